"""Gene-by-gene matrices as packed tiles: products of sparse counts, and joint ranks over all pairs.

A tile holds the pairs of two blocks of genes: ``idx`` (row in block ``ta`` * block + row in
block ``tb``) and ``val``, as arrays of bytes (``squeezed``). Only the pairs ``gene_a > gene_b`` that are
defined are in it; ``diag`` lists the defined genes of a tile on the diagonal. Pairs become
rows at the end only.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import RANGE_ROWS, SAMPLES
from ..schemas import GeneSpan

GENE_BLOCK = 512
CHUNK_CELLS = 4096
#: A chunk holds more cells where they hold a smaller part of the genes than this, up to so many values.
SPARSE, CHUNK_VALUES = 1 / 32, 1 << 20
#: Listing a pair of values of a cell takes as long as this many multiplications of a product of blocks; pairs listed at a time.
PAIR_COST, LISTED_PAIRS = 1000, 4 << 20
#: Tasks per block of genes that make rows of pairs; adaptive execution would see few bytes and put all tiles into a few tasks.
ROW_TASKS = 8
#: Genes of one side that meet a block of genes in a row that becomes pairs by column functions; all pairs of such a row are in memory at once.
TILE_ROWS = 32

Keys = tuple[str, ...]
TILE = "ta int, tb int, idx binary, val binary, diag binary, n_defined long, n_above long"


def blocks(genes: GeneSpan, gene_block: int = GENE_BLOCK) -> tuple[int, int]:
    """Genes per block, and number of blocks; block 0 starts at ordinal 0."""
    block = min(gene_block, genes.first + genes.n)
    return block, (genes.first + genes.n - 1) // block + 1


def fields(df: DataFrame, keys: Keys) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegerType | T.LongType | T.ShortType)


def _batch(schema: list[str], *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema)


# ---------------------------------------------------------------- arrays as bytes

#: Values that are whole multiples of 1 / scale travel as whole numbers: sums of ranks, and correlations of 10 decimals.
SCALES = (1.0, 1e10)
RAW, HEAD = len(SCALES) + 1, struct.Struct("<B?BqI")


def squeezed(a: np.ndarray, ascending: bool = False) -> bytes:
    """An array of whole numbers or of float64, without loss; of one in ascending order the steps are kept.

    Numbers lose their common smallest value and leading zeros, equal places of all bytes are put together and compressed.
    """
    kind, n = 0, a
    if a.dtype == np.float64:
        kind, n = RAW, a.view(np.int64)
        for k, scale in enumerate(SCALES, 1):
            with np.errstate(over="ignore"):
                whole = np.rint(a * scale)
            if (np.abs(whole) < 2.0**53).all() and ((m := whole.astype(np.int64)) / scale).tobytes() == a.tobytes():
                kind, n = k, m
                break
    n = n.astype(np.int64)
    if ascending:
        n = np.diff(n, prepend=np.int64(0))
    low = int(n.min()) if len(n) else 0
    rest = n.view(np.uint64) - np.array([low], np.int64).view(np.uint64)
    width = max(1, (int(rest.max(initial=0)).bit_length() + 7) // 8)
    planes = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return HEAD.pack(kind, ascending, width, low, len(n)) + zstandard.compress(planes.tobytes(), 1)


def spread(data: bytes) -> np.ndarray:
    """The array (int64 or float64) of ``squeezed``."""
    kind, ascending, width, low, size = HEAD.unpack_from(data)
    places = np.zeros((size, 8), np.uint8)
    places[:, :width] = np.frombuffer(zstandard.decompress(data[HEAD.size :]), np.uint8).reshape(width, size).T
    n = (places.view("<u8").ravel() + np.array([low], np.int64).view(np.uint64)).view(np.int64)
    if ascending:
        n = np.cumsum(n)
    return n if kind == 0 else n.view(np.float64) if kind == RAW else n / SCALES[kind - 1]


# ---------------------------------------------------------------- products

def _chunk_products(block: int, n_blocks: int, names: Keys, queries_from: int, chunk_cells: int):
    """All tiles of one chunk of cells. Where cells hold few of the genes, the pairs of each cell are listed and added; else blocks are multiplied."""

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        rows = rows[(rows["gene"] >= 0) & (rows["gene"] < n_blocks * block)]
        gene, value = rows["gene"].to_numpy(np.int64), rows["value"].to_numpy()
        cells, cell = np.unique(rows["cell_id"].to_numpy(), return_inverse=True)
        held, genes = np.bincount(cell, minlength=len(cells)), len(np.unique(gene))
        listed = (held * (held - 1) // 2).sum() * PAIR_COST < len(cells) * genes * genes
        for tiles in (_listed(gene, value, cell, held) if listed else _multiplied(gene, value, cell, len(cells))):
            n = len(tiles["ta"])
            yield pd.DataFrame({**{c: [v] * n for c, v in zip(names, key)}, "ta": tiles["ta"], "tb": tiles["tb"], "lane": [key[-1]] * n, "idx": tiles["idx"], "val": tiles["val"]})

    def _listed(gene: np.ndarray, value: np.ndarray, cell: np.ndarray, held: np.ndarray) -> Iterator[dict]:
        order = np.lexsort((gene, cell))
        gene, value = gene[order], value[order]
        first = np.repeat(np.cumsum(held) - held, held)
        before = np.arange(len(gene)) - first  # a value meets those before it in its cell
        upto = np.cumsum(before)
        edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(LISTED_PAIRS, upto[-1] if len(upto) else 0, LISTED_PAIRS)), len(gene)])
        for lo, hi in zip(edges[:-1], edges[1:]):
            n = before[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            ga, gb = gene[a], gene[b]
            kept = ga > gb
            if queries_from:
                kept &= (ga // block >= queries_from) & (gb // block < queries_from)
            a, b, ga, gb = a[kept], b[kept], ga[kept], gb[kept]
            at = (ga // block * n_blocks + gb // block) * block * block + ga % block * block + gb % block
            order = np.argsort(at, kind="stable")
            at, product = at[order], (value[a] * value[b])[order]
            if len(at):
                start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                at, product = at[start], np.add.reduceat(product, start)
                tile, begin = np.unique(at // (block * block), return_index=True)
                ends = [*begin[1:], len(at)]
                yield {
                    "ta": tile // n_blocks, "tb": tile % n_blocks,
                    "idx": [squeezed(at[i:j] % (block * block), True) for i, j in zip(begin, ends)], "val": [squeezed(product[i:j]) for i, j in zip(begin, ends)],
                }

    def _multiplied(gene: np.ndarray, value: np.ndarray, cell: np.ndarray, n_cells: int) -> Iterator[dict]:
        order = np.argsort(gene, kind="stable")
        gene, value, cell = gene[order], value[order], cell[order]
        edges = np.searchsorted(gene, np.arange(n_blocks + 1) * block)
        starts = range(0, n_cells, chunk_cells)

        def dense(b: int, start: int) -> tuple[np.ndarray, np.ndarray]:
            own = slice(edges[b], edges[b + 1])
            columns, pos = np.unique(gene[own], return_inverse=True)
            x = np.zeros((min(chunk_cells, n_cells - start), len(columns)))
            here = (cell[own] >= start) & (cell[own] < start + chunk_cells)
            np.add.at(x, (cell[own][here] - start, pos[here]), value[own][here])
            return columns - b * block, x

        full = [b for b in range(n_blocks) if edges[b] < edges[b + 1]]
        for ta in full:
            if ta < queries_from:
                continue
            kept = dense(ta, 0) if len(starts) == 1 else None
            for tb in full:
                if tb > ta or queries_from and tb >= queries_from:
                    break
                product = 0.0
                for start in starts:
                    ga, xa = kept or dense(ta, start)
                    gb, xb = (ga, xa) if ta == tb else dense(tb, start)
                    product = product + xa.T @ xb
                i, j = np.nonzero(np.tril(product, -1) if ta == tb else product)
                yield {"ta": [ta], "tb": [tb], "idx": [squeezed((ga[i] * block + gb[j]).astype(np.int64))], "val": [squeezed(product[i, j])]}

    return run


def _added(parts: Iterator[pd.DataFrame], block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sums of all parts of a tile; few entries are added without the whole tile."""
    few: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))]
    total, held = None, 0
    for part in parts:
        for idx, val in zip(part["idx"], part["val"]):
            if idx is None:
                continue
            few.append((spread(idx), spread(val)))
            held += len(few[-1][0])
            if total is not None or held > block * block // 8:
                total = np.zeros(block * block) if total is None else total
                for i, v in few:
                    total[i] += v
                few = []
    if total is not None:
        return (idx := np.flatnonzero(total)), total[idx]
    idx, back = np.unique(np.concatenate([i for i, _ in few]), return_inverse=True)
    return idx, np.bincount(back, np.concatenate([v for _, v in few]), len(idx))


def _whole(parts: Iterator[pd.DataFrame], block: int) -> np.ndarray:
    total = np.zeros((block, block))
    idx, val = _added(parts, block)
    total.ravel()[idx] = val
    return total


def gene_moments(expr: DataFrame, keys: Keys) -> DataFrame:
    v = F.col("value").cast("double")
    return expr.groupBy(*keys, F.col("gene").cast("long").alias("gene")).agg(F.count_if(v > 0).alias("nz"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"))


def defined_genes(expr: DataFrame, meta: DataFrame, keys: Keys, min_cell: int, moments: DataFrame | None = None) -> DataFrame:
    """(keys, gene, n_cells, sx, var): genes with enough positive cells and a variance above rounding; pairs of them are defined."""
    moments = gene_moments(expr, keys) if moments is None else moments
    moments = moments.join(meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")), list(keys))
    variance = F.col("n_cells") * F.col("sxx") - F.col("sx") * F.col("sx")
    ok = (F.col("nz") >= min_cell) & (variance > F.lit(1e-13) * F.col("n_cells") * F.col("sxx"))
    return moments.filter(ok).select(*keys, "gene", "n_cells", "sx", variance.alias("var"))


def _products(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, keys: Keys, min_cell: int, gene_block: int, chunk_cells: int, queries_from: int, defined: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """The tiles (keys, n_cells, ta, tb, and per side the genes, sums and variances ga, sa, va, gb, sb, vb), and their sums of products by lane (keys, ta, tb, idx, val)."""
    block, n_blocks = blocks(genes, gene_block)
    kept = expr.filter(F.col("value") != 0).select(
        *keys, F.col("cell_id").cast("long").alias("cell_id") if integral(expr, "cell_id") else F.xxhash64("cell_id").alias("cell_id"),
        F.col("gene").cast("long").alias("gene"), F.col("value").cast("double").alias("value"),
    )
    sizes = meta.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")), list(keys))
    sparse = F.col("n_values") / min(chunk_cells * genes.n * SPARSE, CHUNK_VALUES)
    chunks = F.ceil(F.least(F.col("n_cells") / chunk_cells, sparse))
    plan = sizes.select(*keys, chunks.cast("int").alias("n_chunks"), F.ceil(F.sqrt(chunks.cast("double"))).cast("int").alias("n_lanes"))
    chunk = F.pmod(F.xxhash64("cell_id"), F.col("n_chunks")).cast("int")
    dealt = kept.join(plan, list(keys)).withColumn("chunk", chunk).withColumn("lane", F.pmod("chunk", "n_lanes")).drop("n_chunks", "n_lanes")
    key_fields = fields(kept, keys)
    made = _chunk_products(block, n_blocks, keys, queries_from, chunk_cells)
    partial = dealt.groupBy(*keys, "chunk", "lane").applyInPandas(made, f"{key_fields}, ta int, tb int, lane int, idx binary, val binary")

    def lane_sum(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, val = _added(parts, block)
        yield pd.DataFrame({**{c: [v] for c, v in zip(keys, key)}, "ta": [key[-3]], "tb": [key[-2]], "idx": [squeezed(idx, True)], "val": [squeezed(val)]})

    lanes = partial.groupBy(*keys, "ta", "tb", "lane").applyInPandas(lane_sum, f"{key_fields}, ta int, tb int, idx binary, val binary")

    defined = defined_genes(kept, meta, keys, min_cell) if defined is None else defined
    packed = defined.groupBy(*keys, "n_cells", F.floor(F.col("gene") / block).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("gene", "sx", "var"))).alias("m"))
    left = packed.select(*keys, "n_cells", F.col("b").alias("ta"), F.col("m").alias("ma"))
    right = packed.select(*keys, F.col("b").alias("tb"), F.col("m").alias("mb"))
    spine = left.join(right, list(keys)).filter(f"tb < {queries_from} AND ta >= {queries_from}" if queries_from else "ta >= tb")
    for side, own in (("a", "ma"), ("b", "mb")):
        spine = spine.withColumns({f"g{side}": F.transform(own, lambda x: x["gene"]), f"s{side}": F.transform(own, lambda x: x["sx"]), f"v{side}": F.transform(own, lambda x: x["var"])})
    return spine.drop("ma", "mb"), lanes


def _correlations(total: np.ndarray, n: float, sa: np.ndarray, sb: np.ndarray, va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """From sums of products of genes (rows) with genes (columns)."""
    val = (n * total - np.multiply.outer(sa, sb)) / np.multiply.outer(np.sqrt(va), np.sqrt(vb))
    return np.floor(val * 1e10 + 0.5) / 1e10


def product_tiles(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, keys: Keys, min_cell: int, raw: bool = False, gene_block: int = GENE_BLOCK, chunk_cells: int = CHUNK_CELLS, queries_from: int = 0, defined: DataFrame | None = None,
) -> DataFrame:
    """Tiles (keys, ``TILE``) of the Pearson correlations, or the sums of products, of the defined genes of each group.

    1. The cells of a group are dealt to chunks by a hash. A chunk's counts go to one task, which
       multiplies them block by block, or lists the pairs of each cell where cells hold few of the
       genes; counts are shuffled once. A chunk has ``chunk_cells`` cells, or more if these hold few values.
    2. The partial tiles of all chunks are added in two levels: about the square root of the chunks
       meet in a lane, then the lanes meet. No task reads all chunks of a large group.
    3. Every tile of two blocks with defined genes has a row, also if no cell has counts in both.

    ``queries_from`` makes it a rectangle: ordinals from that block on are queries, and only the tiles
    of a block of queries (``ta``) with a block of the others (``tb``) are made. ``defined`` takes ``defined_genes`` made before.
    """
    block, _ = blocks(genes, gene_block)
    spine, lanes = _products(expr, meta, genes, keys, min_cell, gene_block, chunk_cells, queries_from, defined)

    def result(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(parts)
        ta, tb, one = key[-2], key[-1], first.iloc[0]
        ga, gb = (np.asarray(one[c], np.int64) - t * block for c, t in (("ga", ta), ("gb", tb)))
        val = _whole((p for some in ([first], parts) for p in some), block)[ga[:, None], gb]
        if not raw:
            val = _correlations(val, float(one["n_cells"]), *(np.asarray(one[c], float) for c in ("sa", "sb", "va", "vb")))
        idx = ga[:, None] * block + gb
        val, idx = (x[np.tril_indices(len(ga), -1)] if ta == tb else x.ravel() for x in (val, idx))
        diag = ga if ta == tb else ga[:0]
        yield pd.DataFrame({
            **{c: [k] for c, k in zip(keys, key)}, "ta": [ta], "tb": [tb], "idx": [squeezed(idx, True)], "val": [squeezed(val)], "diag": [squeezed(diag, True)],
            "n_defined": [len(val)], "n_above": [int((val > 0).sum())],
        })

    met = spine.join(lanes, [*keys, "ta", "tb"], "left")
    return met.groupBy(*keys, "ta", "tb").applyInPandas(result, f"{fields(expr, keys)}, {TILE}")


def product_rows(
    expr: DataFrame, meta: DataFrame, genes: GeneSpan, keys: Keys, min_cell: int, raw: bool = False, gene_block: int = GENE_BLOCK, chunk_cells: int = CHUNK_CELLS, queries_from: int = 0,
) -> DataFrame:
    """Rows (keys, gene_a, gene_b, r) of the pairs of ``product_tiles``; the diagonal is 1. Tiles become rows where they are added up."""
    block, n_blocks = blocks(genes, gene_block)
    spine, lanes = _products(expr, meta, genes, keys, min_cell, gene_block, chunk_cells, queries_from, None)
    sums = lanes.groupBy(*keys, "ta", "tb").agg(F.collect_list(F.struct("idx", "val")).alias("sums"))
    met = spine.join(sums, [*keys, "ta", "tb"], "left").repartition(ROW_TASKS * n_blocks, *keys, "ta", "tb")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for k in range(batch.num_rows):
                ta, tb, n = (at[c][k].as_py() for c in ("ta", "tb", "n_cells"))
                ga, gb, *sides = (at[c][k].values.to_numpy(zero_copy_only=False) for c in ("ga", "gb", "sa", "sb", "va", "vb"))
                total = _whole(iter([pd.DataFrame(at["sums"][k].as_py() or [], columns=["idx", "val"])]), block)
                val = total[(ga - ta * block)[:, None], gb - tb * block]
                if not raw:
                    val = _correlations(val, float(n), *sides)
                ga, gb = ga.astype(np.int32), gb.astype(np.int32)
                if ta == tb:
                    np.fill_diagonal(val, 1.0)
                step = max(1, (1 << 16) // len(gb))
                for i in range(0, len(ga), step):
                    some = ga[i : i + step]
                    a, b, r = np.repeat(some, len(gb)), np.tile(gb, len(some)), val[i : i + step].ravel()
                    if ta == tb:
                        lower = a >= b
                        a, b, r = a[lower], b[lower], r[lower]
                    yield _batch([*keys, "gene_a", "gene_b", "r"], *[pa.repeat(at[c][k], len(r)) for c in keys], a, b, r)

    columns = [*keys, "n_cells", "ta", "tb", "ga", "gb", "sa", "sb", "va", "vb", "sums"]
    return met.select(*columns).mapInArrow(rows, f"{fields(expr, keys)}, gene_a int, gene_b int, r double")


def unpacked(tiles: DataFrame, keys: Keys, block: int, value: str = "r") -> DataFrame:
    """Rows (keys, gene_a, gene_b, value) of the defined pairs; the diagonal is 1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ta, tb, idx, val, diag = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("ta", "tb", "idx", "val", "diag"))
                idx, val, diag = spread(idx), spread(val), spread(diag)
                a, b = np.append(idx // block, diag) + ta * block, np.append(idx % block, diag) + tb * block
                r = np.append(val, np.ones(len(diag)))
                for at in range(0, len(r), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    lead = [pa.repeat(batch.column(c)[k], len(r[some])) for c in range(len(keys))]
                    yield _batch([*keys, "gene_a", "gene_b", value], *lead, a[some].astype(np.int32), b[some].astype(np.int32), r[some])

    return tiles.select(*keys, "ta", "tb", "idx", "val", "diag").mapInArrow(rows, f"{fields(tiles, keys)}, gene_a int, gene_b int, {value} double")


def packed(pairs: DataFrame, keys: Keys, genes: GeneSpan, gene_block: int = GENE_BLOCK, value: str = "r") -> DataFrame:
    """Tiles of a table of pairs ``gene_a >= gene_b``."""
    block, _ = blocks(genes, gene_block)

    def pack(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        ta, tb = key[-2:]
        a, b, v = rows["gene_a"].to_numpy(np.int64) - ta * block, rows["gene_b"].to_numpy(np.int64) - tb * block, rows[value].to_numpy(float)
        same = (a == b) if ta == tb else np.zeros(len(a), bool)
        idx, val, diag = (a * block + b)[~same], v[~same], a[same]
        return pd.DataFrame({
            **{c: [k] for c, k in zip(keys, key)}, "ta": [ta], "tb": [tb], "idx": [squeezed(idx, True)], "val": [squeezed(val)], "diag": [squeezed(diag, True)],
            "n_defined": [len(val)], "n_above": [int((val > 0).sum())],
        })

    at = [F.floor(F.col(g) / block).cast("int").alias(t) for g, t in (("gene_a", "ta"), ("gene_b", "tb"))]
    return pairs.select(*keys, *at, "gene_a", "gene_b", value).groupBy(*keys, "ta", "tb").applyInPandas(pack, f"{fields(pairs, keys)}, {TILE}")


# ---------------------------------------------------------------- ranks over all tiles of a group

def _scrambled(values: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each value; 0.0 and -0.0 are one value."""
    x = (values + 0.0).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _each(names: list[str], read: list[str], kernel):
    """Applies ``kernel(row values) -> lists of output columns`` to every row, with the row's names in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in read]
            for k in range(batch.num_rows):
                out = kernel(*(batch.column(c)[k].as_py() for c in at))
                if out is not None and len(columns := list(out.values())) and len(columns[0]):
                    lead = [pa.repeat(batch.column(batch.schema.get_field_index(c))[k], len(columns[0])) for c in names]
                    yield _batch([*names, *out], *lead, *columns)

    return run


def joint_ranks(tiles: DataFrame, keys: Keys, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(keys, ta, tb, ranks): 1 + number of larger values among all tiles of a group, for the distinct values of each tile in ascending order.

    Each tile gives its distinct values with counts. Split points from a sample by hash (see
    ``ranks.range_splits``) cut the values of a group into ranges; a task ranks one range, in which a
    value takes one entry per tile however many pairs share it, and the pairs of the higher ranges
    are added. No group and no tie meets in one task.
    """
    names, lead = [*keys, "ta", "tb"], fields(tiles, keys)
    rate = np.uint64(max(range_rows // SAMPLES, 1))

    def sample(val: bytes) -> dict:
        u = np.unique(spread(val) + 0.0)
        return {"value": u[_scrambled(u) % rate == 0]}

    drawn = tiles.select(*names, "val").mapInArrow(_each(list(keys), ["val"], sample), f"{lead}, value double")
    splits = drawn.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("s")).filter(F.size("s") >= SAMPLES)
    splits = splits.select(*keys, F.filter("s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("splits"))

    def cut(val: bytes, split: list[float] | None) -> dict:
        u, n = np.unique(spread(val) + 0.0, return_counts=True)
        at = np.searchsorted(np.array(split or [], float), u, "right")
        number, first = np.unique(at, return_index=True)
        pieces = list(zip(first, [*first[1:], len(u)][: len(first)], strict=True))
        return {"range": number.astype(np.int32), "values": [squeezed(u[a:b], True) for a, b in pieces], "counts": [squeezed(n[a:b]) for a, b in pieces], "n": [int(n[a:b].sum()) for a, b in pieces]}

    pieces = tiles.select(*names, "val").join(splits, list(keys), "left")
    pieces = pieces.mapInArrow(_each(names, ["val", "splits"], cut), f"{lead}, ta int, tb int, range int, values binary, counts binary, n long")

    def rank(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = ([spread(b) for b in rows[c]] for c in ("values", "counts"))
        u, back = np.unique(np.concatenate(values), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)
        larger = n.sum() - np.cumsum(n)
        cuts = np.cumsum([len(v) for v in values])[:-1]
        return rows[[*names, "range"]].assign(ranks=[squeezed(r, True) for r in np.split(larger[back] + 1, cuts)])

    ranked = pieces.groupBy(*keys, "range").applyInPandas(rank, f"{lead}, ta int, tb int, range int, ranks binary")
    higher = F.sum("n").over(W.partitionBy(*keys).orderBy(F.col("range").desc())) - F.col("n")
    offsets = pieces.groupBy(*keys, "range").agg(F.sum("n").alias("n")).select(*keys, "range", higher.alias("offset"))
    met = ranked.join(offsets, [*keys, "range"]).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("range", "ranks", "offset"))).alias("r"))

    def glued(r: list[dict]) -> dict:
        return {"ranks": [squeezed(np.concatenate([spread(x["ranks"]) + x["offset"] for x in r]), True)]}

    return met.mapInArrow(_each(names, ["r"], glued), f"{lead}, ta int, tb int, ranks binary")


def rank_of(val: np.ndarray, ranks: bytes | None) -> np.ndarray:
    """The ranks of a tile's values, from those of its distinct values."""
    return spread(ranks)[np.unique(val + 0.0, return_inverse=True)[1]] if len(val) else np.zeros(0, np.int64)


def summed_tiles(tiles: DataFrame, groups: DataFrame, genes: GeneSpan, gene_block: int = GENE_BLOCK) -> DataFrame:
    """Tiles of all pairs (diagonal included) per dataset: ``val`` is the sum of joint ranks, ``c`` the number of types that define the pair.

    ``tiles`` carry ``base``, the rank that undefined pairs of their group share, and ``zeros``, the
    number of these pairs; ``groups`` has ``n_used`` and ``s0``, the sum of ``base``, per dataset. Undefined pairs count as 0 and
    the diagonal as 1, which has rank 1 in every group; both are numbers here and not entries.
    """
    block, n_blocks = blocks(genes, gene_block)
    ranked = tiles.join(joint_ranks(tiles, ("dataset_id", "cell_type")), ["dataset_id", "cell_type", "ta", "tb"], "left")

    def shift(idx: bytes, val: bytes, ranks: bytes, base: int, zeros: int, diag: bytes) -> dict:
        r = spread(val)
        rank = rank_of(r, ranks) + np.where(r < 1, genes.n, 0) + np.where(r < 0, zeros, 0)
        return {"idx": [idx], "diag": [diag], "d": [squeezed(rank - base)]}

    kind = fields(tiles, ("dataset_id",))
    moved = ranked.mapInArrow(_each(["dataset_id", "ta", "tb"], ["idx", "val", "ranks", "base", "zeros", "diag"], shift), f"{kind}, ta int, tb int, idx binary, diag binary, d binary")
    row = F.explode(F.sequence(F.lit(genes.first // block), F.lit(n_blocks - 1)))
    spine = groups.withColumn("ta", row).withColumn("tb", F.explode(F.sequence(F.lit(genes.first // block), F.col("ta"))))

    def add(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ta, tb = key
        total, seen, head = np.zeros(block * block, np.int64), np.zeros(block * block, np.int32), None
        for part in parts:
            head = part.iloc[0] if head is None else head
            for idx, diag, d in zip(part["idx"], part["diag"], part["d"]):
                if idx is not None:
                    idx, diag = spread(idx), spread(diag)
                    total[idx] += spread(d)
                    seen[idx] += 1
                    seen[diag * (block + 1)] += 1
        rows, columns = (np.arange(max(genes.first - t * block, 0), min(genes.first + genes.n - t * block, block)) for t in (ta, tb))
        i, j = (x.ravel() for x in np.meshgrid(rows, columns, indexing="ij"))
        if ta == tb:
            i, j = i[i >= j], j[i >= j]
        idx = i * block + j
        val = np.where((i == j) & (ta == tb), head["n_used"], head["s0"] + total[idx]).astype(float)
        yield pd.DataFrame({"dataset_id": [key[0]], "ta": [ta], "tb": [tb], "idx": [squeezed(idx, True)], "val": [squeezed(val)], "c": [squeezed(seen[idx])]})

    met = spine.join(moved, ["dataset_id", "ta", "tb"], "left")
    return met.groupBy("dataset_id", "ta", "tb").applyInPandas(add, f"{kind}, ta int, tb int, idx binary, val binary, c binary")


def ranked_pairs(tiles: DataFrame, gene_block: int, genes: GeneSpan) -> DataFrame:
    """Rows (dataset_id, gene_a, gene_b, rank, c) of ``summed_tiles``: the joint rank of every pair of a dataset, 1 = largest sum."""
    block, _ = blocks(genes, gene_block)
    ranked = tiles.join(joint_ranks(tiles, ("dataset_id",)), ["dataset_id", "ta", "tb"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = at or {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                ta, tb, idx, c, val, ranks = (batch.column(at[n])[k].as_py() for n in ("ta", "tb", "idx", "c", "val", "ranks"))
                idx, c, rank = spread(idx).astype(np.int32), spread(c).astype(np.int32), rank_of(spread(val), ranks)
                for a in range(0, len(idx), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    lead = pa.repeat(batch.column(at["dataset_id"])[k], len(idx[s]))
                    yield _batch(["dataset_id", "gene_a", "gene_b", "rank", "c"], lead, idx[s] // block + ta * block, idx[s] % block + tb * block, rank[s], c[s])

    return ranked.mapInArrow(rows, f"{fields(tiles, ('dataset_id',))}, gene_a int, gene_b int, rank long, c int")
