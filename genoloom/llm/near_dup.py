"""Near-duplicate detection: weighted MinHash by hashed darts, banded joining, exact similarity."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import written
from .common import table, unused
from .components import components
from .shingles import MULTIPLIER, WordHashes, hashed, mix, shingle_hashes, unit_cells, words_of


def dart_signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k coordinates for each set of cells; two sets agree in a coordinate with the probability of their similarity.

    A cell is a unit of an element's weight. Its region, one unit wide and without end in rank, is
    cut into slabs of height 1; hashing (cell, slab, number) throws the darts of a Poisson process of
    rate 1 into each. A dart falls to a random coordinate, and each coordinate keeps the dart of the
    least rank. About k (ln k + 4) darts are needed whatever the size of the set, so only ranks up
    to a height that fits the set's weight are thrown; more slabs follow while a coordinate is empty.
    Sets must not be empty; several of them share the array operations.
    """
    out, todo = np.zeros((len(sets), k), np.uint64), np.arange(len(sets))
    height = k * (math.log(k) + 4) / np.array([len(c) for c in sets])
    while len(todo):
        sizes, slabs = np.array([len(sets[i]) for i in todo]), np.maximum(1, np.ceil(height[todo])).astype(np.int64)
        own = np.repeat(np.arange(len(todo)), sizes * slabs)
        slab = np.concatenate([np.repeat(np.arange(s), n) for s, n in zip(slabs, sizes, strict=True)])
        cells = np.concatenate([np.tile(sets[i], s) for i, s in zip(todo, slabs, strict=True)])
        with np.errstate(over="ignore"):
            seed = mix(cells + (slab + 1).astype(np.uint64) * MULTIPLIER)
            rank, end = slab.astype(float), np.minimum(slab + 1.0, height[todo][own])
            ranks, ids, owners = [], [], []
            while len(seed):
                seed = mix(seed)
                rank = rank - np.log((seed >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
                hit = rank < end
                seed, rank, end, own = seed[hit], rank[hit], end[hit], own[hit]
                ranks.append(rank)
                ids.append(seed)
                owners.append(own)
            dart, at = np.concatenate(ids), np.concatenate(ranks)
            place = np.concatenate(owners) * k + (mix(dart ^ MULTIPLIER) % np.uint64(k)).astype(np.int64)
        least = np.full(len(todo) * k, np.inf)
        np.minimum.at(least, place, at)
        first = at == least[place]
        kept = np.zeros(len(todo) * k, np.uint64)
        kept[place[first]] = dart[first]
        out[todo] = kept.reshape(-1, k)
        todo = todo[~np.isfinite(least).reshape(-1, k).all(axis=1)]
        height[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A hash per set and band."""
    rows = signatures.reshape(len(signatures), bands, -1)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2])
        for j in range(rows.shape[2]):
            out = mix(out ^ rows[:, :, j])
    return out.view(np.int64)


def _text_key(words: list[str]) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), np.int64)
    return int(both[0]), int(both[1])


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, size: int) -> DataFrame:
    """Per row: its id, a mark of its text, a 128-bit key of its words, its band hashes (none without words)."""
    kind = docs.schema[id_col].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keys, cells = [], []
            out, waiting, held = [np.empty(0, np.int64)] * batch.num_rows, [], 0
            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                keys.append(_text_key(words))
                if words:
                    cells.append(unit_cells(shingle_hashes(hashed(words, known), size)))
                    waiting.append(i)
                    held += len(cells[-1])
                if waiting and (i == batch.num_rows - 1 or len(waiting) == 64 or held > 200_000):
                    for j, hashes in zip(waiting, band_hashes(dart_signatures(cells, bands * rows), bands), strict=True):
                        out[j] = hashes
                    cells, waiting, held = [], [], 0
            lengths = np.cumsum([0, *map(len, out)])
            listed = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64()))
            k1, k2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), k1, k2, listed], ["doc", "mark", "k1", "k2", "bands"])

    rows_in = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows_in.mapInArrow(sign, f"doc {kind.simpleString()}, mark long, k1 long, k2 long, bands array<long>")


def _cells(rows: DataFrame, size: int) -> DataFrame:
    """(node, cells) of the columns ``node`` and ``text``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            step = 64  # cells of 64 texts at a time
            for at in range(0, batch.num_rows, step):
                out = [unit_cells(shingle_hashes(hashed(words_of(text.as_py()), known), size)).view(np.int64) for text in batch.column(1)[at : at + step]]
                lengths = np.cumsum([0, *map(len, out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(out), pa.int64()))], ["node", "cells"])

    return rows.select("node", "text").mapInArrow(cut, "node long, cells array<long>")


def _similar(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (u, v) whose cells overlap enough."""
    side = lambda n: cells.select(F.col("node").alias(n), F.col("cells").alias(f"cells_{n}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u")
    common = F.size(F.array_intersect("cells_u", "cells_v"))
    return both.filter(common >= threshold * (F.size("cells_u") + F.size("cells_v") - common)).select("u", "v")


def _spanning(part: pd.DataFrame, threshold: float, step: int = 8192) -> list[tuple[int, int]]:
    """Links between the components of some texts: enough to join all that similarity joins, at most one less than texts."""
    roots, cells = part["root"].tolist(), part["cells"].tolist()
    values, which, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    sizes = np.array([len(c) for c in cells])
    owner, shared = np.repeat(np.arange(len(cells)), sizes), n[which] > 1
    owner, which = owner[shared], np.unique(which[shared], return_inverse=True)[1]
    common = np.zeros((len(cells), len(cells)), np.float32)
    for low in range(0, int(which.max()) + 1 if len(which) else 0, step):
        some = (which >= low) & (which < low + step)
        has = np.zeros((len(cells), step), np.float32)
        has[owner[some], which[some] - low] = 1
        common += has @ has.T
    group = {r: r for r in roots}

    def top(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(common >= threshold * (sizes[:, None] + sizes[None, :] - common), 1)), strict=True):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            group[a] = b
            out.append((i, j))
    return out


def _links_within(members: DataFrame, cells: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """Links (u, v) between components whose texts meet in a bucket (band, value, node, root, n).

    A bucket of n texts is cut into n / block blocks by a hash; each two blocks meet in a task of
    their own, which compares all their texts exactly and returns spanning links only.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    placed = members.withColumn("blocks", blocks).withColumn("own", own.cast("int")).join(cells, "node")
    placed = placed.select("band", "value", "root", "node", "cells", F.explode(pairs).alias("pair"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        node = part["node"].to_numpy()
        found = np.array(_spanning(part, threshold), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": node[found[:, 0]], "v": node[found[:, 1]]})

    links = placed.withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair").groupBy("band", "value", "i", "j").applyInPandas(compare, "u long, v long")
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 30, rows: int = 6, size: int = 5) -> DataFrame:
    """(id, mark, class_id, keep) per row of ``docs``: its class, and whether it is the row of its class that stays.

    Texts are linked if the weighted Jaccard similarity of their shingles (``size`` lower-cased words,
    weight: number of occurrences) is at least ``threshold``; a class is a connected component, its id
    the smallest document id in it. Candidates agree in one of ``bands`` bands of ``rows``
    coordinates: at similarity 0.8 one in 10,000 pairs has no such band.

    1. Texts with the same words are one text from here on, by a 128-bit key of the words.
    2. In every bucket of a band all members are compared with the smallest; groups of thousands of
       near copies so cost a pair per member, not all pairs.
    3. Buckets whose members are still in different components are compared in full, in blocks inside
       tasks that return spanning links only: no link between components is missed, links within a
       component change nothing, and pairs never become rows.

    Cases: a text of fewer than ``size`` words is one shingle; texts without words (null included)
    are equal to each other and to nothing else. Repeated rows, and rows with a repeated id, are
    classed by their texts; ``keep`` holds for all repeats of one (id, text), ``mark`` is the text's
    hash. Null ids are last in order; a class of null ids only has the class_id null. Other columns
    are ignored. An empty table gives an empty table.
    """
    signed = written(signatures(docs, id_col, text_col, bands, rows, size), "signatures")
    who = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "mark")
    distinct = signed.groupBy("k1", "k2").agg(F.min(who).alias("who"), F.first("bands").alias("bands"))
    # a number per text, fixed by the written table: short keys from here on
    texts = written(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")

    buckets = texts.select("node", F.posexplode("bands").alias("band", "value"))
    leaders = buckets.groupBy("band", "value").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = written(buckets.join(leaders, ["band", "value"]), "members")
    pairs = written(members.filter("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), "pairs")

    # the rows to cut again: one document of each text that has a partner
    partners = members.select("node").distinct()
    wanted = texts.join(partners, "node", "left_semi").select("node", F.col("who.doc").alias("_doc"), F.col("who.mark").alias("_mark"))
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    again = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), text.cast("string").alias("text"))
    hit = again.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    cells = written(_cells(hit.select("node", "text"), size).dropDuplicates(["node"]), "cells")

    links = written(_similar(pairs, cells, threshold), "similar")
    parts = components(links)
    placed = members.join(parts, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high").select("band", "value", "n")
    more = written(_links_within(placed.join(mixed, ["band", "value"]), cells, threshold), "similar")
    if not more.isEmpty():
        parts = components(links.union(more))

    classed = texts.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classed.groupBy("root").agg(F.min("who").alias("first"))
    named = classed.select("root", "k1", "k2").join(least, "root").select("k1", "k2", "first")
    out = signed.select("doc", "mark", "k1", "k2").join(named, ["k1", "k2"])
    return out.select(F.col("doc").alias(id_col), "mark", F.col("first.doc").alias("class_id"), (F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("mark") == F.col("first.mark"))).alias("keep"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, and one row of it where it is repeated."""
    found = near_duplicates(docs, id_col, text_col, **options).filter("keep")
    own, mark = unused(docs, "_nd_id"), unused(docs, "_nd_mark")
    found = found.select(F.col(f"`{id_col}`").alias(own), F.col("mark").alias(mark)).distinct()
    rows = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(mark)))
    return rows.dropDuplicates([own, mark]).drop(own, mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "keep")
