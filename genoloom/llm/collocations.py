"""Phrase collocations by relational mining: sorted occurrence relations, merge-joins, group counts, semi-joins."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import written
from .common import table
from .shingles import mix

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ["name_id", "name_f", "name_word", "name_left", "name_right"]


def _packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Non-negative integers as compressed byte planes; gaps, codes and counts take one to three bytes each."""
    width = np.dtype(kind).itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked(packed: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def _listed(values, kind=None) -> pa.Array:
    """A list column of one row."""
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def occurrences(docs: DataFrame, text_col: str, lang: Column, chunk_words: int) -> DataFrame:
    """Relation 1 (chunk, lang, gaps, codes, ids, n, words): the occurrences of words, sorted by piece and position.

    A row holds the texts of one language met by one task, about ``chunk_words`` words of them (a
    longer text alone). An occurrence is the distance ``gaps`` from the one before, a place being left
    free between pieces, and the number ``codes`` of its word; ``ids`` (64-bit hashes of language and
    word), ``n`` (occurrences) and ``words`` are listed once per chunk. Lists are packed bytes.
    """

    def flush(key: str, held: dict[str, int], codes: list[np.ndarray], number: int) -> pa.RecordBatch:
        flat = np.concatenate(codes)
        at = np.flatnonzero(flat)
        own = xxhash.xxh64_intdigest(key.encode())
        ids = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), own) for w in held), np.uint64, len(held)).view(np.int64)
        counts = np.bincount(flat[at] - 1, minlength=len(held))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in ([number], [key], [len(at)], [_packed(np.diff(at, prepend=0))], [_packed(flat[at] - 1)], [ids.tobytes()], [_packed(counts)], [zstandard.compress("\n".join(held).encode("utf-8", "surrogatepass"), 1)])],
            ["chunk", "lang", "n_words", "gaps", "codes", "ids", "n", "words"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[str, tuple[dict[str, int], list[np.ndarray]]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, codes = open_.setdefault(key, ({}, []))
                new: list[int] = []
                for piece in PIECE.split((text.as_py() or "").translate(LOWER)):
                    if found := WORD.findall(piece):
                        new += [held.setdefault(w, len(held) + 1) for w in found]
                        new.append(0)
                if new:
                    codes.append(np.array(new, np.int32))
                    size[key] = size.get(key, 0) + len(new)
                if size.get(key, 0) >= chunk_words:
                    yield flush(key, held, codes, number)
                    number += 1
                    del open_[key], size[key]
        for key, (held, codes) in open_.items():
            if codes:
                yield flush(key, held, codes, number)
                number += 1

    rows = docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(read, "chunk long, lang string, n_words long, gaps binary, codes binary, ids binary, n binary, words binary")


def _dealt(first: bool, buckets: int, *lists: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a chunk as they travel: their order by bucket and key, and the keys and buckets in that order.

    The key of a word is its hash; that of a longer phrase are the numbers of the parts without the last and without the first word.
    """
    if first:
        key = np.frombuffer(lists[0], np.uint64)
    else:
        numbers = _unpacked(lists[0]).astype(np.uint64)
        key = numbers[_unpacked(lists[1])] << np.uint64(32) | numbers[_unpacked(lists[2])]
    bucket = ((key if first else mix(key)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.lexsort((key, bucket))
    return order, key[order], bucket[order].astype(np.int64)


def _counted(relation: DataFrame, min_count: int, first: bool, buckets: int) -> DataFrame:
    """Group count: (chunk, bucket, at, number, own, f) of the phrases of a chunk that occur ``min_count`` times in all chunks.

    A chunk sends each of its phrases once, with its count, to the bucket of the phrase's key, packed in
    one row per chunk and bucket. Back go the places ``at`` of the frequent ones in that row and their numbers: a bucket
    numbers its frequent phrases in the order of their keys, so a phrase is exactly its number and bucket. The lowest chunk with a phrase
    owns it (``own``), which names every phrase once; ``f`` are the counts of the owned phrases over all chunks.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, *lists = (c[i].as_py() for c in batch.columns[1:])
                order, key, bucket = _dealt(first, buckets, *lists)
                n, high, low = _unpacked(n)[order], (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
                number, begins = np.unique(bucket, return_index=True)
                cuts = [slice(a, b) for a, b in zip(begins, np.append(begins[1:], len(order))[: len(begins)], strict=True)]
                packed = [[_packed(np.diff(high[c], prepend=0)) for c in cuts], [_packed(low[c]) for c in cuts], [_packed(n[c]) for c in cuts]]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.repeat(batch.column(0)[i], len(number)), *[pa.array(x, pa.binary()) for x in packed]], ["bucket", "chunk", "high", "low", "n"])

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        bucket, parts = rows.column("bucket")[0].as_py(), []
        for high, low in zip(rows.column("high").to_pylist(), rows.column("low").to_pylist(), strict=True):
            parts.append(np.cumsum(_unpacked(high)).astype(np.uint64) << np.uint64(32) | _unpacked(low).astype(np.uint64))
        values, lowest, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate([_unpacked(b) for b in rows.column("n").to_pylist()]), len(values)).astype(np.int64)
        stays, own, number = (total >= min_count)[back], np.zeros(len(back), bool), np.cumsum(total >= min_count) - 1
        own[lowest] = True
        if len(number) and (int(number[-1]) + 1) * buckets >= 1 << 32:
            raise ValueError("over four billion frequent phrases of one length do not fit their numbers")
        out, at = {"chunk": [], "at": [], "number": [], "own": [], "f": []}, 0
        for chunk, part in zip(rows.column("chunk").to_pylist(), parts, strict=True):
            here = slice(at, at + len(part))
            keep = np.flatnonzero(stays[here])
            at += len(part)
            if len(keep):
                code, mine = back[here][keep], own[here][keep]
                found = _packed(np.diff(keep, prepend=0)), _packed(np.diff(number[code], prepend=0)), np.packbits(mine).tobytes(), _packed(total[code[mine]], "<u8")
                for name, value in zip(out, (chunk, *found), strict=True):
                    out[name].append(value)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "bucket": pa.array([bucket] * len(out["chunk"]), pa.int64()), **{c: pa.array(out[c], pa.binary()) for c in ("at", "number", "own", "f")}})

    lists = ["ids"] if first else ["parts", "left", "right"]
    pieces = relation.select("chunk", "n", *lists).mapInArrow(deal, "bucket long, chunk long, high binary, low binary, n binary")
    return pieces.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, at binary, number binary, own binary, f binary")


def _extended(relation: DataFrame, frequent: DataFrame, k: int, buckets: int, max_words: int) -> DataFrame:
    """Semi-join and merge-join: the relation of phrases one word longer, and the names of the frequent phrases of ``k`` words.

    Occurrences of phrases that are not frequent go; those at adjacent positions are joined. A row
    (chunk, gaps, codes, parts, left, right, n) is the new relation of a chunk: a phrase is the
    places of its two parts in the list ``parts`` of numbers. The list ``names`` (id, f, word or left and
    right) are the frequent phrases of ``relation`` that the chunk owns; an id is made of the number and the length.
    """
    first = k == 1
    answers = frequent.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "at", "number", "own", "f")).alias("wanted"))
    lists = ["ids", "words"] if first else ["parts", "left", "right"]
    rows = relation.select("chunk", "gaps", "codes", *lists).join(answers, "chunk").select("chunk", "wanted", "gaps", "codes", *lists)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                answer, gaps, codes, *lists = (c[i].as_py() for c in batch.columns[1:])
                order, _, bucket = _dealt(first, buckets, *lists)
                stays, own, number, f = np.zeros(len(order), bool), np.zeros(len(order), bool), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                for x in answer:
                    place = order[np.searchsorted(bucket, x["bucket"]) + np.cumsum(_unpacked(x["at"]))]
                    mine = place[np.unpackbits(np.frombuffer(x["own"], np.uint8), count=len(place)).astype(bool)]
                    stays[place], own[mine], f[mine] = True, True, _unpacked(x["f"], "<u8")
                    number[place] = np.cumsum(_unpacked(x["number"])) * buckets + x["bucket"]
                names = np.flatnonzero(own)
                if first:
                    words = zstandard.decompress(lists[1]).decode("utf-8", "surrogatepass").split("\n")
                    called = {"word": [words[x] for x in names], "left": [0] * len(names), "right": [0] * len(names)}
                else:
                    parts = _unpacked(lists[0]) * max_words + (k - 2)
                    called = {"word": [None] * len(names), "left": parts[_unpacked(lists[1])[names]], "right": parts[_unpacked(lists[2])[names]]}
                codes = _unpacked(codes)
                keep = stays[codes]
                at, codes = np.cumsum(_unpacked(gaps))[keep], (np.cumsum(stays) - 1)[codes[keep]]
                begin = np.flatnonzero(np.diff(at) == 1)
                pairs, code, n = np.unique(codes[begin] << 32 | codes[begin + 1], return_inverse=True, return_counts=True)
                left, right = pairs >> 32, pairs & 0xFFFFFFFF
                blobs = [_packed(x) for x in (np.diff(at[begin], prepend=0), code, number[stays], left, right, n)]
                listed = [_listed(number[names] * max_words + (k - 1)), _listed(f[names]), _listed(called["word"], pa.string()), _listed(called["left"], pa.int64()), _listed(called["right"], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([b]) for b in blobs], *listed], ["chunk", "gaps", "codes", "parts", "left", "right", "n", *NAMES])

    schema = "chunk long, gaps binary, codes binary, parts binary, left binary, right binary, n binary, name_id array<long>, name_f array<long>, name_word array<string>, name_left array<long>, name_right array<long>"
    return rows.mapInArrow(join, schema)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4, min_count: int = 30, chunk_words: int = 1 << 19) -> tuple[DataFrame, list[DataFrame]]:
    """The number of words per language, and per length the phrases (lang, id, left, right, phrase, last, f) that occur ``min_count`` times.

    1. Relation 1 is written: the occurrences of words in order of piece and position, packed per chunk.
    2. The groups of a relation are counted over all chunks; a phrase travels once per chunk, however
       often it occurs.
    3. The relation keeps the occurrences of frequent phrases, those at adjacent positions are merged
       to phrases one word longer, and these are written as the next relation.

    ``left`` and ``right`` are the ids of the phrase without its last and without its first word.
    """
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    relation = written(occurrences(docs, text_col, lang, chunk_words), "occurrences-1")
    totals = relation.groupBy("lang").agg(F.sum("n_words").alias("n"))
    chunks, levels, none = relation.select("chunk", "lang"), [], F.lit(None).cast("long")
    buckets = int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in range(1, max_words + 1):
        relation = written(_extended(relation, _counted(relation, min_count, k == 1, buckets), k, buckets, max_words), f"occurrences-{k + 1}")
        found = relation.select("chunk", F.explode(F.arrays_zip(*[F.col(c) for c in NAMES])).alias("p")).select("chunk", *[F.col(f"p.{c}").alias(c.removeprefix("name_")) for c in NAMES])
        if k == 1:
            levels.append(found.join(chunks, "chunk").select("lang", "id", none.alias("left"), none.alias("right"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f"))
            continue
        shorter = levels[-1]
        found = found.join(shorter.select(F.col("id").alias("left"), "lang", "phrase"), "left").join(shorter.select(F.col("id").alias("right"), "last"), "right")
        levels.append(written(found.select("lang", "id", "left", "right", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"), f"phrases-{k}"))
    return totals, levels


def _cuts(levels: list[DataFrame]) -> DataFrame:
    """(id, words, k, l, r): every cut of every phrase of two words and more, with the counts of both parts."""
    # chains[k] holds each phrase of k words with the ids of its first 1 .. k-1 and its last 1 .. k-1 words
    chains, out = {1: levels[0].select("id", "f")}, None
    for k in range(2, len(levels) + 1):
        own = levels[k - 1].select("id", "f", "left", "right")
        heads = chains[k - 1].select(F.col("id").alias("left"), *[F.col(f"h{j}") for j in range(1, k - 1)], F.col("f").alias(f"f{k - 1}"), *[F.col(f"f{j}") for j in range(1, k - 1)])
        tails = chains[k - 1].select(F.col("id").alias("right"), *[F.col(f"t{j}") for j in range(1, k - 1)], F.col("f").alias(f"g{k - 1}"), *[F.col(f"g{j}") for j in range(1, k - 1)])
        chain = own.join(heads, "left").join(tails, "right").withColumns({f"h{k - 1}": F.col("left"), f"t{k - 1}": F.col("right")}).drop("left", "right")
        chains[k] = chain
        cuts = F.explode(F.array(*[F.struct(F.lit(j).alias("k"), F.col(f"f{j}").alias("l"), F.col(f"g{k - j}").alias("r")) for j in range(1, k)]))
        part = chain.select("id", F.col("f").alias("a"), cuts.alias("c")).select("id", "a", "c.k", "c.l", "c.r")
        out = part if out is None else out.unionAll(part)
    return out


def _covers(levels: list[DataFrame]) -> DataFrame:
    """(id, longer): the most frequent phrase that holds a phrase of two words or more, one row per phrase."""
    out, inside = None, None
    for k in range(3, len(levels) + 1):
        own = levels[k - 1].select(F.col("id").alias("whole"), F.col("f").alias("longer"), "left", "right")
        near = own.select("whole", "longer", F.explode(F.array("left", "right")).alias("id"))
        if inside is None:
            inside = near
        else:  # what the two parts hold is held too
            held = inside.select(F.col("whole").alias("part"), F.col("id").alias("deep"))
            inside = near.unionAll(near.join(held, near["id"] == held["part"]).select("whole", "longer", F.col("deep").alias("id")))
        out = inside if out is None else out.unionAll(inside)
    return out.groupBy("id").agg(F.max("longer").alias("longer"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 4, min_count: int = 30, scale: int = 2_000_000, covered: int = 80, top: int = 2000, chunk_words: int = 1 << 19,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``max_words`` (at least 3) words per language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends (\\n, \\v, \\f, \\r) into pieces and at
    spaces and tabs into words. Candidates are phrases that occur ``min_count`` times (a), overlaps
    included, inside pieces. Of the cuts of a candidate into two parts with counts l and r the one with the
    lowest score floor(scale * a / (l + r)) counts, at ties the earliest. A candidate inside a longer
    one with 100 * f(longer) >= ``covered`` * a goes. Ranks are by score, a (both falling) and phrase.

    Words are told apart by 64-bit hashes of language and word: among a billion different words of a corpus two
    meet with a chance of 3 %. Longer phrases are told apart exactly, by the numbers of their parts.

    Cases: null and empty texts have no words; a null language is ``und``, also for the words of texts that
    say so; repeated rows count each; ids do not matter; very long texts are a chunk of their own; other columns are
    ignored, whatever their names. An empty table, or one without frequent phrases, gives an empty table.
    """
    totals, levels = frequent_phrases(docs, text_col, lang_col, max_words, min_count, chunk_words)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = _cuts(levels).withColumns({"l_": wide("l"), "r_": wide("r"), "a_": F.lit(scale).cast("decimal(18,0)") * F.col("a").cast("decimal(20,0)")})
    cuts = cuts.withColumn("score", F.expr("cast(a_ div (l_ + r_) as bigint)"))
    best = cuts.groupBy("id").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("id", "b.*")
    kept = best.join(_covers(levels), "id", "left").filter(F.expr(f"longer IS NULL OR 100 * cast(longer AS decimal(20,0)) < {covered} * cast(a AS decimal(20,0))"))
    names = levels[1].select("id", "lang", "phrase")
    for level in levels[2:]:
        names = names.unionAll(level.select("id", "lang", "phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = kept.join(names, "id").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k.k, unnest(list_transform(range(1, len(ws) - k.k + 2), lambda i: array_to_string(ws[i:i + k.k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) k(k) WHERE len(ws) >= k.k),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.phrase, c.k, a, ws, unnest(range(1, c.k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.k, a, cut, p1.f AS l, p2.f AS r, (2000000 * a) // (p1.f + p2.f) AS score
      FROM x JOIN f p1 ON p1.lang = x.lang AND p1.phrase = array_to_string(ws[1:cut], ' ') AND p1.k = cut
      JOIN f p2 ON p2.lang = x.lang AND p2.phrase = array_to_string(ws[cut + 1:], ' ') AND p2.k = x.k - cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a AS longer, unnest(list_transform(list_filter(list_transform(range(0, 12), lambda j: [j // 4 + 1, j % 4 + 2]), lambda e: e[2] < k AND e[1] + e[2] - 1 <= k), lambda e: array_to_string(ws[e[1]:e[1] + e[2] - 1], ' '))) AS phrase FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
