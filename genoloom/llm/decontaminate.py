"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle similarity."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import written
from .common import table, unused
from .shingles import mix, shingle_hashes

#: Fingerprints are four words of 64 bits, which are the blocks of the index.
BITS, BLOCKS = 256, 4
MATCH = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,distance:int,similarity:double>>"
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))


class PlainWords(dict):
    """raw word -> 64-bit hash of the word without punctuation at its ends; 0 if nothing is left."""

    BOUND = 300_000

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        a, b = 0, len(raw)
        while a < b and not raw[a].isalnum():
            a += 1
        while a < b and not raw[b - 1].isalnum():
            b -= 1
        value = self[raw] = (xxhash.xxh64_intdigest(raw[a:b].encode("utf-8", "surrogatepass")) or 1) if a < b else 0
        return value


def plain_hashes(text: str | None, known: PlainWords) -> np.ndarray:
    raw = text.lower().split() if text else []
    out = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
    return out[out != 0] if len(out) and not out.all() else out


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of a 256-bit hash of each shingle."""
    words = np.stack([mix(shingles ^ np.uint64(k * 0x5DEECE66D)) for k in range(BLOCKS)], axis=1)
    return np.unpackbits(words.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash (four 64-bit words) of the windows of ``width`` shingles that begin at ``starts``; every occurrence has weight 1."""
    low, high = int(starts.min()), int(starts.max()) + width
    total = np.zeros((high - low + 1, BITS), np.int32)
    np.cumsum(signs(shingles[low:high]), axis=0, dtype=np.int32, out=total[1:])
    return np.packbits(total[starts - low + width] - total[starts - low] > 0, axis=1).view(np.uint64)


def near(prints: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(print, item, distance) of all pairs within ``radius`` bits.

    If two fingerprints differ in at most ``radius`` bits, one of their four blocks differs in at most
    ``radius // 4``; a random pair does so in one of 150 cases. Only pairs found by a block get
    their full distance.
    """
    found = np.zeros((len(prints), len(items)), bool)
    for block in range(BLOCKS):
        found |= np.bitwise_count(prints[:, None, block] ^ items[None, :, block]) <= radius // BLOCKS
    window, item = np.nonzero(found)
    distance = np.bitwise_count(prints[window] ^ items[item]).sum(1, dtype=np.int64)
    close = distance <= radius
    return window[close], item[close], distance[close]


@dataclass
class SizeClass:
    """The items of one length in words."""

    words: int
    shingle: int
    ids: list
    shingles: list[np.ndarray]
    counts: list[Counter]
    prints: np.ndarray
    known: np.ndarray  # sorted: the rarest shingles of each item, one of which a similar window must hold


def rarest(shingles: list[np.ndarray], threshold: float) -> np.ndarray:
    """Of n shingles of an item, the n - t + 1 that the fewest items have, t being the number a similar window shares with it.

    A window without any of them shares t - 1 at most. Phrases that many items have are so looked up
    for hardly any item.
    """
    values, n_items = np.unique(np.concatenate([np.unique(s) for s in shingles]), return_counts=True)
    out = []
    for own in shingles:
        often = n_items[np.searchsorted(values, own)]
        least = max(1, int(np.ceil(threshold * len(own) - 1e-9)))
        out.append(own[np.lexsort((own, often))][: len(own) - least + 1])
    return np.unique(np.concatenate(out))


def size_classes(items: list[tuple[int | None, str | None]], threshold: float, size: int) -> list[SizeClass]:
    known, by_words = PlainWords(), {}
    for item_id, text in items:
        words = plain_hashes(text, known)
        if len(words):
            by_words.setdefault(len(words), []).append((item_id, words))
    out = []
    for n, found in sorted(by_words.items()):
        shingles = [shingle_hashes(words, size) for _, words in found]
        prints = np.concatenate([fingerprints(s, np.array([0]), len(s)) for s in shingles])
        out.append(SizeClass(n, min(size, n), [i for i, _ in found], shingles, [Counter(s.tolist()) for s in shingles], prints, rarest(shingles, threshold)))
    return out


@dataclass
class Index:
    """The size classes, and the shingles of all classes of one shingle size together."""

    classes: dict[int, list[SizeClass]]
    known: dict[int, np.ndarray]

    @classmethod
    def of(cls, classes: list[SizeClass]) -> Index:
        by = {}
        for c in classes:
            by.setdefault(c.shingle, []).append(c)
        return cls(by, {size: np.unique(np.concatenate([c.known for c in some])) for size, some in by.items()})


def held(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values that the sorted array has."""
    at = np.searchsorted(sorted_values, values)
    return np.flatnonzero(sorted_values[np.minimum(at, len(sorted_values) - 1)] == values)


def matches(words: np.ndarray, index: Index, radius: int, threshold: float, step: int = 2048) -> list[dict]:
    """The best window of a text for each item that it holds; of equal ones the first.

    Every window that holds one of the rarest shingles of an item of its size gets a fingerprint; no
    other can be similar. The index by blocks finds all pairs within ``radius`` bits, then the exact
    similarity decides.
    """
    best, todo = {}, []
    for size, known in index.known.items():
        if len(words) >= size:
            own = shingle_hashes(words, size)
            if len(any_hits := held(known, own)):
                todo += [(c, own, hits) for c in index.classes[size] if len(hits := any_hits[held(c.known, own[any_hits])])]
    for c, own, hits in todo:
        width = min(c.words - c.shingle + 1, len(own))
        last = len(own) - width
        edge = np.zeros(last + 2, np.int64)  # windows that hold a hit: from hit - width + 1 to hit
        np.add.at(edge, np.clip(hits - width + 1, 0, last), 1)
        np.add.at(edge, np.minimum(hits, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for i in range(0, len(starts), step):
            some = starts[i : i + step]
            for w, item, distance in zip(*(x.tolist() for x in near(fingerprints(own, some, width), c.prints, radius)), strict=True):
                start = int(some[w])
                shared = sum((Counter(own[start : start + width].tolist()) & c.counts[item]).values())
                similarity = shared / max(width, len(c.shingles[item]))
                key = (c.words, item)
                if similarity >= threshold and (key not in best or similarity > best[key]["similarity"]):
                    best[key] = {"item_id": c.ids[item], "first_word": start, "n_words": min(c.words, len(words)), "distance": distance, "similarity": similarity}
    return sorted(best.values(), key=lambda m: (m["item_id"] is None, m["item_id"] or 0, m["first_word"]))


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = 0.8, radius: int = 83, size: int = 5, block_items: int = 20_000, matches_as: str = "matches",
) -> DataFrame:
    """``docs`` with an array of the benchmark items each text holds.

    Words are lower-cased, without punctuation at their ends. A window has as many words as the item;
    similarity is the weight of common shingles (``size`` words, weighted by occurrences) over the
    larger total weight. ``radius`` of 256 bits: at similarity 0.8 the expected distance is 53 with a
    deviation of 6.4. The benchmark is taken in blocks of about ``block_items`` items, each block
    broadcast to one pass over the documents; between passes the documents are written, and the block is
    freed. No document is shuffled, whatever its length or source.

    Cases: null and empty texts hold nothing; null and empty items are ignored, an item of fewer
    than ``size`` words is one shingle; a text shorter than an item is one window. Repeated items are
    reported once per item id. Rows and other columns of ``docs`` pass unchanged; a column of the
    name ``matches_as`` is replaced. Empty tables give no matches. Item ids are integers.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("t IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // block_items))
    docs = docs.drop(matches_as).withColumn(matches_as, F.array().cast(MATCH))
    schema, column = docs.schema, docs.columns.index(text_col)
    for block in range(blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(size_classes(rows, threshold, size)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = PlainWords()
            for batch in batches:
                found = [before + matches(plain_hashes(text.as_py(), known), shared.value, radius, threshold) for text, before in zip(batch.column(column), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, MATCH_ARROW)], names=batch.schema.names)

        docs = docs.mapInArrow(scan, schema)
        if block < blocks - 1:
            docs = written(docs, "decontaminate")
            shared.unpersist()
    return docs


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    found = unused(docs, "_matches")
    return find_benchmark(docs, benchmark, matches_as=found, **options).filter(F.size(found) == 0).drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_distinct(F.transform("matches", lambda m: m["item_id"])).alias("item_ids"),
        F.array_max(F.transform("matches", lambda m: m["similarity"])).alias("best_similarity"),
    )
