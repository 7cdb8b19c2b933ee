"""Scoring by prediction by partial matching (PPM) over byte contexts, with a word-level base line."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import written
from .common import learned_from, table

#: Bytes that UTF-8 never uses: before a text, and after it. START is not predicted, so 255 symbols are.
START, END, SYMBOLS = 0xFE, 0xFF, 255
ORDER = 5
#: Orders below this are whole in the driver: their grams have at most three bytes, however large the corpus is.
LOW = 3
#: Parts that the grams are dealt to by the last LOW bytes of their context.
BUCKETS = 1024


def plain_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes.split() then cuts it at the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def packed_grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its END: the byte and its ``order`` predecessors in one number; and sizes per text."""
    pad = bytes([START]) * order
    data = b"".join([*(pad + t + bytes([END]) for t in texts), bytes(8)])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))  # the eight bytes from each place on
    begins = np.cumsum(sizes + order) - sizes - order
    real = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return eight[real].astype(np.uint64) >> np.uint64(8 * (7 - order)), sizes


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


@dataclass
class Level:
    """One depth of the trie: contexts of one length, and the symbols seen after them."""

    grams: np.ndarray  # context and symbol, sorted
    log_top: np.ndarray  # log probability where nothing is excluded
    log_count: np.ndarray
    contexts: np.ndarray  # sorted
    escape_top: np.ndarray  # log probability of an escape where nothing is excluded
    log_below: np.ndarray  # of the next shorter context, without the symbols seen here: log of its total weight
    escape_below: np.ndarray  # and log probability of a further escape


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trie:
    """A pretrained context trie; every probability is over the 255 symbols and adds up to 1.

    Escapes follow method D: half an occurrence of each symbol seen in the context goes to the escape,
    with the occurrences of symbols that are too rare to be kept. After an escape, the symbols of the
    longer context are excluded from the shorter one. As every symbol seen after a context is seen
    after its suffixes, what is excluded depends on the longer context alone and is summed beforehand.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], contexts: list[tuple[np.ndarray, np.ndarray]], below: Trie | None = None):
        """grams[d], contexts[d]: sorted keys and counts, d the length of the context; from LOW on where ``below`` has the others."""
        self.levels: list[Level] = below.levels[:LOW] if below else []
        before = self.low = below.low if below else None
        for d, ((keys, counts), (ctx_keys, ctx_counts)) in enumerate(zip(grams, contexts, strict=True), len(self.levels)):
            context = keys >> np.uint64(8)
            own, inverse = np.unique(context, return_inverse=True)
            total = ctx_counts[_found(ctx_keys, own)[0]].astype(float) if len(own) else np.zeros(0)
            kinds, kept = np.bincount(inverse, minlength=len(own)).astype(float), np.bincount(inverse, counts, minlength=len(own))
            below, escape = np.zeros(len(own)), np.zeros(len(own))
            if d and len(own):
                low_keys, low_counts, low_own, low_total, low_kinds, low_kept = before
                excluded = np.bincount(inverse, low_counts[_found(low_keys, keys & _mask(d))[0]], minlength=len(own))
                parent = _found(low_own, own & _mask(d - 1))[0]
                weight = low_total[parent] - excluded
                out = low_total[parent] - low_kept[parent] + (low_kinds[parent] - kinds) / 2
                none = (low_kinds[parent] <= kinds) | (weight <= 0)
                below = np.log(np.where(none, 1, weight))
                escape = np.where(none, 0, np.log(np.maximum(out, 1e-300)) - below)
            log_counts = np.log(counts - 0.5)
            self.levels.append(Level(keys, log_counts - np.log(total)[inverse], log_counts, own, np.log((total - kept + kinds / 2) / total), below, escape))
            before = (keys, counts.astype(float), own, total, kinds, kept)
            if d == LOW - 1:
                self.low = before
        self.last = -math.log(SYMBOLS - len(self.levels[0].grams))

    @classmethod
    def above(cls, below: Trie, grams: np.ndarray, counts: np.ndarray) -> Trie:
        """The low orders of ``below`` under the grams of the highest order that share some contexts of LOW bytes: all of them."""
        def added(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            distinct, inverse = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)

        whole = [added(grams & _mask(d + 1)) for d in range(LOW, ORDER + 1)]
        return cls(whole, [added(grams >> np.uint64(8) & _mask(d)) for d in range(LOW, ORDER + 1)], below)

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last byte of each gram after the bytes before it."""
        out, child = np.zeros(len(packed)), np.full(len(packed), -1)  # child: the longer context that was left by an escape
        todo = np.arange(len(packed))
        for d in range(len(self.levels) - 1, -1, -1):
            level, some, before = self.levels[d], packed[todo], child[todo]
            gram, seen = _found(level.grams, some & _mask(d + 1))
            fresh = before < 0
            out[todo[seen & fresh]] = level.log_top[gram[seen & fresh]]
            if not fresh.all():
                longer, on = self.levels[d + 1], seen & ~fresh
                out[todo[on]] += level.log_count[gram[on]] - longer.log_below[before[on]]
            todo, some, before, fresh = todo[~seen], some[~seen], before[~seen], fresh[~seen]
            at, has = _found(level.contexts, some >> np.uint64(8) & _mask(d))
            out[todo[fresh & has]] = level.escape_top[at[fresh & has]]
            if not fresh.all():
                out[todo[~fresh]] += self.levels[d + 1].escape_below[before[~fresh]]
            child[todo[has]] = at[has]
        out[todo] += self.last
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each text and its end; a gram is looked up once for all its places."""
        packed, sizes = packed_grams(texts, len(self.levels) - 1)
        codes, distinct = pd.factorize(packed)
        return np.add.reduceat(self.log_probabilities(distinct)[codes], np.cumsum(sizes) - sizes) if len(texts) else np.zeros(0)


def _parts(texts: list[bytes], limit: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_words_and_grams(docs: DataFrame, part_bytes: int = 4 << 20, max_words: int = 500_000, max_grams: int = 3_000_000) -> DataFrame:
    """(word, gram, n): counts of words (gram null) and of grams (word null) over all texts, added up in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words, grams, n):
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["word", "gram", "n"])

        def added(held):
            codes, distinct = pd.factorize(np.concatenate([k for k, _ in held]))
            return distinct, np.bincount(codes, np.concatenate([n for _, n in held]), len(distinct)).astype(np.int64)

        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for texts in _parts([plain_bytes(t) for t in batch.column(0).to_pylist()], part_bytes):
                for t in texts:
                    words.update(t.split())
                codes, distinct = pd.factorize(packed_grams(texts)[0])
                grams.append((distinct, np.bincount(codes, minlength=len(distinct))))
                if sum(len(k) for k, _ in grams) >= max_grams:
                    grams = [added(grams)]
                    if len(grams[0][0]) >= max_grams // 2:
                        yield rows([None] * len(grams[0][0]), grams[0][0].astype(np.int64), grams[0][1])
                        grams = []
                if len(words) >= max_words:
                    yield rows(list(words), [None] * len(words), list(words.values()))
                    words = Counter()
        yield rows(list(words), [None] * len(words), list(words.values()))
        if grams:
            distinct, n = added(grams)
            yield rows([None] * len(distinct), distinct.astype(np.int64), n)

    return docs.select("text").mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What scoring needs: all counted grams, the trie of the frequent ones, the frequent words, and the sums of the base line."""

    trie: Trie  # orders from LOW on hold frequent grams only
    grams: DataFrame  # (gram, n)
    frequent: dict[bytes, int]
    tokens: int
    kinds: int
    ends: int


def train(docs: DataFrame, keep_grams: float = 2.0**-20, keep_words: float = 2.0**-20) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the table (word, n) of the words that are not in it.

    Counts cover all texts, and all of them stay in the written table. The grams of the lowest orders
    come to the driver, and of each other order those that make up at least a share ``keep_grams`` of
    all bytes, so at most 1 / keep_grams of them however large the corpus is; their contexts have
    exact totals. The share only says which grams need no look-up in the table; no score depends on
    it. The same holds for words.
    """
    counts = written(count_words_and_grams(docs), "ppm-counts")
    words, grams = counts.filter("word IS NOT NULL").select("word", "n"), counts.filter("gram IS NOT NULL").select("gram", "n")
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_bytes, ends = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("gram").bitwiseAND(0xFF) == END, F.col("n"))), F.lit(0))).first()

    def suffix(gram: Column, n: int) -> Column:
        return gram.bitwiseAND((1 << 8 * n) - 1)

    g = F.col("gram")
    keys = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(True).alias("whole"), suffix(g, d + 1).alias("key")) for d in range(ORDER + 1)], *[F.struct(F.lit(d).alias("d"), F.lit(False).alias("whole"), suffix(F.shiftright(g, 8), d).alias("key")) for d in range(ORDER + 1)])
    levels = grams.select(F.explode(keys).alias("x"), "n").groupBy("x.d", "x.whole", "x.key").agg(F.sum("n").alias("n")).filter((F.col("d") < LOW) | (F.col("n") >= keep_grams * n_bytes))
    kept = levels.toArrow().to_pandas().sort_values(["d", "whole", "key"])

    def level(d: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        some = kept[(kept["d"] == d) & (kept["whole"] == whole)]
        return some["key"].to_numpy(np.uint64), some["n"].to_numpy(np.int64)

    trie = Trie([level(d, True) for d in range(ORDER + 1)], [level(d, False) for d in range(ORDER + 1)])
    floor = keep_words * n_words
    frequent = {bytes(r["word"]): r["n"] for r in words.filter(F.col("n") >= floor).collect()}
    some = int(ends > 0)
    return Model(trie, grams, frequent, int(n_words + ends), int(kinds + some), int(ends)), words.filter(F.col("n") < floor)


def _slot(grams: np.ndarray) -> np.ndarray:
    """24 mixed bits of each gram."""
    return grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)


def _slots(grams: np.ndarray) -> np.ndarray:
    """True at the slots of the grams: most others are told apart by one access."""
    out = np.zeros(1 << 24, bool)
    out[_slot(grams)] = True
    return out


def _frequent_part(trie: Trie, slots: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the log probability of its frequent grams; the distinct other grams, how often each occurs, and the texts it occurs in."""
    packed, sizes = packed_grams(texts)
    codes, distinct = pd.factorize(packed)
    top, some = trie.levels[-1], np.flatnonzero(slots[_slot(distinct)])
    at, have = _found(top.grams, distinct[some])
    log_p, seen = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
    log_p[some[have]], seen[some[have]] = top.log_top[at[have]], True
    scores = np.add.reduceat(log_p[codes], np.cumsum(sizes) - sizes)
    rest = np.flatnonzero(~seen[codes])
    places = np.sort(codes[rest] << 32 | rest) & 0xFFFFFFFF  # by gram, then by place; a part has less than 4 GB
    return scores, distinct[~seen], np.bincount(codes[rest], minlength=len(distinct))[~seen], np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)[places]


def _bucket(context):
    """Of the last LOW bytes of a context; for arrays and columns."""
    return context * 0x9E3779B1 % (1 << 32) % 999_983 % BUCKETS


def _planes(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_rest(grams: np.ndarray, times: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Buckets, and for each its grams, how often each occurs and the texts it occurs in, as compressed byte planes."""
    context = grams >> np.uint64(8) & _mask(LOW)
    bucket = _bucket(context)
    order = np.argsort(bucket << np.uint64(48) | context << np.uint64(24) | grams >> np.uint64(32) << np.uint64(8) | grams & np.uint64(255))
    begins = (np.cumsum(times) - times)[order]
    grams, times, bucket = grams[order], times[order], bucket[order]
    ends = np.cumsum(times)
    places = places[np.repeat(begins - (ends - times), times) + np.arange(len(places))]
    own, first = np.unique(bucket, return_index=True)
    pack, out = zstandard.ZstdCompressor(level=1).compress, []
    for a, b in zip(first, np.append(first[1:], len(grams)), strict=False):
        out.append(pack(np.int64(b - a).tobytes() + _planes(grams[a:b], "<u8") + _planes(times[a:b], "<u4") + _planes(places[ends[a] - times[a] : ends[b - 1]], "<u4")))
    return own.astype(np.int64), out


def unpacked_rest(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return _from_planes(data[8 : 8 + 8 * n], "<u8"), _from_planes(data[8 + 8 * n : 8 + 12 * n], "<u4"), _from_planes(data[8 + 12 * n :], "<u4")


def rest_scores(seen: DataFrame, model: Model) -> DataFrame:
    """(row, score) from (bucket, chunk, packed): the sums per text of the log probabilities of its rarer grams.

    Grams are dealt by the last LOW bytes of their context together with all counted grams. So a task
    has every gram and context of the orders from LOW on that its grams can escape to, and the
    lower orders are broadcast: the trie is whole for them. A task's counts come first and are held;
    the grams to score stream past chunk by chunk, and one row per task and chunk of texts leaves
    with the sums of all its texts. These are added up per chunk.
    """
    none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * (ORDER + 1 - LOW)
    shared = seen.sparkSession.sparkContext.broadcast(Trie(none, none, model.trie))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, unpack, pack = shared.value, zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        counts, trie, current, sums = [], None, None, np.zeros(0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([pack(_planes(sums, "<f8"))])], ["chunk", "sums"])

        for batch in batches:
            counted = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if counted.any():  # they are first
                some = batch.filter(pa.array(counted))
                counts.append((some.column(2).to_numpy().astype(np.uint64), some.column(3).to_numpy()))
                batch = batch.filter(pa.array(~counted))
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if trie is None:
                    trie, counts = Trie.above(below, *(np.concatenate(x) for x in zip(*counts, strict=True))) if counts else below, []
                if chunk != current:
                    if current is not None:
                        yield row()
                    current, sums = chunk, np.zeros(0)
                grams, times, places = unpacked_rest(unpack(packed))
                own = np.bincount(places, np.repeat(trie.log_probabilities(grams), times), len(sums))
                own[: len(sums)] += sums
                sums = own
        if current is not None:
            yield row()

    def add(rows: pa.Table) -> pa.Table:
        first = rows.column("chunk")[0].as_py()
        parts = [_from_planes(zstandard.decompress(b), "<f8") for b in rows.column("sums").to_pylist()]
        total = np.zeros(max(map(len, parts)))
        for part in parts:
            total[: len(part)] += part
        return pa.table({"row": pa.array(first + np.arange(len(total))), "score": pa.array(total / math.log(10))})

    bucket = _bucket(F.shiftright("gram", 8).bitwiseAND((1 << 8 * LOW) - 1)).alias("bucket")
    counts = model.grams.select(bucket, F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("packed"), "gram", "n")
    both = counts.unionByName(seen.select("bucket", "chunk", "packed", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("long").alias("n")))
    dealt = both.repartition("bucket").sortWithinPartitions(F.col("chunk").asc_nulls_first(), "bucket").select("chunk", "packed", "gram", "n")
    return dealt.mapInArrow(look_up, "chunk long, sums binary").groupBy("chunk").applyInArrow(add, "row long, score double")


def score(docs: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities.

    The frequent words and grams are counted in the task. The other words of a text are looked up by a
    join on the word, one row per text and distinct word; the other grams of a chunk of texts once
    for all their places in it. The row of the text itself travels along under a key of its own and
    is completed by a sum, so that no text is shuffled and no key is hot.

    Cases: a null or empty text is the end alone; repeated rows and null ids are scored each; a text
    of any length is read whole; other columns are ignored; if nothing was learned the trie is
    uniform and each token has base probability 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.trie, model.frequent, model.ends))
    kind = docs.schema[id_col].dataType
    names = ["row", "doc", "own", "word", "n", "known", "base", "score", "bucket", "packed"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counted, ends = shared.value
        frequent, slots = {w: math.log10(f + 1) for w, f in counted.items()}.get, _slots(trie.levels[-1].grams)
        task, serial = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in _parts([plain_bytes(t) for t in batch.column(1).to_pylist()], part_bytes):
                (scores, grams, times, places), first = _frequent_part(trie, slots, texts), serial
                n, known, base, rest_row, rest_word, rest_n = [], [], [], [], [], []
                for t in texts:
                    words = t.split()
                    here, weight, rest = int(ends > 0), math.log10(ends + 1), len(rest_word)
                    for w, c in Counter(words).items():
                        log = frequent(w)
                        if log is None:
                            rest_word.append(w)
                            rest_n.append(c)
                        else:
                            here, weight = here + c, weight + c * log
                    rest_row += [task + serial] * (len(rest_word) - rest)
                    n.append(len(words) + 1)
                    known.append(here)
                    base.append(weight)
                    serial += 1
                rows = np.arange(first, serial) + task
                keys = [b" %d" % r for r in rows]

                def filled(size: int, **columns: pa.Array) -> pa.RecordBatch:
                    kinds = [pa.int64(), ids.type, pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()]  # noqa: B023
                    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(size, k)) for name, k in zip(names, kinds, strict=True)], names)

                yield filled(len(texts), row=pa.array(rows), doc=ids.slice(at, len(texts)), own=pa.array(np.ones(len(texts), bool)), word=pa.array(keys, pa.binary()), n=pa.array(n, pa.int64()), known=pa.array(known, pa.int64()), base=pa.array(base), score=pa.array(scores / math.log(10)))
                k = len(rest_row)
                yield filled(k, row=pa.array(rest_row, pa.int64()), own=pa.array(np.zeros(k, bool)), word=pa.array(rest_word, pa.binary()), n=pa.array(rest_n, pa.int64()))
                buckets, packed = packed_rest(grams, times, places)
                yield filled(len(packed), row=pa.array(np.full(len(packed), task + first)), bucket=pa.array(buckets), packed=pa.array(packed, pa.binary()))
                at += len(texts)

    schema = f"row long, doc {kind.simpleString()}, own boolean, word binary, n long, known long, base double, score double, bucket long, packed binary"
    seen = written(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(scan, schema), "ppm-seen")
    rest = rest_scores(seen.filter("bucket IS NOT NULL").select("bucket", F.col("row").alias("chunk"), "packed"), model)
    both = seen.filter("bucket IS NULL").drop("bucket", "packed").join(rare.select("word", F.col("n").alias("c")), "word", "left")
    whole = both.unionByName(rest, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc").alias(id_col), F.max(F.when(F.col("own"), F.col("n"))).alias("n_tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 1)), F.lit(0.0))).alias("weight"),
        F.sum("score").alias("score"),
    )
    each = math.log10(model.tokens + model.kinds + 1)
    return whole.select(id_col, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("weight") - F.col("n_tokens") * each).alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rare = train(docs.filter(learned_from(F.col("doc_id"), 7)))
    out = score(docs, model, rare)
    return out.select("doc_id", (~learned_from(F.col("doc_id"), 7)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
