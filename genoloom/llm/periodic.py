"""Periodic runs of words: block convolution by exact number-theoretic transforms at dyadic scales."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A prime 15 * 2^27 + 1 and a generator of its multiplicative group: transforms of up to 2^27 points.
PRIME, GENERATOR = 2013265921, 31
P = np.uint64(PRIME)
#: Points of one batch of transforms, so that a batch stays in the cache.
POINTS = 1 << 17
_roots: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """The first n/2 powers of an n-th root of unity (or of its inverse)."""
    if (n, inverse) not in _roots:
        root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
        root = pow(root, PRIME - 2, PRIME) if inverse else root
        out = np.ones(max(n // 2, 1), np.uint64)
        have, step = 1, root
        while have < n // 2:  # doubles the table: w^(i + have) = w^i * w^have
            out[have : 2 * have] = out[:have] * np.uint64(step) % P
            have, step = 2 * have, step * step % PRIME
        _roots[n, inverse] = out
    return _roots[n, inverse]


def forward(a: np.ndarray) -> np.ndarray:
    """Transforms the columns of ``a`` (n x any, n a power of two); the result is in bit-reversed order."""
    n, half = len(a), len(a) // 2
    while half:
        x = a.reshape(n // (2 * half), 2, half, -1)
        u, v = x[:, 0], x[:, 1]
        total, less = u + v, u + (P - v)
        x = np.empty_like(x)
        x[:, 0] = np.minimum(total, total - P)
        x[:, 1] = less * _powers(2 * half, False)[None, :, None] % P
        a, half = x.reshape(a.shape), half // 2
    return a


def backward(a: np.ndarray) -> np.ndarray:
    """Undoes ``forward`` but for the factor n."""
    n, half = len(a), 1
    while half < n:
        x = a.reshape(n // (2 * half), 2, half, -1)
        u, v = x[:, 0], x[:, 1] * _powers(2 * half, True)[None, :, None] % P
        total, less = u + v, u + (P - v)
        x = np.empty_like(x)
        x[:, 0], x[:, 1] = np.minimum(total, total - P), np.minimum(less, less - P)
        a, half = x.reshape(a.shape), 2 * half
    return a


def block_matches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block occurs in its window: zero sums of squared differences.

    ``blocks`` is size x k, ``windows`` (2 size - 1) x k; the result is size x k. sum (x - y)^2 =
    sum x^2 + sum y^2 - 2 sum x y, the last by a transform of 2 size points, in which only unused
    places wrap around. The sums are exact: numbers are cut into digits to a base so small that no
    sum reaches the prime; a match has zero sums for every digit.
    """
    base = np.uint64(math.isqrt((PRIME - 1) // len(blocks)))
    found = _digit_matches(blocks % base, windows % base)
    while (windows >= base).any() or (blocks >= base).any():
        blocks, windows = blocks // base, windows // base
        found &= _digit_matches(blocks % base, windows % base)
    return found


def _digit_matches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    size, k = blocks.shape
    n = 2 * size
    a, b = np.zeros((n, k), np.uint64), np.zeros((n, k), np.uint64)
    a[:size], b[: n - 1] = blocks[::-1], windows
    cross = backward(forward(a) * forward(b) % P)[size - 1 : n - 1] * np.uint64(pow(n, PRIME - 2, PRIME)) % P
    squares = np.cumsum(np.vstack([np.zeros((1, k), np.int64), windows.astype(np.int64) ** 2]), 0)
    own = (blocks.astype(np.int64) ** 2).sum(0)
    sums = own[None, :] + squares[size:] - squares[:size]
    return (sums.astype(np.uint64) + np.uint64(2) * (P - cross)) % P == 0


def _extended(x: np.ndarray, at: np.ndarray, lag: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """How far from ``at`` on, in direction ``step`` and before ``bound``, x[i] == x[i + lag] holds."""
    far, open_, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    room = (bound - at) * step
    while len(open_):
        ahead = np.arange(width)
        i = at[open_, None] + step * (far[open_, None] + ahead)
        inside = far[open_, None] + ahead < room[open_, None]
        i = np.where(inside, i, at[open_, None])
        same = inside & (x[i] == x[np.minimum(i + lag[open_, None], len(x) - 1)])
        got = np.where(same.all(1), width, same.argmin(1))
        far[open_] += got
        open_, width = open_[got == width], min(4 * width, 512)
    return far


def _inside(start: np.ndarray, end: np.ndarray, lag: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which stretches lie in a run whose period divides their lag."""
    out, order = np.zeros(len(start), bool), np.argsort(start, kind="stable")
    if len(start):
        runs = runs[runs[:, 1] - runs[:, 0] >= (end - start).min()]
        low, high = np.searchsorted(start[order], runs[:, 0]), np.searchsorted(start[order], runs[:, 1])
        for k in np.flatnonzero(high > low):
            some = order[low[k] : high[k]]
            out[some] |= (end[some] <= runs[k, 1]) & (lag[some] % runs[k, 2] == 0)
    return out


def runs_in(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """Rows (start, end, period) of all runs inside the segments [starts, ends) of the codes ``x``.

    A run of period q with size <= q < 2 size (size a power of two) is at least 4 q long, so it holds a
    whole block of its segment that recurs q words later. Blocks are matched against all distances
    of their scale at once; matches of neighbouring blocks at one distance are one seed, which is
    extended to both sides. A seed inside a run that is already known, at a multiple of its period,
    is that run again: a stretch with a period d in which d neighbours have a period that divides d
    has this smaller period everywhere.
    """
    found, size = [np.zeros((0, 3), np.int64)], 1
    pad = x.max(initial=0) + np.uint64(1)
    while True:
        fits = ends - starts >= max(min_length, exponent * size)
        if not fits.any():
            break
        lo, hi = starts[fits], ends[fits]
        many = np.maximum((hi - lo) // size - 1, 0)
        seg = np.repeat(np.arange(len(lo)), many)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
        at = lo[seg] + nth * size
        seeds = []
        for a in range(0, len(at), step := max(1, POINTS // (2 * size))):
            here, end = at[a : a + step], hi[seg[a : a + step]]
            i = here[None, :] + size + np.arange(2 * size - 1)[:, None]
            windows = np.where(i < end, x[np.minimum(i, len(x) - 1)], pad)
            lag, which = np.nonzero(block_matches(x[here[None, :] + np.arange(size)[:, None]], windows))
            seeds.append(np.stack([which + a, lag + size]))
        which, lag = np.concatenate(seeds, 1)
        order = np.lexsort((nth[which], lag, seg[which]))
        which, lag = which[order], lag[order]
        new = np.ones(len(which), bool)
        new[1:] = (seg[which[1:]] != seg[which[:-1]]) | (lag[1:] != lag[:-1]) | (nth[which[1:]] != nth[which[:-1]] + 1)
        first, last = which[new], which[np.append(new[1:], True)[: len(new)]]
        lag = lag[new]
        fresh = ~_inside(at[first], at[last] + size + lag, lag, np.concatenate(found))
        first, last, lag = first[fresh], last[fresh], lag[fresh]
        of = seg[first]
        left = at[first] - _extended(x, at[first] - 1, lag, lo[of] - 1, -1)
        right = at[last] + size
        right = right + _extended(x, right, lag, hi[of] - lag, 1)
        keep = right + lag - left >= np.maximum(min_length, exponent * lag)
        found.append(np.stack([left, right + lag, lag], 1)[keep])
        size *= 2
    return np.concatenate(found)


def _segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and bounds of the stretches that can hold a run: each word of a run occurs ``exponent`` times in it.

    Words rarer than that in their segment end it; twice, as the shorter segments make more words rare.
    """
    for _ in range(3):
        seg = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.arange(len(seg)) + np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts)
        key = seg * (int(codes.max(initial=0)) + 1) + codes[at]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        often = n[back] >= exponent
        at, seg = at[often], seg[often]
        if not len(at):
            return codes, starts[:0], ends[:0]
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(seg) != 0))
        starts, ends = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)] + 1
        keep = ends - starts >= min_length
        starts, ends = starts[keep], ends[keep]
    return codes, starts, ends


def _dense(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments put together, their words numbered from 0 inside each segment; and where they came from."""
    size = ends - starts
    new_ends = np.cumsum(size)
    seg = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(seg)) + np.repeat(starts - new_ends + size, size)
    top = int(codes.max(initial=0)) + 1
    keys, back = np.unique(seg * top + codes[at], return_inverse=True)
    owner = keys // top
    begin = np.searchsorted(owner, np.arange(len(starts)))
    return (back - begin[seg]).astype(np.uint64), new_ends - size, new_ends, starts - new_ends + size


def runs_of(texts: list[list[str]], min_length: int = 6, exponent: int = 4) -> list[np.ndarray]:
    """Rows (start, length, period), by start and period, for each list of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts, codes = ends - sizes, np.empty(int(sizes.sum()), np.int64)
    for words, a, b in zip(texts, starts, ends, strict=True):
        known: dict[str, int] = {}
        codes[a:b] = [known.setdefault(w, len(known)) for w in words]
    _, lo, hi = _segments(codes, starts[sizes >= min_length], ends[sizes >= min_length], min_length, exponent)
    x, lo, hi, moved = _dense(codes, lo, hi)
    found = runs_in(x, lo, hi, min_length, exponent)
    back = moved[np.searchsorted(hi, found[:, 0], "right")] if len(found) else found[:, 0]
    first, last, period = found[:, 0] + back, found[:, 1] + back, found[:, 2]
    doc = np.searchsorted(ends, first, "right")
    rows = np.stack([first - starts[doc], last - first, period], 1) if len(found) else found
    order = np.lexsort((rows[:, 2], rows[:, 0], doc))
    cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return [rows[order][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, exponent: int = 4, n_words: str = "n_words", runs: str = "runs", collapsed: str = "collapsed", batch_words: int = 200_000) -> DataFrame:
    """``docs`` with three more columns: the number of words, all periodic runs, and the text with runs collapsed.

    Words are stretches without white space (space, \\t, \\n, \\v, \\f, \\r), numbered from 0. A run is
    a stretch with smallest period q, at least ``min_length`` and ``exponent`` * q words long
    (``exponent`` is at least 3), which no neighbouring word extends. ``runs`` has them by start, then
    period; in ``collapsed`` only the first period of each run is left, words are joined by one space.

    No shuffle: every text is searched whole in its own task, texts of about ``batch_words`` words
    together. Per scale the work is that of transforms over twice the words that recur often enough
    in their neighbourhood to be in a run.

    Cases: a null, empty or blank text has 0 words, no run and an empty collapsed text. Very long
    texts take memory in proportion to their words. Repeated rows get equal results; null ids do not
    matter. Other columns pass through; one with the name of a result is replaced. An empty table
    gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in {n_words.lower(), runs.lower(), collapsed.lower()}]
    given = unused(docs, "_pr_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(given))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], f"`{n_words}` bigint", f"`{runs}` {RUNS}", f"`{collapsed}` string"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                words, held = [], 0
                while at + len(words) < batch.num_rows and (not words or held < batch_words):
                    words.append(WORD.findall(batch.column(len(kept))[at + len(words)].as_py() or ""))
                    held += len(words[-1])
                found = runs_of(words, min_length, exponent)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(r) for r in found])), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(found).T.copy()], ["start", "length", "period"]),
                ).cast(kind)
                texts = pa.array([_collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.string())
                columns = batch.slice(at, len(words)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(w) for w in words], pa.int64()), listed, texts], [*kept, n_words, runs, collapsed])
                at += len(words)

    return rows.mapInArrow(search, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; a tenth of them, by a hash of the id, is first continued periodically from some word on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    docs = docs.withColumn("g", F.floor(F.col("h") / 10))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    looped = F.expr("concat(slice(w, 1, cast(a as int)), transform(sequence(a, n - 1), i -> element_at(w, cast(a + (i - a) % p as int) + 1)))")
    planted = docs.filter("h % 10 = 0").withColumn("w", words).withColumn("n", F.size("w")).filter("n > 0")
    planted = planted.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")).select("doc_id", F.array_join(looped, " ").alias("text"))
    # null ids have no hash, null and blank texts no words: they stay as they are
    plain = docs.filter("h IS NULL OR h % 10 <> 0 OR text IS NULL OR NOT text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select("doc_id", "text")
    out = periodic_runs(plain.unionAll(planted))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(1))
    out = out.withColumns({"lines": lines, "best": best})
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * -best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
