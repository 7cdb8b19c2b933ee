"""Quality by co-training: a classifier of the text and one of the metadata teach each other."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stage import written
from .common import give_back, table
from .decontaminate import PlainWords
from .langid import draw

WORD_BITS, SOURCE_SLOTS, LANG_SLOTS = 18, 64, 16
#: Classes of bytes whose shares describe a text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r",
    "stop": b".,;:?", "bang": b"!", "markup": b"#$%&*|<>{}[]=_~^\\/@", "quote": b"\"'`()-", "high": bytes(range(128, 256)),
}
BYTE_CLASS = np.stack([np.isin(np.arange(256), list(c)) for c in CLASSES.values()], axis=1).astype(float)


def text_shape(text: str, words: np.ndarray) -> np.ndarray:
    """Shares of the byte classes and a few sizes; the same whatever the length of the text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, lines = max(len(raw), 1), text.split("\n")
    shares = np.bincount(raw, minlength=256) @ BYTE_CLASS / n
    return np.concatenate([shares, [np.log1p(len(raw)), np.log1p(len(words)), len(raw) / max(len(words), 1) / 10, len(np.unique(words)) / max(len(words), 1), len(set(lines)) / len(lines)]])


def word_slots(words: np.ndarray) -> np.ndarray:
    return np.unique(words & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32)


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """One-hot slots of source and language, the size and whether it is known."""
    out = np.zeros(SOURCE_SLOTS + LANG_SLOTS + 2)
    out[xxhash.xxh32_intdigest(str(source)) % SOURCE_SLOTS] = 1
    out[SOURCE_SLOTS + xxhash.xxh32_intdigest(str(lang)) % LANG_SLOTS] = 1
    out[-2:] = np.log1p(max(n_chars or 0, 0)), n_chars is None
    return out


class Logistic:
    """Regularised logistic regression on standardised features, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        weight, penalty = np.ones(len(x)) if weight is None else weight, np.r_[np.full(x.shape[1], ridge), 1e-3]
        self.w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.w, -30, 30)


def word_weights(slots: list[np.ndarray], y: np.ndarray, weight: np.ndarray, least: float = 3.0) -> np.ndarray:
    """Signed root of each word slot's likelihood ratio per document: how much its presence says about the label.

    Unlike plain log odds it does not favour words that few documents have. 0 for slots of fewer
    than ``least`` documents.
    """
    size, n = 1 << WORD_BITS, max(weight.sum(), 1e-9)
    with_word = [np.zeros(size), np.zeros(size)]
    for s, label, w in zip(slots, y, weight, strict=True):
        with_word[int(label)][s] += w
    ones, seen = max(weight[y == 1].sum(), 1e-9), with_word[0] + with_word[1]
    ratio, expected = np.zeros(size), seen * ones / n
    for has, have, expect in ((with_word[1], seen, expected), (with_word[0], seen, seen - expected), (ones - with_word[1], n - seen, ones - expected), (n - ones - with_word[0], n - seen, n - ones - seen + expected)):
        some = (has > 1e-9) & (expect > 1e-9) & (have > 0)
        ratio[some] += has[some] * np.log(has[some] / expect[some])
    root = np.sqrt(2 * np.maximum(ratio, 0) / n) * np.sign(with_word[1] - expected)
    return np.where(seen >= least, root, 0.0)


def word_features(slots: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The strongest words for and against, and all words together."""
    out = np.zeros((len(slots), 5))
    for i, s in enumerate(slots):
        if len(s):
            w = np.sort(weights[s])
            out[i] = w[-1], w[-3:].mean(), w[0], w[:3].mean(), w.sum() / np.sqrt(len(w))
    return out


class TextView:
    """Word weights and the shape of the text. The weights a row is trained with come from the other half of the rows."""

    def fit(self, rows: list[tuple], y: np.ndarray, weight: np.ndarray) -> TextView:
        slots, half = [r[1] for r in rows], np.arange(len(rows)) % 2
        crossed = np.zeros((len(rows), 5))
        for k in (0, 1):
            own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
            crossed[own] = word_features([slots[i] for i in own], word_weights([slots[i] for i in other], y[other], weight[other]))
        self.words = word_weights(slots, y, weight)
        self.model = Logistic().fit(np.c_[np.stack([r[0] for r in rows]), crossed], y, weight)
        return self

    def logit(self, rows: list[tuple]) -> np.ndarray:
        return self.model.logit(np.c_[np.stack([r[0] for r in rows]), word_features([r[1] for r in rows], self.words)])


class MetadataView:
    def fit(self, rows: list[tuple], y: np.ndarray, weight: np.ndarray) -> MetadataView:
        self.model = Logistic().fit(np.stack([r[2] for r in rows]), y, weight)
        return self

    def logit(self, rows: list[tuple]) -> np.ndarray:
        return self.model.logit(np.stack([r[2] for r in rows]))


class CoTrained:
    """Both views, what each has been taught, and the curve that combines their calibrated logits."""

    def __init__(self, rows: list[tuple], y: np.ndarray):
        self.rows, self.y, self.back = rows, y, np.arange(len(rows)) % 5 == 4  # a fifth is kept back for calibration
        if len(set(y[~self.back])) < 2 or len(set(y[self.back])) < 2:
            self.back[:] = False
        self.taught: list[dict[int, tuple[tuple, float]]] = [{}, {}]  # by key
        self.fit_views()

    def fit_views(self) -> None:
        """Fits each view to the labelled rows and, at half weight, to those the other view has taught it."""
        own, labels = [r for r, b in zip(self.rows, self.back, strict=True) if not b], self.y[~self.back]
        self.views = []
        for kind, more in zip((TextView, MetadataView), self.taught, strict=True):
            weight = np.r_[np.ones(len(own)), np.full(len(more), 0.5)]
            self.views.append(kind().fit(own + [r for r, _ in more.values()], np.r_[labels, [label for _, label in more.values()]], weight))

    def wanted(self, per_round: int) -> dict[float, int]:
        """New labels keep the shares of the classes."""
        share = self.y.mean()
        return {1.0: max(1, round(per_round * share)), 0.0: max(1, round(per_round * (1 - share)))}

    def finish(self) -> CoTrained:
        held = [r for r, b in zip(self.rows, self.back, strict=True) if b] if self.back.any() else self.rows
        self.combined = Logistic().fit(self._logits(held), self.y[self.back] if self.back.any() else self.y, ridge=0.1)
        del self.rows, self.taught
        return self

    def _logits(self, rows: list[tuple]) -> np.ndarray:
        return np.stack([v.logit(rows) for v in self.views], axis=1)

    def probability(self, rows: list[tuple]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.combined.logit(self._logits(rows))))


def _rows(batch: pa.RecordBatch, known: PlainWords) -> Iterator[tuple]:
    """(shape, word slots, metadata) of rows of text, source, lang, n_chars."""
    from .decontaminate import plain_hashes

    for text, source, lang, n_chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        text = text or ""
        words = plain_hashes(text, known)
        yield text_shape(text, words), word_slots(words), metadata_features(source, lang, n_chars)


def _inputs(docs: DataFrame) -> list:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def _features(docs: DataFrame, *carried: str) -> DataFrame:
    """(key, features, carried) per row; equal features have equal keys. A row takes a few hundred bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PlainWords()
        for batch in batches:
            given = batch.select(range(batch.num_columns - 4, batch.num_columns))
            packed = [_packed(*r) for at in range(0, batch.num_rows, 500) for r in _rows(given.slice(at, 500), known)]
            keys = np.array([xxhash.xxh64_intdigest(p) for p in packed], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary()), *batch.columns[: len(carried)]], ["key", "features", *carried])
        known.clear()
        give_back()  # the worker stays and serves other stages

    given = docs.select(*carried, *[c.alias(f"_q_{i}") for i, c in enumerate(_inputs(docs))])
    return given.mapInArrow(make, ", ".join(["key long, features binary", *[f"{c} {kinds[c]}" for c in carried]]))


def _packed(shape: np.ndarray, slots: np.ndarray, meta: np.ndarray) -> bytes:
    gaps = np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(shape.tobytes() + meta.tobytes() + np.ascontiguousarray(gaps).tobytes(), 1)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, n_shape, n_meta = zstandard.decompress(packed), len(CLASSES) + 5, SOURCE_SLOTS + LANG_SLOTS + 2
    numbers, planes = np.frombuffer(raw, float, n_shape + n_meta), np.frombuffer(raw, np.uint8, offset=8 * (n_shape + n_meta))
    slots = np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
    return numbers[:n_shape], slots, numbers[n_shape:]


def _surest(pool: DataFrame, heads: dict[int, CoTrained], per_round: int, confident: float) -> tuple[list[tuple], dict[int, tuple]] | None:
    """(head, view, label, -, key) of the pool rows that each view is surest of, for the other to learn from, and features by key.

    Every task scores its rows and keeps its own best; the best of all tasks follow by one window of
    a few rows per task. Rows with equal features count once, and what a view has been taught is left out.
    """
    known = {(h, v): set(c.taught[1 - v]) for h, c in heads.items() for v in (0, 1)}
    wanted = {h: c.wanted(per_round) for h, c in heads.items()}
    shared = pool.sparkSession.sparkContext.broadcast(({h: c.views for h, c in heads.items()}, known, wanted))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, known, wanted = shared.value
        best: dict[tuple, dict[int, float]] = {(h, v, label): {} for h in views for v in (0, 1) for label in (1.0, 0.0)}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                keys, rows = some.column(0).to_numpy(), [_unpacked(p) for p in some.column(1).to_pylist()]
                chance = {(h, v): 1 / (1 + np.exp(-view.logit(rows))) for h, both in views.items() for v, view in enumerate(both)}
                for (h, v, label), found in best.items():
                    sure, n = chance[h, v] if label else 1 - chance[h, v], wanted[h][label]
                    for i in np.flatnonzero(sure >= confident):
                        if int(keys[i]) not in known[h, v]:
                            found[int(keys[i])] = float(sure[i])
                    if len(found) > 4 * n:
                        best[h, v, label] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n])
        rows = [(h, v, label, k, s) for (h, v, label), found in best.items() for k, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[: wanted[h][label]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64()))], ["head", "view", "label", "key", "sure"])

    judged = pool.mapInArrow(judge, "head int, view int, label double, key long, sure double")
    judged = judged.groupBy("head", "view", "label", "key").agg(F.max("sure").alias("sure"))
    place = F.row_number().over(Window.partitionBy("head", "view", "label").orderBy(F.col("sure").desc(), "key"))
    limits = F.lit(0)
    for h, counts in wanted.items():
        for label, n in counts.items():
            limits = F.when((F.col("head") == h) & (F.col("label") == label), n).otherwise(limits)
    most = max(n for counts in wanted.values() for n in counts.values())
    chosen = judged.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") <= limits).select("head", "view", "label", "key", "sure").collect()
    shared.destroy()
    if not chosen:
        return None
    keys = pool.sparkSession.createDataFrame([(k,) for k in sorted({r["key"] for r in chosen})], "key long")
    rows = pool.join(F.broadcast(keys), "key").groupBy("key").agg(F.first("features").alias("features")).collect()  # at most 8 * per_round
    features = {r["key"]: _unpacked(bytes(r["features"])) for r in rows}
    return sorted(((r["head"], r["view"], r["label"], -r["sure"], r["key"]) for r in chosen)), features


@dataclass
class Model:
    good: CoTrained | float
    toxic: CoTrained | float

    def scores(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        each = [m.probability(rows) if isinstance(m, CoTrained) else np.full(len(rows), m) for m in (self.good, self.toxic)]
        return each[0], each[1]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, rounds: int = 4, per_round: int = 300, confident: float = 0.95) -> Model | None:
    """Two co-trained classifiers (good quality, toxic); None without labels.

    About ``max_labelled`` labelled documents are drawn evenly by a hash of their id; only their
    features come to the driver. The features of all other documents are written to the shared
    folder. In each of ``rounds`` rounds each view scores all of them and labels the ``per_round`` it is
    surest of for the other, at half weight; only these come to the driver. Repeated labels: good if
    most say so, toxic if any does; null labels are ignored. Documents with equal features teach once.
    """
    marks = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"), F.max("toxic").cast("int").alias("toxic"))
    n_labels = marks.count()
    if not n_labels or docs.isEmpty():
        return None
    drawn = marks.filter(draw(F.col("doc_id")) < max_labelled / n_labels)
    own = docs.select("doc_id", "text", "source", "lang", "n_chars")
    sample = _features(own.join(F.broadcast(drawn), "doc_id"), "good", "toxic").collect()  # about max_labelled rows
    sample.sort(key=lambda r: (r["key"], str(r["good"]), str(r["toxic"])))
    rows = [(r["good"], r["toxic"], _unpacked(bytes(r["features"]))) for r in sample]
    out: dict[int, CoTrained | float] = {}
    for h in (0, 1):
        some = [r for r in rows if r[h] is not None]
        y = np.array([float(r[h]) for r in some])
        out[h] = CoTrained([r[2] for r in some], y) if len(set(y)) == 2 else float(y[0]) if len(y) else float(h == 0)
    heads = {h: c for h, c in out.items() if isinstance(c, CoTrained)}
    if heads and rounds:
        # features travel to the labels and not texts; by a merge at every size, so that it grows with the documents
        others = _features(own, "doc_id").join(marks.select("doc_id").hint("merge"), "doc_id", "left_anti")
        pool = written(others.select("key", "features"), "quality-features")
        for _ in range(rounds):
            found = _surest(pool, heads, per_round, confident)
            if not found:
                break
            for h, v, label, _, key in found[0]:
                heads[h].taught[1 - v].setdefault(key, (found[1][key], label))
            for c in heads.values():
                c.fit_views()
    for c in heads.values():
        c.finish()
    give_back()
    return Model(out[0], out[1])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``good_score``, ``toxic_score``, ``score`` (good and not toxic) and ``keep``.

    Every document is scored from its whole text and from source, lang and n_chars. Cases: null and
    empty texts have the features of an empty text, null metadata is a value of its own; repeated rows
    get equal scores; columns of these four names are replaced, all others pass. Without a model all
    documents are kept with null scores. No shuffle.
    """
    docs = docs.drop("good_score", "toxic_score", "score", "keep")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"good_score": none, "toxic_score": none, "score": none, "keep": F.lit(True)})
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    given = docs.select("*", *[c.alias(f"_q_{i}") for i, c in enumerate(_inputs(docs))])
    width = len(names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PlainWords()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                good, toxic = shared.value.scores(list(_rows(pa.RecordBatch.from_arrays(some.columns[width:], ["a", "b", "c", "d"]), known)))
                keep = (good >= 0.5) & (toxic < 0.5)
                yield pa.RecordBatch.from_arrays([*some.columns[:width], pa.array(good), pa.array(toxic), pa.array(good * (1 - toxic)), pa.array(keep)], [*names, "good_score", "toxic_score", "score", "keep"])
        known.clear()
        give_back()

    schema = docs.withColumns({"good_score": F.lit(0.0), "toxic_score": F.lit(0.0), "score": F.lit(0.0), "keep": F.lit(True)}).schema
    return given.mapInArrow(judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "good_score", "toxic_score", "score", "keep")
