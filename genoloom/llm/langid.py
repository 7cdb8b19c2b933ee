"""Language identification by interpolated Kneser-Ney character models, one per language."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import learned_from, table
from .shingles import MULTIPLIER, mix

START = 2  # stands before a text, order - 1 times
UNKNOWN = "und"


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """hash of the 1..order points that end at each place; the context of a gram is the shorter hash one place before."""
    own = points.astype(np.uint64) * MULTIPLIER
    out = [mix(own)]
    with np.errstate(over="ignore"):
        for _ in range(order - 1):
            before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
            out.append(mix(before ^ own))
    return out


def padded_points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with START before each, places of real characters, and counts per text."""
    low = [t.lower() for t in texts]
    joined = "".join(chr(START) * (order - 1) + t for t in low)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    ends = np.cumsum(sizes + order - 1)
    real = np.ones(len(points), bool)
    for k in range(order - 1):
        real[ends - sizes - order + 1 + k] = False
    return points, np.flatnonzero(real), sizes


@dataclass
class Order:
    """Grams of one length: sorted hashes with log probabilities, contexts with log back-off weights."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_weight: np.ndarray


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], missing), found


def kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> list[Order]:
    """Orders 1..n from the distinct grams (rows of n code points) of one language and their counts."""
    n, orders, levels = grams.shape[1], [], [(grams, counts.astype(float))]
    for _ in range(n - 1):  # below the top a gram counts its distinct left neighbours
        shorter, kinds = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
        levels.append((shorter, kinds.astype(float)))
    for grams_, counts_ in reversed(levels):
        size = grams_.shape[1]
        if size == 1:
            keep = grams_[:, 0] != START
            grams_, counts_ = grams_[keep], counts_[keep]
        once, twice = (counts_ == 1).sum(), (counts_ == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        hashes = [gram_hashes_of_rows(grams_[:, :k]) for k in (size - 1, size)] if size > 1 else [np.zeros(len(grams_), np.uint64), gram_hashes_of_rows(grams_)]
        context, first, inverse, kinds = np.unique(hashes[0], return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, counts_)
        weight = discount * kinds / total
        if size == 1:
            lower = np.full(len(grams_), 1 / (alphabet + 1))
        else:
            below = gram_hashes_of_rows(grams_[:, 1:])
            lower = np.exp(look_up(orders[-1].grams, orders[-1].log_p, below, -40.0)[0])
        p = (counts_ - discount) / total[inverse] + weight[inverse] * lower
        by = np.argsort(hashes[1])
        orders.append(Order(hashes[1][by], np.log(p[by]), context, np.log(weight)))
    return orders


def gram_hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    out = mix(rows[:, 0].astype(np.uint64) * MULTIPLIER)
    for k in range(1, rows.shape[1]):
        out = mix(out ^ (rows[:, k].astype(np.uint64) * MULTIPLIER))
    return out


@dataclass
class Model:
    """Per language the orders; the calibration of margins; the cross-entropy above which a text is refused."""

    languages: list[str]
    orders: list[list[Order]]
    alphabet: int
    order: int
    slope: float = 1.0
    offset: float = 0.0
    limit: np.ndarray | None = None

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each text under each language. A text is not cut, repeats of a gram are looked up once."""
        points, real, sizes = padded_points(texts, self.order)
        hashes = gram_hashes(points, self.order)
        codes, distinct = pd.factorize(hashes[-1][real])
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = real[::-1]
        out = np.zeros((len(texts), len(self.languages)))
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        for k, orders in enumerate(self.orders):
            log_p = self._log_p(orders, hashes, first)
            if len(starts):
                out[some, k] = -np.add.reduceat(log_p[codes], starts) / sizes[some]
        return out

    def _log_p(self, orders: list[Order], hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), np.nan)
        carried, open_ = np.zeros(len(at)), np.ones(len(at), bool)
        for size in range(len(orders), 0, -1):
            o = orders[size - 1]
            log_p, found = look_up(o.grams, o.log_p, hashes[size - 1][at], 0.0)
            now = open_ & found
            out[now] = carried[now] + log_p[now]
            open_ &= ~found
            context = hashes[size - 2][np.maximum(at - 1, 0)] if size > 1 else np.zeros(len(at), np.uint64)
            carried += np.where(open_, look_up(o.contexts, o.log_weight, context, 0.0)[0], 0.0)
        out[open_] = carried[open_] - np.log(self.alphabet + 1)
        return out

    def judged(self, entropies: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its calibrated probability, whether it is accepted."""
        best = entropies.argmin(axis=1)
        low = entropies[np.arange(len(best)), best]
        score = 1 / (1 + np.exp(-np.clip(self.slope * margins(entropies, sizes) + self.offset, -500, 500)))
        accepted = (score >= 0.5) & (low <= self.limit[best] if self.limit is not None else True)
        return best, score, accepted


def margins(entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How much better the best language is than the next, in deviations: per character, times the root of the length."""
    if entropies.shape[1] == 1:
        return np.sqrt(sizes)
    two = np.partition(entropies, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(sizes)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, points, n): distinct grams of the texts of each language; added up in the task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                points, real, _ = padded_points(texts, order)
                if len(real):
                    _, first, n = np.unique(gram_hashes(points, order)[-1][real], return_index=True, return_counts=True)
                    rows = points[real[first][:, None] + np.arange(1 - order, 1)].astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, order), pa.int32()), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), listed, pa.array(n, pa.int64())], ["lang", "points", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, points array<int>, n long").groupBy("lang", "points").agg(F.sum("n").alias("n"))


def _with_entropies(docs: DataFrame, shared, names: list[str], chunk_chars: int = 2 << 20) -> DataFrame:
    """docs (keys.., text) with ``chars`` and ``nats`` (per character and language) in place of the text."""
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= chunk_chars):
                    held, end = held + len(texts[end]), end + 1
                nats = shared.value.entropies(texts[at:end])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, nats.size + 1, nats.shape[1]), pa.int32()), pa.array(nats.ravel()))
                chars = pa.array([len(t) for t in texts[at:end]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:-1]), chars, listed], [*names, "chars", "nats"])
                at = end

    return docs.select(*[F.col(f"`{n}`") for n in names], "text").mapInArrow(score, f"{schema}, chars long, nats array<double>")


def train(docs: DataFrame, order: int = 4, max_docs: int = 5000, refuse: float = 0.001, enough: int = 20) -> Model | None:
    """A model from ``docs`` (lang, text, and a ``draw`` number in [0, 1) that says which rows are drawn first).

    Of each language about ``max_docs`` rows are drawn, evenly; a fifth of them is kept back for the
    calibration, but only where at least ``enough`` rows are outside the lowest fifth of the draw. A
    rarer language is learned from all its rows. The calibration gives a logistic curve from margins to the probability of being right, and per language
    the cross-entropy that only a share ``refuse`` of its texts exceeds. Gram counts come to the
    driver; their number is bounded by the sample. None if there is nothing to learn from.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("draw") >= 0.2).alias("rest")).collect()
    sizes, split = {r["lang"]: r["n"] for r in found}, [r["lang"] for r in found if r["rest"] >= enough]
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / n))) for lang, n in sorted(sizes.items())])
    drawn = rows.withColumn("part", F.col("draw") / share).filter("part < 1")
    kept_back = (F.col("part") < 0.2) & F.col("lang").isin(split)
    counted = gram_counts(drawn.filter(~kept_back), order).toArrow().to_pandas()
    if not len(counted):
        return None
    grams = np.stack(counted["points"].to_numpy())
    alphabet, languages = len(np.unique(grams[:, -1])), sorted(set(counted["lang"]))
    own = [(counted["lang"] == lang).to_numpy() for lang in languages]
    model = Model(languages, [kneser_ney(grams[m], counted["n"].to_numpy()[m], alphabet) for m in own], alphabet, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    back = _with_entropies(drawn.filter(kept_back), shared, ["lang"]).toArrow().to_pandas()
    back = back[(back["chars"] > 0) & back["lang"].isin(languages)]
    if len(back):
        nats, chars = np.stack(back["nats"].to_numpy()), back["chars"].to_numpy(float)
        right = np.array(languages)[nats.argmin(axis=1)] == back["lang"].to_numpy()
        model.slope, model.offset = _logistic(margins(nats, chars), right)
        low = nats.min(axis=1)
        model.limit = np.array([np.quantile(low[m], 1 - refuse) if (m := (back["lang"] == lang).to_numpy() & right).any() else np.inf for lang in languages])
    shared.unpersist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and offset by Newton steps; two made-up rows keep separable data finite."""
    x, y = np.concatenate([x, [0.0, 0.0]]), np.concatenate([y.astype(float), [0.0, 1.0]])
    scale = x.std() or 1.0
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - p) - 0.1 * w)
    return max(0.0, float(w[0] / scale)), float(w[1])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, cross_entropy) per row.

    The language of the lowest cross-entropy per character; ``score`` is its calibrated probability
    of being right, ``accepted`` is false where that is below a half or the text is unlike its own
    language. Cases: ``und`` with score 0 if the text is null or has no letter, or if nothing could
    be learned; a text of any length is read whole; repeated rows and null ids pass, other columns
    are ignored. No shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"), text.alias("text"))
    if model is None:
        return rows.select(id_col, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("cross_entropy"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            nats = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, score, accepted = m.judged(nats, batch.column(2).to_numpy().astype(float))
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            names = pa.array([m.languages[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.where(letters, score, 0.0)), pa.array(accepted & letters), pa.array(nats.min(axis=1))], [id_col, "lang_pred", "score", "accepted", "cross_entropy"])

    return _with_entropies(rows, shared, [id_col, "_letters"]).mapInArrow(judge, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean, cross_entropy double")


def draw(*columns: Column) -> Column:
    """An even number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 30)) / float(1 << 30)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(learned_from(F.col("doc_id"), 4)).withColumn("draw", draw(F.col("doc_id"), F.col("text"))))
    found = identify(docs, model)
    return found.select("doc_id", (~learned_from(F.col("doc_id"), 4)).alias("held_out"), "lang_pred", "score", "accepted")
