"""Toxicity scores: a linear classifier on character n-grams whose features are scaled by naive Bayes
log-count ratios.

A text's features are the distinct character n-grams (orders 3 to 5, lower-cased, hashed to 2**18 buckets) of the
whole text. Each feature carries the log ratio of its smoothed share among toxic and other training texts; logistic
regression is then fitted on the scaled features with L-BFGS in numpy, with both classes weighing the same.

The fit is on a bounded sample of labelled rows: at most ``per_class`` of each class, chosen by a hash of the id.
Scoring streams Arrow batches through numpy; nothing of the corpus is gathered.

Defined results: a null text counts as empty and scores the intercept; very long texts are read whole; repeated rows each
get a row; ids may be null;
conflicting labels of one id count as toxic; without labelled rows of both classes every score is 0.0; an empty
table gives no rows. Columns beyond the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_crc, worker_cache

ORDERS = (3, 4, 5)
BITS = 18
_BASE = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class ToxicityModel:
    """weights[b]: what bucket b adds to the log odds (its ratio times its coefficient)."""

    weights: np.ndarray
    bias: float
    fitted: bool = True


def ngram_buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct feature buckets of a whole text, in no special order."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    found = []
    rolling = codes
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        rolling = rolling[:-1] * _BASE + codes[order - 1 :]
        if order in ORDERS:
            mixed = (rolling ^ (rolling >> np.uint32(15))) * _MIX
            found.append(mixed >> np.uint32(32 - bits))
    if not found:
        return np.empty(0, np.int64)
    every = np.concatenate(found).astype(np.int64)
    stamp = worker_cache("toxicity").setdefault(bits, np.zeros(1 << bits, np.int64))
    places = np.arange(len(every))
    stamp[every] = places
    return every[stamp[every] == places]


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -500, 500))))


def _lbfgs(value_and_gradient, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    f, g = value_and_gradient(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * s.dot(q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _rho = pairs[-1]
            q *= s.dot(y) / y.dot(y)
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - rho * y.dot(q)) * s
        slope, t = -g.dot(q), 1.0 if pairs else 1.0 / max(1.0, float(np.abs(g).sum()))
        for _ in range(20):
            f_new, g_new = value_and_gradient(x - t * q)
            if f_new <= f + 1e-4 * t * slope:
                break
            t /= 2
        s, y = -t * q, g_new - g
        x, done = x + s, f - f_new < 1e-7 * max(1.0, abs(f))
        f, g = f_new, g_new
        if s.dot(y) > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1.0 / s.dot(y))]
        if done:
            break
    return x


def fit_rows(texts: list[str | None], labels: list[int], *, bits: int = BITS, smoothing: float = 1.0, ridge: float = 1e-3, steps: int = 40) -> ToxicityModel:
    """Fit on texts and 0/1 labels in memory."""
    y = np.asarray(labels, dtype=np.int8)
    if not (y == 1).any() or not (y == 0).any():
        return ToxicityModel(np.zeros(1 << bits, np.float32), 0.0, fitted=False)
    # Only the buckets of the texts are kept, at 4 bytes each; products are made for some texts at a time.
    groups: list[tuple[np.ndarray, np.ndarray, slice]] = []
    for at in range(0, len(texts), 100):
        rows = [ngram_buckets(t, bits).astype(np.int32) for t in texts[at : at + 100]]
        groups.append((np.concatenate(rows), np.array([len(r) for r in rows]), slice(at, at + len(rows))))
    toxic, other = np.full(1 << bits, smoothing), np.full(1 << bits, smoothing)
    for flat, sizes, own in groups:
        marked = np.repeat(y[own] == 1, sizes)
        toxic += np.bincount(flat[marked], minlength=1 << bits)
        other += np.bincount(flat[~marked], minlength=1 << bits)
    # Shares of texts that hold the feature, so that a longer class doesn't tilt every ratio.
    ratio = np.log(toxic / ((y == 1).sum() + 2 * smoothing)) - np.log(other / ((y == 0).sum() + 2 * smoothing))
    ratio[(toxic == smoothing) & (other == smoothing)] = 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    target = np.where(y == 1, 1.0, -1.0)

    def value_and_gradient(x: np.ndarray):
        each, gradient, loss, bias = ratio * x[:-1], np.zeros(1 << bits), 0.5 * ridge * float(x[:-1].dot(x[:-1])), 0.0
        for flat, sizes, own in groups:
            ends = np.cumsum(sizes)
            running = np.concatenate([[0.0], np.cumsum(each[flat])])
            margins = target[own] * (running[ends] - running[ends - sizes] + x[-1])
            loss += float((weight[own] * np.logaddexp(0.0, -margins)).sum())
            pull = -weight[own] * target[own] / (1.0 + np.exp(np.clip(margins, -500, 500)))
            gradient += np.bincount(flat, weights=np.repeat(pull, sizes), minlength=1 << bits)
            bias += float(pull.sum())
        return loss, np.append(ratio * gradient + ridge * x[:-1], bias)

    x = _lbfgs(value_and_gradient, np.zeros((1 << bits) + 1), steps)
    return ToxicityModel((ratio * x[:-1]).astype(np.float32), float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1200) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class, smallest hash of the id first.

    The ids are chosen from the narrow labels alone; their texts then come by a broadcast of those ids.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    known = known.withColumn("_h", F.xxhash64("_id"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("_y") == value).orderBy("_h", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.select("_id", "_y")), "_id")
    rows = picked.dropDuplicates(["_id"]).toPandas().sort_values("_id")
    return fit_rows(rows["_text"].tolist(), rows["_y"].tolist())


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    weights, bias, fitted = model.weights, model.bias, model.fitted
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [sigmoid(weights[ngram_buckets(t)].sum(dtype=np.float64) + bias) if fitted else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["id", "score", "predicted"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The fold to learn from: ids whose crc32 leaves a remainder other than 0 by 5."""
    return labels.filter(id_crc(F.col(id_col)) % 5 != 0)


def reject_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier, fitted on the training fold, doesn't call toxic; all columns stay.

    The text is scored in the same pass that carries the row, so nothing is shuffled.
    """
    model = fit(docs, training_labels(labels, id_col), id_col=id_col, text_col=text_col)
    if not model.fitted or not docs.columns:
        return docs
    weights, bias, at = model.weights, model.bias, docs.columns.index(text_col)
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [sigmoid(weights[ngram_buckets(t)].sum(dtype=np.float64) + bias) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
