"""Quality classification from positive and unlabelled texts.

A linear model of style features is fitted by minimising the unbiased risk of logistic loss,
R = -p * mean over trusted positives of z + mean over unlabelled texts of log(1 + e^z), where
p is the class prior, by Newton's method; each step is one pass over the features of every
unlabelled document.  The part of the risk that stands for the negatives,
mean_U log(1 + e^z) - p * mean_P log(1 + e^z), may not fall below zero: a step that would
take it there is halved until it doesn't.  The prior is estimated first: the least ratio of unlabelled to
positive mass over the tails of a first model's scores bounds it from above.

Trusted positives: labelled training rows with label 1, `most_positives` of these at most.
Unlabelled: all documents, whatever their label.

Defined results: null and empty texts have features of zero and get a score like any other;
with no trusted positives every score is 0.5; repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.llm.textarrays import release, shingle_hashes, text_bytes, text_slices, word_hashes

FEATURES = ("log_bytes", "upper", "symbol", "digit", "space", "other_bytes", "word_bytes", "distinct_words", "distinct_pairs", "top_word", "line_words", "stops", "bars", "repeat_next", "marks")

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, [ord(x) for x in "#*$%&<>@^~=+_{}[]\\"]] = True
_CLASSES[2, 48:58] = True
_CLASSES[3, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CLASSES[4, 128:] = True
_CLASSES[5, [ord("."), ord(",")]] = True
_CLASSES[6, ord("|")] = True
_CLASSES[7, [ord(x) for x in "!?"]] = True


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = []
    for a, b in text_slices(texts):
        own = texts.slice(a, b - a)
        raw, starts = text_bytes(own)
        n = np.diff(starts)
        rows = np.zeros((b - a, len(FEATURES)))
        size = np.maximum(n, 1)
        sums = []
        for mask in _CLASSES:
            upto = np.concatenate(([0], np.cumsum(mask[raw], dtype=np.int32)))
            sums.append(upto[starts[1:]] - upto[starts[:-1]])
        upper, symbol, digit, space, high, stop, bar, mark = sums
        words, at = word_hashes(own)
        count = np.diff(at)
        some = np.maximum(count, 1)
        newline = np.concatenate(([0], np.cumsum(raw == 10, dtype=np.int32)))
        lines = newline[starts[1:]] - newline[starts[:-1]] + 1
        rows[:, 0] = np.log1p(n)
        rows[:, 1] = upper / size
        rows[:, 2] = np.minimum(1, symbol / some)
        rows[:, 3] = digit / size
        rows[:, 4] = space / size
        rows[:, 5] = high / size
        rows[:, 6] = np.log1p((n - space) / some)
        rows[:, 10] = np.log1p(count / lines)
        rows[:, 11] = stop / some
        rows[:, 12] = np.minimum(1, bar / some)
        rows[:, 14] = np.minimum(2, mark / some)
        same = np.zeros(len(words), np.int32)
        if len(words) > 1:
            same[1:] = words[1:] == words[:-1]
            same[at[:-1][at[:-1] < len(words)]] = 0
        again = np.concatenate(([0], np.cumsum(same, dtype=np.int32)))
        rows[:, 13] = (again[at[1:]] - again[at[:-1]]) / some
        for k, pair in enumerate(shingle_hashes(words, at, 2)):
            if count[k]:
                part = np.sort(words[at[k] : at[k + 1]])
                edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                runs = np.diff(edges)
                # what a text of its length repeats by chance is taken out
                rows[k, 7] = np.log(len(runs)) - 0.8 * np.log(count[k])
                rows[k, 8] = len(pair) / max(1, count[k] - 1)
                rows[k, 9] = runs.max() / count[k]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def expand(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares, and 1."""
    z = np.clip((rows - centre) / scale, -6, 6)
    return np.concatenate((z, z * z, np.ones((len(rows), 1))), axis=1)


def feature_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    def run(texts: pa.Array) -> pa.Array:
        found = features(texts).astype(np.float32)
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    return docs.withColumn("features", F.arrow_udf(run, "array<float>")(F.col(text)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)


def _summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum over all rows of part(matrix), a vector of `width` numbers; one row comes back from each task and one in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total = total + part(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(width)
    for x in rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[x["k"]] = x["v"]
    return out


class QualityModel:
    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expand(rows, self.centre, self.scale) @ self.weights, -30, 30)))


def _prior(positive: np.ndarray, unlabelled: np.ndarray, n: float) -> float:
    """The least ratio of unlabelled to positive mass in the upper tails of a score, with a margin for small counts."""
    p, u = np.cumsum(positive[::-1])[::-1], np.cumsum(unlabelled[::-1])[::-1]
    ok = p >= max(10, 0.1 * p[0])
    ratio = (u[ok] / n) / (p[ok] / p[0])
    return float(np.clip(ratio.min() if len(ratio) else 0.9, 0.05, 0.98))


def fit(unlabelled: DataFrame, positives: DataFrame, steps: int = 10, ridge: float = 1e-3) -> QualityModel:
    """Fit on the `features` columns of both; the positives' rows are collected and have to be bounded."""
    width = len(FEATURES)
    got = positives.select("features").collect()
    pos = np.array([x["features"] for x in got], np.float64).reshape(-1, width)
    first = _summed(unlabelled.select("features"), lambda m: np.concatenate(([len(m)], m.sum(0), (m * m).sum(0))), 1 + 2 * width)
    n = max(first[0], 1)
    centre = first[1 : 1 + width] / n
    scale = np.sqrt(np.maximum(first[1 + width :] / n - centre**2, 1e-6))
    dims = 2 * width + 1
    weights = np.zeros(dims)
    if not len(pos):
        return QualityModel(centre, scale, weights, 0.5)
    xp = expand(pos, centre, scale)
    mean_p = xp.mean(0)

    def passed(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(m: np.ndarray) -> np.ndarray:
            x = expand(m, centre, scale)
            z = x @ w
            s = 1 / (1 + np.exp(-z))
            return np.concatenate(([np.logaddexp(0, z).sum()], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()))

        total = _summed(unlabelled.select("features"), part, 1 + dims + dims * dims) / n
        return total[0], total[1 : 1 + dims], total[1 + dims :].reshape(dims, dims)

    def newton(prior: float, w: np.ndarray, rounds: int) -> np.ndarray:
        risk, grad, curve = passed(w)
        while risk - prior * np.logaddexp(0, xp @ w).mean() < 0:  # at zero weights it is (1 - prior) ln 2
            w = w / 2
            risk, grad, curve = passed(w)
        for _ in range(rounds):
            slope = grad - prior * mean_p + ridge * w
            step = np.linalg.solve(curve + ridge * np.eye(dims), slope)
            size = 1.0
            step *= min(1.0, 8.0 / max(1e-9, np.abs(step).max()))
            while True:
                trial = w - size * step
                risk, grad, curve = passed(trial)
                negative = risk - prior * np.logaddexp(0, xp @ trial).mean()
                if negative >= 0 or size < 0.1:
                    break
                size /= 2
            if negative < 0:
                break
            w = trial
            if np.abs(size * step).max() < 0.02:
                break
        return w

    start = newton(0.5, weights, 4)
    edges = np.linspace(-8, 8, 161)
    bins = lambda m: np.bincount(np.clip(np.digitize(expand(m, centre, scale) @ start, edges), 0, 161), minlength=162).astype(np.float64)
    prior = _prior(bins(pos), _summed(unlabelled.select("features"), bins, 162), n)
    return QualityModel(centre, scale, newton(prior, start, steps), prior)


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, features: held in the shared folder."""
    from siltflow.llm import storage

    rows = feature_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")
    return storage.materialize(rows.select("doc_id", "features"), "quality-features")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", folds_n: int = 5, held_out: int = 0, most_positives: int = 20_000, key: str = "doc_id", text: str = "text") -> QualityModel:
    return fit_labels(feature_table(docs, key, text), labels, target, folds_n, held_out, most_positives, key)


def fit_labels(rows: DataFrame, labels: DataFrame, target: str = "quality", folds_n: int = 5, held_out: int = 0, most_positives: int = 20_000, key: str = "doc_id") -> QualityModel:
    """Fit on a feature_table: all rows are the unlabelled side, trusted positives are its rows that are labelled 1 outside the held-out fold."""
    from siltflow.llm import folds

    marked = labels.where((folds.remainder(key, folds_n) != held_out) & (F.col(target) == 1)).select(F.col(key).alias("doc_id")).distinct()
    trusted = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positives)  # most_positives keys: may be broadcast
    return fit(rows, rows.join(F.broadcast(trusted), "doc_id", "left_semi"))


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is of good quality."""

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array(model.score(features(texts)))
        release()
        return out

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def score_features(rows: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """score() for a feature_table."""

    def run(held: pa.Array) -> pa.Array:
        return pa.array(model.score(held.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)))

    return rows.withColumn(out, F.arrow_udf(run, "double")(F.col("features")))
