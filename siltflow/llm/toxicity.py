"""Toxicity by weak supervision.

Voters are lexicon voters (a fixed word list, and tokens mined from the training rows: words
and word beginnings that toxic rows hold far more often) and pattern voters (direct address,
shouting, exclamation runs, no lexicon hit).  A mined token counts as present, or as dense: one
word in DENSITY of a text at least, so that what a clean text has once by chance is no sign.
Of the mined tokens those become voters that reach toxic rows which few voters reach yet, so
that a language with few toxic rows has voters too; no language is told to the model.

A voter votes or abstains.  A generative label model, a mixture of two classes with a firing
rate for each voter and class, is fitted by expectation-maximisation; voters that fire together
within a class beyond chance are correlated, and such a group counts as one voter.  A linear
classifier is then trained on the posterior labels over all mined tokens and patterns, and
scores every text.

Training takes `most_rows` labelled rows at most, in the order of a hash of the key.

Defined results: null and empty texts get the score of a text without any feature; with no
training rows all scores are 0; repeated rows and clashing columns have no effect; tokens that
tie are taken in the order of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltflow.llm.textarrays import _SPACE, release, rolling, runs, span_hashes, text_bytes, text_slices

# Words that insult.
SEED_WORDS = "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool jerk imbecile garbage vermin filth".split()
# Direct address in four languages.
ADDRESS = "you are|you're|du bist|ihr seid|tu es|vous êtes|eres|sois"

PREFIXES = (4, 5, 6)
VOTERS = 128
FEATURES = 512
#: Voters that should reach each toxic row.
REACH = 8
#: Share of toxic ones among the rows that a voter, and that any mined token, has to reach at least.
PRECISE, LEAST_PRECISE = 0.93, 0.85
#: A token is dense in a text if it is one of so many words, or more often.
DENSITY = 100
#: Log-likelihood gain of a mined token at least: log of about a million tokens tried, and 2 more.
TRIED = 16.0
PATTERNS = ("address", "shouting", "exclamations", "no_hit")

_LETTERS_OUT = np.ones(256, bool)
_LETTERS_OUT[65:91] = _LETTERS_OUT[97:123] = _LETTERS_OUT[128:] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


_BARE = np.uint64((1 << 64) - 2)
_DENSE = np.uint64(1)


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: the hashes (even) of all words (runs of letters, lower case) and of their beginnings, the text of each, and how many words each text has."""
    lowered = pc.utf8_lower(texts)
    for a, b in text_slices(lowered):
        raw, starts = text_bytes(lowered.slice(a, b - a))
        begin, end = runs(raw, starts, _LETTERS_OUT)
        total = rolling(raw)
        row = np.searchsorted(starts, begin, side="right") - 1 + a
        found, rows = [span_hashes(total, begin, end)], [row]
        for k in PREFIXES:
            longer = end - begin > k
            found.append(span_hashes(total, begin[longer], begin[longer] + k) ^ np.uint64(k << 8))
            rows.append(row[longer])
        yield np.concatenate(found) & _BARE, np.concatenate(rows), np.bincount(row, minlength=len(texts))


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(rolling(raw), np.array([0]), np.array([len(raw)]))[0] & _BARE)


class Hits:
    """Which of a sorted set of tokens each text holds: even hashes present, odd ones (the even one and 1) dense."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.base = np.unique(known & _BARE)
        self.place = [self._places(self.base), self._places(self.base | _DENSE)]
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.base >> np.uint64(48)).astype(np.int64)] = True

    def _places(self, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted hash stands in the set, or -1."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        return np.where(self.known[at] == wanted, at, -1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, place in the set) pairs."""
        out_row, out_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.base):
            return out_row[0], out_at[0]
        for found, rows, words in tokens(texts):
            near = np.flatnonzero(self.quick[(found >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.base, found[near]), len(self.base) - 1)
            hit = self.base[at] == found[near]
            pair, often = np.unique(rows[near][hit] * len(self.base) + at[hit], return_counts=True)
            row, at = pair // len(self.base), pair % len(self.base)
            dense = often * DENSITY >= words[row]
            for place, which in ((self.place[0][at], slice(None)), (self.place[1][at][dense], dense)):
                there = place >= 0
                out_row.append(row[which][there])
                out_at.append(place[there])
        return np.concatenate(out_row), np.concatenate(out_at)


def patterns(texts: pa.Array) -> np.ndarray:
    """A column for each of PATTERNS but the last."""
    out = np.zeros((len(texts), len(PATTERNS)), bool)
    body = pc.fill_null(texts, "")
    out[:, 0] = pc.match_substring_regex(body, rf"(?i)\b({ADDRESS})\b").to_numpy(zero_copy_only=False)
    for a, b in text_slices(body):
        raw, starts = text_bytes(body.slice(a, b - a))
        letters, upper, marks, spaces = (np.concatenate(([0], np.cumsum(x, dtype=np.int32))) for x in (~_LETTERS_OUT[raw], _UPPER[raw], raw == 33, _SPACE[raw]))
        some = lambda x: x[starts[1:]] - x[starts[:-1]]  # noqa: E731, B023
        out[a:b, 1] = some(upper) > 0.6 * np.maximum(1, some(letters))
        out[a:b, 2] = some(marks) > 0.2 * (1 + some(spaces))
    return out


def label_model(votes: np.ndarray, clean: int, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row of a 0/1 matrix of votes; the voters' accuracies; the number of voters in each one's correlated group.

    `clean` is the voter that votes for the other class.
    """
    fired = votes.astype(np.float64)
    others = np.delete(np.arange(votes.shape[1]), clean)
    q = np.where(votes[:, others[: max(1, len(others) - len(PATTERNS) + 1)]].any(axis=1), 0.9, 0.02)
    group = np.ones(votes.shape[1])
    for turn in range(rounds):
        on, off = q.sum() + 1e-9, (1 - q).sum() + 1e-9
        rate1 = (q @ fired + 0.5 * prior) / (on + 1)
        rate0 = ((1 - q) @ fired + 0.5 * (1 - prior) * fired.mean(0)) / (off + 1)
        rate1, rate0 = np.clip(rate1, 1e-4, 1 - 1e-4), np.clip(rate0, 1e-4, 1 - 1e-4)
        if turn in (2, 8):
            centred = (fired - rate1) * np.sqrt(q)[:, None]
            var = np.maximum((centred**2).sum(0), 1e-9)
            corr = centred.T @ centred / np.sqrt(var[:, None] * var[None, :])
            group = (corr > 0.35).sum(1).clip(1)
        weight = 1.0 / group
        logit = np.log(prior / (1 - prior)) + (fired * weight) @ np.log(rate1 / rate0) + ((1 - fired) * weight) @ np.log((1 - rate1) / (1 - rate0))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    share = np.where(np.arange(votes.shape[1]) == clean, rate0 * (1 - prior), rate1 * prior)
    return q, share / (rate1 * prior + rate0 * (1 - prior)), group


def _fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) / len(x) + keep * w * (10 / len(x))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(x) + np.diag(keep * 10 / len(x))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return w


class ToxicityModel:
    def __init__(self, known: np.ndarray, voters: np.ndarray, weights: np.ndarray, accuracies: dict[str, float]):
        self.known, self.voter, self.weights, self.accuracies = known, np.isin(known, voters), weights, accuracies

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.weights[-1])
        rows, at = Hits(self.known)(texts)
        np.add.at(total, rows, self.weights[at])
        seen = patterns(texts)
        seen[:, -1] = np.bincount(rows[self.voter[at]], minlength=len(texts)) == 0
        total += seen @ self.weights[len(self.known) : -1]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _counts(rows: DataFrame, known: np.ndarray | None, most: int = 1 << 20) -> DataFrame:
    """Of each token, present or dense, the rows that hold it: token, n; summed in each task first.  known: only these."""
    base = None if known is None else np.unique(known & _BARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for found, text, words in tokens(batch.column(0)):
                if base is not None:
                    at = np.minimum(np.searchsorted(base, found), len(base) - 1)
                    keep = base[at] == found
                    found, text = found[keep], text[keep]
                order = np.lexsort((text, found))
                found, text = found[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (text[1:] != text[:-1])))) if len(found) else np.zeros(0, np.int64)
                often = np.diff(np.append(first, len(found)))
                token, dense = found[first], often * DENSITY >= words[text[first]]
                once = [np.unique(x, return_counts=True) for x in (token, token[dense] | _DENSE)]
                values, place = np.unique(np.concatenate([values, *(x[0] for x in once)]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([sums, *(x[1] for x in once)]), len(values)).astype(np.int64)
        if known is not None and len(values):
            keep = np.isin(values, known)
            values, sums = values[keep], sums[keep]
        for k in range(0, len(values), most):
            yield pa.RecordBatch.from_arrays([pa.array(values[k : k + most].view(np.int64)), pa.array(sums[k : k + most])], ["token", "n"])

    return rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _mined(sample: DataFrame, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that are far likelier in toxic rows than chance would have it among all the tokens tried, best first, and how precise each is."""
    # the sample bounds all of this
    often = _counts(sample.where("label = 1"), None).where(F.col("n") >= max(3, n1 // 300)).toArrow()
    candidates, n_pos = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy().astype(np.float64)
    order = np.argsort(candidates)
    candidates, n_pos = candidates[order], n_pos[order]
    n_neg = np.zeros(len(candidates))
    if len(candidates):
        others = _counts(sample.where("label = 0"), candidates).toArrow()
        n_neg[np.searchsorted(candidates, others["token"].to_numpy().view(np.uint64))] = others["n"].to_numpy()
    odds = np.log((n_pos + 0.5) / (n1 + 1)) - np.log((n_neg + 0.5) / (n0 + 1))
    share, both = n1 / (n1 + n0), n_pos + n_neg
    gain = n_pos * np.log(np.maximum(n_pos, 1e-9) / np.maximum(both * share, 1e-9)) + n_neg * np.log(np.maximum(n_neg, 1e-9) / np.maximum(both * (1 - share), 1e-9))
    precise = n_pos / np.maximum(1, both)
    ranked = np.argsort(-(n_pos * odds), kind="stable")
    sure = ranked[((odds > 2.5) & (gain > TRIED) & (precise >= LEAST_PRECISE))[ranked]]
    return candidates[sure], precise[sure]


def _reaching(held: np.ndarray, most: int) -> list[int]:
    """Columns, best first, each of which reaches a row (of toxic ones) that fewer than REACH of those taken before reach."""
    reached, out = np.zeros(len(held), np.int64), []
    for k in range(held.shape[1]):
        if len(out) == most:
            break
        if (reached[held[:, k]] < REACH).any():
            out.append(k)
            reached[held[:, k]] += 1
    return out


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds_n: int = 5, held_out: int = 0, most_rows: int = 10_000, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    from siltflow.llm import folds, storage

    sample = storage.materialize(folds.training_rows(docs, labels, target, folds_n, held_out, most_rows, key, text), "toxicity-sample")
    sizes = {x["label"]: x["n"] for x in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    seeds = np.unique(np.array([_word_hash(x) for x in SEED_WORDS], np.uint64))
    if not n1 + n0:
        return ToxicityModel(seeds, seeds, np.concatenate((np.zeros(len(seeds) + len(PATTERNS)), [-30.0])), {})
    mined, precise = _mined(sample, n1, n0)
    mined, precise = mined[: 8 * FEATURES], precise[: 8 * FEATURES]
    known = np.unique(np.concatenate((seeds, mined)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Hits(known)
        for batch in batches:
            texts = batch.column(0)
            rows, at = look(texts)
            lists: list[list[int]] = [[] for _ in range(len(texts))]
            for r, a in zip(rows.tolist(), at.tolist(), strict=True):
                lists[r].append(a)
            for r, row in enumerate(patterns(texts)):
                lists[r] += [len(known) + int(k) for k in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["label", "at"])

    got = sample.select("text", "label").mapInArrow(hits, "label int, at array<int>").collect()  # most_rows rows
    x = np.zeros((len(got), len(known) + len(PATTERNS)), bool)
    for r, row in enumerate(got):
        x[r, row["at"]] = True
    # of the mined tokens, the voters and as many more features as there may be
    toxic = np.array([row["label"] == 1 for row in got])
    at = np.searchsorted(known, mined)
    strong = np.flatnonzero(precise >= PRECISE)
    voters = np.unique(np.concatenate((seeds, mined[strong[_reaching(x[toxic][:, at[strong]], VOTERS)]])))
    chosen = mined[_reaching(x[toxic][:, at], FEATURES)]
    keep = np.isin(known, np.concatenate((voters, chosen)))
    x, known = x[:, np.concatenate((keep, np.ones(len(PATTERNS), bool)))], known[keep]
    of_voters = np.searchsorted(known, voters)
    x[:, -1] = ~x[:, of_voters].any(axis=1)
    votes = np.concatenate((x[:, of_voters], x[:, len(known) :]), axis=1)
    posterior, accuracy, _ = label_model(votes, votes.shape[1] - 1, float(np.clip(n1 / (n1 + n0), 0.005, 0.5)))
    weights = _fit_linear(x.astype(np.float64), posterior)
    names = [f"token {int(h):016x}" for h in voters] + list(PATTERNS)
    return ToxicityModel(known, voters, weights, dict(zip(names, accuracy.tolist(), strict=True)))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is toxic."""

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array(model.score(texts))
        release()
        return out

    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))
