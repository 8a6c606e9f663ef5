"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes that a document is good (1), bad (-1), or abstains (0), which tells nothing.
Votes are counted by pattern; over these patterns (3 to the number of rules at most)
expectation-maximisation, begun from "no bad vote is good", estimates the share of good
documents and of each of the KINDS of bad ones, and how often each rule, when it votes, is
right on these; the posterior probability of being good decides.

Defined results: a document with null, empty or blank text has no words and fails the base
rules; repeated rows are judged one by one; a posterior of one half keeps; an empty table gives an empty table; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltflow.llm.native_text import SPACES, with_shingles, words

WINDOW = 5

# What a rule divides by words, and from where on it is bad or good.
#   name: (numerator, good from or to, bad from or to); the order of the two says which way
RULES = {
    "length": ("n_words", 50, 9),
    "symbols": ("n_symbols", 0.02, 0.1),
    "capitals": ("n_capitals", 0.05, 0.3),
    "exclamations": ("n_exclamations", 0.05, 0.3),
    "stops": ("n_stops", 0.02, 0.005),
    "repeats": ("n_repeat_words", 0.05, 0.2),
    "lines": ("n_dup_lines", 0.0, 0.3),
    "richness": ("n_distinct", 0.3, 0.1),
}
# The rules that tell of one kind of bad documents.
KINDS = (("symbols",), ("capitals", "exclamations"), ("repeats", "lines", "richness"), ("length", "stops", "word_length"))
#: A word of so many characters on average is usual.
WORD_CHARS = (2.5, 12.0)


def _occurrences(text: Column, chars: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c in chars).cast("long")


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that rules go by, a row for each document.

    n_repeat_words: words in windows of five words that the text holds twice or more.  Windows
    are compared by 64-bit hashes; only texts with equal ones have them sorted.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    base = rows.select(
        "doc_id",
        _occurrences(body, "#*$%&|<>").alias("n_symbols"),
        _occurrences(body, "!").alias("n_exclamations"),
        _occurrences(body, ".").alias("n_stops"),
        F.regexp_count(body, F.lit("[A-Z]{3,}")).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
        words(F.col("text")).alias("_words"),
    )
    seen = with_shingles(base, "_words", (WINDOW,), "_windows")
    counted = seen.select(
        "doc_id", "n_symbols", "n_exclamations", "n_stops", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).alias("_windows"),
    )
    ranked = counted.withColumn("_sorted", F.when(F.col("_windows").isNotNull(), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def same(x: Column, k: Column) -> Column:
        neighbour = lambda at: F.coalesce(F.get(F.col("_sorted"), at)["h"] == x["h"], F.lit(False))
        return ((k > 0) & neighbour(k - 1)) | neighbour(k + 1)

    places = F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return ranked.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_sorted").isNotNull(), covered), F.lit(0)).cast("long")).drop("_windows", "_sorted")


def votes() -> dict[str, Column]:
    """The vote of each rule, as columns over metrics()."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    out = {}
    for name, (count, good, bad) in RULES.items():
        by = F.col("n_words") if name == "length" else F.col(count) / (F.greatest(F.col("n_lines"), F.lit(1)) if name == "lines" else n)
        high = good > bad
        out[name] = F.when((by >= good) if high else (by <= good), 1).when((by <= bad) if high else (by >= bad), -1).otherwise(0)
    mean = F.col("word_chars") / n
    out["word_length"] = F.when(mean.between(*WORD_CHARS), F.when(mean.between(3.0, 10.0), 1).otherwise(0)).otherwise(-1)
    return {f"v_{k}": v.cast("int") for k, v in out.items()}


class LabelModel:
    """The shares of good documents and of each kind of bad ones, and for each of these, each rule and vote, P(vote | class, votes)."""

    def __init__(self, shares: list[float], rates: list[dict[str, dict[int, float]]]):
        self.shares, self.rates = shares, rates

    def _odds(self, k: int) -> Column:
        """P(class k) / P(good) given the votes."""
        logit = F.lit(math.log(self.shares[k] / self.shares[0]))
        for name in self.rates[k]:
            case = F.lit(0.0)
            for v in (-1, 1):
                case = F.when(F.col(name) == v, math.log(self.rates[k][name][v] / self.rates[0][name][v])).otherwise(case)
            logit = logit + case
        return F.exp(F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))

    def classes(self) -> list[Column]:
        """The posterior probability of each class, the good one first."""
        odds = [F.lit(1.0)] + [self._odds(k) for k in range(1, len(self.shares))]
        total = sum(odds[1:], odds[0])
        return [x / total for x in odds]


def fit(voted: DataFrame, names: list[str], rounds: int = 12) -> LabelModel:
    """Expectation-maximisation over the patterns of the votes of all rows."""
    from siltflow.llm import storage

    patterns = storage.materialize(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "vote-patterns")
    hit = [F.greatest(*[(F.col(f"v_{x}") < 0).cast("double") for x in group], F.lit(0.0)) for group in KINDS]
    some = sum(hit[1:], hit[0])
    bad = F.when(some > 0, 0.9).otherwise(0.05)
    q = [1 - bad] + [bad * F.when(some > 0, x / some).otherwise(1 / len(KINDS)) for x in hit]
    model = LabelModel([1 / len(q)] * len(q), [{x: {-1: 0.5, 1: 0.5} for x in names}] * len(q))
    for turn in range(rounds):
        weighed = patterns.select("n", *names, *[(F.col("n") * x).alias(f"q{k}") for k, x in enumerate(q)])
        sums = [F.sum(f"q{k}").alias(f"q{k}") for k in range(len(q))]
        sums += [F.sum(F.when(F.col(x) == v, F.col(f"q{k}")).otherwise(0.0)).alias(f"{k}{v}{x}") for k in range(len(q)) for x in names for v in (-1, 1)]
        got = weighed.agg(*sums).first().asDict()  # one row
        total = sum(got[f"q{k}"] or 0.0 for k in range(len(q)))
        if not total:
            return model
        # a tenth of a vote each way is added, so that no rule is beyond doubt
        rates = [{x: {v: (got[f"{k}{v}{x}"] + 0.1) / (got[f"{k}-1{x}"] + got[f"{k}1{x}"] + 0.2) for v in (-1, 1)} for x in names} for k in range(len(q))]
        new = LabelModel([(got[f"q{k}"] + 1) / (total + len(q)) for k in range(len(q))], rates)
        done = turn and max(abs(x - y) for x, y in zip(new.shares, model.shares, strict=True)) < 1e-4
        model, q = new, new.classes()
        if done:
            break
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """metrics(), the votes, quality (posterior probability), base_failed and kept."""
    from siltflow.llm import storage

    known = votes()
    measured = storage.materialize(metrics(docs, key, text).withColumns(known), "rule-votes")
    model = fit(measured, list(known))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("quality", model.classes()[0]).withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= 0.5)})
