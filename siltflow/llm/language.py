"""Language identification by prediction by partial matching.

For each language a byte context tree of up to three bytes of context is counted over
lower-cased training texts and then frozen.  A byte that a context has followed by n of its
T bytes, of q kinds, costs -log2(n / (T + q)) bits; another one costs the escape,
-log2(q / (T + q)), and what it costs in the context one byte shorter (a context that was
never met costs nothing to leave); below order 0 all 256 bytes are alike.  These costs are
exact for every context and byte, and are laid out as one row of a table for each context
that any language has met; each byte of a text is then one look-up for all languages.  The
language with the shortest code wins; the score is its share of 2^-bits.

Training takes `most_docs` documents a language at most, in the order of a hash of the key,
and of these whole texts up to `most_bytes` bytes; texts of over `longest` bytes are not
trained on.  Scoring takes whole texts.

Defined results: null texts, texts without a letter, and all texts if nothing was learned,
are `und` with score 0; ties go to the language that sorts first; repeated rows and clashing
columns have no effect.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltflow.llm import folds, storage
from siltflow.llm.textarrays import text_bytes, text_slices

ORDER = 3
UNKNOWN = "und"

_tables: dict[str, tuple] = {}


class ContextModel:
    """Counts of byte n-grams of 1 to ORDER + 1 bytes, by language."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = np.zeros(256, bool)
        for own in texts.values():
            for text in own:
                seen[np.unique(np.frombuffer(text, np.uint8))] = True
        #: symbol 0 is the beginning of a text and all bytes that training never met, which no context tells apart
        self.symbols = np.zeros(256, np.int64)
        self.symbols[seen] = np.arange(1, seen.sum() + 1)
        self.size = int(seen.sum()) + 1
        self.counts = [self._count(texts[x]) for x in self.languages]

    def _count(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        codes, real = self.padded(texts)
        out, value = [], np.zeros(len(codes), np.int64)
        for order in range(ORDER + 1):
            value[order:] += codes[: len(codes) - order] * self.size**order
            out.append(np.unique(value[real], return_counts=True))
        return out

    def padded(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts with ORDER times symbol 0 before each, and the places of the texts' own bytes."""
        gap = b"\0" * ORDER
        raw = np.frombuffer(b"".join(gap + x for x in texts), np.uint8)
        own = np.ones(len(raw), bool)
        at = 0
        for x in texts:
            own[at : at + ORDER] = False
            at += ORDER + len(x)
        codes = np.where(own, self.symbols[raw], 0)
        return codes, np.flatnonzero(own)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each context of ORDER symbols, and bits by row, symbol and language."""
        size, kinds = self.size, len(self.languages)
        base = np.empty((1, size, kinds))
        base[:] = 8.0
        rows = {0: np.zeros(1, np.int64)}
        bits = {-1: base}
        contexts: dict[int, np.ndarray] = {}
        for order in range(ORDER + 1):
            grams = [own[order] for own in self.counts]
            known = np.unique(np.concatenate([g // size for g, _ in grams])) if order else np.zeros(1, np.int64)
            if order == 0:
                lower = np.repeat(base, 1, axis=0)
            else:
                shorter = known % size ** (order - 1)
                at = np.searchsorted(contexts[order - 1], shorter)
                lower = bits[order - 1][at]
            mine = lower.copy()
            for k, (gram, count) in enumerate(grams):
                context, symbol = gram // size, gram % size
                row = np.searchsorted(known, context)
                total = np.bincount(row, count, len(known))
                kind = np.bincount(row, minlength=len(known))
                met = total > 0
                mine[met, :, k] -= np.log2(kind[met] / (total[met] + kind[met]))[:, None]
                mine[row, symbol, k] = -np.log2(count / (total[row] + kind[row]))
            contexts[order], bits[order] = known, mine
        starts = np.cumsum([0] + [len(contexts[k]) for k in range(ORDER)])
        index = np.arange(size**ORDER)
        place = np.zeros(size**ORDER, np.int32)
        for order in range(1, ORDER + 1):  # the longest context that was met wins
            short = index % size**order
            at = np.minimum(np.searchsorted(contexts[order], short), len(contexts[order]) - 1)
            hit = contexts[order][at] == short
            place[hit] = (starts[order] + at[hit]).astype(np.int32)
        return place, np.concatenate([bits[k] for k in range(ORDER + 1)]).astype(np.float32)


def _bits(texts: pa.Array, model: ContextModel, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Code length of each text under each language."""
    place, table = tables
    flat = table.reshape(-1, table.shape[2])
    out = []
    for a, b in text_slices(texts, 1 << 20):
        raw, starts = text_bytes(texts.slice(a, b - a))
        lengths = np.diff(starts)
        codes = model.symbols[raw]
        context = np.zeros(len(raw), np.int64)
        since = np.arange(len(raw)) - np.repeat(starts[:-1], lengths)
        for back in range(1, ORDER + 1):
            earlier = np.zeros(len(raw), np.int64)
            earlier[back:] = codes[:-back] if len(raw) > back else 0
            earlier[since < back] = 0
            context += earlier * model.size ** (back - 1)
        costs = flat[place[context].astype(np.int64) * model.size + codes]
        sums = np.zeros((b - a, flat.shape[1]))
        some = np.flatnonzero(lengths)
        if len(some):
            sums[some] = np.add.reduceat(costs, starts[:-1][some], axis=0, dtype=np.float64)
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, flat.shape[1]))


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", most_docs: int = 400, most_bytes: int = 400_000, longest: int = 1 << 20) -> ContextModel:
    """Learn from the rows of docs that have a language."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where(F.octet_length("text").between(1, longest)).withColumn("u", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30))
    sizes = {x["lang"]: x["n"] for x in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each language
    kept: dict[str, list[bytes]] = {}
    if sizes:
        shares = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, float(most_docs / n))])
        sample = rows.where(F.col("u") < shares[F.col("lang")]).select("lang", "u", "text")
        # about most_docs rows a language, of which the first most_bytes come to the driver
        before = Window.partitionBy("lang").orderBy("u", "text").rowsBetween(Window.unboundedPreceding, -1)
        sample = sample.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
        found = sample.where(F.col("before") < most_bytes).select("lang", "u", "text").collect()
        for x in sorted(found, key=lambda x: (x["lang"], x["u"], x["text"])):
            kept.setdefault(x["lang"], []).append(x["text"].lower().encode())
    return ContextModel(kept)


def predict(docs: DataFrame, model: ContextModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score."""
    if not model.languages:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    storage.bound_batches(docs.sparkSession)
    packed = pickle.dumps(model)
    name = hashlib.sha256(packed).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # counts of most_bytes bytes a language

    def run(texts: pa.Array) -> pa.Array:
        if name not in _tables:
            own = pickle.loads(shared.value)
            _tables.clear()
            _tables[name] = (own, own.tables())
        own, tables = _tables[name]
        lowered = pc.utf8_lower(texts)
        bits = _bits(lowered, own, tables)
        best = bits.argmin(axis=1)
        share = np.exp2(-(bits - bits.min(axis=1, keepdims=True)))
        values = 1.0 / share.sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(np.array(own.languages, object)[best], pa.string()), pa.array(values)], ["lang", "score"])

    guess = F.arrow_udf(run, "lang string, score double")(F.col(text))
    lettered = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    scored = docs.withColumn("_guess", guess)
    return scored.withColumns({pred: F.when(lettered, F.col("_guess.lang")).otherwise(UNKNOWN), score: F.when(lettered, F.col("_guess.score")).otherwise(0.0)}).drop("_guess")
