"""The classifiers: held-out accuracy, models against plain Python, odd rows, and the pipeline."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltflow.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def joined(spark, name, target, key="doc_id"):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    truth = {r.doc_id: r[target] for r in queries.table(spark, SF, "documents" if target == "lang" else "labels").collect()}
    assert len(rows) == queries.table(spark, SF, "documents").count()
    return rows, truth


def test_language(spark):
    rows, truth = joined(spark, "op7_language", "lang")
    held = [k for k in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in rows.items() if r.held_out} == set(held)
    assert sum(rows[k].lang_pred == truth[k] for k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_context_model_is_exact():
    """The table of costs against the recursion that defines them."""
    texts = {"a": [b"abracadabra", b"abc"], "b": [b"bbbbab", b""]}
    model = language.ContextModel(texts)
    tables = model.tables()

    def bits(own, text):
        padded = [model.symbols[x] for x in text]
        counts = {}
        for t in own:
            row = [0] * 3 + [int(model.symbols[x]) for x in t]
            for k in range(3, len(row)):
                for order in range(4):
                    c = counts.setdefault((order, tuple(row[k - order : k])), {})
                    c[row[k]] = c.get(row[k], 0) + 1

        def cost(context, s):
            if context is None:
                return 8.0
            shorter = context[1:] if context else None
            seen = counts.get((len(context), context))
            if not seen:
                return cost(shorter, s)
            total, kinds = sum(seen.values()), len(seen)
            return -math.log2(seen[s] / (total + kinds)) if s in seen else -math.log2(kinds / (total + kinds)) + cost(shorter, s)

        row = [0] * 3 + [int(x) for x in padded]
        return sum(cost(tuple(row[k - 3 : k]), row[k]) for k in range(3, len(row)))

    probe = ["abra", "", "zzz abc", "bab"]
    got = language._bits(pa.array(probe), model, tables)
    for text, row in zip(probe, got, strict=True):
        for k, name in enumerate(model.languages):
            assert row[k] == pytest.approx(bits(texts[name], text.encode()), rel=1e-5, abs=1e-5)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (None, "the cat", None), (2, "the dog and the cat", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[None].lang_pred) == ("de", "en", "en")
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (3, 4, 5))
    nothing = language.predict(docs, language.train(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}


def test_quality(spark):
    rows, truth = joined(spark, "op5_quality", "quality")
    held = [k for k in truth if rows[k].held_out]
    assert {k for k, r in rows.items() if r.held_out} == {k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum((rows[k].score >= 0.3) == bool(truth[k]) for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def plain_risk_fit(x, trusted):
    """The non-negative unbiased risk minimised on one matrix: Newton steps, halved while the negatives' part would fall below 0; the prior from the tails of a first fit."""
    ridge, dims = 1e-3, x.shape[1]
    negatives = lambda w, prior: np.logaddexp(0, x @ w).mean() - prior * np.logaddexp(0, trusted @ w).mean()

    def newton(prior, w, rounds):
        while negatives(w, prior) < 0:
            w = w / 2
        for _ in range(rounds):
            s = 1 / (1 + np.exp(-(x @ w)))
            slope = x.T @ s / len(x) - prior * trusted.mean(0) + ridge * w
            curve = (x * (s * (1 - s))[:, None]).T @ x / len(x)
            step = np.linalg.solve(curve + ridge * np.eye(dims), slope)
            step *= min(1.0, 8.0 / np.abs(step).max())
            size = 1.0
            while negatives(w - size * step, prior) < 0 and size >= 0.1:
                size /= 2
            if negatives(w - size * step, prior) < 0:
                break
            w = w - size * step
            if np.abs(size * step).max() < 0.02:
                break
        return w

    start = newton(0.5, np.zeros(dims), 4)
    edges = np.linspace(-8, 8, 161)
    own, every = np.clip(np.digitize(trusted @ start, edges), 0, 161), np.clip(np.digitize(x @ start, edges), 0, 161)
    tails = [((every >= k).mean(), (own >= k).mean()) for k in range(162) if (own >= k).sum() >= max(10, 0.1 * len(own))]
    prior = float(np.clip(min(u / p for u, p in tails), 0.05, 0.98))
    w = newton(prior, start, 10)
    assert negatives(w, prior) >= 0
    return prior, w


def test_quality_query_against_plain_numpy(spark):
    """The query's scores from the rows of all documents in one matrix."""
    small = "/root/testdata/sf0.001"
    docs = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    labels = {r.doc_id for r in queries.table(spark, small, "labels").collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = np.concatenate([quality.features(pa.array([r.text], pa.string())) for r in docs]).astype(np.float32).astype(np.float64)
    z = np.clip((rows - rows.mean(0)) / np.sqrt(np.maximum(rows.var(0), 1e-6)), -6, 6)
    x = np.concatenate((z, z**2, np.ones((len(z), 1))), axis=1)
    prior, weights = plain_risk_fit(x, x[[r.doc_id in labels for r in docs]])
    model = quality.train(queries.table(spark, small, "documents"), queries.table(spark, small, "labels"))
    assert model.prior == pytest.approx(prior) and np.allclose(model.weights, weights, atol=1e-5)
    chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
    got = {r.doc_id: (r.score, r.predicted) for r in queries.QUERIES["op5_quality"](spark, small).collect()}
    for r, p in zip(docs, chance, strict=True):
        assert got[r.doc_id][0] == pytest.approx(p, abs=1e-5) and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.3)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Some sound words. More of them."), (2, None), (3, ""), (4, "# # # #"), (None, "x"), (1, "Some sound words. More of them.")], "doc_id long, text string").withColumn("features", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (99, 1), (1, 1)], "doc_id long, quality int")
    for used in (labels, labels.limit(0)):
        model = quality.train(docs, used)
        assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), model).count() == 0
    assert np.isfinite(quality.features(pa.array([None, "", " ", "a" * 10**5, "\n\n"]))).all()


def test_toxicity(spark):
    """Held-out rows of every language, at the size at which each has a few dozen toxic training rows."""
    large = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.QUERIES["op3_toxicity"](spark, large).collect()}
    assert len(rows) == queries.table(spark, large, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert {k for k, r in rows.items() if r.held_out} == {k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    lang = {r.doc_id: r.lang for r in queries.table(spark, large, "documents").collect()}
    held = [(r.doc_id, r.toxic) for r in queries.table(spark, large, "labels").where("toxic IS NOT NULL").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    share = lambda y, names: [rows[k].predicted for k, own in held if own == y and lang[k] in names]
    every = ("en", "de", "es", "fr")
    assert sum(share(1, every)) >= 0.9 * len(share(1, every))
    assert sum(share(0, every)) <= 0.01 * len(share(0, every))
    for name in every:  # of some languages there are a few rows only
        assert len(share(1, name)) >= 5 and sum(share(1, name)) >= 0.85 * len(share(1, name)), name
        assert sum(share(0, name)) <= 0.01 * len(share(0, name)) + 2, name


def test_tokens_present_and_dense():
    words = ["Scum scummy x"] + ["clean word " * 100 + "scum"] + ["", None, "scum " * 3 + "w " * 400]
    known = np.unique(np.array([toxicity._word_hash("scum") | k for k in (0, 1)], np.uint64))
    rows, at = toxicity.Hits(known)(pa.array(words))
    got = {(r, int(known[k] & np.uint64(1))) for r, k in zip(rows.tolist(), at.tolist(), strict=True)}
    assert got == {(0, 0), (0, 1), (1, 0), (4, 0)}  # dense from one word in 100 on
    alone = toxicity.Hits(known[(known & np.uint64(1)) == 1])(pa.array(words))
    assert alone[0].tolist() == [0] and toxicity.Hits(known[:0])(pa.array(words))[0].size == 0


def test_label_model_against_plain_python():
    """The posterior of the last round, from rates of the round before, by the recursion that defines them."""
    rng = np.random.default_rng(8)
    votes = rng.random((60, 6)) < 0.4
    votes[:, 5] = ~votes[:, :2].any(axis=1)
    prior = 0.2
    rows, k = votes.tolist(), votes.shape[1]
    q = [0.9 if any(r[: max(1, k - 1 - len(toxicity.PATTERNS) + 1)]) else 0.02 for r in rows]
    group = [1] * k
    for turn in range(25):
        on, off = sum(q) + 1e-9, sum(1 - x for x in q) + 1e-9
        mean = [sum(r[j] for r in rows) / len(rows) for j in range(k)]
        one = [min(max((sum(x * r[j] for x, r in zip(q, rows, strict=True)) + 0.5 * prior) / (on + 1), 1e-4), 1 - 1e-4) for j in range(k)]
        two = [min(max((sum((1 - x) * r[j] for x, r in zip(q, rows, strict=True)) + 0.5 * (1 - prior) * mean[j]) / (off + 1), 1e-4), 1 - 1e-4) for j in range(k)]
        if turn in (2, 8):
            dev = [[(r[j] - one[j]) * math.sqrt(x) for j in range(k)] for x, r in zip(q, rows, strict=True)]
            var = [max(sum(d[j] ** 2 for d in dev), 1e-9) for j in range(k)]
            group = [max(1, sum(sum(d[i] * d[j] for d in dev) / math.sqrt(var[i] * var[j]) > 0.35 for i in range(k))) for j in range(k)]
        logits = [math.log(prior / (1 - prior)) + sum((math.log(one[j] / two[j]) if r[j] else math.log((1 - one[j]) / (1 - two[j]))) / group[j] for j in range(k)) for r in rows]
        q = [1 / (1 + math.exp(-min(max(x, -30), 30))) for x in logits]
    got, _, sizes = toxicity.label_model(votes, k - 1, prior)
    assert sizes.tolist() == group and np.allclose(got, q, atol=1e-6)


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.15
    good = [(rng.random(4000) < np.where(y, 0.6, 0.001)) for _ in range(5)]
    poor = [rng.random(4000) < 0.1 for _ in range(3)]
    twin = good[0].copy()
    clean = ~np.any([*good, twin], axis=0)
    votes = np.stack([*good, twin, *poor, clean], axis=1)
    q, accuracy, group = toxicity.label_model(votes, votes.shape[1] - 1, 0.15)
    assert ((q > 0.5) == y).mean() > 0.98
    assert min(accuracy[:5]) > 0.85 > 0.5 > max(accuracy[6:9])
    assert group[0] >= 2 and group[5] >= 2


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "You idiot, you are scum"), (2, None), (3, ""), (4, "fine words"), (None, "x"), (1, "You idiot, you are scum")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for used in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.train(docs, used)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_pipeline_against_its_parts(spark):
    """run() against a plain-Python chain of the same decisions."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    stage = lambda df, k: corpus_pipeline.STAGES[k][1](spark, df, sf)
    good = stage(docs, 0)
    clean = stage(good, 1)
    assert good.columns == clean.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    split = {k: (x or "").encode().lower().split() for k, x in rows}
    sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for k, w in split.items()}
    root = {k: k for k in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {k for k in keys if find(k) == k}
    for r in queries.table(spark, sf, "benchmark").collect():
        w = (r.text or "").lower().split()
        item = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for k, x in rows:
            t = (x or "").lower().split()
            if item and len(item & {tuple(t[j : j + 5]) for j in range(len(t) - 4)}) >= 0.8 * len(item):
                left.discard(k)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == left and 0 < len(left) < docs.count()
    lib = Tokenizer.from_file(queries.vocabulary_path())
    for k, x in rows:
        if k in out:
            assert out[k].ids == lib.encode(x or "", add_special_tokens=False).ids


def test_pipeline_edges(spark, tmp_path):
    """Null, empty, very long and repeated rows, ties, missing ids and extra columns through all stages, and empty tables."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    from tokenizers import Tokenizer

    small = "/root/testdata/sf0.001"
    item = queries.table(spark, small, "benchmark").first().text
    sound = [r.text for r in queries.table(spark, small, "documents").join(queries.table(spark, small, "labels").where("quality = 1 AND toxic = 0"), "doc_id").where("lang = 'en' AND n_chars > 900").orderBy("doc_id").limit(4).collect()]
    extra = [(10**6 + k, x) for k, x in enumerate([sound[0], sound[0], None, "", sound[1] + " " + item, (sound[2] + " ") * 300, sound[3]])] + [(10**6, sound[0]), (None, sound[3]), (None, sound[3] + " more words of its own")]
    rows = [(k, x, "clash", 0.5, 1) for k, x in extra]
    at = str(tmp_path / "sf")
    schema = "doc_id long, text string, score string, _score double, key long"
    queries.table(spark, small, "documents").selectExpr("doc_id", "text", "source AS score", "0.0 AS _score", "1L AS key").union(spark.createDataFrame(rows, schema)).write.parquet(f"{at}/documents.parquet")
    for name in ("labels", "benchmark"):
        queries.table(spark, small, name).write.parquet(f"{at}/{name}.parquet")
    docs, seen = queries.table(spark, at, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, at)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        seen.append(docs.collect())
    out = corpus_pipeline.run(spark, at).collect()
    left = sorted((r.doc_id for r in seen[3]), key=repr)
    assert sorted((r.doc_id for r in out), key=repr) == left
    lib, texts = Tokenizer.from_file(queries.vocabulary_path()), {}
    for r in seen[3]:
        texts.setdefault(r.doc_id, []).append(lib.encode(r.text or "", add_special_tokens=False).ids)
    for r in out:
        assert r.ids in texts[r.doc_id]
    judged = [r.doc_id for r in seen[1] if r.doc_id is None or r.doc_id >= 10**6]
    if judged.count(10**6) == 2:  # equal rows and copies: the least id stays
        assert left.count(10**6) + left.count(10**6 + 1) <= 1
    assert left.count(None) == judged.count(None) and 10**6 + 4 not in left
    for name, empty in (("none", "documents"), ("bare", "labels")):
        for table in ("documents", "labels", "benchmark"):
            df = queries.table(spark, small, table)
            (df.limit(0) if table == empty else df.limit(40)).write.parquet(str(tmp_path / name / f"{table}.parquet"))
        n = corpus_pipeline.run(spark, str(tmp_path / name)).count()
        assert n == 0 if empty == "documents" else 0 < n <= 40
