"""Jaccard join, decontamination, rules and language-model scores against plain Python."""

import collections
import math
import random
import re

import duckdb
import pytest

from siltflow.llm import backoff_lm, components, contamination, jaccard, queries, rules

SF = "/root/testdata/sf0.001"


def plain_words(x):
    return re.findall("[^\x20\x09-\x0d]+", x or "")


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def shingles(x):
    w = plain_words(x)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def made_texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \n ", "one two", "One TWO", "one two three", "a b c d e", "A b c d e"]
    for k in range(60):  # a group of near copies, some further than 0.8
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            words[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    for k in range(40):  # texts that share a passage and nothing else
        texts.append(passage + " " + " ".join(f"y{k}_{j}" for j in range(rng.choice([5, 40]))))
    texts += [" ".join(base)] * 30 + ["long " + " ".join(f"z{j}" for j in range(3000))] * 2
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, "comp") for k, x in enumerate(made_texts())]
    return spark.createDataFrame([*rows, (None, "null key text here now", "c"), (8, rows[8][1], "c")], "doc_id long, text string, component_id string")


def brute(rows):
    sets = [(k, shingles(low(x))) for k, x in rows]
    links = collections.Counter()
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i)), links[i]) for i, (k, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"held": 500, "block": 7, "columns": 64}, {"held": 3000, "grams": 2000, "columns": 100}])
def test_jaccard(docs, sizes):
    """Also with small blocks, cut by sets or by shingles, and products over several slices of columns."""
    got = sorted(map(tuple, jaccard.join(docs, sizes=jaccard.Sizes(**sizes)).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("bits", [1, 5])
def test_jaccard_owners_meet(docs, bits):
    assert sorted(map(tuple, jaccard.join(docs, sizes=jaccard.Sizes(owner_bits=bits)).collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_edges(spark, docs):
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {(r.doc_id, r.component_id) for r in jaccard.join(docs).collect()}
    want = sorted([k for k, c in classes if k is not None and k == c])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_jaccard_repeated_ids(spark):
    near = lambda name, k: " ".join(f"{name}{j}" if j else f"{name}_{k}" for j in range(60))
    rows = [
        (None, "first row without id here"), (None, "second row without id here"), (None, None), (None, near("a", 0)),
        (5, near("a", 1)), (5, near("b", 1)), (6, near("a", 2)), (7, near("b", 2)), (7, near("c", 1)), (7, near("c", 1)), (7, ""), (7, " "),
        (3, near("d", 1)), (4, near("d", 2)), (4, near("e", 1)), (9, near("f", 1)), (9, near("f", 2)), (10, near("f", 3)),
    ]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component_id string")
    linked = [x for x in rows if x[0] is not None]  # rows without id take no part in classes
    got = jaccard.join(docs.where("doc_id IS NOT NULL")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(linked)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    left = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    for spare in ((7, ""), (9, near("f", 1))):  # either of two copies may stay
        other = {(7, ""): (7, " "), (9, near("f", 1)): (9, near("f", 2))}[spare]
        assert left.pop(spare, 0) + left.pop(other, 0) == 1
    assert left == collections.Counter([*rows[:6], (7, near("c", 1)), (3, near("d", 1)), (4, near("e", 1))])


def test_jaccard_product():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    n = np.array([len(x) for x in sets], float)
    for columns in (7, 16384):
        linked = jaccard._product(sets, sets, n, n, 40, columns)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert linked[i, j] == (100 * both >= 40 * (len(a) + len(b) - both))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark):
    rng = random.Random(2)
    item = [f"i{k}" for k in range(30)]
    bench = [(1, " ".join(item), "x"), (2, "Two Words", "x"), (3, "", "x"), (4, None, "x"), (5, " ".join(item), "x"), (6, "q w e r t", "x"), (None, "no key", "x")]
    fill = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    damaged = list(item)
    damaged[10] = "zz"
    worse = list(item)
    for k in (5, 12, 20):
        worse[k] = "zz"
    rows = [
        (0, " ".join(fill(4000) + item + fill(4000)), "a"), (1, " ".join(fill(50) + damaged), "a"), (2, " ".join(worse + fill(9)), "a"), (3, "has TWO  words inside", "a"),
        (4, None, "a"), (5, "", "a"), (6, "words two", "a"), (7, "Q W E R T", "a"), (None, " ".join(item), "a"), (8, "two", "a"), (8, "words", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contamination.find(docs, items).collect()}
    own = lambda x, width: {tuple(x[k : k + width]) for k in range(len(x) - width + 1)}
    want = set()
    for d, text, _ in rows:
        for i, q, _ in bench:
            words = plain_words((q or "").lower())
            width = min(5, len(words))
            if i is not None and words:
                a, b = own(words, width), own(plain_words((text or "").lower()), width)
                if len(a & b) >= math.ceil(0.8 * len(a) - 1e-9):
                    want.add((d, i, len(a), len(a & b)))
    assert got == want and (1, 1, 26, 21) in got and len(got) >= 8
    left = contamination.remove(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, *_ in rows if d not in {x[0] for x in want}), key=repr)
    assert contamination.find(docs.limit(0), items).count() == 0 and contamination.remove(docs, items.limit(0)).count() == len(rows)


def test_contamination_removes_rows_by_their_own_text(spark):
    item = [f"i{k}" for k in range(30)]
    half = [" ".join(x) for x in (item[:17], item[13:])]
    rows = [(None, " ".join(item)), (None, "clean words without id"), (None, None), (None, half[0]), (None, half[1]), (8, "x " + " ".join(item)), (8, "clean words of a repeated id"), (9, half[0]), (9, half[1]), (10, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    left = contamination.remove(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted((x for x in rows if x not in (rows[0], rows[5])), key=repr)


def test_contamination_joined_by_hash(spark, monkeypatch):
    docs, items = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    small = sorted(map(tuple, contamination.find(docs, items).collect()))
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, contamination.find(docs, items).collect())) == small and small


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)


def test_rules(spark):
    rng = random.Random(7)
    sound = lambda k: " ".join(f"word{rng.randrange(2000)}" + ("." if j % 9 == 8 else "") for j in range(60 + k % 50))
    texts = [None, "", " \n\t", "a", "a b c d e f g h i j", "x y z w v x y z w v", "s " * 40, "a\n\na\n b \n b ", "# * $ % & | < >" * 3, "é É" * 10]
    texts += [sound(k) for k in range(150)] + [" ".join(w + "%%%" for w in sound(k).split()) for k in range(12)] + [sound(k).upper() for k in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "null key"), (5, texts[5])], "doc_id long, text string")
    got = rules.judge(docs.withColumn("n_words", docs.text)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "null key" if r.doc_id is None else texts[r.doc_id] or ""
        words = plain_words(text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = collections.Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if plain_words(x)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id >= 10:
            assert r.kept == (r.doc_id < 160), (r.doc_id, r)
    assert rules.judge(docs.limit(0)).count() == 0


def test_rules_query_against_plain_python(spark):
    """Votes, expectation-maximisation row by row, posteriors and verdicts of the whole query."""
    rows = [r.asDict() for r in rules.metrics(queries.table(spark, SF, "documents")).collect()]
    names = [*rules.RULES, "word_length"]

    def vote(name, r):
        n = max(r["n_words"], 1)
        if name == "word_length":
            mean = r["word_chars"] / n
            return -1 if not 2.5 <= mean <= 12 else 1 if 3 <= mean <= 10 else 0
        count, good, bad = rules.RULES[name]
        x = r["n_words"] if name == "length" else r[count] / (max(r["n_lines"], 1) if name == "lines" else n)
        if good > bad:
            return 1 if x >= good else -1 if x <= bad else 0
        return 1 if x <= good else -1 if x >= bad else 0

    voted = [{x: vote(x, r) for x in names} for r in rows]
    kinds = len(rules.KINDS)
    q = []
    for v in voted:
        hit = [float(any(v[x] < 0 for x in group)) for group in rules.KINDS]
        some = sum(hit)
        bad = 0.9 if some else 0.05
        q.append([1 - bad] + [bad * (x / some if some else 1 / kinds) for x in hit])
    shares = [1 / (kinds + 1)] * (kinds + 1)
    for turn in range(12):
        total = [sum(x[k] for x in q) for k in range(kinds + 1)]
        rate = []
        for k in range(kinds + 1):
            sums = {(x, s): sum(w[k] for w, v in zip(q, voted, strict=True) if v[x] == s) for x in names for s in (-1, 1)}
            rate.append({(x, s): (sums[x, s] + 0.1) / (sums[x, -1] + sums[x, 1] + 0.2) for x, s in sums})
        new = [(t + 1) / (sum(total) + kinds + 1) for t in total]
        settled = turn and max(abs(a - b) for a, b in zip(new, shares, strict=True)) < 1e-4
        shares, q = new, []
        for v in voted:
            logit = [math.log(shares[k] / shares[0]) + sum(math.log(rate[k][x, s] / rate[0][x, s]) for x, s in v.items() if s) for k in range(1, kinds + 1)]
            odds = [1.0] + [math.exp(max(-30, min(30, x))) for x in logit]
            q.append([x / sum(odds) for x in odds])
        if settled:
            break
    want = {r["doc_id"]: x[0] for r, x in zip(rows, q, strict=True)}
    got = queries.op9_rules(spark, SF).collect()
    assert len(got) == len(rows) == len(want) and 0 < sum(r.kept for r in got) < len(got)
    for r in got:
        assert r.quality == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and want[r.doc_id] >= 0.5)


def test_very_long_texts(spark):
    """One text of 300,000 words beside short ones, through each operator of this module."""
    long = " ".join(f"w{k % 4001} v{k % 977}" for k in range(150_000))
    docs = spark.createDataFrame([(0, long), (1, long + " end"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    own = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert own[0].n_words == 300_000 and own[0].base_failed == (100 * own[0].n_repeat_words > 20 * 300_000)
    scored = {r.doc_id: r for r in backoff_lm.score(docs, order=3).collect()}
    assert scored[0].n_words == 300_000 and scored[1].n_words == 300_001 and scored[3].score is None
    items = spark.createDataFrame([(1, " ".join(long.split(" ")[200_000:200_030]))], "item_id long, text string")
    assert {r.doc_id for r in contamination.find(docs, items).collect()} == {0, 1}
    joined = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(docs, sizes=jaccard.Sizes(held=1000, grams=5000, columns=700)).collect()}
    assert joined == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}


def test_rules_are_native(spark):
    docs = queries.table(spark, SF, "documents")
    for df in (rules.metrics(docs).withColumns(rules.votes()), contamination.item_shingles(queries.table(spark, SF, "benchmark"), "item_id", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapInArrow", plan)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(spark, order):
    texts = [None, "", "a", "a b a b", "A b\tc a b", "b c a", "the cat sat", "the cat ran"] * 2 + ["lone words here"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "a b")], "doc_id long, text string").withColumn("score", F_lit())
    got = backoff_lm.score(docs, order=order)
    split = {k: plain_words(low(x)) for k, x in [*enumerate(texts), (None, "a b")]}
    count = collections.Counter()
    for w in split.values():
        for i in range(len(w)):
            for n in range(1, min(order, i + 1) + 1):
                count[tuple(w[i - n + 1 : i + 1])] += 1
    total = sum(map(len, split.values()))
    for r in got.collect():
        w, value, failed = split[r.doc_id], 0.0, 0
        for i in range(len(w)):
            n = most = min(order, i + 1)
            while n > 1 and count[tuple(w[i - n + 1 : i + 1])] < 2:
                n -= 1
            failed += n < most
            top = count[tuple(w[i - n + 1 : i + 1])]
            value += math.log(0.4 ** (most - n) * top / (count[tuple(w[i - n + 1 : i])] if n > 1 else total))
        assert (r.n_words, r.n_backoff) == (len(w), failed)
        assert r.score is None if not w else r.score == pytest.approx(value / len(w), rel=1e-12)
    assert backoff_lm.score(docs.limit(0), order=order).count() == 0


def test_backoff_query_is_trigram(spark):
    docs = queries.table(spark, SF, "documents")
    got = {r.doc_id: (r.n_words, r.n_backoff, r.score) for r in queries.op8_backoff_lm(spark, SF).collect()}
    want = {r.doc_id: (r.n_words, r.n_backoff, r.score) for r in backoff_lm.score(docs, order=3).collect()}
    split = {r.doc_id: plain_words(low(r.text)) for r in docs.collect()}
    count = collections.Counter(tuple(w[max(0, i - n + 1) : i + 1]) for w in split.values() for i in range(len(w)) for n in (1, 2, 3) if n <= i + 1)
    failed = {k: sum(count[tuple(w[max(0, i - 2) : i + 1])] < 2 for i in range(1, len(w))) for k, w in split.items()}
    assert got == want and {k: x[1] for k, x in got.items()} == failed


def test_backoff_packing():
    import numpy as np

    keys = np.array([0, 1, 5, 1 << 33, (1 << 48) - 1], np.uint64)
    counts = np.array([1, 255, 70000, 1, 1 << 40])
    for k, c in ((keys, counts), (keys[:0], counts[:0]), (keys[4:], counts[4:])):
        got = backoff_lm._unpack(*backoff_lm._pack(k, c))
        assert got[0].tolist() == k.tolist() and got[1].tolist() == c.tolist()


def F_lit():  # noqa: N802
    from pyspark.sql import functions as F

    return F.lit("clash")
