"""Words, shingles, BPE, token files and sharding against plain Python."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltflow.llm import bpe, folds, queries, sharding, storage, token_files
from siltflow.llm.textarrays import shingle_hashes, word_hashes

TEXTS = ["", " \t\n", "one", "One two\x0bthree\x0cfour", "a b c d e", "a b c d e f a b c d e", "É é ß a b", "x" * 5000 + " y", "same same same same same same", "İstanbul ΣΑΣ ﬁ", "it's <|endoftext|> 12 don't <|startoftext|>x", "é ẛ̣ 中文 \U0001f600!", None]
ODD = "doc_id long, text string, shard string, ids string, size string"


def plain_words(x):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, x, "s", "i", "z") for k, x in enumerate(TEXTS)] + [(None, "null key", None, None, None), (5, "a b c d e", "s", "i", "z")], ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB é \n\t\x0b", max_size=60), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    words, at = word_hashes(pa.array(texts))
    split = [plain_words(x) for x in texts]
    assert np.diff(at).tolist() == [len(x) for x in split]
    named = {}
    for word, code in zip([w for x in split for w in x], words.tolist(), strict=True):
        assert named.setdefault(word, code) == code
    assert len(set(named.values())) == len(named)
    for own, x in zip(shingle_hashes(words, at), split, strict=True):
        sets = {tuple(x[k : k + 5]) for k in range(len(x) - 4)} if len(x) >= 5 else {tuple(x)} - {()}
        assert len(own) == len(sets) and (np.diff(own.astype(object)) > 0).all()


def test_a_shingle_is_not_a_shorter_one():
    words, at = word_hashes(pa.array(["a b c d", "a b c d e", "e a b c d"]))
    sets = [set(x.tolist()) for x in shingle_hashes(words, at)]
    assert not sets[0] & sets[1] and not sets[1] & sets[2]


def test_bpe_is_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib = Tokenizer.from_file(path)
    both = bpe.decode(bpe.encode(docs, path), path)
    assert both.columns == ["doc_id", "text", "shard", "ids", "size", "decoded"]
    for r in both.collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want, r.text
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), path).count() == 0
    odd = bpe.decode(spark.createDataFrame([([5, 10**6, -1, 7],), (None,), ([],)], "ids array<int>"), path).collect()
    assert [r.decoded for r in odd] == [lib.decode([5, 7], skip_special_tokens=False), "", ""]


def test_other_files_get_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert not bpe.encoder(path).by_word
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False), r.text


def as_lists(coder, words):
    ids, n = coder.words(pa.array(words, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if words else []


def test_merges_for_all_low_characters():
    coder = bpe.encoder(queries.vocabulary_path())
    assert coder.by_word
    words = [f"{a}{chr(k)}{b}" for k in range(0x300) for a, b in (("", ""), ("a", "b"), ("'", "s"), ("1'", "ll'"))]
    words = [x for w in words for x in re.findall("[^\x20\x09-\x0d]+", w)]
    assert as_lists(coder, words) == [x.ids for x in coder.whole.encode_batch(words, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abthe'sStTrevmld12.,!éÉß\xa0\x85#<|>中İ", min_size=1, max_size=200), max_size=12))
def test_merges_of_words(words):
    coder = bpe.encoder(queries.vocabulary_path())
    words = [*words, "<|endoftext|>", "a<|endoftext|>b", "a" * 127, "ab" * 90]
    assert as_lists(coder, words) == [x.ids for x in coder.whole.encode_batch(words, add_special_tokens=False)]


def test_many_chunks_share_one_word_table(spark, docs):
    """Chunks of one task and of many, a long text by itself, columns named like those within, and repeated rows."""
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib = Tokenizer.from_file(path)
    long = " ".join(f"word{k % 977} It's" for k in range(200_000))
    rows = [(k, f"the {k % 13} words of {k % 7}", "c0", k) for k in range(300)] + [(7, long, None, 1), (7, long, None, 1), (None, None, "x", None)]
    df = spark.createDataFrame(rows, "chunk long, text string, key string, mark long").repartition(3)
    got = bpe.encode(df, path, keep_text=False)
    assert got.columns == ["chunk", "key", "mark", "ids"]
    want = sorted((repr((r[0], r[2], r[3])), lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert sorted((repr((r.chunk, r.key, r.mark)), r.ids) for r in got.collect()) == want


def test_a_chunk_made_anew_is_not_joined_to_old_answers():
    path = queries.vocabulary_path()
    schema = pa.schema([("ids", pa.list_(pa.int32()))])
    import unittest.mock as mock

    with mock.patch("pyspark.TaskContext.get") as now:
        now.return_value.partitionId.return_value = 0
        (one,) = bpe._dealer(2)(iter([pa.record_batch({"c0": ["a b c"]})]))
        (two,) = bpe._dealer(2)(iter([pa.record_batch({"c0": ["a b d"]})]))
    told = pa.Table.from_batches(list(bpe._answerer(path)(iter([one]))))
    chunk = lambda x: pa.Table.from_batches([x]).slice(0, 1)
    assert bpe._joiner([None], schema)(chunk(one), told).num_rows == 1
    with pytest.raises(RuntimeError):
        bpe._joiner([None], schema)(chunk(two), told)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70000), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000))
def test_levels_round_trip(values):
    levels = token_files.pack(np.array(values, np.uint32))
    chunks, bits, ranks = ([x[k] for x in levels] for k in range(3))
    assert token_files.unpack(chunks, bits).tolist() == values
    for place in {0, len(values) // 2, len(values) - 1}:
        assert token_files.token_at(place, chunks, bits, ranks) == values[place]


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_token_files(spark, docs, tmp_path, segment):
    from tokenizers import Tokenizer

    path, at = queries.vocabulary_path(), str(tmp_path / "f")
    docs = docs.union(spark.createDataFrame([(-(2**63), "least id", "s", "i", "z"), (2**63 - 1, "most id", "s", "i", "z")], ODD))
    docs = docs.union(spark.range(100, 400).selectExpr("id", "repeat(concat('word', id, ' and more '), int(id % 9))", "'s'", "'i'", "'z'"))
    token_files.write(docs, at, path, segment_tokens=segment)
    segments = spark.read.parquet(f"{at}/segments").groupBy("part").count().collect()
    assert len(segments) > 1 and (max(r["count"] for r in segments) > 5) == (segment == 50)
    lib = Tokenizer.from_file(path)
    want, start = [], 0
    held = [(r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    flat = []
    for key, ids in sorted(held, key=lambda x: (x[0] is not None, x[0], x[1])):
        want.append((key, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat += ids
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in token_files.read(spark, at).orderBy("start").collect()]
    assert got == want
    places = [0, 1, len(flat) // 2, len(flat) - 1, len(flat), -1]
    found = {r.place: r.id for r in token_files.lookup(spark, at, spark.createDataFrame([(x,) for x in places + places], "place long")).collect()}
    assert found == {x: flat[x] for x in places if 0 <= x < len(flat)}
    token_files.write(docs.limit(0), str(tmp_path / "none"), path)
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_sharding(spark, docs):
    big = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    out = sharding.with_slots(sharding.assign(big.union(docs.select("doc_id", "text"))), "doc_id", ties=["text_crc32", "size"]).collect()
    sizes = {}
    for r in out:
        body = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert r.grown_shard in (r.shard, 16)
        sizes.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16))
    for slots in sizes.values():
        assert sorted(slots) == list(range(len(slots))) and 150 < len(slots) < 350
    moved = sum(r.grown_shard == 16 for r in out)
    assert 150 < moved < 350
    weighted = big.select(sharding.rendezvous(big.doc_id, [1, 3]).alias("s")).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 1000) for r in weighted} == {0: 1, 1: 3}
    assert sharding.assign(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, weights=[0.0])


def test_write_shards(spark, tmp_path):
    big = spark.range(100).selectExpr("id AS doc_id", "'x' AS text", "id AS shard_of")
    sharding.write_shards(big, str(tmp_path / "s"), weights=(1.0,) * 4, parts=2)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().agg({"count": "sum"}).first()[0] == 100


def test_folds_and_storage(spark, docs):
    for r in docs.select("doc_id", folds.remainder("doc_id", 5).alias("m")).collect():
        assert r.m == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5
    held = storage.materialize(docs, "t")
    assert held.count() == docs.count() and storage.shared_dir(spark) == storage.shared_dir(spark)
    with storage.scope(spark) as kept:
        gone, stays = storage.new_path(spark, "gone"), storage.new_path(spark, "stays")
        for at in (gone, stays):
            docs.write.parquet(at)
        kept.add(stays)
    assert spark.read.parquet(stays).count() == docs.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone)
    storage.sweep(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.schema(docs.schema).parquet(*held.inputFiles()).count()
