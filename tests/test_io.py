import json

import pytest

from siltflow.sources import readers as R
from siltflow.sources import writers as W


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def got(read):
    return [json.loads(r.row) if isinstance(r.row, str) else r.row for r in read.rows.orderBy("row_idx").collect()]


def test_ndjson(spark, tmp_path):
    at = put(tmp_path / "a.ndjson", "".join(f'{{"a":{k}}}\n' for k in range(1, 6)))
    read = R.read_ndjson(spark, at)
    assert got(read) == [{"a": k} for k in range(1, 6)]
    assert [r._src.rsplit(":", 1)[1] for r in read.rows.orderBy("row_idx").collect()] == list("12345")
    assert got(R.read_ndjson(spark, at, skip=1, limit=2)) == [{"a": 2}, {"a": 3}]
    assert [(r.format, r.rows) for r in read.meta.collect()] == [("ndjson", 5)]
    import hashlib

    first = read.rows.where("row_idx = 0").first()
    assert first._id == hashlib.blake2b(f"{first.file}:0".encode(), digest_size=8).hexdigest()
    mixed = R.read_ndjson(spark, put(tmp_path / "b.ndjson", '{"a":1}\n\nNOT_JSON\n{"a":3}\nnull\n'))
    assert got(mixed) == [{"a": 1}, {"a": 3}, None]
    assert [r.input for r in mixed.errors.collect()] == ["NOT_JSON"]
    typed = R.read_ndjson(spark, at, "a long")
    assert typed.rows.agg({"row.a": "sum"}).first()[0] == 15


def test_lines_and_csv(spark, tmp_path):
    lines = R.read_lines(spark, put(tmp_path / "l.txt", "a\n\nc\n"))
    assert [r.row for r in lines.rows.orderBy("row_idx").collect()] == ["a", "", "c"]
    at = put(tmp_path / "c.csv", 'a,b,c\n1,2,3\n4,"5,5",6,7\n8\n')
    assert [r.row for r in R.read_csv(spark, at).rows.orderBy("row_idx").collect()] == [{"a": "1", "b": "2", "c": "3"}, {"a": "4", "b": "5,5", "c": "6", "col_3": "7"}, {"a": "8"}]
    assert [r.row for r in R.read_csv(spark, at, header=False, skip=1, limit=1).rows.collect()] == [["1", "2", "3"]]
    assert R.read_csv(spark, put(tmp_path / "d.csv", "a|b\n1|2\n"), delim="|").rows.first().row["b"] == "2"
    with pytest.raises(ValueError):
        R.read_csv(spark, at, delim="ab")


def test_places_are_those_in_the_file(spark, tmp_path):
    """row_idx, _id and _src count physical lines and CSV records, whatever is skipped."""
    read = R.read_ndjson(spark, put(tmp_path / "p.ndjson", '{"a":1}\n\nBAD\n   \n{"a":3}\n{"a":4}\n'), skip=1, limit=1)
    assert [(r.row_idx, r._src.rsplit(":", 1)[1]) for r in read.rows.collect()] == [(4, "5")]
    assert sorted((r.line_no, r.input) for r in read.errors.collect()) == [(2, "BAD"), (3, "   ")]
    csv = R.read_csv(spark, put(tmp_path / "p.csv", "a,b\n\n1,2\n3,4\n\n5,6\n"), skip=1)
    assert [(r.row_idx, r.row["a"]) for r in csv.rows.orderBy("row_idx").collect()] == [(1, "3"), (2, "5")]
    (tmp_path / "many").mkdir()
    for name, text in (("a", "x\ny\n"), ("b", ""), ("c", "z\n")):
        put(tmp_path / "many" / f"{name}.txt", text)
    many = R.read_lines(spark, str(tmp_path / "many"))
    assert sorted((r.file.rsplit("/", 1)[1], r.row_idx, r.row) for r in many.rows.collect()) == [("a.txt", 0, "x"), ("a.txt", 1, "y"), ("c.txt", 0, "z")]
    assert sorted((r.file.rsplit("/", 1)[1], r.rows) for r in many.meta.collect()) == [("a.txt", 2), ("b.txt", 0), ("c.txt", 1)]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    at = put(tmp_path / "big.txt", "".join(f"line {k}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = R.read_lines(spark, at).rows
        assert spark.read.text(at).rdd.getNumPartitions() > 5
        assert rows.where("row <> concat('line ', row_idx)").count() == 0 and rows.count() == 20_000
        assert R.read_lines(spark, at, skip=15_000, limit=3).rows.agg({"row_idx": "sum"}).first()[0] == 45_003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_quotes_and_names(spark, tmp_path):
    rows = lambda text, **kw: [r.row for r in R.read_csv(spark, put(tmp_path / "q.csv", text), **kw).rows.orderBy("row_idx").collect()]
    assert rows("a,b,a\n1,2,3\n") == [{"a": "3", "b": "2"}]  # the last of a repeated name
    assert rows('a,b\n"x\ny",1\n5" pipe,2\n') == [{"a": "x\ny", "b": "1"}, {"a": '5" pipe', "b": "2"}]
    assert rows('a,b\n"say ""hi""",1\n') == [{"a": 'say "hi"', "b": "1"}]
    assert rows('"1\n2",3\n4,5\n', header=False) == [["1\n2", "3"], ["4", "5"]]


def test_fields_of_the_input_record(spark, tmp_path):
    at = put(tmp_path / "in.ndjson", '{"a":1}\n{"a":2}\n')
    inputs = spark.createDataFrame([(at, "north", 9)], "path string, region string, row_idx long")
    read = R.with_input(R.read_ndjson(spark, at, "a long"), inputs)
    assert sorted((r.row.a, r.region, r.row_idx) for r in read.rows.collect()) == [(1, "north", 0), (2, "north", 1)]


def test_seed(spark, tmp_path):
    assert R.seed(spark).count() == 0
    row = R.seed(spark, '{"x":1}').first()
    assert (row.t, row.src, row.v) == ("d", "seed", '{"x":1}') and len(row.id) == 16
    put(tmp_path / "_seed.ndjson", '{"t":"d","id":"1","src":"s","v":{"y":2}}\n{"t":"m","v":3}\n')
    assert {(r.t, r.id, r.v) for r in R.seed(spark, input_path=str(tmp_path)).collect()} == {("d", "1", '{"y":2}'), ("m", "", "3")}


def test_scan(spark, tmp_path):
    put(tmp_path / "a.txt", "x")
    (tmp_path / "sub" / "inner").mkdir(parents=True)
    put(tmp_path / "sub" / "b.pdf", "yy")
    put(tmp_path / ".hidden", "z")
    root = str(tmp_path)
    found = R.scan_fs(spark, root)
    assert {(r.filename, r.ext, r.size) for r in found.collect()} == {("a", "txt", 1), ("b", "pdf", 2)}
    import xxhash

    assert found.where("filename = 'a'").first().hash == xxhash.xxh3_64_hexdigest(b"x")
    assert R.scan_fs(spark, root, returns="dirs").count() == 2
    assert R.scan_fs(spark, root, include="**/*.pdf").count() == 1
    assert R.scan_fs(spark, root, exclude=["*.txt"], hidden=True).count() == 2
    assert R.scan_fs(spark, root, depth=1).count() == 1
    assert R.scan_fs(spark, root, min_size=2, hash="blake2b").first().hash.__len__() == 32
    own = lambda df: sorted((r.directory, r.filename, r.ext, r.size, r.hash) for r in df.collect())
    for how in ({}, {"include": "**/*.pdf"}, {"exclude": ["*.txt"]}, {"depth": 1}, {"min_size": 2, "hash": "blake2b"}, {"max_size": 1, "hash": "none"}):
        assert own(R.scan_store(spark, root, **how)) == own(R.scan_fs(spark, root, **how)), how
    before = R.scan_fs(spark, root).cache()
    before.count()
    put(tmp_path / "a.txt", "changed")
    (tmp_path / "sub" / "b.pdf").unlink()
    put(tmp_path / "new.txt", "n")
    assert {(r.action, r.filename) for r in R.scan_diff(before, R.scan_fs(spark, root)).collect()} == {("modified", "a"), ("removed", "b")}


def test_write_and_hashed(spark, tmp_path):
    base = str(tmp_path / "out")
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", (k,)) for k in range(1, 5)], "_ord long, file string, row struct<x:long>")
    W.write_stream(df, base)
    W.write_stream(df, base)
    lines = W.target_lines(spark, base)
    assert lines.where("file = 'a'").count() == 4
    W.write_stream(df.where("file = 'a'"), base, write_mode="truncate")
    assert {(r.file, r["count"]) for r in W.target_lines(spark, base).groupBy("file").count().collect()} == {("a", 2), ("b", 4)}
    flat = spark.createDataFrame([(1, 'x"', 3.25), (2, "y", None)], "a long, b string, c double")
    W.write_stream(flat, str(tmp_path / "csv"), "csv", csv_columns=["a", "b", "c"])
    assert sorted(r.value for r in W.target_lines(spark, str(tmp_path / "csv")).collect()) == ['1,"x""",3.25', "2,y,"]
    hashed = str(tmp_path / "hashed")
    one = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "_ord long, a long")
    W.write_hashed(one, hashed)
    W.write_hashed(one.union(spark.createDataFrame([(3, 3)], "_ord long, a long")), hashed)
    assert sorted(r.value for r in W.target_lines(spark, hashed).collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    keyed = spark.createDataFrame([(0, "X", 1), (1, "Y", 1), (2, "X", 2), (3, None, 1)], "_ord long, id string, n long")
    import shutil

    shutil.rmtree(next((tmp_path / "hashed").glob("file=*")))  # the output isn't what the keys say: they are made anew
    W.write_hashed(one, hashed)
    assert sorted(r.value for r in W.target_lines(spark, hashed).collect()) == ['{"a":1}', '{"a":2}']
    bare = str(tmp_path / "bare")
    for _ in range(2):
        W.write_hashed(one, bare, sidecar=False)
    assert W.target_lines(spark, bare).count() == 2 and not (tmp_path / "bare_keys").exists()
    bad = W.write_hashed(keyed, str(tmp_path / "keyed"), hash_field="id")
    assert W.target_lines(spark, str(tmp_path / "keyed")).count() == 2 and bad.count() == 1
    assert W.drain(one) is None and len(W.drain(one, "memory")) == 3
