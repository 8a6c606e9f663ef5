"""Sources: seed feeds, NDJSON, lines and CSV files, and file-system scans.

Readers give a row for each record: file, row_idx (place in its file: the number of its line, or
of its CSV record, from 0), row, _id, _src, _ord.  Rows that cannot be read come back beside
them.  Files are split among tasks; a line's number is its place in its split and the sum of
the splits before, so no file is sorted or held by one task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Read:
    """Rows, bad rows with their error, and a row for each file: file, format, rows."""

    rows: DataFrame
    errors: DataFrame
    meta: DataFrame


def blake2b64(values: pa.Array) -> pa.Array:
    """16 hex digits of an 8-byte BLAKE2b."""
    import hashlib

    return pa.array([None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest() for x in values.to_pylist()], pa.string())


def text_id(col) -> F.Column:
    return F.arrow_udf(blake2b64, "string")(col)


def _paths(paths: str | Sequence[str]) -> str | list[str]:
    return paths if isinstance(paths, str) else list(paths)


def _numbered_lines(spark: SparkSession, paths: str | Sequence[str], blank: bool = True) -> DataFrame:
    """file, line, and its number within the file from 0 as _line; without `blank`, empty lines neither stay nor count.

    Rows of a split follow each other, so a row's place in its split is its ordinal less the
    split's first; only the counts of splits meet, a few rows for each file.
    """
    raw = spark.read.text(_paths(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.col("value").alias("line"))
    kept = (raw if blank else raw.where(F.col("line") != "")).withColumn("_m", F.monotonically_increasing_id())
    splits = kept.groupBy("file", "_split").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return kept.join(starts, ["file", "_split"]).select("file", "line", (F.col("_m") + F.col("_start")).alias("_line"))


def _limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of each file; each task keeps `limit` of them at most before they meet."""
    if limit is None:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("_line"))).where(F.col("_k") <= limit).drop("_k")


def _finished(spark: SparkSession, paths: str | Sequence[str], rows: DataFrame, errors: DataFrame | None, kind: str) -> Read:
    """_id is the BLAKE2b of file:row_idx, made by Python in blocks where it is asked for; _src counts from 1.  Files without rows have their meta."""
    own = rows.select("file", F.col("_line").alias("row_idx"), "row", text_id(F.concat_ws(":", "file", F.col("_line").cast("string"))).alias("_id"), F.concat_ws(":", "file", (F.col("_line") + 1).cast("string")).alias("_src"), F.struct("file", F.col("_line").alias("row_idx")).alias("_ord"))
    if errors is None:
        errors = rows.where(F.lit(False)).select("file", F.col("_line").alias("line_no"), F.lit("").alias("input"), F.lit("").alias("error"))
    # names only, which the driver has from listing them; empty files too, which no task reads
    files = spark.createDataFrame([(re.sub("^file:/+", "file:/", x),) for x in spark.read.text(_paths(paths)).inputFiles()], "file string")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    meta = files.join(counts, "file", "left").select("file", F.lit(kind).alias("format"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return Read(own, errors, meta)


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, skip: int = 0, limit: int | None = None) -> Read:
    """A row for each line that isn't empty; a line of blanks is bad JSON.  Without a schema, `row` is the line's JSON text; with one, a struct."""
    lines = _numbered_lines(spark, paths).where((F.col("line") != "") & (F.col("_line") >= skip))
    good = F.try_parse_json("line").isNotNull() | F.lower(F.trim("line")).eqNullSafe("null")
    errors = lines.where(~good).select("file", F.col("_line").alias("line_no"), F.col("line").alias("input"), F.lit("invalid JSON").alias("error"))
    rows = _limited(lines.where(good), limit)
    rows = rows.withColumn("row", F.from_json("line", schema) if schema is not None else F.trim("line"))
    return _finished(spark, paths, rows, errors, "ndjson")


def read_lines(spark: SparkSession, paths: str | Sequence[str], skip: int = 0, limit: int | None = None) -> Read:
    """A row for each line, blank ones too."""
    rows = _limited(_numbered_lines(spark, paths).where(F.col("_line") >= skip), limit).withColumn("row", F.col("line"))
    return _finished(spark, paths, rows, None, "lines")


def _csv_cells(delim: str):
    """Lines to their cells, null for a line that ends within quotes."""

    def run(lines: pa.Array) -> pa.Array:
        import csv

        out: list[list[str] | None] = []
        for line in lines.to_pylist():
            # a record that goes on takes the mark of the next line into its last cell
            cells = next(csv.reader([line + "\n", "\0"], delimiter=delim), [])
            out.append(None if cells and cells[-1].endswith("\n\0") else cells)
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def _csv_streamed(delim: str):
    """Lines (file, _line, line) in order to records (file, _line, cells), one file after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv
        from itertools import groupby

        def rows() -> Iterator[tuple[str, str]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        for name, own in groupby(rows(), key=lambda x: x[0]):
            out: list[list[str]] = []
            place = 0
            for cells in csv.reader((line + "\n" for _, line in own), delimiter=delim):
                if cells:
                    out.append(cells)
                if len(out) == 10_000:
                    yield batch_of(name, place, out)
                    out, place = [], place + len(out)
            if out:
                yield batch_of(name, place, out)

    def batch_of(name: str, place: int, out: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(range(place, place + len(out)), pa.int64()), pa.array(out, pa.list_(pa.string()))], ["file", "_line", "cells"])

    return run


def read_csv(spark: SparkSession, paths: str | Sequence[str], header: bool = True, delim: str = ",", skip: int = 0, limit: int | None = None) -> Read:
    """A map of header to text for each record, or an array of texts without a header.  Cells beyond the header are col_<i>; short rows lack keys; of a repeated name the last cell wins.

    Where every line of a file is a record, its lines are taken apart in all tasks.  A file with a
    line break within quotes (which is read as \\n) is streamed by one task, as only what came
    before tells where a record begins.
    """
    if len(delim) != 1 or ord(delim) > 127:
        raise ValueError("the delimiter has to be one ASCII character")
    lines = _numbered_lines(spark, paths, blank=False).withColumn("cells", _csv_cells(delim)(F.col("line")))
    broken = lines.where(F.col("cells").isNull()).select("file").distinct()
    plain = lines.join(broken, "file", "left_anti").select("file", "_line", "cells")
    whole = _numbered_lines(spark, paths).join(broken, "file", "left_semi")
    streamed = whole.repartition("file").sortWithinPartitions("file", "_line").select("file", "line").mapInArrow(_csv_streamed(delim), "file string, _line long, cells array<string>")
    records = plain.union(streamed)
    if header:
        heads = records.where("_line = 0").select("file", F.col("cells").alias("head"))
        names = F.transform("cells", lambda _, i: F.coalesce(F.get("head", i), F.concat(F.lit("col_"), i.cast("string"))))
        body = records.where("_line > 0").join(heads, "file").select("file", (F.col("_line") - 1).alias("_line"), "cells", names.alias("names"))
        once = F.array_distinct("names")
        last = F.transform(once, lambda k: F.element_at(F.filter(F.arrays_zip("names", "cells"), lambda p: p["names"] == k), -1)["cells"])
        row = F.when(F.size(once) == F.size("names"), F.map_from_arrays("names", "cells")).otherwise(F.map_from_arrays(once, last))
        body = body.select("file", "_line", row.alias("row"))
    else:
        body = records.select("file", "_line", F.col("cells").alias("row"))
    return _finished(spark, paths, _limited(body.where(F.col("_line") >= skip), limit), None, "csv")


def with_input(read: Read, inputs: DataFrame, path: str = "path") -> Read:
    """Each row with the fields of the input record that named its file (passthrough_input); file, row_idx and row stay the reader's.

    Paths are compared without a scheme; an input that names a folder takes no part.
    """
    bare = lambda c: F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:/+", "/")
    kept = [x for x in inputs.columns if x not in read.rows.columns]
    named = inputs.select(bare(F.col(path)).alias("_named"), *[F.col(f"`{x}`") for x in kept]).dropDuplicates(["_named"])
    rows = read.rows.withColumn("_named", bare(F.col("file"))).join(named, "_named", "left").drop("_named")
    return Read(rows, read.errors, read.meta)


def seed(spark: SparkSession, seed_json: str | None = None, seed_file: str | None = None, input_path: str | None = None) -> DataFrame:
    """The seed feed as envelopes t, id, src, v (JSON text): inline JSON, or else a seed file, or else an input file or <dir>/_seed.ndjson, or else nothing.

    Objects without `t` are wrapped: t "d", id the BLAKE2b of v, src "seed".
    """
    if seed_json is not None:
        lines = spark.createDataFrame([(seed_json,)], "line string")
    else:
        path = seed_file
        if path is None and input_path is not None:
            path = f"{input_path}/_seed.ndjson" if os.path.isdir(input_path) else input_path
            if os.path.isdir(input_path) and not os.path.exists(path):
                path = None
        if path and os.path.basename(path).startswith("_"):
            # Spark passes over files with such names; a seed file is read by the driver
            with open(path, encoding="utf-8") as file:
                lines = spark.createDataFrame([(x.rstrip("\n"),) for x in file], "line string")
        else:
            lines = spark.read.text(path).select(F.col("value").alias("line")) if path else spark.createDataFrame([], "line string")
    lines = lines.where(F.trim("line") != "")
    t = F.get_json_object("line", "$.t")
    part = lambda name, own: F.when(t.isNotNull(), F.coalesce(F.get_json_object("line", f"$.{name}"), F.lit(""))).otherwise(own)
    return lines.select(F.coalesce(t, F.lit("d")).alias("t"), part("id", text_id(F.trim("line"))).alias("id"), part("src", F.lit("seed")).alias("src"), F.when(t.isNotNull(), F.get_json_object("line", "$.v")).otherwise(F.trim("line")).alias("v"))


# ---- scans

SCAN_SCHEMA = "kind string, root string, directory string, filename string, ext string, size long, created double, changed double, hash string"


def globs(patterns: str | Sequence[str] | None) -> list[re.Pattern]:
    """Patterns of a list, or parted by semicolons; ** crosses folders, * does not."""
    parts = [x.strip() for x in patterns.split(";")] if isinstance(patterns, str) else list(patterns or [])
    out = []
    for p in filter(None, parts):
        regex = ""
        for piece in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", p):
            regex += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, piece if piece[0] == "[" and len(piece) > 1 else re.escape(piece))
        out.append(re.compile(regex + r"\Z"))
    return out


def hash_bytes(path: str, algo: str) -> str | None:
    """Of a file's bytes: XXH3-64 (16 hex digits), BLAKE2b-128 (32), or none."""
    if algo == "none":
        return None
    if algo == "xxhash":
        import xxhash

        state = xxhash.xxh3_64()
    elif algo == "blake2b":
        import hashlib

        state = hashlib.blake2b(digest_size=16)
    else:
        raise ValueError(f"unknown hash {algo!r}")
    with open(path, "rb") as file:
        while chunk := file.read(1 << 16):
            state.update(chunk)
    return state.hexdigest()


def scan_fs(spark: SparkSession, root: str, returns: str = "files", include: str | Sequence[str] | None = None, exclude: str | Sequence[str] | None = None, depth: int | None = None, hidden: bool = False, follow_symlinks: bool = False, hash: str = "xxhash", min_size: int | None = None, max_size: int | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """A record for each file or folder below root; files are hashed by tasks.

    A root with a scheme other than file: is listed by Spark (scan_store), a local one by the
    driver.  `extra` (passthrough_input) adds constant columns; a record's own fields win.
    """
    if returns not in ("files", "dirs", "both"):
        raise ValueError(f"unknown return {returns!r}")
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*:/", root):
        if returns != "files" or hidden or follow_symlinks:
            raise ValueError("in a store only files are scanned, and no hidden ones")
        return scan_store(spark, root, include, exclude, depth, hash, min_size, max_size, extra)
    root = re.sub("^file:/+", "/", root)
    want, avoid = globs(include), globs(exclude)
    found = []
    for folder, dirs, files in os.walk(root, followlinks=follow_symlinks):
        level = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        if not hidden:
            dirs[:] = [x for x in dirs if not x.startswith(".")]
        for kind, names in (("dir", dirs), ("file", files)):
            for name in names:
                path = os.path.join(folder, name)
                rel = os.path.relpath(path, root).replace(os.sep, "/")
                if (os.path.islink(path) and not follow_symlinks) or (not hidden and name.startswith(".")) or (kind == "file" and not os.path.isfile(path)):
                    continue
                if returns not in (kind + "s", "both") or (depth is not None and level + 1 > depth):
                    continue
                if (want and not any(p.match(rel) for p in want)) or any(p.match(rel) for p in avoid):
                    continue
                info = os.stat(path)
                if kind == "file" and ((min_size is not None and info.st_size < min_size) or (max_size is not None and info.st_size > max_size)):
                    continue
                stem, dot = os.path.splitext(name) if kind == "file" else (name, "")
                found.append((kind, root, folder, stem, dot.lstrip("."), info.st_size if kind == "file" else None, getattr(info, "st_birthtime", info.st_ctime), info.st_mtime, path))
    df = spark.createDataFrame(found, SCAN_SCHEMA.replace("hash string", "path string"))

    def hashed(paths: pa.Array) -> pa.Array:
        return pa.array([hash_bytes(x, hash) if x else None for x in paths.to_pylist()], pa.string())

    value = F.arrow_udf(hashed, "string")(F.when(F.col("kind") == "file", F.col("path"))) if hash != "none" else F.lit(None).cast("string")
    out = df.repartition(max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions"))))).withColumn("hash", value).drop("path")
    return out.withColumns({k: F.lit(v) for k, v in (extra or {}).items() if k not in out.columns and k != "path"})


def scan_store(spark: SparkSession, root: str, include: str | Sequence[str] | None = None, exclude: str | Sequence[str] | None = None, depth: int | None = None, hash: str = "xxhash", min_size: int | None = None, max_size: int | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """scan_fs for files of any store that Spark reads, listed by Spark's tasks; `created` is the time of the last change, as stores know no other.

    Spark passes over names that begin with a dot or an underscore.  Without a hash no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z][a-z0-9+.-]*:/+", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/+", "/")
    found = files.select(path.alias("_path"), "length", "modificationTime", "content")
    if base != "/":  # a path with an authority has it before the folder
        found = found.withColumn("_path", F.concat(F.lit(base), F.substring_index(F.col("_path"), base, -1)))
    found = found.withColumn("_rel", F.substring("_path", len(base) + 1, 1 << 30))
    for patterns, wanted in ((globs(include), True), (globs(exclude), False)):
        if patterns:
            test = F.lit(False)
            for p in patterns:
                test = test | F.col("_rel").rlike("^" + p.pattern.replace("\\Z", "\\z"))
            found = found.where(test if wanted else ~test)
    if depth is not None:
        found = found.where(F.size(F.split("_rel", "/")) <= depth)
    if min_size is not None:
        found = found.where(F.col("length") >= min_size)
    if max_size is not None:
        found = found.where(F.col("length") <= max_size)

    def hashed(contents: pa.Array) -> pa.Array:
        import hashlib

        import xxhash

        of = (lambda x: xxhash.xxh3_64_hexdigest(x)) if hash == "xxhash" else (lambda x: hashlib.blake2b(x, digest_size=16).hexdigest())
        return pa.array([of(x.as_buffer()) for x in contents], pa.string())

    name, seconds = F.element_at(F.split("_rel", "/"), -1), F.unix_micros("modificationTime") / 1e6
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    value = F.lit(None).cast("string") if hash == "none" else F.arrow_udf(hashed, "string")(F.col("content"))
    out = found.select(F.lit("file").alias("kind"), F.lit(root).alias("root"), F.regexp_replace("_path", "/[^/]*$", "").alias("directory"), stem.alias("filename"), ext.alias("ext"), F.col("length").alias("size"), seconds.alias("created"), seconds.alias("changed"), value.alias("hash"))
    return out.withColumns({k: F.lit(v) for k, v in (extra or {}).items() if k not in out.columns and k != "path"})


def scan_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Of an earlier scan's records: those that are gone (action removed, as they were) and those that changed (modified, as they are).  New files aren't reported."""
    key = ["kind", "directory", "filename", "ext"]
    names = [x for x in current.columns if x not in key]
    now = current.select(*key, *[F.col(x).alias("_" + x) for x in names], F.lit(True).alias("_there"))
    both = previous.join(now, [previous[x].eqNullSafe(now[x]) for x in key], "left").select(*[previous[x] for x in previous.columns], *[now["_" + x] for x in names], "_there")
    by_hash = F.col("hash").isNotNull() & F.col("_hash").isNotNull()
    changed = F.when(by_hash, F.col("hash") != F.col("_hash")).otherwise(~F.col("size").eqNullSafe(F.col("_size")) | (F.abs(F.col("changed") - F.col("_changed")) > 0.001))
    action = F.when(F.col("_there").isNull(), "removed").when(changed, "modified")
    fresh = [F.when(F.col("action") == "modified", F.col("_" + x)).otherwise(F.col(x)).alias(x) if x in names else F.col(x) for x in previous.columns]
    return both.withColumn("action", action).where(F.col("action").isNotNull()).select("action", *fresh)


