"""python -m siltflow.plans.cli check|run|test FOLDER VARIANT [...], or log|journal --session FOLDER [...]

check    lists all that is wrong with a variant
run      reads --input (Parquet, JSON or CSV by its ending), writes each leaf to --session/<stage> as JSON, and the session's tables
test     runs the variant over CASE/input/seed.json and compares leaves with CASE/expected/<stage>.json
log      shows the last --tail records of a session's log and errors that match --stage and --search; --follow goes on with those that come
journal  shows rows and errors of each stage
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.operators.sessions import compare, follow, log
from siltflow.plans.runner import Runner
from siltflow.plans.variant import load_variant, validate


def read_input(spark: SparkSession, path: str) -> DataFrame:
    ending = path.rstrip("/").rpartition(".")[2]
    df = spark.read.parquet(path) if ending == "parquet" else spark.read.csv(path, header=True) if ending == "csv" else spark.read.json(path)
    return df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())


def show(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "journal":
        for r in spark.read.parquet(f"{args.session}/journal").orderBy("sid").collect():  # a row for each stage
            print(f"{r.sid}: {r.rows_out} rows, {r.errors} errors, {r.state}")
        return 0
    entries, errors = (spark.read.parquet(f"{args.session}/{x}") for x in ("log", "errors"))
    for r in log(entries, errors, stage=args.stage, search=args.search, tail=args.tail).collect():
        print(f"{r.t} {r.sid or '-'} {r.error or r.msg}")
    if args.follow:
        print_new = lambda rows, _: [print(f"{r.t} {r.sid or '-'} {r.msg}") for r in rows.orderBy("t").collect()]
        follow(spark, f"{args.session}/log", args.stage, args.search).writeStream.foreachBatch(print_new).start().awaitTermination()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("check", "run", "test", "log", "journal"))
    parser.add_argument("folder", nargs="?")
    parser.add_argument("variant", nargs="?")
    parser.add_argument("--input")
    parser.add_argument("--session", default="session")
    parser.add_argument("--case")
    parser.add_argument("--stage")
    parser.add_argument("--search")
    parser.add_argument("--tail", type=int, default=50)
    parser.add_argument("--follow", action="store_true")
    args = parser.parse_args(argv)
    if args.command in ("log", "journal"):
        return show(spark or SparkSession.builder.appName("siltflow").getOrCreate(), args)
    if not (args.folder and args.variant):
        parser.error("a folder and a variant are needed")
    variant = load_variant(args.folder, args.variant)
    errors = validate(variant)
    for x in errors:
        print(x, file=sys.stderr)
    if args.command == "check" or errors:
        return int(bool(errors))
    spark = spark or SparkSession.builder.appName("siltflow").getOrCreate()
    source = args.input if args.command == "run" else os.path.join(args.case or "", "input", "seed.json")
    runner = Runner(spark, args.session)
    if args.command == "run":
        run = runner.execute(variant, read_input(spark, source))
        for name, df in run.leaves(variant).items():
            df.write.mode("overwrite").json(os.path.join(args.session, name))
        return 0
    leaves = runner.compile(variant, read_input(spark, source)).leaves(variant)
    wrong = 0
    for name, df in leaves.items():
        at = os.path.join(args.case, "expected", f"{name}.json")
        if not os.path.exists(at):
            print(f"{name}: nothing expected", file=sys.stderr)
            wrong += 1
            continue
        actual = df.select(*[x for x in df.columns if not x.startswith("_")])
        expected = spark.read.schema(actual.schema).json(at)
        found = compare(expected, actual).limit(20).collect()
        for r in found:
            print(f"{name}: {r.side} x{r.n}: {r.record}", file=sys.stderr)
        wrong += bool(found)
    return int(bool(wrong))


if __name__ == "__main__":
    sys.exit(main())
