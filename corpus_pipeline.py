"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to
the shared folder and reads it again for the next one.  All stages but the last return the
columns of `documents`.

Defined results: rows of null, empty or blank text are judged like any other text by the
classifiers, are their own class in the join, hold no benchmark item and encode to no ids;
rows of a repeated or missing doc_id are judged each by its own text; of equal rows with a doc_id
one stays, rows without stay beside each other; ties between equal texts go to the least doc_id;
empty tables pass through all stages as empty tables; without labels nothing is rejected as
toxic, and quality scores are those of an unfitted model (0.5, so that all stay); extra columns
are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.llm import bpe, contamination, jaccard, quality, queries, storage, toxicity


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under queries.QUALITY_CUT go.  Labels are learned from the training fold."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="_score").where(F.col("_score") >= queries.QUALITY_CUT).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.  Labels are learned from the training fold."""
    model = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score").where(F.col("_score") < 0.5).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of the shingles of a benchmark item go."""
    return contamination.remove(docs, queries.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text that they decode to."""
    path = queries.vocabulary_path()
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, keep_text=False), path)
    spelled = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(spelled, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("toxicity", toxicity_filter), ("n-gram Jaccard join", jaccard_join), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe_encoding)]

#: The classifiers and the tokenizer are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = storage.new_path(spark, name.replace(" ", "-"))
        with storage.scope(spark):  # what a stage holds on its way goes with it
            docs = storage.materialize(stage(spark, docs, sf_dir), name, path)
        if last:
            storage.drop(spark, last)
        last = path
    return docs
