"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary file of op4 and op10.
VOCABULARY = "word_bpe_49k.json"

#: Words of the longest n-grams of op8.
LM_ORDER = 3

#: A document is kept from this quality score on.
QUALITY_CUT = 0.3


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import sharding

    dealt = sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharding.with_slots(dealt, "doc_id", ties=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import bpe

    path = vocabulary_path()
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False)
    both = bpe.decode(coded, path)
    spelled = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import contamination

    return contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import backoff_lm

    return backoff_lm.score(table(spark, sf_dir, "documents"), order=LM_ORDER)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import rules

    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import folds, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (folds.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import storage, token_files

    path = storage.new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary_path())
    rows = token_files.read(spark, path)
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import folds, quality

    # features are made once, for the risk over all documents and for the scores
    rows = quality.feature_table(table(spark, sf_dir, "documents"))
    scored = quality.score_features(rows, quality.fit_labels(rows, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (folds.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltflow.llm import folds, language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = folds.remainder("doc_id", 4) == 2
    model = language.train(docs.where(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {"op1_contamination": op1_contamination, "op2_jaccard": op2_jaccard, "op8_backoff_lm": op8_backoff_lm, "op9_rules": op9_rules, "op3_toxicity": op3_toxicity, "op4_token_files": op4_token_files, "op5_quality": op5_quality, "op7_language": op7_language, "op6_sharding": op6_sharding, "op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {
    "op1_contamination": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
        i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM benchmark),
        isz AS (SELECT item_id, ws, least(5, len(ws)) k FROM i WHERE len(ws) > 0),
        ish AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') s FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) j FROM isz)),
        ks AS (SELECT DISTINCT k FROM isz),
        dsh AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j:j + k - 1], ' ') s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) j FROM w, ks WHERE len(ws) >= k)),
        n AS (SELECT item_id, count(*) n FROM ish GROUP BY item_id)
        SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared, count(*) / n AS containment
        FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING 5 * count(*) >= 4 * n""",
    "op2_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[j:j + 4], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) j FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) n FROM sh GROUP BY doc_id),
        o AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) c FROM r GROUP BY a),
        d AS (SELECT a, count(*) k FROM l GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id, coalesce(d.k, 0) AS n_links
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id LEFT JOIN d ON d.a = w.doc_id""",
    # crc32 by its table, which is made by its rule; with equal weights the largest draw is the largest unit
    "op6_sharding": """
        WITH RECURSIVE t(i, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
        tab AS MATERIALIZED (SELECT list(c ORDER BY i) l FROM t WHERE k = 8),
        b AS (SELECT doc_id, coalesce(text, '') x, list_transform(range(0, 17), lambda j: ('0x' || substr(md5(doc_id::VARCHAR || ':' || j::VARCHAR), 1, 13))::BIGINT) u FROM documents),
        d AS (SELECT doc_id, octet_length(encode(x)) + 1 AS size, list_position(u[1:16], list_max(u[1:16])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda p, q: xor(p >> 8, l[(xor(p, q) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, tab)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
            row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 1024, doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard
        FROM d""",
}
