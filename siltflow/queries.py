"""Queries over the driver's tables, one for each operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltflow.functions.normalize import normalize
from siltflow.functions.sdk import run_tool
from siltflow.operators import accumulators as A
from siltflow.operators import builtins as B
from siltflow.operators import scratch
from siltflow.operators import sessions as S
from siltflow.sources import readers as R
from siltflow.sources import writers as W
from siltflow.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- filter and the expression language


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 100")
def filter_events(spark, sf):
    return B.filter_rows(_t(spark, sf, "events"), "v.event_type == 'purchase' && v.value > 100").select("event_id", "user_id", "value")


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR starts_with(lower(p_brand), 'brand#1')) AND NOT (p_type IS NULL OR p_type = '') AND (contains(p_type, 'A') OR p_size <= 10) AND length(p_name) > 3")
def filter_functions(spark, sf):
    text = "(includes(v.p_name, 'A') || startsWith(v.p_brand, 'BRAND#1')) && !empty(v.p_type) && (matches(v.p_type, 'A') || v.p_size <= 10) && length(v.p_name) > 3"
    return B.filter_rows(_t(spark, sf, "part"), text).select("p_partkey", "p_name")


@query("SELECT event_id FROM events WHERE value > 50 OR value IS NULL")
def filter_error_pass(spark, sf):
    return B.filter_rows(_t(spark, sf, "events"), "v.value > 50", "pass").select("event_id")


@query("SELECT event_id FROM events WHERE user_id IS DISTINCT FROM 3 AND (event_type = 'view' OR event_type = 'click')")
def filter_not_equal(spark, sf):
    return B.filter_rows(_t(spark, sf, "events"), "v.user_id != 3 && (v.event_type == 'view' || v.event_type == 'click')").select("event_id")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '^the') OR suffix(lower(lang), 'r')")
def filter_patterns(spark, sf):
    return B.filter_rows(_t(spark, sf, "documents"), "matches(lower(v.text), '^the') || endsWith(v.lang, 'R')").select("doc_id", "lang")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'eco') OR contains(lower(p_type), 'promo')")
def filter_contains(spark, sf):
    return B.filter_rows(_t(spark, sf, "part"), "contains(v.p_type, ['eco', 'PROMO'])").select("p_partkey")


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN c_custkey % 4 = 3 THEN 'inc' ELSE '' END AS company FROM customer")
def company_names(spark, sf):
    ending = F.element_at(F.array(F.lit(", Inc"), F.lit(" Ltd"), F.lit(" GMBH"), F.lit("Inc")), (F.col("c_custkey") % 4 + 1).cast("int"))
    df = _t(spark, sf, "customer").select("c_custkey", F.concat("c_name", ending).alias("name"))
    return normalize(df, [{"op": "compute", "expression": "normalize(v.name)", "target": "v.company"}]).data.select("c_custkey", "company")


@query("SELECT n_nationkey, 2 AS n, true AS same FROM nation WHERE n_regionkey < 3")
def object_lengths(spark, sf):
    """length and == of objects: a field of null is there."""
    one = F.struct(F.col("n_name").alias("a"), F.lit(None).cast("string").alias("b"))
    df = _t(spark, sf, "nation").select("n_nationkey", "n_regionkey", one.alias("o"), one.alias("p"))
    kept = B.filter_rows(df, "length(v.o) == 2 && v.o == v.p && v.n_regionkey < 3")
    made = normalize(kept, [{"op": "compute", "expression": "length(v.o)", "target": "v.n"}, {"op": "compute", "expression": "v.o == v.p", "target": "v.same"}]).data
    return made.select("n_nationkey", F.col("n").cast("int").alias("n"), "same")


# ---- route, fan-in, spread, toggle, replicas

_ROUTES = {"urgent": "v.o_orderpriority == '1-URGENT' && v.o_totalprice > 1000", "open": "v.o_orderstatus == 'O'", "large": "v.o_totalprice > 100000"}
_ROUTES_SQL = "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 1000 THEN 'urgent' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 100000 THEN 'large' END"


@query(f"SELECT {_ROUTES_SQL} AS channel, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE {_ROUTES_SQL} IS NOT NULL GROUP BY 1")
def route_orders(spark, sf):
    marked = B.with_channel(_t(spark, sf, "orders"), _ROUTES).where("_channel IS NOT NULL")
    return marked.groupBy(F.col("_channel").alias("channel")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"SELECT o_orderkey, o_custkey, {_ROUTES_SQL} AS channel FROM orders WHERE {_ROUTES_SQL} IN ('urgent', 'large')")
def fan_in_channels(spark, sf):
    parts = B.route(_t(spark, sf, "orders"), _ROUTES)
    return B.fan_in([parts[x].withColumn("channel", F.lit(x)) for x in ("urgent", "large")]).select("o_orderkey", "o_custkey", "channel")


@query("SELECT c_custkey AS k, 'c' AS side, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, 's', s_nationkey FROM supplier")
def fan_in_tables(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"))
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"))
    return B.fan_in([c, s])


@query("SELECT n_regionkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_regionkey, upper(n_name) FROM nation")
def spread_nation(spark, sf):
    one, two = B.spread(_t(spark, sf, "nation"), 2)
    return B.fan_in([B.filter_rows(one, "v.n_nationkey < 10").select("n_regionkey", "n_name"), two.select("n_regionkey", F.upper("n_name").alias("n_name"))])


@query("SELECT r_regionkey, r_name FROM region")
def toggle_region(spark, sf):
    df = _t(spark, sf, "region").select("r_regionkey", "r_name")
    return B.fan_in([B.toggle(df, "MODE", value="on", environ={"MODE": "on"}), B.toggle(df, "MODE", value="on", mode="off", environ={"MODE": "on"})])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def replicas_events(spark, sf):
    return B.replicas(_t(spark, sf, "events").withColumn("_id", F.col("event_id").cast("string")), 4, "hash-id").groupBy("user_id").agg(F.count("*").alias("n"))


# ---- dedup


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_documents(spark, sf):
    return B.dedup(_t(spark, sf, "documents").select("doc_id", "text"), ["v.text"], ["doc_id"]).data.select("doc_id")


@query("SELECT arg_min(event_id, event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedup_composite(spark, sf):
    return B.dedup(_t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]).data


@query("SELECT l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS k, count(*) - 1 AS dropped FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def dedup_traced(spark, sf):
    df = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    gone = B.dedup(df, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"], "trace").trace
    return gone.groupBy("k").agg(F.count("*").alias("dropped"))


@query("SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)")
def dedup_seen_keys(spark, sf):
    """Two runs of dedup over one index of keys: the second passes what the first has not seen."""
    orders = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    cut = orders.agg((F.max("o_orderdate") - F.expr("INTERVAL 365 DAYS")).alias("cut"))
    marked = orders.join(F.broadcast(cut))  # one row
    index = scratch.path(spark, "seen-keys")
    B.dedup(marked.where("o_orderdate < cut"), ["o_custkey"], ["o_orderkey"], index=index)
    return B.dedup(marked.where("o_orderdate >= cut"), ["o_custkey"], ["o_orderkey"], index=index).data.select("o_custkey")


@query("SELECT DISTINCT n FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def union_distinct(spark, sf):
    both = B.fan_in([_t(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("_ord")), _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("_ord"))])
    return B.dedup(both, ["v.n"], ["_input", "_ord"]).data.select("n")


# ---- group-by


@query("SELECT user_id::VARCHAR AS _group_key, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY user_id HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')")
def group_by_user(spark, sf):
    return B.group_by_unique(_t(spark, sf, "events"), "user_id", "event_type", "v.value", ["click", "purchase"])


@query("WITH n AS (SELECT o_custkey, o_orderstatus, max(o_orderkey) k FROM orders GROUP BY 1, 2) SELECT o_custkey::VARCHAR AS _group_key, count(*) AS n_labels, sum(k)::BIGINT AS keys FROM n GROUP BY 1")
def group_by_partial(spark, sf):
    out = B.group_by(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", emit_partial=True, order=["o_orderkey"])
    return out.select("_group_key", F.size("labels").cast("long").alias("n_labels"), F.aggregate(F.map_values("labels"), F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query("SELECT user_id::VARCHAR AS _group_key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS _seq, event_id FROM events WHERE event_type = 'view'")
def group_by_again(spark, sf):
    out = B.group_by(B.filter_rows(_t(spark, sf, "events"), "v.event_type == 'view'"), "user_id", "event_type", "event_id", expected=["view"], order=["event_id"])
    return out.select("_group_key", F.col("_seq").cast("long").alias("_seq"), F.col("labels")["view"].alias("event_id"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type AS l, event_id AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s(user_id, n, seq, now, done) AS (
        SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, CAST([] AS STRUCT(l VARCHAR, x BIGINT)[]), CAST(NULL AS STRUCT(l VARCHAR, x BIGINT)[]) FROM e
        UNION ALL
        SELECT user_id, n, seq + (len(t) >= 3)::BIGINT, CASE WHEN len(t) >= 3 THEN CAST([] AS STRUCT(l VARCHAR, x BIGINT)[]) ELSE t END, CASE WHEN len(t) >= 3 THEN t END
        FROM (SELECT e.user_id, e.n, s.seq, list_append(list_filter(s.now, lambda p: p.l <> e.l), {'l': e.l, 'x': e.x}) AS t FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT user_id::VARCHAR AS _group_key, seq AS _seq, '{' || array_to_string(list_transform(done, lambda p: '"' || p.l || '":' || p.x::VARCHAR), ',') || '}' AS labels FROM s WHERE done IS NOT NULL""")
def group_by_threshold(spark, sf):
    out = B.group_by(_t(spark, sf, "events"), "user_id", "event_type", "event_id", count_threshold=3, order=["event_id"])
    return out.select("_group_key", F.col("_seq").cast("long").alias("_seq"), F.to_json("labels").alias("labels"))


# ---- normalize


@query("SELECT p_partkey, floor(abs(p_retailprice) * 10 + 0.5) / 10 * sign(p_retailprice) AS rounded, p_retailprice * 1.5 AS scaled, least(greatest(p_size::DOUBLE, 5.0), 20.0) AS clamped, abs(p_retailprice - 1000) AS away, CAST(p_size AS DOUBLE) AS parsed FROM part")
def normalize_numbers(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("rounded"), F.col("p_retailprice").alias("scaled"), F.col("p_size").alias("clamped"), (F.col("p_retailprice") - 1000).alias("away"), F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(",0")).alias("parsed"))
    return normalize(df, [
        {"op": "round", "path": "v.rounded", "decimals": 1}, {"op": "scale", "path": "v.scaled", "factor": 1.5}, {"op": "clamp", "path": "v.clamped", "min": 5, "max": 20},
        {"op": "abs", "path": "v.away"}, {"op": "parse_number", "path": "v.parsed", "decimal": ","},
    ]).data


@query("SELECT p_partkey, trim(p_name) AS trimmed, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS replaced, upper(p_brand) AS upper, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END AS nulled FROM part")
def normalize_strings(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("trimmed"), F.col("p_name").alias("replaced"), F.col("p_brand").alias("upper"), F.col("p_type").alias("slug"), F.col("p_brand").alias("nulled"))
    return normalize(df, [
        {"op": "trim", "path": "v.trimmed"}, {"op": "replace", "path": "v.replaced", "pattern": "([aeiou])", "with": "<$1>", "regex": True}, {"op": "case", "path": "v.upper", "to": "upper"},
        {"op": "slugify", "path": "v.slug"}, {"op": "null_if", "path": "v.nulled", "values": ["Brand#11"]},
    ]).data


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp, epoch_ms(o_orderdate) AS ms FROM orders")
def normalize_dates(spark, sf):
    text = F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")
    df = _t(spark, sf, "orders").select("o_orderkey", text.alias("day"), text.alias("stamp"), text.alias("ms"))
    rule = lambda at, out: {"op": "parse_date", "path": f"v.{at}", "formats": ["%Y-%m-%d", "%d.%m.%Y %H:%M:%S"], "output": out}
    return normalize(df, [rule("day", "date"), rule("stamp", "datetime"), rule("ms", "epoch_ms")]).data


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN regexp_matches(c_mktsegment, '^AUTO(.*)$') THEN 'car-' || regexp_extract(c_mktsegment, '^AUTO(.*)$', 1) ELSE c_mktsegment END AS segment FROM customer")
def dict_segments(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return normalize(df, [{"op": "dict", "path": "v.segment", "map": {"BUILDING": "b", "/^AUTO(.*)$/": "car-$1"}}]).data


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS flag, CASE WHEN c_nationkey % 3 = 0 THEN 'USD' WHEN c_nationkey % 3 = 1 THEN 'EUR' ELSE 'XYZ' END AS code FROM customer")
def normalize_flags(spark, sf):
    code = F.element_at(F.array(F.lit(" us$ "), F.lit("€"), F.lit("xyz")), F.col("c_nationkey") % 3 + 1)
    df = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", " Yes").otherwise("off").alias("flag"), code.alias("code"))
    return normalize(df, [{"op": "parse_bool", "path": "v.flag"}, {"op": "normalize_currency", "path": "v.code"}]).data


@query("SELECT p_partkey, split_part(p_brand, '#', 1) AS maker, nullif(split_part(p_brand, '#', 2), '') AS number, concat_ws('/', split_part(p_brand, '#', 1), p_size::VARCHAR) AS joined, coalesce(nullif(split_part(p_brand, '#', 2), ''), p_type) AS filled, '{' || p_partkey::VARCHAR || '} ' || p_type AS label FROM part")
def shape_part(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), "p_size", "p_type")
    return normalize(df, [
        {"op": "split_field", "field": "brand", "separator": "#", "into": ["maker", "number"]},
        {"op": "join_fields", "fields": ["maker", "p_size"], "separator": "/", "into": "joined"},
        {"op": "coalesce", "fields": ["number", "p_type"], "into": "filled"},
        {"op": "template", "template": "{{{k}}} {t}", "from": {"k": "v.p_partkey", "t": "v.p_type"}, "target": "v.label"},
        {"op": "keep_fields", "fields": ["p_partkey", "maker", "number", "joined", "filled", "label"]},
    ]).data


@query("SELECT c_custkey AS x_key, c_acctbal AS x_balance FROM customer WHERE c_name IS NOT NULL AND c_name <> '' AND c_acctbal IS NOT NULL")
def require_and_keys(spark, sf):
    return normalize(_t(spark, sf, "customer"), [
        {"op": "require", "fields": ["c_name", "c_acctbal"]}, {"op": "whitelist", "keys": ["c_*key", "c_acct*"]}, {"op": "blacklist", "keys": ["*nation*"]},
        {"op": "rename", "map": {"c_custkey": "key", "c_acctbal": "balance"}}, {"op": "prefix_keys", "value": "x_"},
    ]).data


@query("SELECT event_id, value > 50 AND event_type = 'view' AS hit, 'v1' AS version FROM events WHERE value IS NOT NULL")
def compute_events(spark, sf):
    df = _t(spark, sf, "events").select("event_id", "value", "event_type")
    return normalize(df, [{"op": "compute", "expression": "v.value > 50 && v.event_type == 'view'", "target": "v.hit", "on_error": "drop"}, {"op": "add_field", "field": "version", "value": "v1"}, {"op": "drop_fields", "fields": ["value", "event_type"]}]).data


@query("SELECT o_orderkey, o_orderkey % 10000 + 0.5 AS amount, '€' AS currency FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, -(o_orderkey % 10000 + 0.5), '$' FROM orders WHERE o_orderkey % 7 = 0")
def split_amounts(spark, sf):
    number = F.concat((F.col("o_orderkey") % 10000).cast("string"), F.lit(",50"))
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("($"), number, F.lit(")"))).otherwise(F.concat(number, F.lit(" €")))
    return normalize(_t(spark, sf, "orders").select("o_orderkey", text.alias("price")), [{"op": "split_amount_currency", "path": "v.price", "target_amount": "amount", "target_currency": "currency", "decimal": ","}]).data.select("o_orderkey", "amount", "currency")


@query("SELECT p_partkey AS p_partkey_x, p_name || ' ' || p_brand AS spaced_x, lower(p_brand) AS low_x, nfc_normalize('é' || p_name) AS marked_x, [upper(p_name), upper(p_type)] AS many_x FROM part")
def normalize_texts(spark, sf):
    """Blanks, Unicode forms, all elements of an array, and suffixes of keys."""
    df = _t(spark, sf, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" \t  "), F.col("p_brand")).alias("spaced"), F.col("p_brand").alias("low"), F.concat(F.lit("e\u0301"), F.col("p_name")).alias("marked"), F.array("p_name", "p_type").alias("many"))
    return normalize(df, [
        {"op": "collapse_whitespace", "path": "v.spaced"}, {"op": "case", "path": "v.low", "to": "lower"}, {"op": "normalize_unicode", "path": "v.marked"},
        {"op": "case", "path": "v.many", "to": "upper"}, {"op": "suffix_keys", "value": "_x"},
    ]).data


@query("SELECT p_partkey, 1 AS one, 2 AS two, 3 AS three, p_size::VARCHAR AS single, '[' || p_size || ',7]' AS several FROM part")
def to_object_kinds(spark, sf):
    """Suffixes for repeated keys, and several values of a key as an array beside single ones."""
    df = _t(spark, sf, "part").select("p_partkey", F.array(F.lit("a"), F.lit("a"), F.lit("b")).alias("k"), F.array(*map(F.lit, (1, 2, 3))).alias("x"), F.array(F.lit("s"), F.lit("m"), F.lit("m")).alias("l"), F.array("p_size", "p_size", F.lit(7)).alias("y"))
    made = normalize(df, [{"op": "to_object", "keys": "v.k", "values": "v.x", "target": "v.m", "on_duplicate": "suffix"}, {"op": "to_object", "keys": "v.l", "values": "v.y", "target": "v.n", "on_duplicate": "array"}]).data
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return made.select("p_partkey", at("m", "a_1").alias("one"), at("m", "a_2").alias("two"), at("m", "b").alias("three"), F.to_json(at("n", "s")).alias("single"), F.to_json(at("n", "m")).alias("several"))


@query("SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f FROM orders GROUP BY 1")
def to_object_orders(spark, sf):
    # sums of doubles depend on their order: whole cents are compared
    held = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")))
    df = _t(spark, sf, "orders").groupBy("o_custkey").agg(held.alias("h")).select("o_custkey", F.col("h.o_orderstatus").alias("k"), F.col("h.o_totalprice").alias("x"))
    made = normalize(df, [{"op": "to_object", "keys": "v.k", "values": "v.x", "target": "v.m", "on_duplicate": "sum"}]).data
    return made.select("o_custkey", F.round(F.try_element_at("m", F.lit("O")), 2).alias("o"), F.round(F.try_element_at("m", F.lit("F")), 2).alias("f"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'P' WHEN value > 50 THEN 'big' END AS mark FROM events")
def normalize_profiles(spark, sf):
    df = _t(spark, sf, "events").select("event_id", "event_type", "value")
    mark = lambda x: [{"op": "add_field", "field": "mark", "value": x}]
    return normalize(df, profiles=[{"when": "v.event_type == 'purchase'", "rules": mark("P")}, {"when": "v.value > 50", "rules": mark("big")}]).data.select("event_id", "mark")


@query("SELECT event_id, 'rule_0: cannot convert value' AS _error FROM events WHERE event_type IN ('view', 'click')")
def normalize_errors(spark, sf):
    text = F.when(F.col("event_type").isin("view", "click"), "n/a").otherwise(F.col("value").cast("decimal(20,4)").cast("string"))
    return normalize(_t(spark, sf, "events").select("event_id", text.alias("value")), [{"op": "parse_number", "path": "v.value", "on_error": "quarantine"}]).errors.select("event_id", "_error")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_paths(spark, sf):
    df = _t(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return B.filter_rows(df, "v.p.k >= 50").select("event_id", F.col("p.k").alias("k"))


# ---- readers, writers, barriers, scans


def _text_file(df: DataFrame, name: str) -> str:
    """One text file with the lines of df, which has to be small, in its order; its path."""
    at = scratch.path(df.sparkSession, name)
    df.coalesce(1).write.text(at)
    return f"{at}/part-*.txt"


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_name AS line FROM customer QUALIFY row_idx BETWEEN 10 AND 109")
def read_skip_limit(spark, sf):
    at = _text_file(_t(spark, sf, "customer").orderBy("c_custkey").select("c_name"), "lines")
    return R.read_lines(spark, at, skip=10, limit=100).rows.select("row_idx", F.col("row").alias("line"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_partkey::VARCHAR AS k, p_name || ', \"' || p_brand || '\"' AS name, p_type AS col_2 FROM part")
def read_csv_part(spark, sf):
    """Quoted cells, and a last cell beyond the header."""
    name = F.concat(F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('""'))
    body = _t(spark, sf, "part").select("p_partkey", F.concat(F.col("p_partkey"), F.lit(',"'), name, F.lit('",'), F.col("p_type")).alias("value"))
    lines = body.union(spark.createDataFrame([(-1, "k,name")], "p_partkey long, value string")).orderBy("p_partkey").select("value")
    read = R.read_csv(spark, _text_file(lines, "csv"))
    return read.rows.select("row_idx", *[F.col("row")[x].alias(x) for x in ("k", "name", "col_2")])


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id % 2 = 0")
def write_read_ndjson(spark, sf):
    """Events written to two targets, and one of them read back."""
    base = scratch.path(spark, "ndjson")
    df = _t(spark, sf, "events").select("event_id", "user_id", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("file"), F.col("event_id").alias("_ord"))
    W.write_stream(df, base)
    return R.read_ndjson(spark, f"{base}/file=even", "event_id long, user_id long, event_type string").rows.select("row.*")


@query("SELECT event_type AS file, count(*) AS rows, 'lines' AS format FROM events GROUP BY 1")
def reader_meta(spark, sf):
    base = scratch.path(spark, "targets")
    W.write_stream(_t(spark, sf, "events").select(F.col("event_id").cast("string").alias("row"), F.col("event_type").alias("file"), F.col("event_id").alias("_ord")), base, "lines")
    meta = R.read_lines(spark, f"{base}/file=*").meta
    return meta.groupBy(F.regexp_extract("file", "file=([^/]+)", 1).alias("file"), "format").agg(F.sum("rows").alias("rows"))


@query("SELECT n_nationkey AS line_no, 'invalid JSON' AS error FROM nation WHERE n_nationkey % 5 = 3")
def reader_errors(spark, sf):
    """Bad lines beside good and empty ones; lines count as they stand in the file."""
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 3, F.concat(F.lit("{"), F.col("n_name"))).when(k % 5 == 4, "").otherwise(F.to_json(F.struct("n_name")))
    at = _text_file(_t(spark, sf, "nation").orderBy("n_nationkey").select(text), "bad-lines")
    return R.read_ndjson(spark, at).errors.select(F.col("line_no").cast("int").alias("line_no"), "error")


@query("SELECT DISTINCT o_custkey AS k FROM orders")
def write_hashed_twice(spark, sf):
    """Two runs over overlapping records leave each record once."""
    base = scratch.path(spark, "hashed")
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_ord"))
    W.write_hashed(orders.where("_ord % 3 <> 0"), base)
    W.write_hashed(orders.where("_ord % 3 <> 1"), base)
    return W.target_lines(spark, base).select(F.get_json_object("value", "$.k").cast("long").alias("k"))


@query("SELECT 'g' AS name, count(*) AS count, max(event_id)::VARCHAR AS last_id, true AS predicate_met, 'gate' AS stage_id FROM events")
def gate_state(spark, sf):
    at = scratch.path(spark, "gate")
    own = B.Gate(_t(spark, sf, "events").select(F.col("event_id").cast("string").alias("_id"), F.col("event_id").alias("_ord")), "g", at)
    own.data.agg(F.sum("_ord")).collect()  # an action that the rows pass, and one row
    own.settle()
    return spark.read.json(at).select("name", "count", "last_id", "predicate_met", "stage_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def checkpoint_gated(spark, sf):
    orders, at = _t(spark, sf, "orders").select("o_orderstatus", F.col("o_orderkey").alias("_ord")), scratch.path(spark, "gate")
    passed = B.Gate(orders, "g", at)
    return B.checkpoint(passed.data, scratch.path(spark, "spool"), [at], [passed]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey::VARCHAR AS target, octet_length(encode(r_name)) + 1 AS size, 'txt' AS ext, 'file' AS kind FROM region")
def scan_files(spark, sf):
    base = scratch.path(spark, "scanned")
    W.write_stream(_t(spark, sf, "region").select(F.col("r_name").alias("row"), F.col("r_regionkey").cast("string").alias("file")), base, "lines")
    found = R.scan_fs(spark, base.removeprefix("file://"), include="**/*.txt")
    return found.select(F.regexp_extract("directory", "file=([^/]+)$", 1).alias("target"), "size", "ext", "kind")


@query("SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'removed' ELSE 'modified' END AS action, n_name AS filename, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE n_nationkey + 1 END::BIGINT AS size FROM nation WHERE n_nationkey % 4 IN (0, 1)")
def scan_changes(spark, sf):
    size = F.col("n_nationkey").cast("long")
    scan = lambda df, size: df.select(F.lit("file").alias("kind"), F.lit("/r").alias("root"), F.lit("/r").alias("directory"), F.col("n_name").alias("filename"), F.lit("").alias("ext"), size.alias("size"), F.lit(0.0).alias("created"), F.lit(0.0).alias("changed"), F.lit(None).cast("string").alias("hash"))
    nation = _t(spark, sf, "nation")
    now = scan(nation.where("n_nationkey % 4 <> 0"), F.when(F.col("n_nationkey") % 4 == 1, size + 1).otherwise(size))
    return R.scan_diff(scan(nation, size), now).select("action", "filename", "size")


# ---- user tools, streams


class _Words:
    """Sends each word of a part's name through a queue; rejects large parts."""

    def process_input(self, v, settings, ctx):
        if v["p_size"] > settings["most"]:
            raise ValueError("too large")
        for x in v["p_name"].split(" "):
            ctx.emit("word", {"k": v["p_partkey"], "w": x})

    def process_word(self, v, settings, ctx):
        ctx.output({"k": v["k"], "w": ctx.cached("up", v["w"], lambda: v["w"].upper())})


_WORDS_SQL = "SELECT p_partkey AS k, upper(w) AS w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size <= 25)"


@query(f"{_WORDS_SQL} UNION ALL SELECT p_partkey, 'ValueError: too large' FROM part WHERE p_size > 25")
def tool_words(spark, sf):
    out = run_tool(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), _Words(), {"most": 25}, once=True)
    one = out.data.select(F.from_json("v", "k long, w string").alias("x")).select("x.*")
    bad = out.errors.select(F.from_json("v", "input string, error string").alias("e")).select(F.get_json_object("e.input", "$.p_partkey").cast("long").alias("k"), F.col("e.error").alias("w"))
    return one.unionByName(bad)


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a stream of one batch."""
    at = scratch.path(spark, "stream")
    df.write.parquet(at)
    return spark.readStream.schema(df.schema).parquet(at)


def _streamed(df: DataFrame, mode: str = "append") -> tuple[DataFrame, str]:
    """What a stream gives until its input ends, and its checkpoint folder."""
    spark, at, kept = df.sparkSession, scratch.path(df.sparkSession, "stream-out"), scratch.path(df.sparkSession, "stream-state")
    stateful.run_available(df, lambda rows, k: rows.write.mode("overwrite").parquet(f"{at}/batch={k}"), kept, mode)
    return spark.read.schema(df.schema).parquet(f"{at}/batch=*"), kept


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    events = _stream(spark, _t(spark, sf, "events").select("user_id", "event_type", "event_id"))
    return _streamed(stateful.dedup(events, ["v.user_id", "v.event_type"]).select("user_id", "event_type"))[0]


@query("SELECT user_id::VARCHAR AS _group_key, event_id AS view, false AS _partial FROM events WHERE event_type = 'view' UNION ALL SELECT user_id::VARCHAR, max(event_id), true FROM events WHERE event_type = 'click' GROUP BY user_id")
def stream_group_by(spark, sf):
    """Full groups as they fill, and the partial ones that the stream still holds at its end."""
    events = _t(spark, sf, "events").where("event_type IN ('view', 'click')").select(F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("k"), "event_type", "event_id", F.col("event_id").alias("_ord"))
    full, state = _streamed(stateful.group_by(_stream(spark, events), "v.k", "v.event_type", "v.event_id", expected=["view"]))
    rows = full.unionByName(stateful.partial_groups(spark, state))
    return rows.select(F.split_part("_group_key", F.lit("/"), F.lit(1)).alias("_group_key"), F.get("values", F.lit(0)).alias("view"), "_partial")


@query("SELECT user_id, count(*) AS count FROM events GROUP BY 1")
def stream_counts(spark, sf):
    return _streamed(stateful.running_counts(_stream(spark, _t(spark, sf, "events").select("user_id", "event_id")), ["user_id"]), "complete")[0]


# ---- accumulators, sessions


@query("SELECT user_id, sum(event_id)::BIGINT AS number, round(coalesce(avg(value), 0.0), 6) AS average, min(value) AS low, max(value) AS high, count(value) AS n, count(DISTINCT event_type) AS kinds, bool_or(event_type = 'view') AS view, bool_or(event_type = 'purchase') AS purchase, arg_max(event_id % 2 = 0, event_id) AS flag, count(*) % 2 = 1 AS toggled FROM events GROUP BY 1")
def accumulators(spark, sf):
    c = F.col
    mask = A.BitMask(["view", "purchase"])
    state = _t(spark, sf, "events").groupBy("user_id").agg(A.number(c("event_id")).alias("number"), A.average(c("value")).alias("average"), A.min_max(c("value")).alias("m"), F.size(A.set_of(c("event_type"))).cast("long").alias("kinds"), *mask.bits(c("event_type")), A.boolean(c("event_id") % 2 == 0, c("event_id")).alias("flag"), A.toggled(F.lit(1)).alias("toggled"))
    return A.trigger(state, c("number") >= 0).select("user_id", "number", F.round("average", 6).alias("average"), c("m.min").alias("low"), c("m.max").alias("high"), c("m.count").alias("n"), "kinds", "view", "purchase", "flag", "toggled")


@query("SELECT event_id, coalesce(lag(event_id, 2) OVER w, lag(event_id, 1) OVER w, event_id) AS oldest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def buffer_running(spark, sf):
    held = A.running_buffer(F.col("event_id"), 3, ["user_id"], ["event_id"])
    return _t(spark, sf, "events").select("event_id", F.get(held, F.lit(0)).alias("oldest"))


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1")
def accumulator_map(spark, sf):
    held = A.map_of(F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderkey"))
    out = _t(spark, sf, "orders").groupBy("o_custkey").agg(held.alias("m"))
    return out.select("o_custkey", F.try_element_at("m", F.lit("O")).alias("o"), F.try_element_at("m", F.lit("F")).alias("f"))


@query("SELECT 'c' || c_custkey AS id, 0 AS step, 'c' || c_custkey AS at FROM customer UNION ALL SELECT 'c' || c_custkey, 1, 'n' || c_nationkey FROM customer UNION ALL SELECT 'c' || c_custkey, 2, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def provenance_walk(spark, sf):
    """The records that each customer comes from; regions point at themselves in a circle of two."""
    name = lambda letter, x: F.concat(F.lit(letter), F.col(x).cast("string"))
    customer, nation = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    trace = customer.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("src")).union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(_t(spark, sf, "region").select(name("r", "r_regionkey"), name("r", "r_regionkey")))
    return S.provenance(trace, customer.select(name("c", "c_custkey").alias("id")))


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS src, 'stage' AS sid, o_orderstatus AS status FROM orders")
def trace_records(spark, sf):
    df = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), F.col("o_custkey").cast("string").alias("_src"), "o_orderstatus")
    return S.traced(df, "stage", {"status": F.col("o_orderstatus")}).select("id", "src", "sid", F.col("labels")["status"].alias("status"))


@query("""SELECT 'unexpected' AS side, '{"a":"<is_string>","k":"' || n_nationkey || '"}' AS record, 1::BIGINT AS n FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'missing', '{"a":"<is_string>","k":"<in_range>"}', count(*) FROM nation WHERE n_nationkey > 20""")
def snapshot_matchers(spark, sf):
    """Names match as any text and keys in a range; keys beyond it don't."""
    nation = _t(spark, sf, "nation")
    expected = nation.select(F.lit("any").alias("a"), F.least("n_nationkey", F.lit(20)).alias("k"))
    return S.compare(expected, nation.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("k")), matchers={"a": "is_string", "k": ("in_range", 0, 20)})


@query("SELECT event_id AS t, user_id::VARCHAR AS sid, event_type AS msg FROM events WHERE contains(event_type, 'click') ORDER BY t DESC LIMIT 50")
def session_log(spark, sf):
    entries = _t(spark, sf, "events").select(F.col("event_id").alias("t"), F.col("user_id").cast("string").alias("sid"), F.col("event_type").alias("msg"))
    return S.log(entries, search="CLICK", tail=50).select("t", "sid", "msg")


@query("SELECT coalesce(t.sid, e.sid) AS sid, coalesce(rows_out, 0) AS rows_out, coalesce(errors, 0) AS errors, 'killed' AS state FROM (SELECT o_orderpriority sid, count(*) rows_out FROM orders GROUP BY 1) t FULL JOIN (SELECT o_orderpriority sid, count(*) errors FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) e ON t.sid = e.sid")
def session_journal(spark, sf):
    trace = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("sid"), "o_orderstatus")
    return S.journal(["1-URGENT"], trace, trace.where("o_orderstatus = 'F'"))


@query("SELECT 'missing' AS side, n_name AS name, 1::BIGINT AS n FROM nation WHERE n_nationkey >= 20")
def snapshot_compare(spark, sf):
    nation = _t(spark, sf, "nation").select("n_name")
    found = S.compare(nation, _t(spark, sf, "nation").where("n_nationkey < 20").select("n_name"))
    return found.select("side", F.get_json_object("record", "$.n_name").alias("name"), "n")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT * FROM orders WHERE o_totalprice > 1000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) WHERE o_orderstatus IN ('O', 'F') GROUP BY 1")
def variant_dag(spark, sf):
    """A whole variant: filter, dedup, route and fan-in, compiled by the runner."""
    from siltflow.plans.runner import Runner
    from siltflow.plans.variant import Variant

    stages = {
        "dear": {"tool": "filter", "expression": "v.o_totalprice > ${LEAST:-1000}"},
        "first": {"tool": "dedup", "input": "dear", "dedup": {"key": ["v.o_custkey"]}},
        "by": {"tool": "route", "input": "first", "routes": {"open": "v.o_orderstatus == 'O'", "done": "v.o_orderstatus == 'F'"}},
        "all": {"tool": "spread", "input": ["by.open", "by.done"]},
        "end": {"tool": "normalize", "input": "all", "settings": {"rules": [{"op": "keep_fields", "fields": ["o_orderstatus", "o_orderkey"]}]}},
    }
    orders = _t(spark, sf, "orders").withColumn("_ord", F.col("o_orderkey"))
    run = Runner(spark, scratch.path(spark, "session"), environ={}).compile(Variant("v", "p", stages), orders)
    return run.data["end"].groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _session(spark: SparkSession, sf: str):
    """A run of a variant that is loaded from files: a child that overrides its parent's expression and takes settings from a file."""
    import json
    import os
    import tempfile

    from siltflow.plans.runner import Runner
    from siltflow.plans.variant import load_variant

    folder = tempfile.mkdtemp(prefix="siltflow-variant-")  # of the driver, which alone reads variants
    parent = {"variant": "base", "stages": {
        "dear": {"tool": "filter", "expression": "v.o_totalprice > 10"},
        "clean": {"tool": "normalize", "input": "dear", "settings_file": "$conf/rules.json"},
        "by": {"tool": "route", "input": "clean", "routes": {"open": "v.o_orderstatus == 'O'", "rest": "true"}},
    }}
    rules = {"rules": [{"op": "parse_number", "path": "v.mark", "on_error": "error"}, {"op": "keep_fields", "fields": ["o_orderkey", "o_orderstatus", "mark"]}]}
    for name, spec in (("base", parent), ("child", {"variant": "child", "extends": "base", "overrides": {"dear": {"expression": "v.o_totalprice > ${LEAST}"}}}), ("rules", rules)):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as file:
            json.dump(spec, file)
    mark = F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise("1")
    source = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", mark.alias("mark"), F.col("o_orderkey").alias("_ord"), F.col("o_orderkey").cast("string").alias("_id"), F.col("o_custkey").cast("string").alias("_src"))
    runner = Runner(spark, scratch.path(spark, "session"), environ={"LEAST": "1000"}, prefixes={"conf": folder})
    runner.execute(load_variant(folder, "child"), source)
    return runner


_DEAR = "FROM orders WHERE o_totalprice > 1000"


@query(f"""SELECT 'dear' AS sid, count(*) AS rows_out, 0::BIGINT AS errors, 'ok' AS state {_DEAR} UNION ALL SELECT 'clean', count(*) FILTER (WHERE o_orderkey % 10 <> 0), count(*) FILTER (WHERE o_orderkey % 10 = 0), 'failed' {_DEAR}
    UNION ALL SELECT 'by', 0, 0, 'ok' UNION ALL SELECT 'by.open', count(*), 0, 'ok' {_DEAR} AND o_orderkey % 10 <> 0 AND o_orderstatus = 'O' UNION ALL SELECT 'by.rest', count(*), 0, 'ok' {_DEAR} AND o_orderkey % 10 <> 0 AND o_orderstatus <> 'O'""")
def run_journal(spark, sf):
    """The journal that a run leaves."""
    return _session(spark, sf).session_table("journal")


@query(f"SELECT 'clean' AS sid, 'error' AS level, count(*) || ' rows rejected' AS msg {_DEAR} AND o_orderkey % 10 = 0")
def run_log(spark, sf):
    """What a run's log says of errors."""
    return S.log(_session(spark, sf).session_table("log"), search="rejected").select("sid", "level", "msg")


@query(f"SELECT 'o' || o_orderkey AS id, step, CASE step WHEN 0 THEN 'o' || o_orderkey ELSE o_custkey::VARCHAR END AS at FROM (SELECT o_orderkey, o_custkey {_DEAR} AND o_orderkey % 10 <> 0 AND o_orderstatus = 'O'), (VALUES (0), (1)) s(step)")
def run_provenance(spark, sf):
    """From a run's own trace: the records that the rows of a channel come from."""
    trace = _session(spark, sf).session_table("trace").where("sid = 'by.open'").select(F.concat(F.lit("o"), "id").alias("id"), "src")
    return S.provenance(trace, trace.select("id"))


@query(f"SELECT sid, tool, rows_in, rows_out FROM (SELECT 'clean' AS sid, 'normalize' AS tool, count(*) AS rows_in, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS rows_out {_DEAR})")
def run_stages(spark, sf):
    """Counts of a stage as it ran."""
    return _session(spark, sf).session_table("stages").where("sid = 'clean'").select("sid", "tool", "rows_in", "rows_out")
