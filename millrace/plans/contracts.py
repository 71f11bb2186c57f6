"""Queries of contracts and adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import contracts as C
from millrace.sources import files
from millrace.sources.tables import r6, s6, table, trajectories

QUERIES, SQL = {}, {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _trainer(s, d):
    """Two rows for each customer, some of them spoiled."""
    c, k = F.col("c_custkey"), F.col("k")
    digest = F.sha2(c.cast("string"), 256)
    truth = F.when(k == 0, "A").otherwise("B")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    extra = F.struct(
        F.when(c % 13 == 0, F.lit("x")).otherwise(digest).alias("pair_id"), F.when(c % 17 == 0, F.lit("")).otherwise(F.lpad(c.cast("string"), 9, "0")).alias("original_question_id"),
        F.when(c % 11 == 0, F.lit(0)).otherwise(k).cast("int").alias("permutation_id"), F.when((c % 7 == 0) | (k == 0), "AB").otherwise("BA").alias("permutation_label"),
        F.lit("s").alias("source"), F.when((c % 5 == 0) & (k == 1), "other").otherwise("train").alias("split"),
        *[digest.alias(run) for run in C.RUNS],
    )
    rows = table(s, d, "customer").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("not (c_custkey % 19 = 0 and k = 1)")
    return rows.select(
        (c * 2 + k).cast("long").alias("row_id"), F.when(c % 23 == 0, "no").otherwise("pairs").alias("data_source"), F.array(message("system", F.lit(C.SYSTEM)), message("user", F.when(c % 29 > 0, F.lit("q")))).alias("prompt"),
        F.lit("math").alias("ability"), F.struct(F.lit("rule").alias("style"), F.when(c % 31 == 0, "C").otherwise(truth).alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"),
    )


_T = """t AS (SELECT c_custkey AS c, k, c_custkey * 2 + k AS pos, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE sha256(CAST(c_custkey AS VARCHAR)) END AS pair_id,
CASE WHEN c_custkey % 17 = 0 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS q, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE k END AS p, CASE WHEN c_custkey % 7 = 0 OR k = 0 THEN 'AB' ELSE 'BA' END AS label,
CASE WHEN c_custkey % 5 = 0 AND k = 1 THEN 'other' ELSE 'train' END AS split, CASE WHEN c_custkey % 31 = 0 THEN 'C' WHEN k = 0 THEN 'A' ELSE 'B' END AS truth FROM customer, (VALUES (0), (1)) v(k) WHERE NOT (c_custkey % 19 = 0 AND k = 1)),
g AS (SELECT pair_id, count(*) AS n, count(DISTINCT p) AS k, count(DISTINCT q || '|' || split || '|' || CASE WHEN pair_id = 'x' THEN CAST(c AS VARCHAR) ELSE '' END) AS lines FROM t GROUP BY pair_id),
o AS (SELECT count(*) AS n FROM (SELECT q, p, lag(q) OVER (ORDER BY pos) AS q0, lag(p) OVER (ORDER BY pos) AS p0 FROM t) WHERE q < q0 OR (q = q0 AND p < p0))"""
_add("gat_trainer_contract", lambda s, d: C.trainer_faults(_trainer(s, d), "pairs"), f"""WITH {_T}
SELECT 'source' AS fault, count(*) FILTER (c % 23 = 0) AS n FROM t UNION ALL SELECT 'prompt', count(*) FILTER (c % 29 = 0) FROM t UNION ALL SELECT 'reward_model', count(*) FILTER (truth = 'C') FROM t
UNION ALL SELECT 'pair_id', count(*) FILTER (pair_id = 'x') FROM t UNION ALL SELECT 'permutation_id', 0 UNION ALL SELECT 'question', count(*) FILTER (q = '') FROM t
UNION ALL SELECT 'surface', count(*) FILTER (label <> CASE WHEN p = 0 THEN 'AB' ELSE 'BA' END OR truth <> CASE WHEN p = 0 THEN 'A' ELSE 'B' END) FROM t
UNION ALL SELECT unnest(['split_manifest_hash', 'generation_run_id', 'pair_run_id', 'permutation_run_id']), 0
UNION ALL SELECT 'duplicate_identity', CAST(sum(n - k) AS BIGINT) FROM g UNION ALL SELECT 'incomplete_pair', count(*) FILTER (n <> 2 OR k <> 2) FROM g UNION ALL SELECT 'lineage', count(*) FILTER (lines > 1) FROM g
UNION ALL SELECT 'order', n FROM o""")


def _logged(s, d):
    """A log of checks by supplier, against a manifest of 20 pairs."""
    n = s.range(40)
    manifest = n.select(F.floor(F.col("id") / 2).cast("long").alias("pair_id"), (F.col("id") % 2).alias("permutation"), F.col("id").alias("row_index"), F.floor(F.col("id") / 2).cast("long").alias("place"))
    pair = (F.col("l_partkey") % 23).cast("long")
    lines = table(s, d, "lineitem")
    checks = lines.select(F.col("l_suppkey").alias("block"), pair.alias("pair_id"), (F.col("l_linenumber") % 2).cast("long").alias("slot"), (pair * 2).alias("idx0"), (pair * 2 + F.when(F.col("l_quantity") % 10 == 0, 2).otherwise(1)).cast("long").alias("idx1"))
    spots = table(s, d, "supplier").select(F.col("s_suppkey").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(79).cast("long"))).alias("at"))
    moved = F.when(F.col("block") % 3 == 0, 79 - F.col("at")).otherwise(F.col("at"))
    base = spots.select("block", "at", F.floor(moved / 4).cast("long").alias("pair_id"), (F.floor(moved / 2) % 2).cast("long").alias("permutation"), F.floor(moved / 2).cast("long").alias("source"))
    return base, checks, manifest


_I = """c AS (SELECT l_suppkey AS block, l_partkey % 23 AS pair, l_linenumber % 2 AS slot, l_quantity % 10 = 0 AS bad FROM lineitem),
k AS (SELECT block, pair, slot, count(*) AS n, count(*) FILTER (bad OR pair >= 20) AS bad FROM c GROUP BY ALL),
b AS (SELECT block, CAST(sum(n) AS BIGINT) AS pair_checks, CAST(sum(n - 1) AS BIGINT) AS duplicate_check_keys, 40 - count(*) FILTER (pair < 20) AS missing_check_keys, count(*) FILTER (pair >= 20) AS unexpected_check_keys,
CAST(sum(bad) AS BIGINT) AS bad_pair_joins FROM k GROUP BY block),
i AS (SELECT s_suppkey AS block, 80::BIGINT AS base_rows, coalesce(pair_checks, 0) AS pair_checks, coalesce(duplicate_check_keys, 0) AS duplicate_check_keys, coalesce(missing_check_keys, 40) AS missing_check_keys,
coalesce(unexpected_check_keys, 0) AS unexpected_check_keys, coalesce(bad_pair_joins, 0) AS bad_pair_joins, 0::BIGINT AS unknown_sources, s_suppkey % 3 = 0 AS placement_reordered FROM supplier LEFT JOIN b ON s_suppkey = b.block)"""
_add("log_identity", lambda s, d: C.identity_report(*_logged(s, d)), f"WITH {_I} SELECT * FROM i")
_add("log_verdict", lambda s, d: C.identity_verdict(C.identity_report(*_logged(s, d)), 10).select("check", "n", "verdict"), f"""WITH {_I}, n AS (SELECT 'duplicate_check_keys' AS "check", count(*) FILTER (duplicate_check_keys > 0) AS n FROM i
UNION ALL SELECT 'missing_check_keys', count(*) FILTER (missing_check_keys > 0) FROM i UNION ALL SELECT 'unexpected_check_keys', count(*) FILTER (unexpected_check_keys > 0) FROM i
UNION ALL SELECT 'bad_pair_joins', count(*) FILTER (bad_pair_joins > 0) FROM i UNION ALL SELECT 'unknown_sources', 0 UNION ALL SELECT 'block_count', abs(count(*) - 10) FROM i
UNION ALL SELECT 'never_reordered', CASE WHEN bool_or(placement_reordered) THEN 0 ELSE count(*) END FROM i) SELECT *, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM n""")
_add("log_window", lambda s, d: C.log_window(table(s, d, "events").select((F.col("event_id") * 10).alias("at"), F.col("event_type").alias("line")), 400, 5000), "SELECT event_id * 10 AS at, event_type AS line FROM events WHERE event_id >= 40 AND event_id < 500")


def _fields(s, d):
    k = F.col("o_orderkey") % 6
    m = F.create_map(
        F.lit("status"), F.when(k == 0, "O K").otherwise(F.col("o_orderstatus")), F.lit("count"), F.when(k == 1, "-3").otherwise(F.col("o_custkey").cast("string")),
        F.when(k == 2, F.lit("password")).otherwise(F.lit("shard_id")), F.when(k == 3, "a/b").when(k == 4, "hf_abc").otherwise("x@1"), F.lit("elapsed_seconds"), F.when(k == 5, "nan").otherwise("1.5e3"),
    )
    return table(s, d, "orders").select("o_orderkey", F.array_join(C.public_faults(m), ",").alias("faults"))


_add("chk_public_fields", _fields, "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'status' WHEN 1 THEN 'count' WHEN 2 THEN 'password' WHEN 5 THEN 'elapsed_seconds' ELSE 'shard_id' END AS faults FROM orders")
_NAMES = ("ReadTimeout", "OutOfMemoryError", "ImportError", "GatedRepoError", "ValueError")
_add("chk_error_category", lambda s, d: table(s, d, "orders").select("o_orderkey", C.error_category(F.array(F.lit("Exception"), F.get(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % 5).cast("int")))).alias("category")),
     "SELECT o_orderkey, (['timeout', 'oom', 'dependency_error', 'access_denied', 'unexpected_error'])[1 + o_orderkey % 5] AS category FROM orders")
_add("gat_group_id", lambda s, d: table(s, d, "orders").select("o_orderkey", C.group_id(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 4 == 1, F.col("o_custkey")), F.when(F.col("o_orderkey") % 4 == 2, F.col("o_custkey")), F.col("o_orderkey")).alias("g")),
     "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CAST(o_custkey // 2 AS VARCHAR) ELSE CAST(o_orderkey // 2 AS VARCHAR) END AS g FROM orders")


def _tagged(s, d):
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    run = F.concat(F.lit(" think\n<code>\n```python\nprint("), n, F.lit(")\n```\n</code><interpreter>\n"), n, F.lit("\n</interpreter>"))
    text = F.when(k == 0, F.concat(run, F.lit("so <answer>"), n, F.lit("</answer>"))).when(k == 1, F.concat(F.lit("<answer>"), n, F.lit("</answer>"))).when(k == 2, F.concat(run, run, F.lit("open"))).otherwise(F.concat(F.lit("<interpreter>x</interpreter>"), run))
    turns = F.transform(C.tool_messages(text), lambda t: F.concat_ws("|", t["role"], t["content"], t["code"]))
    return table(s, d, "orders").select("o_orderkey", F.array_join(turns, "~").alias("turns"))


_add("rcp_tool_messages", _tagged, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'assistant|think|print(' || o_custkey || ')~tool|' || o_custkey || '~assistant|so ' || o_custkey WHEN 1 THEN 'assistant|' || o_custkey END AS turns FROM orders")
_add("arr_preference_row", lambda s, d: table(s, d, "orders").select("o_orderkey", C.preference_row(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")), F.sequence(F.lit(7), (F.col("o_custkey") % 3 + 7).cast("int")), 4).alias("p")).select(
    "o_orderkey", F.array_join(F.flatten("p.ids"), ",").alias("ids"), F.array_join(F.flatten("p.mask"), ",").alias("mask")),
     """WITH p AS (SELECT o_orderkey, o_orderkey % 5 + 1 AS a, o_custkey % 3 + 1 AS b FROM orders) SELECT o_orderkey, array_to_string([CASE WHEN i <= a THEN i ELSE 0 END FOR i IN range(1, 5)] || [CASE WHEN i <= b THEN i + 6 ELSE 0 END FOR i IN range(1, 5)], ',') AS ids,
array_to_string([CAST(i <= a AS INT) FOR i IN range(1, 5)] || [CAST(i <= b AS INT) FOR i IN range(1, 5)], ',') AS mask FROM p""")
_add("mth_flops", lambda s, d: C.dense_flops(table(s, d, "lineitem").select(F.col("l_suppkey").alias("batch"), F.col("l_quantity").cast("long").alias("length"), F.lit(0.5).alias("seconds")), 64, 1000, 3, 4, 2, 128).select("batch", r6("teraflops").alias("teraflops")),
     f"SELECT l_suppkey AS batch, {s6('(6.0 * (3 * (64 * 128 * 3 + 64 * (64 + 32 + 32 + 64)) + 1000 * 64 * 2) * sum(l_quantity) + 12.0 * sum(l_quantity * l_quantity) * 16 * 4 * 3) / 0.5 / 1e12')} AS teraflops FROM lineitem GROUP BY l_suppkey")
#: No SQL: the draws of a generator.
_add("met_bootstrap", lambda s, d: C.bootstrap(trajectories(s, d).select(F.col("uid").alias("group"), F.col("slot").alias("order"), F.col("score").alias("value")), 4, times=50))


def _scanned(s, d):
    """Two tables read as one, in order of files."""
    rows = files.read_many(s, f"{d}/documents.parquet", f"{d}/benchmark.parquet")
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return rows.select("file_no", F.coalesce(F.col("doc_id").cast("string"), F.col("item_id").cast("string")).alias("id"), message.alias("prompt"))


_add("src_prompt_rows", lambda s, d: files.prompt_rows(_scanned(s, d), longest=900).select("file_no", "id", F.md5(F.col("prompt")[0]["content"]).alias("text")),
     "SELECT 0 AS file_no, CAST(doc_id AS VARCHAR) AS id, md5(text) AS text FROM documents WHERE length(text) <= 900 UNION ALL SELECT 1, CAST(item_id AS VARCHAR), md5(text) FROM benchmark WHERE length(text) <= 900")
_add("src_answer_rows", lambda s, d: files.answer_rows(
    table(s, d, "documents").select("doc_id", F.array(F.struct(F.map_from_arrays(F.array(F.lit("q")), F.array("text")).alias("m"))).alias("turns"), F.struct(F.struct("lang").alias("inner")).alias("out")),
    "turns", "out", ("m", "q"), ("inner", "lang")).select("doc_id", F.md5("prompt").alias("prompt"), "response"),
     "SELECT doc_id, md5(text) AS prompt, lang AS response FROM documents")
_add("src_preference_rows", lambda s, d: files.preference_rows(table(s, d, "documents"), "source", "text", "lang").select("prompt", F.md5("chosen").alias("chosen"), "rejected"), "SELECT source AS prompt, md5(text) AS chosen, lang AS rejected FROM documents")


def _gate(s, d):
    x = table(s, d, "lineitem")
    source, generator = F.col("l_returnflag").alias("source"), F.concat(F.lit("g"), F.col("l_suppkey") % 3)
    plans = x.select(F.col("l_orderkey").alias("question"), source, generator.alias("generator"))
    status = F.when(F.col("l_quantity") % 4 == 0, "invalid").when((F.col("l_suppkey") % 3 == 1) | (F.col("l_quantity") % 4 == 1), "correct").when(F.col("l_quantity") % 4 == 2, "incorrect").otherwise("ambiguous")
    outcomes = x.select(source, generator.alias("generator"), status.alias("status"))
    k = F.col("l_orderkey") % 20
    pairs = x.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).where((F.col("l_returnflag") != "R") & (k < F.when(F.col("l_returnflag") == "A", 5).otherwise(3)))
    pairs = pairs.select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("source"), F.when(k < 3, "g0").otherwise("g1").alias("positive_generator"), F.when(F.col("n") < 0, "g1").otherwise("g2").alias("negative_generator"))
    return C.statistical_gate(plans, outcomes, pairs)


_G = """x AS (SELECT l_orderkey AS q, l_returnflag AS s, 'g' || l_suppkey % 3 AS g, CASE WHEN l_quantity % 4 = 0 THEN 'invalid' WHEN l_suppkey % 3 = 1 OR l_quantity % 4 = 1 THEN 'correct' WHEN l_quantity % 4 = 2 THEN 'incorrect' ELSE 'ambiguous' END AS st FROM lineitem),
c AS (SELECT s, g, count(*) AS n, count(*) FILTER (st = 'invalid') AS bad, count(*) FILTER (st = 'correct') AS k, count(*) FILTER (st IN ('correct', 'incorrect')) AS d FROM x GROUP BY ALL),
p AS (SELECT DISTINCT q, s, CASE WHEN q % 20 < 3 THEN 'g0' ELSE 'g1' END AS pg FROM x WHERE s <> 'R' AND q % 20 < CASE WHEN s = 'A' THEN 5 ELSE 3 END),
y AS (SELECT s, count(DISTINCT q) AS n, (SELECT count(*) FROM p WHERE p.s = x.s) AS k FROM x GROUP BY s),
e AS (SELECT s AS scope, 'positive' AS side, pg AS g FROM p UNION ALL SELECT 'pooled', 'positive', pg FROM p UNION ALL SELECT s, 'negative', 'g2' FROM p UNION ALL SELECT 'pooled', 'negative', 'g2' FROM p),
h AS (SELECT *, sum(k) OVER (PARTITION BY scope, side) AS n, 'generator_share:' || scope || '/' || side || '/' || g AS r FROM (SELECT scope, side, g, count(*) AS k FROM e GROUP BY ALL)),
f AS (SELECT 'invalid_error_rate:' || s || '/' || g || ':above_20_percent' AS rule, 'FAIL' AS severity FROM c WHERE bad * 5 > n
UNION ALL SELECT 'correct_rate:' || s || '/' || g || ':binary_extreme', 'WARN' FROM c WHERE d > 0 AND k IN (0, d)
UNION ALL SELECT 'pair_yield:' || s || ':below_20_percent', 'FAIL' FROM y WHERE k * 5 < n UNION ALL SELECT 'pair_yield:' || s || ':below_30_percent', 'WARN' FROM y WHERE k * 10 < n * 3
UNION ALL SELECT r || ':at_least_90_percent', 'FAIL' FROM h WHERE scope = 'pooled' AND k * 10 >= n * 9 UNION ALL SELECT r || ':above_70_percent', 'WARN' FROM h WHERE k * 10 > n * 7
UNION ALL SELECT r || ':strong_at_least_90_percent', 'WARN' FROM h WHERE scope <> 'pooled' AND k * 10 >= n * 9)"""
_add("gat_statistical", _gate, f"WITH {_G} SELECT * FROM f")
_add("gat_status", lambda s, d: C.gate_status(_gate(s, d)), f"WITH {_G} SELECT CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) > 0 THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status FROM f")
_add("met_partial_spans", lambda s, d: C.partial_spans(table(s, d, "lineitem").select(F.col("l_linenumber").alias("version_start"), (F.col("l_linenumber") + F.col("l_orderkey") % 3).alias("version_end"))).select("partial", r6("ratio").alias("ratio"), F.col("widest").cast("long").alias("widest")),
     f"SELECT count(*) FILTER (l_orderkey % 3 > 0) AS partial, {s6('count(*) FILTER (l_orderkey % 3 > 0) / count(*)')} AS ratio, CAST(max(l_orderkey % 3) AS BIGINT) AS widest FROM lineitem")


def _results(s, d, paired):
    k, name = F.col("o_orderkey") % 4, F.concat(F.lit("q"), F.floor(F.col("o_orderkey") / 4) if paired else F.col("o_orderkey"), F.lit("_perm_"), F.col("o_orderkey") % 2)
    extra = F.when(k < 3, F.struct(F.lit(None).cast("string").alias("question_id"), F.when(k == 2, name).alias("pair_id"), F.lit("x").alias("id"), F.col("o_custkey").alias("original_index"))) if paired else F.struct(
        F.lit(None).cast("string").alias("question_id"), name.alias("pair_id"), F.lit("x").alias("id"), F.col("o_custkey").alias("original_index"))
    none = F.lit(None).cast("string")
    rows = table(s, d, "orders").select("o_orderkey", (F.when(k == 0, name) if paired else none).alias("question_id"), (F.when(k == 1, name) if paired else none).alias("id"), extra.alias("extra"), F.col("o_orderkey").cast("string").alias("row_index"))
    return C.result_groups(rows).select("o_orderkey", "group")


_add("met_result_groups", lambda s, d: _results(s, d, True), """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'q' || o_orderkey // 4 ELSE CAST(o_orderkey AS VARCHAR) END AS "group" FROM orders""")
_add("met_result_groups_by_index", lambda s, d: _results(s, d, False), """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS "group" FROM orders""")
