"""Queries of checks and dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import balance as K
from millrace.operators import checks as C
from millrace.operators import pairing as P
from millrace.operators import recipes as R
from millrace.operators import rewards as W
from millrace.plans.pipeline import _CA, _PAIR, _batches, _candidates
from millrace.sources.tables import r6, table, trajectories

QUERIES, SQL = {}, {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_add("chk_successful_keys", lambda s, d: C.successful_keys(table(s, d, "lineitem").where("l_returnflag = 'N'"), "l_orderkey", "l_suppkey"), "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL")
_add("chk_inheritance", lambda s, d: C.inheritance(table(s, d, "documents").select("doc_id", (F.length("text") % 2).alias("quality")), table(s, d, "labels").select("doc_id", F.col("quality")), "doc_id", "quality"),
     "SELECT count(*) FILTER (l.doc_id IS NULL) AS unassigned, count(*) FILTER (l.doc_id IS NOT NULL AND length(text) % 2 <> l.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
_add("chk_same_order", lambda s, d: C.same_order(table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey"), table(s, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") + (F.col("o_orderkey") % 3)).alias("o_custkey")), "o_custkey"),
     "SELECT count(*) FILTER (o_orderkey % 7 = 0) AS missing, count(*) FILTER (o_orderkey % 7 > 0 AND o_orderkey % 3 > 0) AS unequal FROM orders")
_add("chk_pair_members", lambda s, d: C.pair_members(P.closest_pair(_candidates(s, d)), _candidates(s, d).where("tokens % 2 = 0")), f"""WITH {_CA}, {_PAIR}, m AS (SELECT question, 'positive' AS member, positive AS key FROM pr UNION ALL SELECT question, 'negative', negative FROM pr)
SELECT member, count(*) FILTER (tokens % 2 = 1) AS "foreign", 0::BIGINT AS wrong FROM m JOIN ca USING (question, key) GROUP BY member""")
_add("chk_mirrored", lambda s, d: C.mirrored(P.permutations(P.closest_pair(_candidates(s, d))).where("permutation_id = 0 OR length(question) % 2 = 0")), f"WITH {_CA}, {_PAIR} SELECT question FROM pr WHERE length(question) % 2 = 1")
_add("chk_records", lambda s, d: C.record_faults(table(s, d, "documents").select(F.substring(F.sha2("text", 256), 1, (F.col("doc_id") % 2 + 63).cast("int")).alias("text_hash"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("source_id"), (F.col("n_chars") - 300).alias("spare"), F.try_divide(F.lit(1.0), F.col("doc_id") % 4).alias("rate")), ("text_hash",), ("source_id",), ("spare",), ("rate",)),
     "SELECT 'text_hash' AS \"column\", count(*) FILTER (doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 'source_id', count(*) FILTER (doc_id % 5 = 0) FROM documents UNION ALL SELECT 'spare', count(*) FILTER (n_chars < 300) FROM documents UNION ALL SELECT 'rate', count(*) FILTER (doc_id % 4 = 0) FROM documents")
_add("chk_named_failures", lambda s, d: C.named_failures({"duplicate_key": P.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"), "orphan_order": table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")}),
     """WITH k AS (SELECT 'duplicate_key' AS "check", count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'orphan_order', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
SELECT *, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM k""")


def _mixed(s, d):
    k = F.col("o_orderkey") % 3
    n = F.col("o_custkey").cast("string")
    response = F.when(k == 0, F.concat(F.lit("so #### "), n)).when(k == 1, F.concat(F.lit("<answer>The "), n, F.lit("!</answer>"))).otherwise(F.concat(F.lit("\\boxed{"), n, F.lit("}")))
    golden = F.when(F.col("o_orderkey") % 2 == 0, n).otherwise("no")
    return table(s, d, "orders").select("o_orderkey", F.when(k == 0, "numbers").when(k == 1, "search").otherwise("boxed").alias("data_source"), response.alias("response"), golden.alias("golden"))


_add("rwd_dispatch", lambda s, d: W.dispatch(_mixed(s, d)).select("o_orderkey", "score"), "SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS DOUBLE) AS score FROM orders")
_add("rwd_at_last_token", lambda s, d: trajectories(s, d).groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "mask"))), lambda x: x["mask"]).alias("mask")).select("uid", F.array_position(W.at_last_token(F.lit(1.0), F.col("mask")), 1.0).alias("at")),
     "WITH t AS (SELECT l_orderkey AS uid, l_returnflag <> 'R' AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) SELECT uid, coalesce(max(k) FILTER (m), 0) AS at FROM t GROUP BY uid")
_add("par_rank_balance", lambda s, d: K.balanced(_batches(s, d), R.rank_balance, ranks=8))
_add("rwd_scores_rounded", lambda s, d: W.number_score(table(s, d, "orders").select("o_orderkey", F.concat(F.lit("#### "), F.col("o_custkey") % 9).alias("response"), F.lit("4").alias("golden")), True, 0.25).select("o_orderkey", r6("score").alias("score")), "SELECT o_orderkey, CASE WHEN o_custkey % 9 = 4 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS score FROM orders")
