"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.sources.tables import EVAL, TRAJ, evaluations, r6, s6, table, trajectories

QUERIES, SQL = {}, {}


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _add(name, run, sql):
    QUERIES[name], SQL[name] = (lambda spark, sf_dir: _rounded(run(spark, sf_dir))), sql


CANON = """canon AS (SELECT *, CASE WHEN prediction = '' THEN '' ELSE substr(permutation, ascii(prediction) - 64, 1) END AS answer
FROM eval QUALIFY count(*) OVER (PARTITION BY question) >= 2)"""
E = f"WITH {EVAL}"

_add("met_accuracy", lambda s, d: M.accuracy(evaluations(s, d)), f"{E} SELECT {s6('avg(CAST(correct AS INT))')} AS accuracy, count(*) AS n FROM eval")
_add("met_pair_consistency", lambda s, d: M.pair_consistency(evaluations(s, d)), f"""{E}, k AS (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY perm_index) - 1) // 2 AS pair FROM eval),
p AS (SELECT count(DISTINCT golden) = 2 AND count(DISTINCT prediction) = 2 AS c, bool_and(correct) AS b FROM k GROUP BY question, pair HAVING count(*) = 2)
SELECT count(*) AS pairs, {s6("avg(CAST(c AS INT))")} AS consistency, {s6("avg(CAST(c AND b AS INT))")} AS consistent_accuracy FROM p""")
_add("met_rstd", lambda s, d: M.recall_spread(evaluations(s, d)), f"{E}, r AS (SELECT avg(CAST(correct AS INT)) AS r FROM eval GROUP BY golden) SELECT {s6('stddev_pop(r)')} AS rstd FROM r")
_add("met_ckld", lambda s, d: M.class_divergence(evaluations(s, d)), f"""{E}, l AS (SELECT golden AS l, 1 AS g, 0 AS p FROM eval UNION ALL SELECT prediction, 0, 1 FROM eval),
c AS (SELECT l, (sum(g) + 1e-10) / (SELECT count(*) FROM eval) AS g, (sum(p) + 1e-10) / (SELECT count(*) FROM eval) AS p FROM l GROUP BY l) SELECT {s6("sum(g * ln(g / p))")} AS ckld FROM c""")
_add("met_modal_consistency", lambda s, d: M.modal_consistency(evaluations(s, d)), f"""{E}, {CANON}, n AS (SELECT question, answer, count(*) AS n FROM canon GROUP BY ALL),
q AS (SELECT max(n) / sum(n) AS s FROM n GROUP BY question) SELECT {s6("avg(s)")} AS consistency, count(*) AS questions FROM q""")
_add("met_modal_accuracy", lambda s, d: M.modal_accuracy(evaluations(s, d)), f"""{E}, {CANON}, n AS (SELECT question, original, answer, count(*) AS n FROM canon GROUP BY ALL),
t AS (SELECT * FROM n QUALIFY rank() OVER (PARTITION BY question ORDER BY n DESC) = 1),
q AS (SELECT count(*) = 1 AND bool_and(answer = original) AS ok FROM t GROUP BY question) SELECT {s6("avg(CAST(ok AS INT))")} AS consistent_accuracy FROM q""")
_LET = "l(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'))"
_add("met_selection_rstd", lambda s, d: M.selection_spread(evaluations(s, d)), f"""{E}, {CANON}, {_LET},
f AS (SELECT letter, (SELECT count(*) FROM canon WHERE answer = letter) / (SELECT count(*) FROM canon) AS f FROM l) SELECT {s6("stddev_pop(f)")} AS rstd FROM f""")
_add("met_selection_rstd_strict", lambda s, d: M.selection_spread(evaluations(s, d), True), f"""{E}, {CANON}, {_LET},
f AS (SELECT letter, (SELECT count(*) FROM canon WHERE answer = letter) / (SELECT count(*) FROM canon WHERE answer <> '') AS f FROM l) SELECT {s6("stddev_pop(f)")} AS rstd FROM f""")
_add("met_selection_ckld", lambda s, d: M.selection_divergence(evaluations(s, d)), f"""{E}, {CANON}, {_LET},
f AS (SELECT ((SELECT count(*) FROM canon WHERE original = letter) + 1e-10) / (t + 4e-10) AS g, ((SELECT count(*) FROM canon WHERE answer = letter) + 1e-10) / (t + 4e-10) AS p
FROM l, (SELECT count(*) AS t FROM canon)) SELECT {s6("sum(g * ln(g / p))")} AS ckld FROM f""")


def _values(s, d):
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("prompt"), F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 997.0).alias("value"))


_best = ", ".join(f"sum(v * (pow(i / n, {k}) - pow((i - 1) / n, {k}))) AS best_{k}, sum(v * (pow(1 - (i - 1) / n, {k}) - pow(1 - i / n, {k}))) AS worst_{k}" for k in (2, 4, 8))
_add("met_validation_cube", lambda s, d: M.validation_cube(_values(s, d)), f"""WITH x AS (SELECT o_orderpriority AS source, o_custkey AS prompt, o_totalprice / 997.0 AS v,
CAST(row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice, o_orderkey) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY o_orderpriority, o_custkey) AS DOUBLE) AS n FROM orders),
p AS (SELECT source, prompt, avg(v) AS mean, stddev_pop(v) AS std, {_best} FROM x GROUP BY source, prompt)
SELECT source, count(*) AS prompts, {", ".join(f"{s6(f'avg({c})')} AS {c}" for c in ("mean", "std", *[f"{w}_{k}" for k in (2, 4, 8) for w in ("best", "worst")]))} FROM p GROUP BY source""")
_add("met_majority_vote", lambda s, d: M.majority_value(table(s, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("vote"), F.col("o_totalprice").alias("value"))),
     f"""WITH v AS (SELECT o_custkey AS question, o_orderstatus AS vote, count(*) AS n, min(o_orderkey) AS first, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL)
SELECT question, vote, n, {s6("value")} AS value FROM v QUALIFY row_number() OVER (PARTITION BY question ORDER BY n DESC, first) = 1""")


def _batch(s, d):
    return trajectories(s, d).select("score", (F.col("score") - 3).alias("advantage"), (-F.col("old_lp")).alias("value"), (F.col("score") - F.col("new_lp")).alias("returns"), "length")


_add("met_batch_data", lambda s, d: M.data_metrics(_batch(s, d), 50), f"""WITH {TRAJ}, b AS (SELECT score, score - 3 AS advantage, -old_lp AS value, score - new_lp AS returns, length FROM traj)
SELECT {", ".join(f"{s6(f'avg({c})')} AS {c}_mean, {s6(f'max({c})') if c != 'length' else 'max(length)'} AS {c}_max, {s6(f'min({c})') if c != 'length' else 'min(length)'} AS {c}_min" for c in ("score", "advantage", "value", "returns", "length"))},
{s6("avg(CAST(length = 50 AS INT))")} AS clip_ratio, {s6("avg(CAST(length = 0 AS INT))")} AS aborted_ratio, {s6("1 - var_samp(returns - value) / (var_samp(returns) + 1e-5)")} AS explained_var FROM b""")


def _named(s, d):
    name = F.concat_ws("/", "event_type", F.element_at(F.array(*map(F.lit, ("max", "mean", "min"))), (F.col("user_id") % 3).cast("int") + 1))
    return table(s, d, "events").select(name.alias("name"), "value")


_add("met_reduce_by_name", lambda s, d: M.reduce_metrics(_named(s, d)), f"""WITH e AS (SELECT event_type || '/' || (['max','mean','min'])[user_id % 3 + 1] AS name, value FROM events)
SELECT name, {s6("CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END")} AS value FROM e GROUP BY name""")
_RULES = ("time_sum", "last", "avg", "max", "min", "sum", "weighted_avg")
_add("met_step_rules", lambda s, d: M.step_metrics(table(s, d, "events").select("event_type", (F.col("user_id") % 7).alias("r"), "event_id", "value").select(
    F.concat_ws("/", "event_type", "r").alias("name"), F.element_at(F.array(*map(F.lit, _RULES)), F.col("r").cast("int") + 1).alias("rule"), F.col("event_id").alias("step"), "value", (F.col("event_id") % 5 + 1).alias("weight"))),
    f"""WITH e AS (SELECT event_type || '/' || (user_id % 7) AS name, ({list(_RULES)})[user_id % 7 + 1] AS rule, event_id AS step, value, event_id % 5 + 1 AS weight FROM events)
SELECT name, rule, {s6("CASE rule WHEN 'time_sum' THEN sum(value) WHEN 'sum' THEN sum(value) WHEN 'last' THEN arg_max(value, step) WHEN 'avg' THEN avg(value) WHEN 'max' THEN max(value) WHEN 'min' THEN min(value) ELSE sum(value * weight) / sum(weight) END")} AS value FROM e GROUP BY name, rule""")
_add("met_percentiles", lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)], F.count_distinct("user_id").alias("versions")),
     f"SELECT event_type, {', '.join(f'{s6(f'quantile_cont(value, {p / 100})')} AS p{p}' for p in (50, 95, 99))}, count(DISTINCT user_id) AS versions FROM events GROUP BY event_type")
_add("met_summary_sets", lambda s, d: M.summary(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("double")), ("lang", "source"), ("quality", "n_chars")),
     f"""SELECT lang, NULL AS source, count(*) AS n, round_even(avg(quality), 4) AS quality, round_even(avg(n_chars), 4) AS n_chars, 'lang' AS level FROM documents JOIN labels USING (doc_id) GROUP BY lang
UNION ALL SELECT NULL, source, count(*), round_even(avg(quality), 4), round_even(avg(n_chars), 4), 'source' FROM documents JOIN labels USING (doc_id) GROUP BY source""")
_add("met_cramers_v", lambda s, d: M.cramers_v(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "source", "quality"), f"""WITH c AS (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS a, sum(n) OVER (PARTITION BY quality) AS b FROM c)
SELECT {s6("sqrt(greatest(sum(n * n / (a * b)) - 1, 0) / (least(count(DISTINCT source), count(DISTINCT quality)) - 1))")} AS v, count(DISTINCT source) AS r, count(DISTINCT quality) AS c FROM t""")
_add("met_softmean", lambda s, d: M.softmean_baseline(trajectories(s, d), 0.5).select("uid", "slot", "advantage"), f"""WITH {TRAJ}, m AS (SELECT max(score) AS t FROM traj), b AS (SELECT max(t) + ln(avg(exp(0.5 * (score - t)))) / 0.5 AS b FROM traj, m)
SELECT uid, slot, {s6("score - b")} AS advantage FROM traj, b""")
_add("met_ranking_accuracy", lambda s, d: M.ranking_accuracy(trajectories(s, d).withColumn("acc", F.col("length") % 3)), f"""WITH {TRAJ}, t AS (SELECT *, length % 3 AS acc FROM traj)
SELECT a.uid, {s6("coalesce(sum(CAST((a.score > b.score) = (a.acc > b.acc) AS INT) * abs(a.acc - b.acc)) / nullif(sum(abs(a.acc - b.acc)), 0), 0.5)")} AS accuracy FROM t a JOIN t b ON a.uid = b.uid AND a.slot < b.slot GROUP BY a.uid""")
_add("met_masked_stats", lambda s, d: M.masked_stats(trajectories(s, d), "score"), f"""WITH {TRAJ}, m AS (SELECT sum(score * mask) AS s, sum(mask) AS n, sum(score * mask) / (sum(mask) + 1e-8) AS mean FROM traj)
SELECT {s6("max(s)")} AS sum, {s6("max(mean)")} AS mean, {s6("sum((score - mean) * (score - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1)")} AS var FROM traj, m""")
_add("met_agg_loss", lambda s, d: M.agg_loss(trajectories(s, d).withColumn("loss", F.col("score")), 16), f"""WITH {TRAJ}, r AS (SELECT sum(score * mask) AS s, sum(mask) AS n FROM traj GROUP BY uid)
SELECT {s6("sum(s) / (sum(n) + 1e-8)")} AS token_mean, {s6("sum(CASE WHEN n > 0 THEN s ELSE 0 END) / (sum(CAST(n > 0 AS INT)) + 1e-8)")} AS seq_mean_token_sum,
{s6("sum(CASE WHEN n > 0 THEN s / (n + 1e-8) ELSE 0 END) / (sum(CAST(n > 0 AS INT)) + 1e-8)")} AS seq_mean_token_mean, {s6("sum(s) / 16")} AS seq_mean_token_sum_norm FROM r""")
_add("met_pearson", lambda s, d: trajectories(s, d).where("mask = 1").agg(F.corr(F.exp("old_lp"), F.exp("new_lp")).alias("corr"), F.max(F.abs(F.exp("old_lp") - F.exp("new_lp"))).alias("max_diff"), F.avg(F.abs(F.exp("old_lp") - F.exp("new_lp"))).alias("mean_diff"), F.stddev_samp(F.abs(F.exp("old_lp") - F.exp("new_lp"))).alias("std_diff")),
     f"WITH {TRAJ} SELECT {s6('corr(exp(old_lp), exp(new_lp))')} AS corr, {s6('max(abs(exp(old_lp) - exp(new_lp)))')} AS max_diff, {s6('avg(abs(exp(old_lp) - exp(new_lp)))')} AS mean_diff, {s6('stddev_samp(abs(exp(old_lp) - exp(new_lp)))')} AS std_diff FROM traj WHERE mask = 1")
_add("met_score_by_source", lambda s, d: trajectories(s, d).groupBy("flag", "uid").agg(F.avg("score").alias("m")).groupBy("flag").agg(F.avg("m").alias("score")), f"WITH {TRAJ}, m AS (SELECT flag, uid, avg(score) AS m FROM traj GROUP BY ALL) SELECT flag, {s6('avg(m)')} AS score FROM m GROUP BY flag")
_add("met_rank_tail", lambda s, d: table(s, d, "events").crossJoin(F.broadcast(table(s, d, "events").agg(F.percentile("value", F.lit(0.9)).alias("q")))).agg(F.avg((F.col("value") > F.col("q")).cast("int")).alias("ratio"), F.min("value").alias("min"), F.max("value").alias("max")),
     f"SELECT {s6('avg(CAST(value > (SELECT quantile_cont(value, 0.9) FROM events) AS INT))')} AS ratio, {s6('min(value)')} AS min, {s6('max(value)')} AS max FROM events")
_add("met_timing", lambda s, d: trajectories(s, d).groupBy("flag").agg(F.try_divide(F.sum("score") * 1000, F.sum("length")).alias("ms_per_token"), F.try_divide(F.sum("length"), F.sum("score")).alias("throughput")),
     f"WITH {TRAJ} SELECT flag, {s6('sum(score) * 1000 / sum(length)')} AS ms_per_token, {s6('sum(length) / sum(score)')} AS throughput FROM traj GROUP BY flag")
_add("met_two_phase_stats", lambda s, d: trajectories(s, d).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.stddev_samp("score").alias("std")),
     f"WITH {TRAJ} SELECT {s6('avg(score)')} AS mean, {s6('max(score)')} AS max, {s6('min(score)')} AS min, {s6('stddev_samp(score)')} AS std FROM traj")
_add("met_timing_reduce", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.sum("value").alias("sum")), f"SELECT event_type, {s6('avg(value)')} AS avg, {s6('max(value)')} AS max, {s6('sum(value)')} AS sum FROM events GROUP BY event_type")
