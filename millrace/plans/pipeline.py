"""Queries of losses, record pipeline, retrieval, logs and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import advantage as A
from millrace.operators import balance as K
from millrace.operators import losses as L
from millrace.operators import pairing as P
from millrace.sources.tables import TRAJ, r6, s6, table, trajectories

QUERIES, SQL = {}, {}
D = "old_lp - new_lp"


def _rounded(df):
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _add(name, run, sql=None):
    QUERIES[name] = lambda s, d: _rounded(run(s, d))
    if sql:
        SQL[name] = sql


def _tokens(s, d):
    return A.global_paper(trajectories(s, d)).withColumn("old_lp", F.col("old_lp") * 5).withColumn("new_lp", F.col("new_lp") * 5)


TOK = f"""{TRAJ}, tok AS (SELECT uid, slot, mask, score, length, old_lp * 5 AS old_lp, new_lp * 5 AS new_lp, (score - avg(score) OVER (PARTITION BY uid)) / (stddev_pop(score) OVER (PARTITION BY uid) + 1e-6) AS advantage FROM traj)"""
W_ = f"WITH {TOK}"
MM = "sum(({}) * mask) / (sum(mask) + 1e-8)"

for kind, sql in {"k1": "new_lp - old_lp", "abs": "abs(new_lp - old_lp)", "k2": "0.5 * (new_lp - old_lp) * (new_lp - old_lp)", "k3": f"greatest(least(exp({D}) - ({D}) - 1, 10), -10)"}.items():
    _add(f"off_kl_{kind}", lambda s, d, k=kind: _tokens(s, d).select("uid", "slot", L.kl(F.col("new_lp"), F.col("old_lp"), k).alias("kl")), f"{W_} SELECT uid, slot, {s6(sql)} AS kl FROM tok")
for level, sql in {"token": D, "sequence": f"sum(({D}) * mask) OVER (PARTITION BY uid)"}.items():
    _add(f"off_importance_{level}", lambda s, d, k=level: L.importance(_tokens(s, d), k).select("uid", "slot", "weight"), f"{W_} SELECT uid, slot, {s6(f'least(exp({sql}) * mask, 2.0)')} AS weight FROM tok")
_LEVEL = {"token": D, "sequence": f"sum(({D}) * mask) OVER (PARTITION BY uid)", "geometric": f"sum(({D}) * mask) OVER (PARTITION BY uid) / (sum(mask) OVER (PARTITION BY uid) + 1e-8)"}
for level, sql in _LEVEL.items():
    _add(f"off_rejection_{level}", lambda s, d, k=level: L.rejection(_tokens(s, d), k, 1.15).select("uid", "slot", "kept"), f"{W_} SELECT uid, slot, CAST(mask * CAST(exp({sql}) BETWEEN 1 / 1.15::DOUBLE AND 1.15::DOUBLE AS INT) AS BIGINT) AS kept FROM tok")
_add("off_veto", lambda s, d: L.rejection(_tokens(s, d), "geometric", 1.5, veto=0.7).select("uid", "slot", "kept"), f"""{W_} SELECT uid, slot, CAST(mask * CAST(exp({_LEVEL["geometric"]}) BETWEEN 1 / 1.5::DOUBLE AND 1.5::DOUBLE
AND coalesce(min(CASE WHEN mask = 1 THEN {D} END) OVER (PARTITION BY uid) >= ln(0.7::DOUBLE), true) AS INT) AS BIGINT) AS kept FROM tok WHERE true""")
_add("off_weight_metrics", lambda s, d: L.weight_metrics(_tokens(s, d), 1.1), f"{W_} SELECT {s6(f'avg(exp({D}))')} AS mean, {s6(f'max(exp({D}))')} AS max, {s6(f'min(exp({D}))')} AS min, {s6(f'avg(CAST(exp({D}) > 1.1 AS INT))')} AS fraction_high, {s6(f'pow(avg(exp({D})), 2) / avg(exp(2 * ({D})))')} AS ess FROM tok WHERE mask = 1")
_add("off_diagnostics", lambda s, d: L.diagnostics(_tokens(s, d)), f"""{W_}, r AS (SELECT {MM.format("old_lp")} AS a, {MM.format("new_lp")} AS b, sum(({D}) * mask) AS t, sum(mask) AS n, sum(-({D}) * mask) AS kl, sum((exp({D}) - ({D}) - 1) * mask) AS k3, sum(exp(2 * ({D})) * mask) AS chi FROM tok GROUP BY uid)
SELECT {s6("avg(exp(-a))")} AS training_ppl, {s6("avg(exp(-b))")} AS rollout_ppl, {s6("sum(kl) / (sum(n) + 1e-8)")} AS kl, {s6("sum(k3) / (sum(n) + 1e-8)")} AS k3_kl, {s6("avg(b - a)")} AS log_ppl_diff, {s6("max(b - a)")} AS log_ppl_diff_max,
{s6("avg(exp(b - a))")} AS ppl_ratio, {s6("sum(chi) / (sum(n) + 1e-8) - 1")} AS chi2_token, {s6("avg(exp(2 * t)) - 1")} AS chi2_seq FROM r""")
_R = "exp(new_lp - old_lp)"
_T = "greatest(-advantage * r, -advantage * greatest(least(r, 1.2), 0.8))"
_add("los_vanilla", lambda s, d: L.loss("vanilla")(_tokens(s, d)), f"""{W_}, x AS (SELECT *, {_R} AS r FROM tok), y AS (SELECT *, {_T} AS top FROM x) SELECT {s6(MM.format("CASE WHEN advantage < 0 THEN least(-advantage * 3, top) ELSE top END"))} AS loss,
{s6(MM.format("CAST(-advantage * greatest(least(r, 1.2), 0.8) > -advantage * r AS INT)"))} AS clipfrac, {s6(MM.format("CAST(top > -advantage * 3 AND advantage < 0 AS INT)"))} AS clipfrac_lower, {s6(MM.format("old_lp - new_lp"))} AS ppo_kl FROM y""")
_add("los_gspo", lambda s, d: L.loss("gspo")(_tokens(s, d)), f"""{W_}, x AS (SELECT *, exp(least(sum((new_lp - old_lp) * mask) OVER (PARTITION BY uid) / greatest(sum(mask) OVER (PARTITION BY uid), 1), 10)) AS r FROM tok),
s AS (SELECT sum(({_T}) * mask) / (sum(mask) + 1e-8) AS l, sum(mask) AS n FROM x GROUP BY uid) SELECT {s6("sum(CASE WHEN n > 0 THEN l ELSE 0 END) / (sum(CAST(n > 0 AS INT)) + 1e-8)")} AS loss FROM s""")
_add("los_geo_mean", lambda s, d: L.loss("geo_mean")(_tokens(s, d)), f"""{W_}, x AS (SELECT *, sign(advantage) * least(sign(advantage) * (new_lp - old_lp), sign(advantage) * greatest(least(new_lp - old_lp, 0.2), -0.2)) AS k FROM tok),
s AS (SELECT exp({MM.format("k")}) AS r, {MM.format("advantage")} AS a FROM x GROUP BY uid) SELECT {s6("avg(-a * r)")} AS loss FROM s""")
_add("los_gpg", lambda s, d: L.loss("gpg")(_tokens(s, d)), f"{W_} SELECT {s6(MM.format('-advantage * new_lp'))} AS loss FROM tok")
_COV = f"""{W_}, m AS (SELECT avg(advantage) AS ma, avg(new_lp) AS ml, count(*) AS n FROM tok WHERE mask = 1),
c AS (SELECT uid, slot, advantage, old_lp, new_lp, n, (advantage - ma) * (new_lp - ml) AS cov FROM tok, m WHERE mask = 1)"""
_add("los_kl_cov", lambda s, d: L.loss("kl_cov")(_tokens(s, d)), f"""{_COV}, r AS (SELECT *, row_number() OVER (ORDER BY CAST(round(cov * 1e9) AS BIGINT) DESC, uid, slot) <= greatest(1, CAST(floor(0.01 * n) AS BIGINT)) AS hot FROM c)
SELECT {s6("avg(-advantage * exp(new_lp - old_lp) + CASE WHEN hot THEN abs(new_lp - old_lp) ELSE 0 END)")} AS loss, count(*) FILTER (hot) AS n_hot FROM r""")
#: A share of one takes all open tokens out, so that SQL needs no draw.
_add("los_clip_cov", lambda s, d: L.loss("clip_cov")(_tokens(s, d), ratio=1.0, low=0.05, high=0.2), f"""{_COV}, x AS (SELECT *, -advantage * exp(new_lp - old_lp) AS l1, -advantage * greatest(least(exp(new_lp - old_lp), 1.2), 0.8) AS l2 FROM c),
o AS (SELECT *, cov > 0.05 AND cov < 0.2 AND l2 <= l1 AS open FROM x) SELECT {s6("avg(CASE WHEN open THEN 0 ELSE greatest(l1, l2) END)")} AS loss, count(*) FILTER (open) AS n_out, count(*) FILTER (open) AS n_open FROM o""")
_add("los_clip_cov_drawn", lambda s, d: L.loss("clip_cov")(_tokens(s, d), ratio=0.01, low=0.05, high=0.2).select("n_out", "n_open"), f"""{_COV}, x AS (SELECT *, -advantage * exp(new_lp - old_lp) AS l1, -advantage * greatest(least(exp(new_lp - old_lp), 1.2), 0.8) AS l2 FROM c)
SELECT least(count(*) FILTER (cov > 0.05 AND cov < 0.2 AND l2 <= l1), greatest(1, CAST(floor(0.01 * max(n)) AS BIGINT))) AS n_out, count(*) FILTER (cov > 0.05 AND cov < 0.2 AND l2 <= l1) AS n_open FROM x""")
for level, sql in _LEVEL.items():
    _w = "exp(greatest(least(r, 20), -20))"
    _ends = ("max(top)", "min(least)", "sum(over_) / (sum(n) + 1e-8)", "sum(under_) / (sum(n) + 1e-8)") if level == "token" else ("exp(least(max(r), 20))", "exp(min(r))", "avg(CAST(r > ln(1.2) AS INT))", "avg(CAST(r < ln(1 / 1.2) AS INT))")
    _add(f"off_rejection_metrics_{level}", lambda s, d, k=level: L.rejection_metrics(_tokens(s, d), k, 1.2), f"""{W_}, x AS (SELECT uid, mask, {sql} AS r FROM tok), y AS (SELECT *, {_w} AS w, greatest(least({_w}, 1.2), 1 / 1.2) AS cut FROM x),
q AS (SELECT max(r) AS r, sum(mask) AS n, sum(w * mask) AS w, sum(cut * mask) AS cut, sum(cut * cut * mask) AS cut2, max(w) FILTER (mask = 1) AS top, min(w) FILTER (mask = 1) AS least,
count(*) FILTER (mask = 1 AND w > 1.2) AS over_, count(*) FILTER (mask = 1 AND w < 1 / 1.2) AS under_, sum(w * mask) / (sum(mask) + 1e-8) AS mean FROM y GROUP BY uid),
t AS (SELECT sum(n) + 1e-8 AS n, sum(cut) / (sum(n) + 1e-8) AS mc, sum(cut2) / (sum(n) + 1e-8) AS mc2 FROM q)
SELECT {s6("sum(w) / (sum(n) + 1e-8)")} AS mean, {s6(_ends[0])} AS max, {s6(_ends[1])} AS min, {s6(_ends[2])} AS fraction_high, {s6(_ends[3])} AS fraction_low,
{s6("sqrt(greatest((SELECT mc2 - mc * mc FROM t), 0))")} AS std, {s6("(SELECT (mc + 1e-8) * (mc + 1e-8) / mc2 FROM t)")} AS eff_sample_size, {s6("avg(mean)")} AS seq_mean, {s6("stddev_samp(mean)")} AS seq_std, {s6("max(mean)")} AS seq_max,
{s6("min(mean)")} AS seq_min, {s6("max(abs(mean - 1))")} AS seq_max_deviation, {s6("avg(CAST(mean > 1.2 AS INT))")} AS seq_fraction_high, {s6("avg(CAST(mean < 1 / 1.2 AS INT))")} AS seq_fraction_low FROM q""")
_add("los_value", lambda s, d: L.value_loss(_tokens(s, d).select("mask", F.col("score").alias("pred"), (F.col("score") - F.col("old_lp")).alias("value"), (F.col("score") - 1).alias("returns"))),
     f"""{W_}, x AS (SELECT mask, score AS pred, score - old_lp AS v, score - 1 AS ret FROM tok), y AS (SELECT mask, pow(pred - ret, 2) AS a, pow(greatest(least(pred, v + 0.5), v - 0.5) - ret, 2) AS b FROM x)
SELECT {s6("0.5 * " + MM.format("greatest(a, b)"))} AS loss, {s6(MM.format("CAST(b > a AS INT)"))} AS clipfrac FROM y""")


def _prefs(s, d):
    return _tokens(s, d).select(F.col("old_lp").alias("policy_chosen"), F.col("new_lp").alias("policy_rejected"), (F.col("score") / 9).alias("reference_chosen"), (F.col("advantage") / 3).alias("reference_rejected"))


_H = "(old_lp - new_lp - score / 9 + advantage / 3)"
_add("los_preference", lambda s, d: L.preference_loss(_prefs(s, d), 0.1, smoothing=0.1), f"{W_} SELECT {s6(f'avg(0.9 * ln(1 + exp(-0.1 * {_H})) + 0.1 * ln(1 + exp(0.1 * {_H})))')} AS loss FROM tok")
_add("los_preference_ipo", lambda s, d: L.preference_loss(_prefs(s, d), 0.1, "ipo"), f"{W_} SELECT {s6(f'avg(pow({_H} - 5, 2))')} AS loss FROM tok")


def _logprob(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 9).alias("e"))
    lp, h = L.log_softmax_at(F.col("e"), (F.col("vec_id") % 64).cast("int"))
    return rows.select("vec_id", lp.alias("lp"), h.alias("entropy"))


_add("mth_logprob_entropy", _logprob, f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) * 9 FOR x IN embedding] AS e FROM embeddings), n AS (SELECT vec_id, e, ln(list_sum([exp(x) FOR x IN e])) AS z FROM e)
SELECT vec_id, {s6("e[vec_id % 64 + 1] - z")} AS lp, {s6("z - list_sum([exp(x - z) * x FOR x IN e])")} AS entropy FROM n""")
_add("mth_workload", lambda s, d: trajectories(s, d).select("uid", "slot", K.workload(F.col("length")).alias("w")), f"WITH {TRAJ} SELECT uid, slot, length * 24576 + length * length AS w FROM traj")

# --- record pipeline ---


def _questions(s, d):
    return table(s, d, "documents").select(F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("row_id"), "lang", "source", F.concat_ws("/", "lang").alias("meta"), F.col("doc_id").cast("string").alias("id"))


_add("ded_questions", lambda s, d: P.dedup_questions(_questions(s, d)).select("hash", "row_id", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"), "conflict"),
     "SELECT sha256(text) AS hash, min(doc_id) AS row_id, array_to_string(list(doc_id ORDER BY doc_id)[2:], ',') AS dropped, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY text")
_add("ded_responses", lambda s, d: P.dedup_responses(table(s, d, "lineitem").select(F.col("l_partkey").alias("question"), F.col("l_quantity").cast("long").alias("hash"), F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("generator"), F.col("l_linestatus").alias("status")))
     .select("question", "hash", "representative", F.size("members").alias("n"), F.size("generators").alias("g"), "status", "conflict"),
     "SELECT l_partkey AS question, CAST(l_quantity AS BIGINT) AS hash, min(l_orderkey) AS representative, count(*) AS n, count(DISTINCT l_suppkey) AS g, min(l_linestatus) AS status, min(l_linestatus) <> max(l_linestatus) AS conflict FROM lineitem GROUP BY ALL")
_add("ded_dependency_faults", lambda s, d: P.dependency_faults(table(s, d, "orders"), "o_custkey", "o_orderstatus"), "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
_add("jn_duplicate_keys", lambda s, d: P.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")


def _strata(s, d):
    return table(s, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("source"), F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("stratum"), F.col("o_orderkey").cast("string").alias("id"))


_ST = "st AS (SELECT 's' || (o_custkey % 3) AS source, o_orderpriority || '|' || o_orderstatus AS stratum, CAST(o_orderkey AS VARCHAR) AS id FROM orders)"
_add("win_holdout", lambda s, d: P.holdout(_strata(s, d)).select("id", "split"), f"""WITH {_ST}, z AS (SELECT source, stratum, count(*) AS n FROM st GROUP BY ALL), t AS (SELECT source, sum(n) AS t, count(*) AS g FROM z GROUP BY source),
seats AS (SELECT source, stratum, n, unnest(range(1, n - 1)) AS k FROM z WHERE n > 2), r AS (SELECT seats.source, stratum, row_number() OVER (PARTITION BY seats.source ORDER BY CAST(k AS DECIMAL(20,0)) / n, stratum) AS r FROM seats),
m AS (SELECT r.source, stratum, count(*) AS more FROM r JOIN t USING (source) WHERE r <= least(t - 1, greatest(1, (t + 5) // 10)) - g GROUP BY ALL)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY st.source, st.stratum ORDER BY sha256('42:' || id), id) <= coalesce(more, 0) + 1 THEN 'holdout' ELSE 'train' END AS split FROM st LEFT JOIN m ON m.source = st.source AND m.stratum = st.stratum""")
_add("win_proportional_pick", lambda s, d: P.proportional_pick(_strata(s, d), 200).select("source", "id"), f"""WITH {_ST}, z AS (SELECT source, stratum, count(*) AS n FROM st GROUP BY ALL), q AS (SELECT *, n * 200 // sum(n) OVER (PARTITION BY source) AS q, (n * 200) % sum(n) OVER (PARTITION BY source) AS rest FROM z),
f AS (SELECT *, q + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY rest DESC, stratum) <= 200 - sum(q) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS quota FROM q)
SELECT st.source, id FROM st JOIN f ON f.source = st.source AND f.stratum = st.stratum QUALIFY row_number() OVER (PARTITION BY st.source, st.stratum ORDER BY sha256('42:smoke:' || id), id) <= quota""")
_add("win_audit_sample", lambda s, d: P.audit_sample(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "source", "lang", "quality", "toxic"), ("source", "lang", "quality"), F.col("toxic") == 1).select("id", "reason"),
     "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'exceptional' ELSE 'sample' END AS reason FROM documents JOIN labels USING (doc_id) QUALIFY toxic = 1 OR row_number() OVER (PARTITION BY source, lang, quality ORDER BY sha256('7:' || doc_id), CAST(doc_id AS VARCHAR)) <= 5")


def _cells(s, d):
    return table(s, d, "documents").select(F.col("source").alias("cell"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("length"))


_CE = "ce AS (SELECT source AS cell, CAST(doc_id AS VARCHAR) AS id, n_chars AS length FROM documents)"
_add("win_bucket_pick", lambda s, d: P.bucket_pick(_cells(s, d), 4), f"""WITH {_CE}, b AS (SELECT *, (row_number() OVER (PARTITION BY cell ORDER BY length, id) - 1) * 4 // count(*) OVER (PARTITION BY cell) AS bucket FROM ce)
SELECT cell, bucket, arg_min(id, sha256('3:' || id)) AS id FROM b GROUP BY cell, bucket""")
_add("win_alternating", lambda s, d: P.alternating(_cells(s, d)).select("cell", "id", "place"), f"""WITH {_CE}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY length DESC, id) - 1 AS r, count(*) OVER (PARTITION BY cell) AS n FROM ce)
SELECT cell, id, CASE WHEN r < n - r THEN 2 * r ELSE 2 * (n - 1 - r) + 1 END AS place FROM r""")


def _candidates(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.concat_ws("/", "lang", "source").alias("question"), F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "correct").otherwise("incorrect").alias("status"), F.col("n_chars").alias("tokens"))


_CA = "ca AS (SELECT lang || '/' || source AS question, CAST(doc_id AS VARCHAR) AS key, quality, n_chars AS tokens FROM documents JOIN labels USING (doc_id))"
_PAIR = """pr AS (SELECT a.question, a.key AS positive, b.key AS negative, abs(a.tokens - b.tokens) AS gap FROM ca a JOIN ca b ON a.question = b.question AND a.quality = 1 AND b.quality = 0
QUALIFY row_number() OVER (PARTITION BY a.question ORDER BY abs(a.tokens - b.tokens), a.key, b.key) = 1)"""
_add("jn_closest_pair", lambda s, d: P.closest_pair(_candidates(s, d)), f"WITH {_CA}, {_PAIR} SELECT * FROM pr")
_add("gat_permutations", lambda s, d: P.permutations(P.closest_pair(_candidates(s, d))), f"""WITH {_CA}, {_PAIR} SELECT question, 0::BIGINT AS permutation_id, 'AB' AS permutation_label, positive AS surface_a, negative AS surface_b, 'A' AS correct_surface FROM pr
UNION ALL SELECT question, 1, 'BA', negative, positive, 'B' FROM pr""")
_add("jn_trainer_rows", lambda s, d: P.trainer_rows(P.permutations(P.closest_pair(_candidates(s, d))), table(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"), "Judge.").select(
    "data_source", "ability", F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.question").alias("question"), F.md5(F.concat(F.col("prompt")[0]["content"], F.col("prompt")[1]["content"])).alias("prompt")),
    f"""WITH {_CA}, {_PAIR}, p AS (SELECT question, positive AS a, negative AS b, 'A' AS truth FROM pr UNION ALL SELECT question, negative, positive, 'B' FROM pr)
SELECT 'pairwise' AS data_source, 'judge' AS ability, truth, question, md5('Judge.Response A:' || chr(10) || x.text || chr(10) || chr(10) || 'Response B:' || chr(10) || y.text) AS prompt FROM p JOIN documents x ON CAST(x.doc_id AS VARCHAR) = a JOIN documents y ON CAST(y.doc_id AS VARCHAR) = b""")


def _rolls(s, d):
    return trajectories(s, d).select("uid", "pslot", "perm", (F.col("uid") * 100 + F.col("slot")).alias("row_id"), (F.col("length") % 2).alias("coin"))


_add("jn_pair_identity", lambda s, d: P.pair_by_identity(_rolls(s, d)).fillna(-1), f"WITH {TRAJ} SELECT uid, pslot, coalesce(min(CASE WHEN perm = 0 THEN uid * 100 + slot END), -1) AS zero, coalesce(min(CASE WHEN perm = 1 THEN uid * 100 + slot END), -1) AS one FROM traj GROUP BY uid, pslot")
_add("jn_pair_position", lambda s, d: P.pair_by_position(_rolls(s, d).select("uid", F.col("coin").alias("perm"), "row_id")), f"""WITH {TRAJ}, k AS (SELECT uid, length % 2 AS c, uid * 100 + slot AS r, row_number() OVER (PARTITION BY uid, length % 2 ORDER BY slot) AS k FROM traj)
SELECT a.uid, a.k, a.r AS zero, b.r AS one FROM k a JOIN k b ON a.uid = b.uid AND a.k = b.k AND a.c = 0 AND b.c = 1""")
_add("win_plan_candidates", lambda s, d: P.plan_candidates(table(s, d, "customer").select(F.col("c_custkey").alias("question")), table(s, d, "region").select(F.col("r_name").alias("generator")), 2, 500),
     """WITH q AS (SELECT c_custkey AS question, row_number() OVER (ORDER BY c_custkey) - 1 AS q FROM customer), g AS (SELECT r_name AS generator, row_number() OVER (ORDER BY r_name) - 1 AS g FROM region),
x AS (SELECT generator, question, range AS sample, g * (SELECT count(*) * 2 FROM customer) + q * 2 + range AS place FROM q, g, range(2)) SELECT *, lpad(CAST(place // 500 AS VARCHAR), 5, '0') AS shard FROM x""")
_add("jn_missing_work", lambda s, d: P.missing_work(table(s, d, "customer").withColumnRenamed("c_custkey", "k"), table(s, d, "orders").select(F.col("o_custkey").alias("k")).where("k % 2 = 0"), "k").select("k"), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)")
_add("jn_coverage", lambda s, d: P.coverage(table(s, d, "documents"), table(s, d, "labels").where("quality = 1").unionByName(s.range(3).select((F.col("id") - 9).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))), "doc_id"),
     "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS missing, 3::BIGINT AS \"foreign\"")
_add("gat_generator_gate", lambda s, d: P.generator_gate(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("lang").alias("source"), F.col("source").alias("generator"), (1 - F.col("quality")).cast("long").alias("bad"))),
     """WITH g AS (SELECT lang, source, 1 - quality AS bad FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang AS scope, source AS generator, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM g GROUP BY ALL UNION ALL SELECT 'ALL', source, count(*), CAST(sum(bad) AS BIGINT) FROM g GROUP BY source)
SELECT *, CASE WHEN bad * 5 > n THEN 'FAIL' ELSE 'PASS' END AS verdict FROM r""")
_add("flt_zero_variance", lambda s, d: P.zero_variance_filter(trajectories(s, d).withColumn("acc", F.col("length") % 2), "acc").select("uid", "slot"), f"WITH {TRAJ} SELECT uid, slot FROM traj QUALIFY max(length % 2) OVER (PARTITION BY uid) <> min(length % 2) OVER (PARTITION BY uid) OR count(*) OVER (PARTITION BY uid) = 1")
_add("flt_bounds", lambda s, d: P.bounds_filter(trajectories(s, d).withColumn("acc", F.col("length") % 2), 0.3, 0.7, 50, 2000).select("uid", "slot", "kept"), f"""WITH {TRAJ}, g AS (SELECT uid, avg(length % 2) BETWEEN 0.3 AND 0.7 AND max(length) < 50 AS kept FROM traj GROUP BY uid ORDER BY kept DESC, uid LIMIT 2000) SELECT uid, slot, kept FROM traj JOIN g USING (uid)""")
_add("flt_date_range", lambda s, d: table(s, d, "orders").where((F.date_format("o_orderdate", "yyyy-MM-dd") >= "1996-01-01") & (F.date_format("o_orderdate", "yyyy-MM-dd") < "1997-01-01")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1997-01-01'")
_add("jn_audit_decisions", lambda s, d: P.audit_join(table(s, d, "documents").where("doc_id % 3 <> 0").select("doc_id"), table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "AGREE").otherwise("DISAGREE").alias("verdict")), "doc_id"),
     "WITH b AS (SELECT d.doc_id AS s, l.doc_id AS l, quality FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l ON d.doc_id = l.doc_id) SELECT CASE WHEN s IS NULL THEN 'foreign' WHEN l IS NULL THEN 'missing' WHEN quality = 1 THEN 'AGREE' ELSE 'DISAGREE' END AS state, count(*) AS n FROM b GROUP BY 1")
_add("jn_dense_top_k", lambda s, d: P.dense_top_k(table(s, d, "embeddings").where("vec_id % 20 = 0"), table(s, d, "embeddings"), 5).select("query_id", "vec_id", "rank", "score"), f"""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS s FROM e q, e c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, vec_id) AS rank, {s6("s")} AS score FROM p QUALIFY rank <= 5""")
_add("jn_keyword_top_k", lambda s, d: P.keyword_top_k(table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(s, d, "documents"), 3).select("query_id", "doc_id", "rank"), r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS word FROM benchmark),
t AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / m))) AS s FROM t JOIN f USING (word) JOIN q USING (word), st GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""")
_add("log_metrics", lambda s, d: P.log_metrics(table(s, d, "events").select(F.col("event_id").alias("step"), F.concat_ws(" ", F.concat(F.lit("loss:"), F.col("value")), F.concat(F.lit("user:"), F.when(F.col("user_id") % 5 == 0, "NaN").otherwise(F.col("user_id").cast("string"))), F.lit("junk x:y")).alias("line"))),
     f"SELECT event_id AS step, 'loss' AS key, {s6('value')} AS value FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events WHERE user_id % 5 <> 0")
_add("log_blocks", lambda s, d: P.log_blocks(table(s, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("line_no"), (F.col("event_type") == "error").alias("starts"))).select("stream", "line_no", "block"), "SELECT user_id AS stream, event_id AS line_no, CAST(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS block FROM events")


def _batches(s, d):
    return table(s, d, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("batch"), F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 100).alias("length"))


_add("par_differencing", lambda s, d: K.balanced(_batches(s, d), K.differencing, parts=8))
_add("par_greedy", lambda s, d: K.balanced(_batches(s, d), K.greedy, parts=8, equal=True))
_add("par_micro_batches", lambda s, d: K.balanced(_batches(s, d), K.micro_batches, most=20_000))
_add("par_imbalance", lambda s, d: K.imbalance(K.balanced(_batches(s, d), K.differencing, parts=4)))
