"""Queries of the advantage estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import advantage as A
from millrace.sources.tables import PAIRED, TRAJ, paired, r6, s6, sequences, trajectories

QUERIES, SQL = {}, {}
G = "OVER (PARTITION BY uid)"
N = f"count(*) {G}"


def _estimated(name, sql, **options):
    def run(spark, sf_dir):
        return A.estimator(name)(trajectories(spark, sf_dir), **options).select("uid", "slot", r6("advantage").alias("advantage"))

    return run, f"WITH {TRAJ} SELECT uid, slot, {s6(sql)} AS advantage FROM traj"


MEAN = f"CASE WHEN {N} > 1 THEN avg(score) {G} ELSE 0 END"
STD = f"CASE WHEN {N} > 1 THEN stddev_samp(score) {G} ELSE 1 END"
VAR = f"CASE WHEN {N} > 1 THEN sqrt(greatest(var_samp(score) {G}, 1e-6)) ELSE 1 END"
POP = f"stddev_pop(score) {G}"
Z = f"(score - avg(score) {G}) / ({POP} + 1e-6)"
FLOORED = f"(score - avg(score) {G}) / greatest(sqrt(greatest({POP} * {POP}, 1e-6)), 1e-6)"

for key, spec in {
    "adv_grpo": ("grpo", f"(score - ({MEAN})) / (({STD}) + 1e-6)", {}),
    "adv_grpo_nostd": ("grpo", f"score - ({MEAN})", {"by_std": False}),
    "adv_grpo_vectorized": ("grpo_vectorized", f"(score - ({MEAN})) / (({VAR}) + 1e-6)", {}),
    "adv_rloo": ("rloo", f"CASE WHEN {N} > 1 THEN ({N} * score - sum(score) {G}) / ({N} - 1) ELSE score END", {}),
    "adv_rloo_vectorized": ("rloo", f"CASE WHEN {N} > 1 THEN ({N} * score - sum(score) {G}) / ({N} - 1) ELSE 0 END", {"singleton": "zero"}),
    "adv_opo": ("opo", f"score - CASE WHEN {N} > 1 THEN sum(length * score) {G} / sum(length) {G} ELSE 0 END", {}),
    "adv_gpg": ("gpg", f"count(*) OVER () / greatest(sum(CASE WHEN score <> 0 THEN 1 ELSE 0 END) OVER (), 1) * (score - ({MEAN}))", {}),
    "adv_global_paper": ("global_paper", Z, {}),
    "adv_global_gated": ("global_paper", f"CASE WHEN {POP} < 1.5 THEN 0 ELSE {Z} END", {"gate": 1.5}),
    "adv_pair_baseline": ("pair_baseline", f"greatest(least({FLOORED}, 5.0), -5.0)", {}),
}.items():
    QUERIES[key], SQL[key] = _estimated(spec[0], spec[1], **spec[2])


def adv_passk(spark, sf_dir):
    return A.passk(trajectories(spark, sf_dir)).select("uid", "slot", r6("advantage").alias("advantage"))


QUERIES["adv_passk"] = adv_passk
SQL["adv_passk"] = f"""WITH {TRAJ}, k AS (SELECT uid, slot, score, row_number() OVER w AS k, lead(score) OVER w AS second, {N} AS n, stddev_samp(score) {G} AS sd
FROM traj WINDOW w AS (PARTITION BY uid ORDER BY score DESC, slot))
SELECT uid, slot, {s6("CASE WHEN k = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END")} AS advantage FROM k WHERE n > 1"""


def adv_official(spark, sf_dir):
    return A.official(trajectories(spark, sf_dir), width=50).select("uid", "slot", r6("advantage").alias("advantage"))


QUERIES["adv_official"] = adv_official
SQL["adv_official"] = f"""WITH {TRAJ}, c AS (SELECT uid, slot, (score - ({MEAN})) * length / 50.0 AS score FROM traj)
SELECT uid, slot, {s6(f"greatest(least({FLOORED}, 5.0), -5.0)")} AS advantage FROM c"""


def _controlled(mode, gate=None):
    def run(spark, sf_dir):
        out = A.controlled(paired(trajectories(spark, sf_dir)), mode=mode, gate=gate)
        return out.select("uid", "perm", "pslot", r6("score").alias("score"), r6("weight").alias("weight"), r6("advantage").alias("advantage"))

    p = "OVER (PARTITION BY uid, perm)"
    gap = f"abs(avg(CASE WHEN perm = 0 THEN score END) {G} - avg(CASE WHEN perm = 1 THEN score END) {G})"
    weight = {"eis": "1.0", "alc": f"CASE WHEN {gap} = 0 THEN 0 ELSE least({gap} / ({POP} + 1e-6), 1.0) END"}.get(mode, "0.0")
    whole = f"CASE WHEN max(score) {G} = min(score) {G} THEN 0 ELSE {Z} END"
    local = f"CASE WHEN max(score) {p} = min(score) {p} THEN 0 ELSE (score - avg(score) {p}) / (stddev_pop(score) {p} + 1e-6) END"
    total = f"{whole} + ({weight}) * {local}"
    if gate is not None:
        total = f"CASE WHEN {POP} < {gate} THEN 0 ELSE {total} END"
    return run, f"WITH {TRAJ}, {PAIRED} SELECT uid, perm, pslot, {s6('score')} AS score, {s6(weight)} AS weight, {s6(total)} AS advantage FROM paired"


for key, args in {"adv_global": ("global_only",), "adv_eis": ("eis",), "adv_alc": ("alc",), "adv_pa": ("pa_controlled",), "adv_pa_gated": ("pa_controlled", 1.2)}.items():
    QUERIES[key], SQL[key] = _controlled(*args)


def pair_faults(spark, sf_dir):
    return A.pair_faults(trajectories(spark, sf_dir))


QUERIES["adv_pair_faults"] = pair_faults
SQL["adv_pair_faults"] = f"""WITH {TRAJ} SELECT uid, 'missing' AS fault FROM traj GROUP BY uid HAVING count(*) % 2 = 1"""


def returns_to_go(spark, sf_dir):
    rows = A.returns_to_go(sequences(trajectories(spark, sf_dir)), gamma=0.9)
    return rows.select("uid", F.posexplode("returns").alias("slot", "r")).select("uid", F.col("slot").cast("long").alias("slot"), r6("r").alias("returns"))


_BACK = f"""WITH RECURSIVE {TRAJ}, o AS MATERIALIZED (SELECT uid, slot, score, mask, -old_lp AS value, {N} - 1 AS last FROM traj),"""
QUERIES["adv_returns_to_go"] = returns_to_go
SQL["adv_returns_to_go"] = f"""{_BACK} f AS (SELECT uid, slot, score AS r, mask FROM o WHERE slot = last
UNION ALL SELECT o.uid, o.slot, o.score + 0.9 * f.r * f.mask, o.mask FROM f JOIN o ON o.uid = f.uid AND o.slot = f.slot - 1)
SELECT uid, slot, {s6("r")} AS returns FROM f"""


def gae(spark, sf_dir):
    rows = A.gae(sequences(trajectories(spark, sf_dir)))
    tokens = rows.select("uid", F.posexplode(F.arrays_zip("tokens", "gae")).alias("slot", "t")).select("uid", F.col("slot").cast("long").alias("slot"), "t.tokens.mask", "t.tokens.old_lp", "t.gae")
    out = A.whiten(tokens, "gae")
    return out.select("uid", "slot", r6("advantage").alias("advantage"), r6(F.col("gae") - F.col("old_lp")).alias("returns"))


def _whitened(src: str, x: str, more: str = "") -> str:
    return f"""m AS (SELECT sum({x} * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM {src}),
v AS (SELECT mean, sum(({x} - mean) * ({x} - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM {src}, m GROUP BY mean)
SELECT uid, slot, {s6(f"({x} - mean) / sqrt(var + 1e-8)")} AS advantage{more} FROM {src}, v"""


QUERIES["adv_gae"] = gae
SQL["adv_gae"] = f"""{_BACK} f AS (SELECT uid, slot, mask, value, value * mask AS nxt, (score - value) * mask AS g FROM o WHERE slot = last
UNION ALL SELECT o.uid, o.slot, o.mask, o.value, o.value * o.mask + (1 - o.mask) * f.nxt,
(o.score + 0.99 * f.nxt - o.value + 0.99 * 0.95 * f.g) * o.mask + (1 - o.mask) * f.g FROM f JOIN o ON o.uid = f.uid AND o.slot = f.slot - 1),
{_whitened("f", "g", f", {s6('g + value')} AS returns")}"""


def reinforce_pp(spark, sf_dir):
    rows = A.returns_to_go(sequences(trajectories(spark, sf_dir)), gamma=0.9)
    tokens = rows.select("uid", F.posexplode(F.arrays_zip("tokens", "returns")).alias("slot", "t")).select("uid", F.col("slot").cast("long").alias("slot"), "t.tokens.mask", "t.returns")
    return A.whiten(tokens, "returns").select("uid", "slot", r6(F.col("advantage") * F.col("mask")).alias("advantage"))


QUERIES["adv_reinforce_pp"] = reinforce_pp
SQL["adv_reinforce_pp"] = SQL["adv_returns_to_go"].rsplit("\n", 1)[0] + ",\n" + _whitened("f", "r").replace("(r - mean) / sqrt(var + 1e-8)", "(r - mean) / sqrt(var + 1e-8) * mask")


def reinforce_pp_baseline(spark, sf_dir):
    rows = A.grpo(trajectories(spark, sf_dir), by_std=False).withColumnRenamed("advantage", "centred")
    return A.whiten(rows, "centred").select("uid", "slot", r6(F.col("advantage") * F.col("mask")).alias("advantage"))


QUERIES["adv_reinforce_pp_baseline"] = reinforce_pp_baseline
SQL["adv_reinforce_pp_baseline"] = f"WITH {TRAJ}, c AS (SELECT uid, slot, mask, score - ({MEAN}) AS x FROM traj),\n" + _whitened("c", "x").replace("(x - mean) / sqrt(var + 1e-8)", "(x - mean) / sqrt(var + 1e-8) * mask")


def adv_remax(spark, sf_dir):
    rows = trajectories(spark, sf_dir).withColumn("baseline", F.col("length") / 7)
    return A.remax(rows).select("uid", "slot", r6("advantage").alias("advantage"))


QUERIES["adv_remax"] = adv_remax
SQL["adv_remax"] = f"""WITH {TRAJ} SELECT uid, slot, {s6(f"(sum(score * mask) OVER (PARTITION BY uid ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - length / 7.0) * mask")} AS advantage FROM traj"""


def adv_batch(spark, sf_dir):
    rows = paired(trajectories(spark, sf_dir))
    token = lambda score, mask: F.struct(score.cast("double").alias("score"), mask.alias("mask"))
    tokens = F.array(token(F.col("score") - 1, F.lit(1)), token(F.lit(7), F.lit(0)), token(F.lit(1.5), F.lit(1)))
    rows = rows.select("uid", "perm", "pslot", tokens.alias("tokens"), (F.col("score") - 0.5).alias("base"), F.lit(1.0).alias("bonus"))
    out, _ = A.controlled_batch(rows, "pa_controlled")
    return out.select("uid", "perm", "pslot", r6(F.aggregate("advantages", F.lit(0.0), lambda a, x: a + x) / 2).alias("mean"), r6(F.col("advantages")[1]).alias("unmasked"))


QUERIES["adv_controlled_batch"] = adv_batch
SQL["adv_controlled_batch"] = f"""WITH p AS ({SQL["adv_pa"]}) SELECT uid, perm, pslot, advantage AS mean, 0.0::DOUBLE AS unmasked FROM p"""
