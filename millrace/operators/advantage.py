"""Group-relative advantage estimators.

Every estimator takes rows with ``uid`` (group), ``score`` and, where lengths
count, ``length``, and adds ``advantage``. Statistics of one group are windows
over the same partitioning, so they share one exchange and one sort.
Zero-variance tests compare the extremes of a group, as a deviation of equal
numbers may come out as a tiny positive one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Estimator = Callable[..., DataFrame]
_ESTIMATORS: dict[str, Estimator] = {}


def register(name: str) -> Callable[[Estimator], Estimator]:
    """Name an estimator; a name cannot be given to another one."""

    def put(f: Estimator) -> Estimator:
        if _ESTIMATORS.setdefault(name, f) is not f:
            raise ValueError(f"estimator {name!r} is already registered")
        return f

    return put


def estimator(name: str) -> Estimator:
    if name not in _ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(_ESTIMATORS)}")
    return _ESTIMATORS[name]


def _over(*keys: str):
    return W.partitionBy(*keys)


def _constant(x: str, w) -> Column:
    return F.max(x).over(w) == F.min(x).over(w)


@register("grpo")
def grpo(rows: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(score - mean) / (sample deviation + eps); a group of one keeps its score."""
    w = _over("uid")
    n = F.count(F.lit(1)).over(w)
    mean, std = F.when(n > 1, F.avg("score").over(w)).otherwise(0.0), F.when(n > 1, F.stddev_samp("score").over(w)).otherwise(1.0)
    centred = F.col("score") - mean
    return rows.withColumn("advantage", centred / (std + eps) if by_std else centred)


@register("grpo_vectorized")
def grpo_vectorized(rows: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """As grpo, with the variance floored at eps."""
    w = _over("uid")
    n = F.count(F.lit(1)).over(w)
    mean = F.when(n > 1, F.avg("score").over(w)).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp("score").over(w), F.lit(eps)))).otherwise(1.0)
    centred = F.col("score") - mean
    return rows.withColumn("advantage", centred / (std + eps) if by_std else centred)


@register("passk")
def passk(rows: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Best minus second best for the best row (ties: the least slot), else 0; groups of one have none."""
    ranked = W.partitionBy("uid").orderBy(F.desc("score"), "slot")
    gap = F.col("score") - F.lead("score").over(ranked)
    scale = F.stddev_samp("score").over(_over("uid")) + eps if by_std else F.lit(1.0)
    return rows.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, gap / scale).otherwise(0.0)).where("advantage is not null")


@register("rloo")
def rloo(rows: DataFrame, singleton: str = "raw") -> DataFrame:
    """(n * score - sum) / (n - 1); a group of one has its score ("raw") or 0 ("zero")."""
    w = _over("uid")
    n = F.count(F.lit(1)).over(w)
    alone = F.col("score") if singleton == "raw" else F.lit(0.0)
    return rows.withColumn("advantage", F.when(n > 1, (n * F.col("score") - F.sum("score").over(w)) / F.when(n > 1, n - 1)).otherwise(alone))


@register("opo")
def opo(rows: DataFrame) -> DataFrame:
    """Score less the group's length-weighted mean; a group of one keeps its score."""
    w = _over("uid")
    base = F.sum(F.col("length") * F.col("score")).over(w) / F.sum("length").over(w)
    return rows.withColumn("advantage", F.col("score") - F.when(F.count(F.lit(1)).over(w) > 1, base).otherwise(0.0))


@register("gpg")
def gpg(rows: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha * (score - mean) / f_norm, alpha = rows / rows with a score."""
    w = _over("uid")
    alpha = rows.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha"))
    mean = F.when(F.count(F.lit(1)).over(w) > 1, F.avg("score").over(w)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("alpha") * (F.col("score") - mean) / f_norm).drop("alpha")


@register("global_paper")
def global_paper(rows: DataFrame, eps: float = 1e-6, gate: float | None = None) -> DataFrame:
    """Population z-score; 0 where the group's deviation is under the gate."""
    w = _over("uid")
    std = F.stddev_pop("score").over(w)
    value = (F.col("score") - F.avg("score").over(w)) / (std + eps)
    return rows.withColumn("advantage", value if gate is None else F.when(std < gate, 0.0).otherwise(value))


@register("controlled")
def controlled(rows: DataFrame, mode: str = "pa_controlled", eps: float = 1e-6, gate: float | None = None) -> DataFrame:
    """Global advantage plus weight times the advantage within a permutation.

    rows: uid, perm (0 or 1), score, complete pairs (see ``pair_faults``).
    mode: global_only and pa_controlled weigh 0, eis 1, alc by the gap of the
    permutations' means in deviations, at most 1. Adds advantage, weight.
    """
    if mode not in ("global_only", "eis", "alc", "pa_controlled"):
        raise ValueError(f"unknown mode {mode!r}")
    if gate is not None and mode != "pa_controlled":
        raise ValueError("a gate belongs to pa_controlled")
    g, p = _over("uid"), _over("uid", "perm")
    std = F.stddev_pop("score").over(g)
    whole = F.when(_constant("score", g), 0.0).otherwise((F.col("score") - F.avg("score").over(g)) / (std + eps))
    local = F.when(_constant("score", p), 0.0).otherwise((F.col("score") - F.avg("score").over(p)) / (F.stddev_pop("score").over(p) + eps))
    zero, one = (F.avg(F.when(F.col("perm") == k, F.col("score"))).over(g) for k in (0, 1))
    gap = F.abs(zero - one)
    weight = {"eis": F.lit(1.0), "alc": F.when(gap == 0, 0.0).otherwise(F.least(gap / (std + eps), F.lit(1.0)))}.get(mode, F.lit(0.0))
    total = whole + weight * local
    if gate is not None:
        total = F.when(std < gate, 0.0).otherwise(total)
    return rows.withColumn("weight", weight).withColumn("advantage", total)


def pair_faults(rows: DataFrame) -> DataFrame:
    """uid, fault: groups that ``controlled`` must not get (duplicate, missing or gapped slots, other permutations)."""
    cells = rows.groupBy("uid", "pslot", "perm").agg(F.count(F.lit(1)).alias("n"))
    slots = cells.groupBy("uid", "pslot").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("perms"), F.max(~F.col("perm").isin(0, 1)).alias("odd"))
    groups = slots.groupBy("uid").agg(F.max("most").alias("most"), F.min("perms").alias("perms"), F.max("odd").alias("odd"), F.max("pslot").alias("last"), F.count(F.lit(1)).alias("k"))
    fault = (
        F.when(F.col("odd"), "permutation").when(F.col("most") > 1, "duplicate").when(F.col("perms") != 2, "missing").when(F.col("last") != F.col("k") - 1, "gap")
    )
    return groups.select("uid", fault.alias("fault")).where("fault is not null")


@register("pair_baseline")
def pair_baseline(rows: DataFrame, floor: float = 1e-6, clip: float = 5.0) -> DataFrame:
    """Population z-score with floored variance, clipped."""
    w = _over("uid")
    std = F.sqrt(F.greatest(F.pow(F.stddev_pop("score").over(w), 2), F.lit(floor)))
    z = (F.col("score") - F.avg("score").over(w)) / F.greatest(std, F.lit(1e-6))
    return rows.withColumn("advantage", F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


@register("official")
def official(rows: DataFrame, width: int, floor: float = 1e-6, clip: float = 5.0) -> DataFrame:
    """Two stages: centre, mean over a padded width of tokens (so longer rows weigh more), then the pair baseline."""
    w = _over("uid")
    first = F.when(F.count(F.lit(1)).over(w) > 1, F.avg("score").over(w)).otherwise(0.0)
    held = rows.withColumn("__score", F.col("score")).withColumn("score", (F.col("score") - first) * F.col("length") / F.lit(float(width)))
    return pair_baseline(held, floor, clip).withColumn("score", F.col("__score")).drop("__score")


def whiten(tokens: DataFrame, x: str, mask: str = "mask", out: str = "advantage") -> DataFrame:
    """Token rows: (x - masked mean) / sqrt(unbiased masked variance + 1e-8), over all tokens."""
    m, v = F.col(mask).cast("double"), F.col(x)
    sums = tokens.agg(F.sum(v * m).alias("s1"), F.sum(v * v * m).alias("s2"), F.sum(m).alias("n"))
    mean = F.col("s1") / (F.col("n") + 1e-8)
    var = (F.col("s2") - 2 * F.col("mean") * F.col("s1") + F.col("mean") * F.col("mean") * F.col("n")) / (F.col("n") + 1e-8) * F.col("n") / (F.col("n") - 1)
    stats = sums.withColumn("mean", mean).select("mean", var.alias("var"))
    return tokens.crossJoin(F.broadcast(stats)).withColumn(out, (F.col(x) - F.col("mean")) / F.sqrt(F.col("var") + 1e-8)).drop("mean", "var")


def _fold(tokens: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Backward fold that collects one number per token, in token order; start and step carry ``out``."""
    return F.reverse(F.aggregate(F.reverse(tokens), start, step)["out"])


def returns_to_go(sequences: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Adds returns: discounted sums from each token on; the sum starts anew at tokens of mask 0."""
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        late = t["score"] + gamma * a["run"]
        return F.struct((late * t["mask"]).alias("run"), F.array_append(a["out"], late).alias("out"))

    return sequences.withColumn("returns", _fold(F.col("tokens"), start, step))


def gae(sequences: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Adds gae: generalised advantages before whitening (values: -old_lp); tokens of mask 0 are passed over."""
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        value = -t["old_lp"]
        delta = t["score"] + gamma * a["next"] - value
        late = (delta + gamma * lam * a["last"]) * t["mask"] + (1 - t["mask"]) * a["last"]
        return F.struct((value * t["mask"] + (1 - t["mask"]) * a["next"]).alias("next"), late.alias("last"), F.array_append(a["out"], late).alias("out"))

    return sequences.withColumn("gae", _fold(F.col("tokens"), start, step))


def remax(rows: DataFrame) -> DataFrame:
    """Token rows with baseline, the score of the group's greedy rollout: masked return-to-go less the baseline."""
    rest = F.sum(F.col("score") * F.col("mask")).over(W.partitionBy("uid").orderBy("slot").rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn("advantage", (rest - F.col("baseline")) * F.col("mask"))


def controlled_batch(rows: DataFrame, mode: str, gate: float | None = None, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """rows: uid, perm, pslot, tokens (array of score and mask), base, bonus. Token advantages of a whole batch, and its summary.

    Each token of mask 1 has its row's advantage, every other 0. A batch with a fault has none: a mask other than 0 or 1, or
    empty; a score that is not finite; a total that is not base plus bonus. The error names the first rows and their faults.
    """
    total = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["score"] * t["mask"])
    n = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + t["mask"].cast("long"))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    fault = (
        F.when(F.exists("tokens", lambda t: t["mask"].isNull() | ~t["mask"].isin(0, 1)), "mask")
        .when(n == 0, "empty")
        .when(~F.coalesce(F.forall("tokens", lambda t: finite(t["score"])), F.lit(False)), "not_finite")
        .when(~F.coalesce(F.abs(total - F.col("base") - F.col("bonus")) <= tolerance, F.lit(False)), "total")
    )
    faults = rows.select("uid", "perm", "pslot", fault.alias("fault")).where("fault is not null")
    if first := faults.orderBy("uid", "perm", "pslot").limit(5).collect():
        raise ValueError(f"faulty rows: {[tuple(r) for r in first]}")
    scored = controlled(rows.withColumn("score", total), mode=mode, gate=gate)
    out = scored.withColumn("advantages", F.transform("tokens", lambda t: F.col("advantage") * t["mask"]))
    summary = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("uid").alias("groups"), F.avg("score").alias("score_mean"), F.avg("advantage").alias("advantage_mean"),
        F.avg("weight").alias("weight_mean"), F.avg((F.col("advantage") == 0).cast("int")).alias("zero_fraction"),
    )
    return out, summary
