"""Off-policy correction and forward losses over token rows.

Tokens: uid, slot, old_lp, new_lp, mask, advantage. Sequence-level numbers are
windows over uid, so tokens are not exploded or joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.operators import rank

BOUND = 20.0
_LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def put(f):
        if _LOSSES.setdefault(name, f) is not f:
            raise ValueError(f"loss {name!r} is already registered")
        return f

    return put


def loss(name: str) -> Callable[..., DataFrame]:
    if name not in _LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(_LOSSES)}")
    return _LOSSES[name]


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


def masked_mean(x: Column, mask: Column = None) -> Column:
    m = F.col("mask") if mask is None else mask
    return F.sum(x * m) / (F.sum(m) + 1e-8)


def kl(new: Column, ref: Column, kind: str) -> Column:
    """k1 (difference), abs, k2 (half square) or k3 (exp(d) - d - 1 within bounds); a trailing + has the same forward value."""
    d = new - ref
    back = clamp(-d, -20, 20)
    forms = {"k1": d, "kl": d, "abs": F.abs(d), "k2": 0.5 * d * d, "mse": 0.5 * d * d}
    forms["k3"] = forms["low_var_kl"] = clamp(F.exp(back) - back - 1, -10, 10)
    return forms[kind.rstrip("+")]


def _ratio(level: str) -> Column:
    """Clamped log ratio old - new at token, sequence (sum) or geometric (mean) level."""
    w = W.partitionBy("uid")
    d = F.col("old_lp") - F.col("new_lp")
    total = F.sum(d * F.col("mask")).over(w)
    return {"token": d, "sequence": total, "geometric": total / (F.sum("mask").over(w) + 1e-8)}[level]


def importance(tokens: DataFrame, level: str = "token", most: float = 2.0) -> DataFrame:
    """Adds weight: exp of the clamped log ratio, masked, at most ``most``."""
    if level not in ("token", "sequence"):
        raise ValueError(f"unknown level {level!r}")
    return tokens.withColumn("weight", F.least(F.exp(clamp(_ratio(level), -BOUND, BOUND)) * F.col("mask"), F.lit(float(most))))


def rejection(tokens: DataFrame, level: str, high: float, low: float | None = None, veto: float | None = None) -> DataFrame:
    """Adds kept: mask where the weight lies in [low, high] (low: 1 / high) and no token of the sequence is under the veto ratio."""
    weight = F.exp(clamp(_ratio(level), -BOUND, BOUND))
    keep = weight.between(1.0 / high if low is None else low, high)
    if veto is not None:
        least = F.min(F.when(F.col("mask") == 1, F.col("old_lp") - F.col("new_lp"))).over(W.partitionBy("uid"))
        keep = keep & F.coalesce(least >= F.ln(F.lit(float(veto))), F.lit(True))
    return tokens.withColumn("kept", F.col("mask") * keep.cast("int"))


def weight_metrics(tokens: DataFrame, high: float) -> DataFrame:
    """Mean, extremes, share above ``high``, and effective sample size of untruncated token weights."""
    w = F.exp(clamp(_ratio("token"), -BOUND, BOUND))
    x = tokens.withColumn("w", w).where("mask = 1")
    return x.agg(
        F.avg("w").alias("mean"), F.max("w").alias("max"), F.min("w").alias("min"), F.avg((F.col("w") > high).cast("int")).alias("fraction_high"),
        (1 / F.avg(F.pow(F.col("w") / F.lit(1.0), 2)) * F.pow(F.avg("w"), 2)).alias("ess"),
    )


def rejection_metrics(tokens: DataFrame, level: str, high: float, low: float | None = None) -> DataFrame:
    """Mean, extremes, shares beyond the bounds, spread and effective sample size of the weights that a rejection looks at, by token and by sequence.

    Extremes and shares of sequence levels count sequences and use unclamped log ratios; everything else weighs tokens of mask 1.
    """
    low = 1.0 / high if low is None else low
    x = tokens.withColumn("r", _ratio(level)).withColumn("w", F.exp(clamp(F.col("r"), -BOUND, BOUND)))
    x = x.withColumn("cut", clamp(F.col("w"), low, high))
    m, by_token = F.col("mask"), level == "token"
    rows = x.groupBy("uid").agg(
        F.max("r").alias("r"), F.sum(m).alias("n"), F.sum(F.col("w") * m).alias("w"), F.sum(F.col("cut") * m).alias("cut"), F.sum(F.col("cut") * F.col("cut") * m).alias("cut2"),
        F.max(F.when(m == 1, F.col("w"))).alias("top"), F.min(F.when(m == 1, F.col("w"))).alias("least"),
        F.sum((F.col("w") > high).cast("int") * m).alias("over"), F.sum((F.col("w") < low).cast("int") * m).alias("under"),
    ).withColumn("mean", F.col("w") / (F.col("n") + 1e-8))
    n = F.sum("n") + 1e-8
    mean_cut = F.sum("cut") / n
    ends = (F.max("top"), F.min("least")) if by_token else (F.exp(F.least(F.max("r"), F.lit(BOUND))), F.exp(F.min("r")))
    log_high, log_low = F.ln(F.lit(float(high))), F.ln(F.lit(float(low)))
    shares = (F.sum("over") / n, F.sum("under") / n) if by_token else (F.avg((F.col("r") > log_high).cast("int")), F.avg((F.col("r") < log_low).cast("int")))
    return rows.agg(
        (F.sum("w") / n).alias("mean"), ends[0].alias("max"), ends[1].alias("min"), shares[0].alias("fraction_high"), shares[1].alias("fraction_low"),
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.sum("cut2") / n - mean_cut * mean_cut, F.lit(0.0)))).otherwise(0.0).alias("std"),
        (F.pow(mean_cut + 1e-8, 2) / (F.sum("cut2") / n)).alias("eff_sample_size"), F.avg("mean").alias("seq_mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("seq_std"),
        F.max("mean").alias("seq_max"), F.min("mean").alias("seq_min"), F.max(F.abs(F.col("mean") - 1)).alias("seq_max_deviation"),
        F.avg((F.col("mean") > high).cast("int")).alias("seq_fraction_high"), F.avg((F.col("mean") < low).cast("int")).alias("seq_fraction_low"),
    )


def diagnostics(tokens: DataFrame) -> DataFrame:
    """KL, k3, perplexities and chi-square of training (old_lp) against rollout (new_lp)."""
    m, old, new = F.col("mask"), F.col("old_lp"), F.col("new_lp")
    d = old - new
    rows = tokens.groupBy("uid").agg(
        masked_mean(old).alias("a"), masked_mean(new).alias("b"), F.sum(d * m).alias("total"), F.sum(m).alias("n"), F.sum(-d * m).alias("kl"),
        F.sum((F.exp(d) - d - 1) * m).alias("k3"), F.sum(F.exp(2 * clamp(d, -BOUND, BOUND)) * m).alias("chi"),
    )
    gap = F.col("b") - F.col("a")
    n = F.sum("n") + 1e-8
    return rows.agg(
        F.avg(F.exp(-F.col("a"))).alias("training_ppl"), F.avg(F.exp(-F.col("b"))).alias("rollout_ppl"), (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"),
        F.avg(gap).alias("log_ppl_diff"), F.max(gap).alias("log_ppl_diff_max"), F.avg(F.exp(gap)).alias("ppl_ratio"), (F.sum("chi") / n - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clamp(F.col("total"), -BOUND, BOUND))) - 1).alias("chi2_seq"),
    )


@register("vanilla")
def vanilla(tokens: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> DataFrame:
    """Dual-clipped policy loss, token mean; clip fractions and KL."""
    a = F.col("advantage")
    ratio = F.exp(clamp(F.col("new_lp") - F.col("old_lp"), -20, 20))
    x = tokens.withColumn("l1", -a * ratio).withColumn("l2", -a * clamp(ratio, 1 - low, 1 + high)).withColumn("top", F.greatest("l1", "l2")).withColumn("l3", -a * c)
    out = F.when(a < 0, F.least("l3", "top")).otherwise(F.col("top"))
    return x.agg(
        masked_mean(out).alias("loss"), masked_mean((F.col("l2") > F.col("l1")).cast("int")).alias("clipfrac"),
        masked_mean(((F.col("top") > F.col("l3")) & (a < 0)).cast("int")).alias("clipfrac_lower"), masked_mean(-clamp(F.col("new_lp") - F.col("old_lp"), -20, 20)).alias("ppo_kl"),
    )


@register("gspo")
def gspo(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Sequence-mean log ratio, clipped; mean over sequences of token means."""
    w = W.partitionBy("uid")
    mean = F.sum((F.col("new_lp") - F.col("old_lp")) * F.col("mask")).over(w) / F.greatest(F.sum("mask").over(w), F.lit(1))
    ratio = F.exp(F.least(mean, F.lit(10.0)))
    x = tokens.withColumn("l", F.greatest(-F.col("advantage") * ratio, -F.col("advantage") * clamp(ratio, 1 - low, 1 + high)))
    rows = x.groupBy("uid").agg(F.sum(F.col("l") * F.col("mask")).alias("s"), F.sum("mask").alias("n"))
    some = (F.col("n") > 0).cast("int")
    return rows.agg((F.sum(F.col("s") / (F.col("n") + 1e-8) * some) / (F.sum(some) + 1e-8)).alias("loss"))


@register("geo_mean")
def geo_mean(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """exp of the masked mean of the clamped log ratio, per sequence; mean over sequences."""
    a, d = F.col("advantage"), F.col("new_lp") - F.col("old_lp")
    sign = F.signum(a)
    worst = sign * F.least(sign * d, sign * clamp(d, -low, high))
    rows = tokens.groupBy("uid").agg(F.exp(masked_mean(worst)).alias("ratio"), masked_mean(a).alias("a"))
    return rows.agg(F.avg(-F.col("a") * F.col("ratio")).alias("loss"))


@register("gpg")
def gpg(tokens: DataFrame) -> DataFrame:
    return tokens.agg(masked_mean(-F.col("advantage") * F.col("new_lp")).alias("loss"))


@register("kl_cov")
def kl_cov(tokens: DataFrame, ratio: float = 0.01, coef: float = 1.0) -> DataFrame:
    """The plain loss with a KL term for the share of tokens of largest centred product of advantage and log-probability.

    Products count to nine digits; ties: the least (uid, slot). The last token to mark is found by histograms, so no task
    holds or sorts the marked ones.
    """
    x, n = _covariance(tokens.where("mask = 1"))
    hot = rank.top(x, [rank.nine_digits(F.col("cov")), -F.col("uid"), -F.col("slot")], max(1, int(ratio * n)))
    d = F.col("new_lp") - F.col("old_lp")
    per = -F.col("advantage") * F.exp(d) + F.when(hot, coef * F.abs(d)).otherwise(0.0)
    return x.agg(F.avg(per).alias("loss"), F.count_if(hot).alias("n_hot"))


def _covariance(tokens: DataFrame) -> tuple[DataFrame, int]:
    """tokens with cov, the centred product of advantage and log-probability, and their number."""
    means = tokens.agg(F.avg("advantage").alias("ma"), F.avg("new_lp").alias("ml"), F.count(F.lit(1)).alias("n")).first()
    cov = (F.col("advantage") - F.lit(means["ma"])) * (F.col("new_lp") - F.lit(means["ml"]))
    return tokens.withColumn("cov", cov), means["n"]


@register("clip_cov")
def clip_cov(tokens: DataFrame, ratio: float = 0.0002, low: float = 1.0, high: float = 5.0, clip: float = 0.2, seed: int = 0) -> DataFrame:
    """The clipped loss with a share of the tokens taken out, drawn from those whose centred product lies between low and high
    and that the clip does not hold already. The draw goes by a hash of (uid, slot) and the seed."""
    x, n = _covariance(tokens.where("mask = 1"))
    ratio_of, a = F.exp(F.col("new_lp") - F.col("old_lp")), F.col("advantage")
    x = x.withColumn("l1", -a * ratio_of).withColumn("l2", -a * clamp(ratio_of, 1 - clip, 1 + clip)).withColumn("draw", F.xxhash64("uid", "slot", F.lit(seed)))
    open_ = (F.col("cov") > low) & (F.col("cov") < high) & (F.col("l2") <= F.col("l1"))
    out = open_ & rank.top(x.where(open_), [F.col("draw"), -F.col("uid"), -F.col("slot")], max(1, int(ratio * n)))
    return x.agg(F.avg(F.when(out, 0.0).otherwise(F.greatest("l1", "l2"))).alias("loss"), F.count_if(out).alias("n_out"), F.count_if(open_).alias("n_open"))


def value_loss(tokens: DataFrame, clip: float = 0.5) -> DataFrame:
    """Half the masked mean of the larger of plain and clipped squared errors; tokens have pred, value, returns."""
    cut = F.greatest(F.least(F.col("pred"), F.col("value") + clip), F.col("value") - clip)
    a, b = F.pow(F.col("pred") - F.col("returns"), 2), F.pow(cut - F.col("returns"), 2)
    return tokens.agg((0.5 * masked_mean(F.greatest(a, b))).alias("loss"), masked_mean((b > a).cast("int")).alias("clipfrac"))


def preference_loss(rows: DataFrame, beta: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.0) -> DataFrame:
    """rows: policy_chosen, policy_rejected, reference_chosen, reference_rejected. Mean sigmoid or IPO loss."""
    h = F.col("policy_chosen") - F.col("policy_rejected") - F.col("reference_chosen") + F.col("reference_rejected")
    nls = lambda x: F.ln(1 + F.exp(-x))
    per = nls(beta * h) * (1 - smoothing) + nls(-beta * h) * smoothing if kind == "sigmoid" else F.pow(h - 1 / (2 * beta), 2)
    return rows.agg(F.avg(per).alias("loss"))


def log_softmax_at(logits: Column, label: Column) -> tuple[Column, Column]:
    """Log-probability of a label and the entropy of a row of logits, with the largest taken out first."""
    top = F.array_max(logits)
    norm = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    entropy = norm - F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - norm) * x)
    return F.get(logits, label) - norm, entropy
