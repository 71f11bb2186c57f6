"""Evaluation metrics over answer rows and batches.

Answer rows have ``question`` (group), ``perm_index``, ``permutation``,
``prediction``, ``golden`` and ``correct``; a missing prediction is the empty
string. Each metric is a chain of grouped counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LETTERS = "ABCD"
SMOOTH = 1e-10


def accuracy(rows: DataFrame) -> DataFrame:
    """Share of correct rows; missing counts as false, no rows give 0."""
    return rows.agg(F.coalesce(F.avg(F.coalesce(F.col("correct"), F.lit(False)).cast("int")), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def adjacent_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a question in order, taken two by two; an odd last row is dropped. One row per pair."""
    k = F.row_number().over(W.partitionBy("question").orderBy("perm_index")) - 1
    flat = rows.withColumn("pair", F.floor(k / 2))
    pairs = flat.groupBy("question", "pair").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("golden").alias("goldens"), F.count_distinct("prediction").alias("predictions"), F.bool_and("correct").alias("both")
    )
    return pairs.where("n = 2").withColumn("consistent", (F.col("goldens") == 2) & (F.col("predictions") == 2))


def pair_consistency(rows: DataFrame) -> DataFrame:
    """Shares of pairs whose answers flip with the order, and of those that are right as well."""
    pairs = adjacent_pairs(rows)
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), share(F.col("consistent")).alias("consistency"), share(F.col("consistent") & F.col("both")).alias("consistent_accuracy"))


def recall_spread(rows: DataFrame) -> DataFrame:
    """Population deviation of the recalls of the golden labels."""
    recall = rows.groupBy("golden").agg(F.avg((F.col("prediction") == F.col("golden")).cast("int")).alias("recall"))
    return recall.agg(F.coalesce(F.stddev_pop("recall"), F.lit(0.0)).alias("rstd"))


def class_divergence(rows: DataFrame) -> DataFrame:
    """KL divergence of golden from predicted labels over the union of labels; counts are smoothed, the total is not."""
    labels = rows.select(F.explode(F.array(F.struct(F.col("golden").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"))
    counts = labels.groupBy("x.label").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    total = F.sum("g").over(W.partitionBy(F.lit(1)))
    p, q = (F.col("g") + SMOOTH) / F.col("total"), (F.col("p") + SMOOTH) / F.col("total")
    return counts.withColumn("total", total).agg(F.coalesce(F.sum(p * F.ln(p / q)), F.lit(0.0)).alias("ckld"))


def canonical(letter: Column, permutation: Column) -> Column:
    """The original letter at the place that a letter names in a permutation; other answers stay."""
    known = (F.length(letter) == 1) & F.lit(LETTERS).contains(letter) & (F.length(permutation) == 4)
    return F.when(known, F.substr(permutation, F.ascii(letter) - 64, F.lit(1))).otherwise(letter)


def _canonical_rows(rows: DataFrame) -> DataFrame:
    size = F.count(F.lit(1)).over(W.partitionBy("question"))
    return rows.withColumn("size", size).where("size >= 2").withColumn("answer", canonical(F.col("prediction"), F.col("permutation")))


def modal_consistency(rows: DataFrame) -> DataFrame:
    """Mean over questions of the share of the most common answer."""
    counts = _canonical_rows(rows).groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("question").agg((F.max("n") / F.sum("n")).alias("share"))
    return groups.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("consistency"), F.count(F.lit(1)).alias("questions"))


def modal_accuracy(rows: DataFrame) -> DataFrame:
    """Share of questions whose only most common answer is the right one; a tie for first fails."""
    counts = _canonical_rows(rows).groupBy("question", "original", "answer").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.rank().over(W.partitionBy("question").orderBy(F.desc("n")))).where("r = 1")
    groups = top.groupBy("question").agg((F.count(F.lit(1)) == 1).alias("single"), F.bool_and(F.col("answer") == F.col("original")).alias("right"))
    return groups.agg(F.coalesce(F.avg((F.col("single") & F.col("right")).cast("int")), F.lit(0.0)).alias("consistent_accuracy"))


def _letters(counts: DataFrame, key: str) -> DataFrame:
    letters = counts.sparkSession.sql("SELECT explode(array('A', 'B', 'C', 'D')) AS letter")
    return letters.join(counts, F.col("letter") == F.col(key), "left").drop(key)


def selection_spread(rows: DataFrame, strict_labels: bool = False) -> DataFrame:
    """Population deviation of how often A to D are chosen. An empty answer enters the total unless strict_labels."""
    chosen = _canonical_rows(rows)
    chosen = chosen.where(F.col("answer").isin(*LETTERS) | (F.lit(not strict_labels) & (F.col("answer") == "")))
    counts = chosen.groupBy("answer").agg(F.count(F.lit(1)).alias("n"))
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    full = _letters(counts, "answer").crossJoin(F.broadcast(total))
    return full.agg(F.coalesce(F.stddev_pop(F.try_divide(F.coalesce("n", F.lit(0)), "total")), F.lit(0.0)).alias("rstd"))


def selection_divergence(rows: DataFrame, strict_labels: bool = False) -> DataFrame:
    """KL divergence of right from chosen letters; smoothing in counts and total."""
    chosen = _canonical_rows(rows)
    chosen = chosen.where(F.col("answer").isin(*LETTERS) | (F.lit(not strict_labels) & (F.col("answer") == "")))
    counts = chosen.select(F.explode(F.array(F.struct(F.col("original").alias("l"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("answer").alias("l"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"))
    counts = counts.groupBy(F.col("x.l").alias("l")).agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    full = _letters(counts, "l").crossJoin(F.broadcast(chosen.agg(F.count(F.lit(1)).alias("total"))))
    size = F.col("total") + 4 * SMOOTH
    p, q = (F.coalesce("g", F.lit(0)) + SMOOTH) / size, (F.coalesce("p", F.lit(0)) + SMOOTH) / size
    return full.agg(F.sum(p * F.ln(p / q)).alias("ckld"))


def validation_cube(rows: DataFrame, sizes: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """rows: source, prompt, row_id, value. Per source, prompt-means of mean@N, std@N and the exact expected best and worst of n draws.

    Of N sorted values the i-th is the best of n draws with replacement with
    chance (i/N)**n - ((i-1)/N)**n, so no resampling is needed.
    """
    w = W.partitionBy("source", "prompt")
    i, n = F.row_number().over(w.orderBy("value", "row_id")), F.count(F.lit(1)).over(w)
    x = rows.withColumn("i", i).withColumn("n", n)
    hi, lo = F.col("i") / F.col("n"), (F.col("i") - 1) / F.col("n")
    per = x.groupBy("source", "prompt").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        *[F.sum(F.col("value") * (F.pow(hi, F.lit(k)) - F.pow(lo, F.lit(k)))).alias(f"best_{k}") for k in sizes],
        *[F.sum(F.col("value") * (F.pow(1 - lo, F.lit(k)) - F.pow(1 - hi, F.lit(k)))).alias(f"worst_{k}") for k in sizes],
    )
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("prompts"), *[F.avg(c).alias(c) for c in per.columns[2:]])


def majority_value(rows: DataFrame) -> DataFrame:
    """rows: question, row_id, vote, value. The value of the first row of the most common vote; ties go to the vote seen first."""
    votes = rows.groupBy("question", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.min_by("value", "row_id").alias("value"))
    best = F.row_number().over(W.partitionBy("question").orderBy(F.desc("n"), "first"))
    return votes.withColumn("k", best).where("k = 1").select("question", "vote", "n", "value")


def data_metrics(rows: DataFrame, most: int) -> DataFrame:
    """rows: score, advantage, value, returns, length. Mean, max and min of each, clip ratio and explained variance."""
    names = ("score", "advantage", "value", "returns", "length")
    aggs = [f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    gone = F.col("returns") - F.col("value")
    return rows.agg(
        *aggs, F.avg((F.col("length") == most).cast("int")).alias("clip_ratio"), F.avg((F.col("length") == 0).cast("int")).alias("aborted_ratio"),
        (1 - F.var_samp(gone) / (F.var_samp("returns") + 1e-5)).alias("explained_var"),
    )


def reduce_metrics(rows: DataFrame) -> DataFrame:
    """rows: name, value. Max where the name says max, min where it says min, else the mean."""
    by = F.when(F.max(F.col("name")).contains("max"), F.max("value")).when(F.max(F.col("name")).contains("min"), F.min("value")).otherwise(F.avg("value"))
    return rows.groupBy("name").agg(by.alias("value"))


def step_metrics(rows: DataFrame) -> DataFrame:
    """rows: name, rule, step, value, weight. One number per name by its rule: time_sum, last, avg, max, min, sum, weighted_avg."""
    v, w = F.col("value"), F.col("weight")
    out = rows.groupBy("name", "rule").agg(
        F.sum(v).alias("sum"), F.max_by(v, "step").alias("last"), F.avg(v).alias("avg"), F.max(v).alias("max"), F.min(v).alias("min"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted_avg")
    )
    value = F.when(F.col("rule").isin("sum", "time_sum"), F.col("sum"))
    for rule in ("last", "avg", "max", "min", "weighted_avg"):
        value = value.when(F.col("rule") == rule, F.col(rule))
    return out.select("name", "rule", value.alias("value"))


def summary(rows: DataFrame, keys: tuple[str, str], values: tuple[str, ...]) -> DataFrame:
    """Counts and rounded means by either key, in one pass of grouping sets; ``level`` names the key."""
    a, b = keys
    out = rows.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(
        F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(v), 4).alias(v) for v in values], F.grouping_id().alias("gid")
    )
    return out.withColumn("level", F.when(F.col("gid") == 1, a).otherwise(b)).drop("gid")


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two columns from long-form counts; null where a side has fewer than two values."""
    counts = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    one = W.partitionBy(F.lit(1))
    t = counts.withColumn("ra", F.sum("n").over(W.partitionBy(a))).withColumn("rb", F.sum("n").over(W.partitionBy(b))).withColumn("total", F.sum("n").over(one))
    # chi2 / n = sum(n_ij^2 / (r_i c_j)) - 1, for which empty cells need not exist
    got = t.agg((F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1).alias("phi2"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"))
    least = F.least("r", "c") - 1
    return got.select(F.when(least > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / least)).alias("v"), "r", "c")


def softmean_baseline(rows: DataFrame, beta: float) -> DataFrame:
    """score less (1 / beta) ln mean exp(beta score); the plain mean at beta 0."""
    top = rows.agg(F.max("score").alias("top"))
    if beta:
        base = rows.crossJoin(F.broadcast(top)).agg((F.max("top") + F.ln(F.avg(F.exp(beta * (F.col("score") - F.col("top"))))) / beta).alias("base"))
    else:
        base = rows.agg(F.avg("score").alias("base"))
    return rows.crossJoin(F.broadcast(base)).withColumn("advantage", F.col("score") - F.col("base")).drop("base")


def ranking_accuracy(rows: DataFrame) -> DataFrame:
    """rows: uid, slot, score, acc. Per group, pairs whose score order agrees with acc, weighted by the acc gap; 0.5 if all acc are equal."""
    a, b = (rows.select("uid", *[F.col(c).alias(f"{c}_{s}") for c in ("slot", "score", "acc")]) for s in "ab")
    pairs = a.join(b, "uid").where("slot_a < slot_b")
    gap = F.col("acc_a") - F.col("acc_b")
    agree = ((F.col("score_a") > F.col("score_b")) == (gap > 0)).cast("int")
    got = pairs.groupBy("uid").agg(F.sum(agree * F.abs(gap)).alias("hit"), F.sum(F.abs(gap)).alias("all"))
    return got.select("uid", F.coalesce(F.try_divide("hit", "all"), F.lit(0.5)).alias("accuracy"))


def masked_stats(tokens: DataFrame, x: str, mask: str = "mask") -> DataFrame:
    """Masked sum, mean (over n + 1e-8) and unbiased variance over all tokens."""
    m, v = F.col(mask).cast("double"), F.col(x)
    n, s1, s2 = F.sum(m), F.sum(v * m), F.sum(v * v * m)
    mean = s1 / (n + 1e-8)
    return tokens.agg(s1.alias("sum"), mean.alias("mean"), ((s2 - 2 * mean * s1 + mean * mean * n) / (n + 1e-8) * n / (n - 1)).alias("var"))


def agg_loss(tokens: DataFrame, width: int) -> DataFrame:
    """tokens: uid, loss, mask. All four reductions; sequences without a masked-in token do not count."""
    rows = tokens.groupBy("uid").agg(F.sum(F.col("loss") * F.col("mask")).alias("s"), F.sum("mask").alias("n"))
    some = (F.col("n") > 0).cast("int")
    return rows.agg(
        (F.sum("s") / (F.sum("n") + 1e-8)).alias("token_mean"), (F.sum(F.col("s") * some) / (F.sum(some) + 1e-8)).alias("seq_mean_token_sum"),
        (F.sum(F.col("s") / (F.col("n") + 1e-8) * some) / (F.sum(some) + 1e-8)).alias("seq_mean_token_mean"), (F.sum("s") / width).alias("seq_mean_token_sum_norm"),
    )
