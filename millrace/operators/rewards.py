"""Rule-based rewards over answer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as T


def length_band(thought: Column) -> Column:
    """Reward of a thought's length; a missing thought counts as too short."""
    return length_reward(F.char_length(thought))


def length_reward(n: Column) -> Column:
    """length_band of a thought of n characters."""
    return F.when(n < 500, -0.1).when(n < 2000, 0.1).when(n <= 3500, 0.2).when(n <= 5000, 0.1).otherwise(-0.1)


def judge_base(rows: DataFrame) -> DataFrame:
    """rows: response, golden. Adds answer, correct_score, format_score, length_score, base; a null golden scores 0."""
    answer = T.answer_with_confidence(F.col("response"))["answer"]
    tagged = F.col("response").contains("<answer>") & F.col("response").contains("</answer>")
    none = F.col("golden").isNull()
    out = rows.withColumn("answer", answer)
    out = out.withColumn("correct_score", F.when(none, 0.0).when(F.col("answer").eqNullSafe(F.col("golden")), 1.0).otherwise(-1.0))
    out = out.withColumn("format_score", F.when(none, 0.0).when(tagged, 0.3).otherwise(-0.3))
    out = out.withColumn("length_score", F.when(none, 0.0).otherwise(length_band(T.thinking(F.col("response")))))
    return out.withColumn("base", F.col("correct_score") + F.col("format_score") + F.col("length_score"))


def order_bonus(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    """rows: uid, pslot, perm, answer, base. Adds bonus (the pair's letters flip with the order: +weight, else -weight) and total.

    Pairs with an invalid or missing answer get no bonus.
    """
    w = W.partitionBy("uid", "pslot")
    zero, one = (F.max(F.when(F.col("perm") == k, F.col("answer"))).over(w) for k in (0, 1))
    valid = zero.isin("A", "B") & one.isin("A", "B")
    bonus = F.when(valid, F.when(zero != one, weight).otherwise(-weight)).otherwise(0.0)
    return rows.withColumn("bonus", F.coalesce(bonus, F.lit(0.0))).withColumn("total", F.col("base") + F.col("bonus"))


def consensus(rows: DataFrame, weight: float = 1.0, least: int = 3) -> DataFrame:
    """rows: question, k (rollout column), row_id, answer. Adds bonus: of a column's answers the mode with ``least`` votes or more gives
    +weight to those who agree and -weight to others; a weaker mode gives -weight to all; nobody parsed: 0."""
    votes = rows.where("answer is not null").groupBy("question", "k", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    best = F.row_number().over(W.partitionBy("question", "k").orderBy(F.desc("n"), "first"))
    mode = votes.withColumn("r", best).where("r = 1").select("question", "k", F.col("answer").alias("mode"), F.col("n").alias("votes"))
    agree = F.col("answer").eqNullSafe(F.col("mode"))
    bonus = F.when(F.col("mode").isNull(), 0.0).when((F.col("votes") >= least) & agree, weight).otherwise(-weight)
    return rows.join(mode, ["question", "k"], "left").withColumn("bonus", bonus)


def overlong(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """min(-(length - (most - buffer)) / buffer * factor, 0)."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def number_score(rows: DataFrame, strict: bool = True, format_score: float = 0.0, score: float = 1.0) -> DataFrame:
    """rows: response, golden. 0 without an answer, score if equal, format_score if not."""
    got = T.last_number(F.col("response"), strict)
    return rows.withColumn("score", F.when(got.isNull(), 0.0).when(got == F.col("golden"), score).otherwise(format_score))


def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """steps: run, step, kl, n. The coefficient after each step of each run."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "kl", "n")))
    init = F.struct(F.lit(float(start)).alias("v"), F.array().cast("array<struct<step:bigint,value:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        late = a["v"] * (1 + F.greatest(F.least(x["kl"] / target - 1, F.lit(0.2)), F.lit(-0.2)) * x["n"] / horizon)
        return F.struct(late.alias("v"), F.array_append(a["out"], F.struct(x["step"].alias("step"), late.alias("value"))).alias("out"))

    return steps.groupBy("run").agg(F.aggregate(ordered, init, step)["out"].alias("out")).select("run", F.inline("out"))


def preference(rows: DataFrame) -> DataFrame:
    """rows: row_id, score. Of each adjacent pair the higher score is preferred, ties the first."""
    w = W.partitionBy(F.floor(F.col("row_id") / 2)).orderBy(F.desc("score"), "row_id")
    return rows.withColumn("preferred", F.row_number().over(w) == 1)


def point_in_box(points: Column, box: Column) -> Column:
    """1 / rank of the first point inside [x1, y1, x2, y2]; 0 if none is."""
    inside = F.transform(points, lambda p: (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3]))
    at = F.array_position(inside, True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def collinear(points: Column) -> Column:
    """Whether three of the points lie on one line, by cross products equal within one in 10^9."""
    n = F.size(points)

    def on_line(i, j, k):
        p, q, r = F.get(points, i), F.get(points, j), F.get(points, k)
        a, b = (q["y"] - p["y"]) * (r["x"] - p["x"]), (r["y"] - p["y"]) * (q["x"] - p["x"])
        return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))

    later = lambda i: F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i)
    triple = F.exists(F.sequence(F.lit(0), n - 1), lambda i: F.exists(later(i), lambda j: F.exists(later(j), lambda k: on_line(i, j, k))))
    return F.when(n >= 3, triple).otherwise(False)


def point_accuracy(points: Column, box: Column) -> Column:
    """1 / sqrt(n * rank) of the first of n points inside [x1, y1, x2, y2]; -1 / n if none is; -1 without points or with three on one line."""
    inside = F.transform(points, lambda p: (p["x"] >= box[0]) & (p["x"] <= box[2]) & (p["y"] >= box[1]) & (p["y"] <= box[3]))
    n, at = F.size(points), F.array_position(inside, True)
    invalid = points.isNull() | (n <= 0) | collinear(points)
    return F.when(invalid, -1.0).when(at > 0, 1.0 / F.sqrt(n * at)).otherwise(-1.0 / n)


def component_faults(rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose total is not base plus bonus, or not finite."""
    odd = F.abs(F.col("total") - F.col("base") - F.col("bonus")) > tolerance
    return rows.where(odd | F.isnan("total") | F.col("total").isNull())


# --- dispatch ----------------------------------------------------------------

_SCORERS: dict[str, object] = {}


def register(source: str, scorer) -> None:
    """Names the scorer of a data source: a function of the columns (response, golden) to a score column."""
    if _SCORERS.setdefault(source, scorer) is not scorer:
        raise ValueError(f"a scorer for {source!r} is already registered")


def dispatch(rows: DataFrame) -> DataFrame:
    """rows: data_source, response, golden. Adds score by the source's scorer; an unknown source raises."""
    score = F.when(F.lit(False), F.lit(None).cast("double"))
    for source, scorer in _SCORERS.items():
        score = score.when(F.col("data_source") == source, scorer(F.col("response"), F.col("golden")))
    unknown = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce("data_source", F.lit("null")))).cast("double")
    return rows.withColumn("score", score.otherwise(unknown))


def search_score(response: Column, golden: Column, score: float = 1.0, format_score: float = 0.0, most_tags: int = 10) -> Column:
    """Exact match of the last <answer>; a quarter of it where more than ten tags were opened or closed."""
    bodies = F.regexp_extract_all(response, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    tags = F.size(F.regexp_extract_all(response, F.lit("</?answer>"), F.lit(0)))
    hit = T.exact_match(F.trim(F.try_element_at(bodies, F.lit(-1))), F.array(golden)) == 1
    return F.when(F.size(bodies) == 0, 0.0).when(hit, F.when(tags > most_tags, score / 4).otherwise(score)).otherwise(format_score)


def boxed_score(response: Column, golden: Column) -> Column:
    """1 where the last boxed answer equals golden after normalisation."""
    return F.coalesce((T.minerva_normal(T.last_box(response)) == T.minerva_normal(golden)).cast("double"), F.lit(0.0))


def number_scorer(response: Column, golden: Column) -> Column:
    return F.coalesce((T.last_number(response) == golden).cast("double"), F.lit(0.0))


def math_score(response: Column, golden: Column) -> Column:
    """1 where the last boxed answer and golden have one spelling; 0 otherwise or without a box."""
    box = T.last_box(response)
    return F.when(box.isNotNull() & T.math_equal(box, golden, T.as_it_stands), 1.0).otherwise(0.0)


register("numbers", number_scorer)
register("search", search_score)
register("boxed", boxed_score)
register("math", math_score)


def at_last_token(score: Column, mask: Column) -> Column:
    """Token rewards: the score at the last token of mask 1, else 0."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i)))
    return F.transform(mask, lambda m, i: F.when(i == last, score).otherwise(0.0))


def custom(path: str, name: str, **options):
    """A reward function from a file, with options bound; it takes and returns columns or pandas Series."""
    import importlib.util
    from functools import partial

    spec = importlib.util.spec_from_file_location("custom_reward", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return partial(getattr(module, name), **options)
