"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed up by (source, lang, topic) cell; raking multiplies
the cells by one factor per source, language and topic in turn until the
weighted token shares of all three meet their targets. A document's sampling
probability is its cell's factor, scaled so that the largest is 1: the
expected token shares of the sample are then exactly the raked ones. The draw
compares a hash of the document with the probability, so it is repeatable and
the same at any partitioning.

Targets: a mapping value -> weight per dimension, or a temperature: the share
of a value becomes proportional to its token share to that power (1 keeps the
mix, 0 makes values equal). Values that a mapping lacks get weight 0 and are
not sampled. Targets that the cells cannot meet (a cell pattern with zeros)
leave the last iterate, which meets the dimension raked last.

Scale: documents are summed with map-side combine, so a hot source costs one
row a task. Cells number at most the product of the three vocabularies. They
are counted first: up to ``small_cells`` they stay in one partition, where
windows need no exchange, and are broadcast back to the documents; beyond
that, sums combine map-side and joins are shuffle joins that adaptive
execution splits where a value or a cell is hot. Both ways compute the same.

Defined cases: null source, lang or topic are values of their own; a null or
blank text has no tokens, weighs nothing and is sampled by its cell's
probability (a cell without tokens: 0); rows that repeat a doc_id and text
are drawn alike; no rows give no rows; other columns, whatever their names,
pass through ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import Scratch, Shielded, read

DIMS = ("source", "lang", "topic")
#: Production mix: token shares to these powers.
TEMPERATURE = {"source": 0.85, "lang": 0.9, "topic": 0.95}
ITERATIONS, TOLERANCE, SEED, SMALL_CELLS = 40, 1e-10, 17, 100_000


def tokens_of(text: Column) -> Column:
    """Words between spaces and line ends."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\n]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.char_length(flat) - F.char_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of text, from its marks and length."""
    size = F.char_length(text)
    return (
        F.when(text.contains("License"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.contains("{") | text.contains("def ") | text.contains("="), "code")
        .when(size < 600, "brief")
        .when(size < 4000, "article")
        .otherwise("long")
    )


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document and the seed only."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.char_length(text).cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_sums(cells: DataFrame, d: str, one_task: bool) -> DataFrame:
    """Adds have: the weight of the cell's value of d. Few cells: a window in their one partition; many: sums and a join."""
    if one_task:
        return cells.withColumn("have", F.sum("w").over(W.partitionBy(d)))
    sums = cells.groupBy(F.col(d).alias("__d")).agg(F.sum("w").alias("have"))
    return cells.join(sums, F.col(d).eqNullSafe(F.col("__d"))).drop("__d")


def rake(
    cells: DataFrame,
    targets: Mapping[str, Mapping | float],
    scratch: Scratch,
    one_task: bool,
    iterations: int = ITERATIONS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """cells: DIMS and n (tokens). Adds factor: the raked weight of one token of the cell, 0 where nothing is wanted."""
    cells = cells.coalesce(1) if one_task else cells
    total = float(cells.agg(F.sum("n")).first()[0] or 0) or 1.0
    state = cells.withColumn("w", F.col("n") / total)
    for d in DIMS:
        goal = targets[d]
        if isinstance(goal, Mapping):
            share = F.coalesce(*[F.when(F.col(d).eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in goal.items()], F.lit(0.0))
        else:
            share = F.pow(F.col("have"), F.lit(float(goal)))
        state = _with_sums(state, d, one_task).withColumn(f"t_{d}", F.when(F.col("have") > 0, share).otherwise(0.0)).drop("have")
    state = scratch.write(state)
    sums = {d: float(state.groupBy(d).agg(F.max(f"t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 0) or 1.0 for d in DIMS}
    for _ in range(iterations):
        late = (state.coalesce(1) if one_task else state).withColumn("was", F.col("w"))
        for d in DIMS:
            late = _with_sums(late, d, one_task)
            late = late.withColumn("w", F.when(F.col("have") > 0, F.col("w") * F.col(f"t_{d}") / sums[d] / F.col("have")).otherwise(0.0)).drop("have")
        late = scratch.write(late)
        moved = late.agg(F.max(F.abs(F.col("w") - F.col("was")))).first()[0]
        scratch.drop(state)
        state = late.drop("was")
        state._scratch = late._scratch
        if not moved or moved < tolerance:
            break
    return state.select(*DIMS, "n", F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(0.0).alias("factor"))


def mix(
    docs: DataFrame, targets: Mapping[str, Mapping | float] = TEMPERATURE, seed: int = SEED, small_cells: int = SMALL_CELLS
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (mean 1 over tokens), probability, sampled of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.col("text")
    rows = scratch.write(
        docs.select(
            "doc_id", "source", "lang", topic_of(F.coalesce(text, F.lit(""))).alias("topic"), tokens_of(text).alias("tokens"),
            uniform(F.col("doc_id"), F.coalesce(text, F.lit("")), seed).alias("u"),
        )
    )
    cells = scratch.write(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("n")))
    small = cells.count() <= small_cells
    raked = rake(cells, targets, scratch, small)
    ends = raked.agg(F.max("factor").alias("top"), F.sum("n").alias("total")).first()
    top, total = ends["top"] or 1.0, ends["total"] or 1
    cell = raked.select(
        *[F.col(d).alias(f"c_{d}") for d in DIMS],
        (F.col("factor") * float(total)).alias("weight"), (F.col("factor") / float(top)).alias("probability"),
    )
    same = F.col("source").eqNullSafe(F.col("c_source")) & F.col("lang").eqNullSafe(F.col("c_lang")) & (F.col("topic") == F.col("c_topic"))
    return rows.join(F.broadcast(cell) if small else cell, same, "left").select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", (F.col("u") < F.col("probability")).alias("sampled")
    )


def mixed_documents(docs: DataFrame, targets: Mapping[str, Mapping | float] = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The sampled rows of docs, with their own columns."""
    held = Shielded(docs)
    cells = mix(docs.select("doc_id", "text", "source", "lang"), targets, seed).groupBy(*DIMS).agg(F.max("probability").alias("p"))
    cells, n = Scratch(docs.sparkSession, "mix-cells").counted(cells)
    text = F.coalesce(held["text"], F.lit(""))
    met = held["source"].eqNullSafe(F.col("source")) & held["lang"].eqNullSafe(F.col("lang")) & (topic_of(text) == F.col("topic"))
    joined = held.rows.join(F.broadcast(cells) if n <= SMALL_CELLS else cells, met)
    return held.back(joined.where(uniform(held["doc_id"], text, seed) < F.col("p")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).withColumns(
        {"weight": F.round("weight", 6), "probability": F.round("probability", 6)}
    )


def _sql(rounds: int = 25) -> str:
    """The same raking, unrolled; rounds is enough for both sides to stand still at the digits compared."""
    text = "coalesce(text, '')"
    flat = f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'), ' ')"
    steps = [
        f"""d AS (SELECT doc_id, source, lang,
  CASE WHEN contains({text}, 'License') THEN 'legal' WHEN contains({text}, ' | ') THEN 'table'
       WHEN contains({text}, '{{') OR contains({text}, 'def ') OR contains({text}, '=') THEN 'code'
       WHEN length({text}) < 600 THEN 'brief' WHEN length({text}) < 4000 THEN 'article' ELSE 'long' END AS topic,
  CASE WHEN {flat} = '' THEN 0 ELSE length({flat}) - length(replace({flat}, ' ', '')) + 1 END AS tokens,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(length({text}) AS VARCHAR)), 1, 13) AS BIGINT)
    / 4503599627370496.0 AS u FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
        "w AS (SELECT *, n / sum(n) OVER () AS w FROM c)",
        *[f"g_{d} AS (SELECT {d}, pow(sum(w), {TEMPERATURE[d]}) / sum(pow(sum(w), {TEMPERATURE[d]})) OVER () AS t_{d} FROM w GROUP BY {d})" for d in DIMS],
        "r0 AS (SELECT w.*, t_source, t_lang, t_topic FROM w JOIN g_source a ON a.source IS NOT DISTINCT FROM w.source "
        "JOIN g_lang b ON b.lang IS NOT DISTINCT FROM w.lang JOIN g_topic e ON e.topic = w.topic)",
    ]
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM r{k})")
            k += 1
    steps.append(f"f AS (SELECT source, lang, topic, n, CASE WHEN n > 0 THEN w / n ELSE 0 END AS f FROM r{k})")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, d.source, d.lang, d.topic, CAST(tokens AS BIGINT) AS tokens, round(f * (SELECT sum(n) FROM c), 6) AS weight, "
        "round(f / (SELECT max(f) FROM f), 6) AS probability, u < f / (SELECT max(f) FROM f) AS sampled\n"
        "FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic"
    )


SQL = _sql()
