"""Adapters from the driver's tables to the engine's relations, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a group key that one task gets at most, but for large groups.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by the keys to as many tasks as their number asks for; few rows stay as they are, for the session's own number of tasks.

    Tables of any size would else meet in a fixed number of tasks, whose memory grows with the table. Later groupings by the same keys need no exchange.
    """
    tasks = -(-rows.count() // TASK_ROWS)
    return rows if tasks <= 1 else rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def r6(x: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def s6(x: str) -> str:
    """r6 in SQL."""
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


#: A trajectory is a line of an order: the order is its group, its place in the order its slot.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, slot, perm, pslot, score, length, old_lp, new_lp, mask, flag, status."""
    slot = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)).cast("long") - 1
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("slot", slot)
    return rows.select(
        F.col("l_orderkey").alias("uid"), "slot", (F.col("slot") % 2).alias("perm"), F.floor(F.col("slot") / 2).alias("pslot"),
        (F.col("l_extendedprice") / 9973.0).alias("score"), F.col("l_quantity").cast("long").alias("length"),
        (-F.col("l_discount")).alias("old_lp"), (-F.col("l_tax")).alias("new_lp"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


TRAJ = f"""traj AS (SELECT uid, slot, slot % 2 AS perm, slot // 2 AS pslot, l_extendedprice / 9973.0 AS score, CAST(l_quantity AS BIGINT) AS length,
  -l_discount AS old_lp, -l_tax AS new_lp, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask, l_returnflag AS flag, l_linestatus AS status
  FROM (SELECT *, l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS slot FROM lineitem))"""


def paired(rows: DataFrame) -> DataFrame:
    """Trajectories whose (uid, pslot) has both permutations."""
    return rows.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("uid", "pslot"))).where("k = 2").drop("k")


PAIRED = "paired AS (SELECT * FROM traj QUALIFY count(*) OVER (PARTITION BY uid, pslot) = 2)"


def sequences(rows: DataFrame) -> DataFrame:
    """One row per group with its tokens in slot order: uid, tokens array of struct(slot, score, old_lp, new_lp, mask)."""
    token = F.struct("slot", "score", "old_lp", "new_lp", "mask")
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list(token)).alias("tokens"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows from orders: row_index, question, perm_index, permutation, prediction, golden, correct, gold_index."""
    perms = F.array(*[F.lit(p) for p in PERMUTATIONS])
    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    rows = table(spark, sf_dir, "orders").withColumn("perm_index", at)
    rows = rows.select(
        F.col("o_orderkey").alias("row_index"), F.col("o_custkey").alias("question"), "perm_index",
        F.element_at(perms, (F.col("perm_index") % 4).cast("int") + 1).alias("permutation"),
        F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, "ABCD")), F.floor(F.pmod(F.col("o_totalprice"), F.lit(4.0))).cast("int") + 1)).alias("prediction"),
        F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("o_custkey") % 4).cast("int") + 1).alias("original"),
    )
    golden = F.element_at(F.array(*map(F.lit, "ABCD")), F.instr("permutation", F.col("original")))
    return rows.withColumn("golden", golden).withColumn("correct", F.col("prediction") == F.col("golden"))


PERMUTATIONS = ("ABCD", "BACD", "CDAB", "DCBA")
EVAL = """eval AS (SELECT *, prediction = golden AS correct FROM (SELECT *, substr('ABCD', instr(permutation, original), 1) AS golden FROM (
  SELECT o_orderkey AS row_index, o_custkey AS question, i AS perm_index, (['ABCD','BACD','CDAB','DCBA'])[i % 4 + 1] AS permutation,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE substr('ABCD', CAST(floor(o_totalprice - 4 * floor(o_totalprice / 4)) AS INT) + 1, 1) END AS prediction,
  substr('ABCD', CAST(o_custkey % 4 AS INT) + 1, 1) AS original
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders))))"""
