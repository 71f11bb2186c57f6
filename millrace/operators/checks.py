"""Checks between relations: each returns violations or counts, so an empty or zero result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def successful_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of successful rows with how often they occur (more than once is a fault)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def inheritance(records: DataFrame, assignments: DataFrame, key: str, *columns: str) -> DataFrame:
    """Records without an assignment, and per column those that disagree with theirs."""
    held = assignments.select(key, F.lit(True).alias("__held"), *[F.col(c).alias(f"__{c}") for c in columns])
    x = records.join(held, key, "left")
    return x.agg(F.count_if(F.col("__held").isNull()).alias("unassigned"), *[F.count_if(F.col("__held") & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns])


def same_order(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Rows of two batches, by row_id: missing on either side, and unequal ones."""
    x = a.select("row_id", F.lit(1).alias("__a"), *columns).join(b.select("row_id", F.lit(1).alias("__b"), *[F.col(c).alias(f"__{c}") for c in columns]), "row_id", "full_outer")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return x.agg(F.count_if(~both).alias("missing"), F.count_if(both & ~same).alias("unequal"))


def pair_members(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """pairs: question, positive, negative; representatives: question, key, status. Counts of members that are none, or of the wrong kind."""
    kinds = []
    for column, status in (("positive", "correct"), ("negative", "incorrect")):
        r = representatives.select("question", F.col("key").alias(column), "status")
        x = pairs.select("question", column).join(r, ["question", column], "left")
        kinds.append(x.agg(F.lit(column).alias("member"), F.count_if(F.col("status").isNull()).alias("foreign"), F.count_if(F.col("status") != status).alias("wrong")))
    return kinds[0].unionAll(kinds[1])


def mirrored(permutations: DataFrame) -> DataFrame:
    """Questions whose two permutations do not mirror each other."""
    g = permutations.groupBy("question").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("permutation_id") == 0, F.concat_ws("|", "surface_a", "surface_b"))).alias("ab"), F.max(F.when(F.col("permutation_id") == 1, F.concat_ws("|", "surface_b", "surface_a"))).alias("ba")
    )
    return g.where((F.col("n") != 2) | ~F.col("ab").eqNullSafe(F.col("ba"))).select("question")


def record_faults(rows: DataFrame, hashes: tuple[str, ...] = (), ids: tuple[str, ...] = (), counts: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Violations of the typed record rules, by column: 64 hex digits, ids that are not blank, whole numbers from 0, finite numbers."""
    rules = {c: ~F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False)) for c in hashes}
    rules |= {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in ids}
    rules |= {c: F.coalesce(F.col(c) < 0, F.lit(True)) for c in counts}
    rules |= {c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in numbers}
    return rows.agg(*[F.count_if(bad).alias(c) for c, bad in rules.items()]).unpivot([], list(rules), "column", "n")


def named_failures(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check: its name, how many rows violate it, and a verdict."""
    parts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionAll, parts).withColumn("verdict", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))
