"""Relational algebra of ordered batches.

A batch is a DataFrame with a ``row_id`` from 0 on without gaps; where an
operator makes a new order, it says how ``row_id`` follows. Numbering rows
needs no single task: ``numbered`` ranks within ranges of the order and adds
the sizes of the ranges before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(df: DataFrame, *order: str, ranges: int = 32) -> DataFrame:
    """Adds row_id 0, 1, ... in the given total order; the first column is a number, whose quantiles bound the ranges."""
    cuts = df.agg(F.percentile_approx(order[0], [k / ranges for k in range(1, ranges)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    parts = df.withColumn("__part", part)
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))  # one row per range
    out = parts.withColumn("__own", own).join(F.broadcast(sizes), "__part")
    return out.withColumn("row_id", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def select_rows(df: DataFrame, index: DataFrame) -> DataFrame:
    """Gather with repetition; index: at (new row_id), row_id (old)."""
    return df.join(index, "row_id").drop("row_id").withColumnRenamed("at", "row_id")


def slice_rows(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    rows = df.where(F.col("row_id") >= start)
    rows = rows if stop is None else rows.where(F.col("row_id") < stop)
    rows = rows.where(F.pmod(F.col("row_id") - start, F.lit(step)) == 0)
    return rows.withColumn("row_id", F.floor((F.col("row_id") - start) / step))


def repeat(df: DataFrame, n: int, interleave: bool = True, size: int | None = None) -> DataFrame:
    """Rows n times, aabb (interleave) or abab (needs the batch's size). Adds slot."""
    out = df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    at = F.col("row_id") * n + F.col("slot") if interleave else F.col("slot") * F.lit(size) + F.col("row_id")
    return out.withColumn("row_id", at)


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Row i as often as its own count says; 0 drops it. Adds slot."""
    some = df.where(F.col(times) > 0)
    return some.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times).cast("long") - 1)))


def unfold_chunks(df: DataFrame, column: str, n: int) -> DataFrame:
    """Splits an array column in n equal parts, one row each. Adds chunk."""
    width = (F.size(column) / n).cast("int")
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(column, k * width + 1, width))).alias("chunk", "__x")).drop(column).withColumnRenamed("__x", column)


def fold(df: DataFrame, size: int) -> DataFrame:
    """Groups of size rows as one row: group, rows (array of structs in order)."""
    return df.groupBy(F.floor(F.col("row_id") / size).alias("group")).agg(F.array_sort(F.collect_list(F.struct("row_id", *[c for c in df.columns if c != "row_id"]))).alias("rows"))


def unfold(df: DataFrame) -> DataFrame:
    return df.select(F.inline("rows"))


def pad_to_divisor(df: DataFrame, divisor: int, n: int) -> DataFrame:
    """Appends rows from the head, cyclically, until the size divides. Adds is_pad; ``unpad`` undoes it."""
    pad = -n % divisor
    extra = df.sparkSession.range(n, n + pad).withColumn("__from", F.pmod("id", F.lit(max(n, 1))))
    tail = df.join(F.broadcast(extra), F.col("row_id") == F.col("__from")).withColumn("row_id", F.col("id")).drop("id", "__from").withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(tail)


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def pad_with(df: DataFrame, k: int, n: int, first: bool = True) -> DataFrame:
    """Appends k copies of the first or last row."""
    one = df.where(F.col("row_id") == (0 if first else n - 1))
    return df.unionByName(one.withColumn("row_id", F.explode(F.sequence(F.lit(n).cast("long"), F.lit(n + k - 1).cast("long")))))


def chunk(df: DataFrame, chunks: int, n: int) -> DataFrame:
    """Adds chunk: parts of ceil(n / chunks) rows."""
    return df.withColumn("chunk", F.floor(F.col("row_id") / -(-n // chunks)))


def split(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col("row_id") / size))


CELL = 50_000


def minibatches(df: DataFrame, size: int, n: int, epochs: int = 1, seed: int = 0) -> DataFrame:
    """epoch, batch and row_id in a seeded order per epoch; the size must divide n."""
    if n % size:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("row_id").cast("string")))
    # a cell is a beginning of the draw, so cells have about CELL rows, and only their sizes meet in one task
    digits = 1
    while n >> 4 * digits > CELL:
        digits += 1
    rows = rows.withColumn("draw", draw).withColumn("cell", F.substring("draw", 1, digits))
    before = F.coalesce(F.sum("k").over(W.partitionBy("epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("epoch", "cell").agg(F.count(F.lit(1)).alias("k")).select("epoch", "cell", before.alias("before"))
    own = F.row_number().over(W.partitionBy("epoch", "cell").orderBy("draw", "row_id")) - 1
    rows = rows.withColumn("own", own).join(cells, ["epoch", "cell"])
    return rows.withColumn("batch", F.floor((F.col("before") + F.col("own")) / size)).drop("draw", "cell", "own", "before")


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positional join that adds b's columns; shared columns must be equal (null and NaN equal themselves)."""
    shared = [c for c in a.columns if c in b.columns and c != "row_id"]
    right = b.withColumnsRenamed({c: f"__{c}" for c in shared})
    out = a.join(right, "row_id")
    for c in shared:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return out.drop(*[f"__{c}" for c in shared])


def concat(*batches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, batches)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Same columns by name and the same rows, repeated ones as often."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reverse_index(df: DataFrame) -> DataFrame:
    """at -> row_id turned round: the row_id that restores the order."""
    return df.select(F.col("row_id").alias("at"), F.col("at").alias("row_id"))


def pad_array(x: Column, n: int, pad: Column, left: bool = False) -> Column:
    """Padded or cut to n entries."""
    fill = F.array_repeat(pad, F.greatest(F.lit(n) - F.size(x), F.lit(0)))
    return F.slice(F.concat(fill, x), F.greatest(F.size(x) - n, F.lit(0)) + 1, F.lit(n)) if left else F.slice(F.concat(x, fill), 1, n)


def truncate(x: Column, n: int, how: str) -> Column:
    """Token ids cut to n: left keeps the end, right the beginning, middle both ends, error raises."""
    long = F.size(x) > n
    if how == "error":
        return F.when(long, F.raise_error(F.lit(f"longer than {n}"))).otherwise(x)
    half = n // 2
    cut = {
        "left": F.slice(x, F.greatest(F.size(x) - n, F.lit(0)) + 1, F.lit(n)),
        "right": F.slice(x, 1, n),
        "middle": F.concat(F.slice(x, 1, half), F.slice(x, F.greatest(F.size(x) - (n - half), F.lit(0)) + 1, F.lit(n - half))),
    }[how]
    return F.when(long, cut).otherwise(x)


def mask_to_first(tokens: Column, eos: Column) -> Column:
    """1 up to and including the first eos, then 0."""
    at = F.array_position(tokens, eos)
    return F.transform(tokens, lambda t, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """Running sum of the mask less 1, at least 0."""
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        mask, start, lambda a, m: F.struct((a["s"] + m).cast("int").alias("s"), F.array_append(a["out"], F.greatest(a["s"] + m - 1, F.lit(0)).cast("int")).alias("out"))
    )["out"]


def loss_mask(messages: Column) -> Column:
    """Per word of an array of (role, content) turns: 1 in assistant turns, else 0."""
    return F.flatten(F.transform(messages, lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), F.size(F.split(m["content"], " ")))))
