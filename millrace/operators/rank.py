"""Exact top-k conditions without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_BITS = 16


def nine_digits(x: Column) -> Column:
    """A number as a whole number of billionths, within the range of a long."""
    return F.round(F.greatest(F.least(x, F.lit(9e9)), F.lit(-9e9)) * 1e9).cast("long")


def top(rows: DataFrame, keys: list[Column], k: int) -> Column:
    """A condition that holds for the k first rows by descending whole-number keys (negate one for ascending order).

    The k-th key is found by histograms of 16 bits from the top, each one grouped sum with map-side combine, so at most
    65,536 counts meet in one task, however many rows there are or are wanted. Rows equal in all keys go together.
    """
    above, equal, left = F.lit(False), F.lit(True), k
    if k <= 0:
        return above
    for key in keys:
        ordered = key.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
        for shift in range(64 - _BITS, -1, -_BITS):
            at = F.shiftrightunsigned(ordered, shift).bitwiseAND((1 << _BITS) - 1)
            counts = rows.where(equal).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            upto = F.sum("n").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
            found = counts.withColumn("upto", upto).where(F.col("upto") >= left).orderBy(F.desc("bin")).limit(1).first()
            if found is None:  # fewer rows than wanted
                return above | equal
            above, equal = above | (equal & (at > found["bin"])), equal & (at == found["bin"])
            left -= found["upto"] - found["n"]
            if left == found["n"]:
                return above | equal
    return above | equal
