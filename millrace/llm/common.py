"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, the context's checkpoint folder
    or one below the warehouse, which all of them read and write as well. Never a machine's own temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/millrace-checkpoints")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


class Shielded:
    """docs with its columns renamed, so that an operator can add columns of any name that does not begin with ``own_``."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.rows = docs.toDF(*[f"own_{k}" for k in range(len(docs.columns))])

    def __getitem__(self, name: str) -> Column:
        """A column of docs; of several that differ by case only, the one spelled so."""
        return F.col(f"own_{self.columns.index(name)}")

    def back(self, rows: DataFrame, **changed: Column) -> DataFrame:
        """rows with the columns of docs only, under their names; some may be replaced."""
        return rows.select(*[changed.get(c, F.col(f"own_{k}")).alias(c) for k, c in enumerate(self.columns)])


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs only the stage that runs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._clear)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        """The written table and its number of rows (of those that ``which`` holds for), counted while it is written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")))
        return out, seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing lazy reads any more."""
        self._remove(df._scratch)

    def _remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _clear(self) -> None:
        """At exit, as results read these tables lazily; the session may be gone by then."""
        with contextlib.suppress(Exception):
            self._remove(self.root)


def most_frequent(counts: DataFrame, limit: int, scratch: Scratch) -> list:
    """Rows of counts (word, n) of largest n, at most limit of them, in order.

    Order is by n, then by word. Counts fall in classes of one sixteenth of a doubling (a thousand at most); whole classes
    are taken from the top while they fit, and of the next one as many words as still fit, in that order. So only the rows
    of one class are ranked, and no task sends more than limit rows.
    """
    counts = scratch.write(counts.withColumn("class", F.floor(F.log2("n") * 16)))
    cut, held = None, 0
    for r in sorted(counts.groupBy("class").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if held + r["k"] > limit:
            break
        held, cut = held + r["k"], r["class"]
    got = counts.where(F.col("class") >= cut).collect() if held else []
    last = counts.where(F.lit(True) if cut is None else F.col("class") < cut)
    top = last.agg(F.max("class")).first()[0] if held < limit else None
    if top is not None:
        got += last.where(F.col("class") == top).orderBy(F.desc("n"), "word").limit(limit - held).collect()
    scratch.drop(counts)
    return sorted(got, key=lambda r: (-r["n"], r["word"]))


ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Python stages hold one Arrow batch of whole texts per task; larger batches than ARROW_ROWS are lowered to that for the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_Z, A_Z.lower()))
