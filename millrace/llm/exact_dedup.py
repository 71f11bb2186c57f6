"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a folder with two tables, both bucketed by digest: ``digests``
(digest, keep_id, group_size), also sorted, one row for each text seen, and
``sightings`` (digest, group_size), the copies that later batches brought of
texts that the index held. A batch is first reduced to one row per digest
(map-side combine, so a digest that a third of the rows share costs one row a
task). The reduced batch meets the index in a sort-merge anti-join whose index
side is not shuffled; digests that the index lacks are appended, and those that
it has are appended as sightings. Labelling rows joins them to the index on the
digest with a shuffle on both sides, which adaptive execution splits where one
digest is hot.

The folder is the index: the number of buckets stands in the names of its
tables, and a session whose catalog does not know them registers them from
there, so that a new application goes on where the last one stopped and never
writes over it. ``forget`` drops the catalog's entries and keeps the folder. An
append writes sightings before digests; one that fails between the two and is
repeated counts the batch's known copies twice, but admits no text twice.

The query sends its table through the index in ``BATCHES`` appends by ranges of
doc_id, the largest first, so that the row that the contract keeps is the one
that the index holds when the other copies arrive.

Defined cases: a null text counts as the empty text; of equal texts in one
batch the row with the largest doc_id stays (nulls lose to any id; rows that
repeat that doc_id all stay, as they are one document); a digest that an
earlier batch brought keeps that batch's doc_id; an empty batch yields no
rows. Other columns, whatever their names, pass through ``kept_rows``.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, Shielded, read

#: Rows of a bucket when the index is made; later batches may bring some times as many.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 8
BATCHES = 3


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """Digests seen so far, as tables bucketed by digest.

    path: the folder (any shared file system); name: what its tables are called
    in the session's catalog; buckets: fixed when the index is made, by default
    by the size of the first batch.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path, name or f"millrace_{uuid.uuid4().hex}"
        self.buckets, self.fixed = buckets, False
        self.scratch = Scratch(spark, "digests")
        self._find()

    def _folder(self, kind: str) -> str:
        return f"{self.path}/{kind}-{self.buckets}"

    def _find(self) -> None:
        """Register the tables of the folder, if there are any."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        for name in sorted(held):
            kind, _, n = name.rpartition("-")
            if kind in SCHEMAS and n.isdigit():
                self.buckets, self.fixed = int(n), True
                self._register(kind)

    def _register(self, kind: str) -> None:
        order = "SORTED BY (digest) " if kind == "digests" else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name}_{kind} ({SCHEMAS[kind]}) USING parquet "
            f"CLUSTERED BY (digest) {order}INTO {self.buckets} BUCKETS LOCATION '{self._folder(kind)}'"
        )

    def forget(self) -> None:
        """Drop the tables from the catalog; the folder stays."""
        for kind in SCHEMAS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def exists(self) -> bool:
        return self.fixed

    def read(self, kind: str = "digests") -> DataFrame:
        """A table of the index, with its buckets."""
        return self.spark.table(f"{self.name}_{kind}")

    def _unbucketed(self, kind: str) -> DataFrame:
        """A table of the index by its files, so that hot digests can be split."""
        return self.spark.read.schema(SCHEMAS[kind]).parquet(self._folder(kind))

    def reduced(self, rows: DataFrame) -> DataFrame:
        """One row per digest of rows (id, digest): digest, keep_id, group_size."""
        return rows.groupBy("digest").agg(F.max("id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a reduced batch that the index lacks."""
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append_digests(self, rows: DataFrame) -> None:
        """Add rows (id, digest): the digests that the index lacks, and the numbers of those it has."""
        batch, n = self.scratch.counted(self.reduced(rows))
        if not self.fixed:
            self.buckets, self.fixed = self.buckets or max(LEAST_BUCKETS, math.ceil(n / BUCKET_ROWS)), True
            for kind in SCHEMAS:
                self._register(kind)
        again = batch.join(self.read().select("digest").hint("merge"), "digest", "left_semi").select("digest", "group_size")
        self._add("sightings", again)
        self._add("digests", self.fresh(batch))
        self.scratch.drop(batch)

    def _add(self, kind: str, rows: DataFrame) -> None:
        """Append rows to a table, each bucket by one task."""
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.select(self.read(kind).columns).write.insertInto(f"{self.name}_{kind}")

    def append(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add a batch of documents."""
        self.append_digests(batch.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")))

    def label_digests(self, rows: DataFrame) -> DataFrame:
        """id, digest, keep_id, group_size, kept of rows (id, digest) of batches that were appended."""
        more = self._unbucketed("sightings").groupBy("digest").agg(F.sum("group_size").alias("more"))
        held = self._unbucketed("digests").join(more, "digest", "left")
        held = held.select("digest", "keep_id", (F.col("group_size") + F.coalesce("more", F.lit(0))).alias("group_size"))
        return rows.join(held, "digest", "left").select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))

    def label(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col, keep_id, group_size, kept, digest of every row of a batch that was appended."""
        rows = self.label_digests(batch.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")))
        return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")

    def kept_rows(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of an appended batch that stay, with their own columns only."""
        docs, held = Shielded(batch), self._unbucketed("digests").select("digest", "keep_id")
        rows = docs.rows.withColumn("d", digest_of(docs[text_col]))
        return docs.back(rows.join(held, (F.col("d") == F.col("digest")) & docs[id_col].eqNullSafe(F.col("keep_id")), "left_semi"))


SCHEMAS = {"digests": "digest string, keep_id long, group_size long", "sightings": "digest string, group_size long"}


def ranges(rows: DataFrame, n: int) -> list[Column]:
    """Conditions on id that part rows in n ranges, the largest first, nulls in the last."""
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    if lo is None:
        return [F.lit(True)]
    cuts = sorted({lo + (hi - lo + 1) * k // n for k in range(1, n)} - {lo}, reverse=True)
    at, ends = F.col("id"), [None, *cuts, None]
    parts = [(at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True)) for high, low in zip(ends, ends[1:], strict=False)]
    return [*parts[:-1], parts[-1] | at.isNull()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "digests")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), digest_of(F.col("text")).alias("digest"))
    docs = scratch.write(docs)  # texts are read once
    index = DigestIndex(spark, f"{scratch.root}/index")
    for part in ranges(docs, BATCHES):
        index.append_digests(docs.where(part))
    index.forget()
    labelled = index.label_digests(docs)
    return labelled.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
