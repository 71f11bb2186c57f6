"""Sharding: k-d tree partitioning over document metadata.

A node of the tree holds documents and a number of leaves. Each level picks,
per node, the metadata dimension with the widest spread (normalised to the
corpus) and cuts the node at the weighted median of that dimension, weight
being bytes; a node with an odd number of leaves is cut in that proportion.
It ends when every node is one leaf, that is, holds the target bytes.

Medians are distributed and exact: the order key of a dimension is a whole
number of 51 bits (21 bits of position, 30 bits of hash as tie-break), and
three histogram rounds of 17 bits each walk down to the cut. A round is one
grouped sum over a narrow table (no text) with map-side combine; only a
node's histogram (at most 2**17 bins) meets in a window. The tree itself has
at most 2 * leaves nodes, a bound fixed by the target and not by the rows of
a group, and is broadcast only within ``broadcast_leaves``; beyond, node
tables are shuffled.

Slots number the rows of a shard without gaps: rows fall in hash cells, cell
sizes are summed up in order, and each cell is numbered on its own, so no
task holds a shard.

Law: ``bytes`` - the sizes of shards differ by single documents only. Equal
texts need not share a shard, as one group of them may outweigh one.

Defined cases: a null text has no bytes, and every document counts one more
than its bytes; nulls in other columns sort before all values; rows that
repeat every key go to one side of a cut; no rows give no rows; text and other
columns pass through ``shard_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import Scratch, read

POSITION_BITS, TIE_BITS, ROUND_BITS, ROUNDS = 21, 30, 17, 3
DIMS = ("bytes", "lang", "source", "id")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _prefix(text: Column) -> Column:
    """The first six bytes as a number, in byte order."""
    padded = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(padded, 16, 10).cast("double")


def _measures() -> dict[str, Column]:
    """Size, checksum, tie-break and one raw number per dimension of a document."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return {
        "size": size_of(F.col("text")),
        "text_crc32": crc,
        "tie": F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), crc, F.lit(7)), 64 - TIE_BITS),
        "d_bytes": F.log2(size_of(F.col("text")).cast("double")),
        "d_lang": _prefix(F.col("lang").cast("string")),
        "d_source": _prefix(F.col("source").cast("string")),
        "d_id": F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)),
    }


class Tree:
    """A k-d tree built over docs (doc_id, text, lang, source): one table of cuts per level, and the corpus' ranges."""

    def __init__(self, docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, broadcast_leaves: int = 100_000):
        self.scratch = Scratch(docs.sparkSession, "shards")
        rows = self.scratch.write(docs.select("doc_id", *[c.alias(k) for k, c in _measures().items()]))
        if n_shards is None:
            total = rows.agg(F.sum("size")).first()[0] or 0
            n_shards = max(1, math.ceil(total / target_bytes))
        self.small = n_shards <= broadcast_leaves
        self.ends = rows.agg(*[f(f"d_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
        self.cuts: list[DataFrame] = []
        rows = self.scratch.write(rows.withColumns(self._scaled()).withColumn("node", F.lit(0).cast("long")))
        # the nodes of a level: the number of a node is that of its first leaf
        half = (F.col("n_leaves") + 1).bitwiseAND(-2) / 2
        nodes = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(n_shards).alias("n_leaves"))
        while n_shards > 1:
            nodes = nodes.withColumn("left_leaves", half.cast("int"))
            self.cuts.append(_cuts(rows, nodes.where("n_leaves > 1"), self._sent, self.scratch))
            late = self.scratch.write(self._below(rows, self.cuts[-1]))
            self.scratch.drop(rows)
            rows = late
            left = F.struct("node", F.col("left_leaves").alias("n_leaves"))
            right = F.struct((F.col("node") + F.col("left_leaves")).alias("node"), (F.col("n_leaves") - F.col("left_leaves")).alias("n_leaves"))
            nodes = self.scratch.write(nodes.select(F.inline(F.when(F.col("n_leaves") > 1, F.array(left, right)).otherwise(F.array(left)))))
            n_shards = (n_shards + 1) // 2
        #: doc_id, size, text_crc32, shard of every document.
        self.rows = rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))

    def _sent(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.small else table

    def _scaled(self) -> dict[str, Column]:
        """Dimensions as whole numbers of POSITION_BITS bits over the corpus' range."""
        top, out = (1 << POSITION_BITS) - 1, {}
        for d in DIMS:
            lo, hi = self.ends[f"lo_{d}"], self.ends[f"hi_{d}"]
            same = lo is None or hi == lo
            out[f"d_{d}"] = F.lit(0).cast("long") if same else F.floor((F.col(f"d_{d}") - lo) / (hi - lo) * top).cast("long")
        return out

    def _below(self, rows: DataFrame, cuts: DataFrame) -> DataFrame:
        """Rows with their node of the next level."""
        right = (F.col("dim").isNotNull() & (_key(F.col("dim")) >= F.col("cut"))).cast("long")
        node = F.col("node") + right * F.coalesce(F.col("left_leaves"), F.lit(0))
        return rows.join(self._sent(cuts), "node", "left").withColumn("node", node).select(*rows.columns)

    def shard(self, docs: DataFrame) -> DataFrame:
        """All columns of docs, a table that the tree was built over, and shard int (a column of that name is replaced).

        Documents walk down the tables of cuts, so texts are not shuffled while the cuts can be broadcast.
        """
        docs = docs.drop("shard")
        named = [f"__{k}" for k in range(len(docs.columns))]  # docs may have columns named like the tree's
        held = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, named, strict=True)], *[c.alias(k) for k, c in _measures().items()])
        rows = held.withColumns(self._scaled()).withColumn("node", F.pmod(F.col("tie"), F.lit(1)))
        for cuts in self.cuts:
            rows = self._below(rows, cuts)
        back = [F.col(n).alias(c) for c, n in zip(docs.columns, named, strict=True)]
        return rows.select(*back, F.col("node").cast("int").alias("shard"))


def _key(dim: Column) -> Column:
    at = F.lit(None).cast("long")
    for k, d in enumerate(DIMS):
        at = F.when(dim == k, F.col(f"d_{d}")).otherwise(at)
    return F.shiftleft(at, TIE_BITS) + F.col("tie")


def _cuts(rows: DataFrame, nodes: DataFrame, sent, scratch: Scratch) -> DataFrame:
    """node, dim, cut, left_leaves for every node of nodes (node, n_leaves, left_leaves), which have more than one leaf."""
    wide = (
        rows.groupBy("node")
        .agg(F.sum("size").alias("total"), *[(F.max(f"d_{d}") - F.min(f"d_{d}")).alias(d) for d in DIMS])
        .withColumn("spread", F.greatest(*DIMS))
    )
    dim = F.coalesce(*[F.when(F.col(d) == F.col("spread"), F.lit(k)) for k, d in enumerate(DIMS)])
    state = scratch.write(
        wide.join(sent(nodes), "node").select(
            "node", "left_leaves", dim.alias("dim"), F.lit(0).cast("long").alias("prefix"),
            (F.col("total") * F.col("left_leaves") / F.col("n_leaves")).alias("rest"),
        )
    )
    for r in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - 1 - r)
        bins = (
            rows.join(sent(state.select("node", "dim", "prefix")), "node")
            .withColumn("at", F.shiftright(_key(F.col("dim")), shift))
            .where(F.shiftright(F.col("at"), ROUND_BITS) == F.col("prefix"))
            .groupBy("node", "at")
            .agg(F.sum("size").alias("bytes"))
        )
        below = F.sum("bytes").over(W.partitionBy("node").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
        found = (
            bins.withColumn("upto", below)
            .join(sent(state.select("node", "rest")), "node")
            .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("bytes") < F.col("rest")))
            .groupBy("node")  # at most one bin holds the cut; this guards against rounding
            .agg(F.min("at").alias("prefix"), F.min(F.col("upto") - F.col("bytes")).alias("passed"))
        )
        state = scratch.write(
            state.drop("prefix").join(sent(found), "node").withColumn("rest", F.col("rest") - F.col("passed")).drop("passed")
        )
    return state.select("node", "dim", F.col("prefix").alias("cut"), "left_leaves")


def with_slots(rows: DataFrame, n_rows: int, rows_per_cell: int = 50_000) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard."""
    cells = max(1, math.ceil(n_rows / rows_per_cell))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    first = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("own", own).join(first, ["shard", "cell"]).withColumn("slot", F.col("first") + F.col("own")).drop("cell", "own", "first")


def shard_documents(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """All columns of docs with shard int."""
    return Tree(docs, n_shards, target_bytes).shard(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = Tree(docs, n_shards=8).rows
    return with_slots(rows, rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
