import hashlib
import uuid

from pyspark.sql import functions as F

from millrace.llm import exact_dedup as e
from millrace.llm.common import shared_dir


def _index(spark):
    tag = uuid.uuid4().hex
    return e.DigestIndex(spark, f"{shared_dir(spark)}/digests-{tag}", f"digests_{tag}", buckets=4)


ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (5, "A", "z"), (None, "a", "w"), (2, "a", "y"), (7, "long " * 40_000, "v")]


def test_labels_against_plain_grouping(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string")
    index = _index(spark)
    index.append(docs)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in ROWS:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, index.label(docs).collect()), key=str) == sorted(want, key=str)
    kept = index.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 4, 5, 7]


def test_later_batches_meet_the_index_in_a_bucketed_anti_join(spark):
    index = _index(spark)
    schema = "doc_id long, text string"
    index.append(spark.createDataFrame([(9, "a"), (1, "b")], schema))
    second = spark.createDataFrame([(20, "a"), (21, "c"), (22, "c")], schema)
    index.append(second)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.label(second).collect()}
    assert got == {20: (9, False), 21: (22, False), 22: (22, True)}
    assert index.read().count() == 3
    index.append(second.limit(0))
    index.append(second)
    assert index.read().count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = second.select(F.col("doc_id").alias("id"), e.digest_of(F.col("text")).alias("digest"))
        plan = index.fresh(index.reduced(rows))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "SelectedBucketsCount" in plan


def test_empty_table(spark):
    index = _index(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    index.append(empty)
    assert index.label(empty).count() == 0
    assert index.label(empty).select(F.count("kept")).first()[0] == 0


def test_an_index_outlives_the_catalog(spark):
    """The folder alone is the index: appending goes on where another session stopped."""
    first = _index(spark)
    schema = "doc_id long, text string"
    first.append(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], schema))
    first.forget()
    later = e.DigestIndex(spark, first.path, f"again_{uuid.uuid4().hex}", buckets=99)
    assert later.exists() and later.buckets == 4
    batch = spark.createDataFrame([(4, "c"), (5, "a"), (6, "a")], schema)
    later.append(batch)
    assert sorted((r["keep_id"], r["group_size"]) for r in later.read().collect()) == [(1, 1), (3, 2), (4, 1)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in later.label(batch).collect()}
    assert got == {4: (4, 1, True), 5: (1, 3, False), 6: (1, 3, False)}
    later.forget()
    assert not spark.catalog.tableExists(f"{later.name}_digests")


def test_ranges_part_the_rows(spark):
    rows = spark.createDataFrame([(k,) for k in [5, 6, 7, 7, 7, 900, None, -3, 2**62, -(2**62)]], "id long")
    for n in (1, 2, 3, 7):
        parts = [[r["id"] for r in rows.where(c).collect()] for c in e.ranges(rows, n)]
        assert sum(map(len, parts)) == 10 and None in parts[-1]
        known = [[i for i in p if i is not None] for p in parts]
        assert all(min(a) > max(b) for a, b in zip([p for p in known if p], [p for p in known if p][1:]))
    assert len(e.ranges(rows.where("id is null"), 3)) == 1
    same = rows.where("id = 7")
    assert sum(same.where(c).count() for c in e.ranges(same, 3)) == 3
