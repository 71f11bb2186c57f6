import random
import zlib

from pyspark.sql import functions as F

from millrace.llm import sharding as s

SCHEMA = "doc_id long, text string, lang string, source string"


def _docs(spark, n=400):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(1, 900), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for i in range(n)]
    return spark.createDataFrame([*rows, *[(10_000 + i, "same text", "en", "s0") for i in range(n // 2)], (None, None, None, None), (-1, "", None, "é")], SCHEMA)


def test_shards_are_near_equal_in_bytes_and_slots_gapless(spark):
    for n in (1, 3, 8):
        rows = s.Tree(_docs(spark), n_shards=n).rows
        got = s.with_slots(rows, rows.count(), rows_per_cell=20).collect()
        sizes, slots = [0] * n, [[] for _ in range(n)]
        for r in got:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert len(got) == 602 and max(sizes) - min(sizes) <= 3 * 901
        assert all(sorted(x) == list(range(len(x))) for x in slots)


def test_tree_equals_a_plain_k_d_tree(spark):
    docs = _docs(spark)
    tree = s.Tree(docs, n_shards=4)
    rows = tree.scratch.write(docs.select("doc_id", *[c.alias(k) for k, c in s._measures().items()])).withColumns(tree._scaled()).collect()

    def split(part, leaves, first, out):
        if leaves == 1:
            out.update({r["doc_id"]: first for r in part})
            return
        spread = [max(r[f"d_{d}"] for r in part) - min(r[f"d_{d}"] for r in part) for d in s.DIMS]
        dim = f"d_{s.DIMS[spread.index(max(spread))]}"
        key = lambda r: (r[dim] << s.TIE_BITS) + r["tie"]
        rest, cut = sum(r["size"] for r in part) * ((leaves + 1) // 2) / leaves, None
        for r in sorted(part, key=key):
            cut = key(r)
            if rest <= r["size"]:
                break
            rest -= r["size"]
        left = (leaves + 1) // 2
        split([r for r in part if key(r) < cut], left, first, out)
        split([r for r in part if key(r) >= cut], leaves - left, first + left, out)

    want = {}
    split(rows, 4, 0, want)
    assert {r["doc_id"]: r["shard"] for r in tree.rows.collect()} == want


def test_columns_pass_and_texts_are_measured_in_utf8(spark):
    docs = _docs(spark).withColumn("shard", F.lit("old")).withColumn("size", F.lit(1)).withColumn("node", F.lit(2))
    out = s.shard_documents(docs, target_bytes=40_000)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard"]
    tree = {(r["doc_id"], r["text_crc32"]): r for r in s.Tree(docs, target_bytes=40_000).rows.collect()}
    for r in out.collect():
        t = tree[r["doc_id"], zlib.crc32((r["text"] or "").encode())]
        assert t["size"] == len((r["text"] or "").encode()) + 1 and t["shard"] == r["shard"]


def test_empty_table_and_repeated_rows(spark):
    assert s.shard_documents(_docs(spark).limit(0), n_shards=8).count() == 0
    same = spark.createDataFrame([(1, "a", "en", "s")] * 50, SCHEMA)
    rows = s.Tree(same, n_shards=4).rows
    assert s.with_slots(rows, 50, 7).count() == 50
