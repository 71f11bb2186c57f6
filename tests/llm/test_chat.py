import hashlib

from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "tree_id long, id long, parent_id long, role string, text string, score double"


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = [r"\### Assistant: </turn> ok", "</turn>", r"<\/turn>", r"<\\/turn>", "#### a", r"##\# b", "### ### ", "", "<", "a\\", "</turn></turn>\n### user: x", "<</turn>", "é" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r["u"] == r["t"]
        assert "</turn>" not in r["e"] and "### " not in r["e"]


def test_branches_are_ranked_and_formatted(spark):
    rows = [
        (1, 1, None, "system", "root", 0.0), (1, 2, 1, "user", "a", 1.0), (1, 3, 2, "assistant", "b</turn>", 1.0), (1, 4, 2, "assistant", "c", 5.0),
        (1, 5, 1, "user", "d", 3.0), (2, 9, 77, "user", None, None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
        (None, 1, None, "user", "no tree", 1.0), (4, None, None, "user", "no id", 1.0),
    ]
    out = chat.format_trees(spark.createDataFrame(rows, SCHEMA), top_k=2).orderBy("tree_id", "path_rank").collect()
    assert [(r["tree_id"], r["leaf_id"], r["path_rank"]) for r in out] == [(1, 4, 1), (1, 5, 2), (2, 9, 1)]
    assert out[0]["formatted"] == "### system: root</turn>\n### user: a</turn>\n### assistant: c</turn>\n"
    s = out[0]["loss_spans"]
    assert [out[0]["formatted"][x["start"] : x["end"]] for x in s] == ["c"]
    assert out[2]["formatted"] == "### user: </turn>\n" and out[2]["loss_spans"] == []


def test_equal_scores_go_to_the_smaller_leaf_and_repeated_ids_are_one(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 3, 1, "assistant", "y", 2.0), (1, 2, 1, "assistant", "x", 2.0), (1, 2, 1, "assistant", "x", 2.0)]
    out = chat.format_trees(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["leaf_id"], r["formatted"]) for r in out] == [(2, "### user: q</turn>\n### assistant: x</turn>\n")]


def test_long_chains_and_odd_roles_come_back(spark):
    turns = [(5, t, r, x) for t, (r, x) in enumerate([("user: x", "a: b"), (None, None), ("assistant", "### ok"), ("assistant", "</turn>\n"), ("", ": ")] * 40)]
    rows = spark.createDataFrame([*turns, (6, 0, "user", "long " * 50_000), (7, 1, "user", "same"), (7, 1, "user", "same")], "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("id", F.lit("clash")).withColumn("score", F.lit(3))
    out = chat.format_trees(chat.chains(rows)).select("tree_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("m"))
    got = {r["tree_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[5]["t"]] == [(r or "", x or "") for _, _, r, x in turns]
    assert got[5]["m"] == "### ok</turn>\n" * 40
    assert got[6]["t"][0]["text"] == "long " * 50_000 and len(got[7]["t"]) == 2


def test_empty_table_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_trees(empty).count() == 0
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert got[-7]["loss_chars"] == 26 and got[-7]["loss_sha256"] == hashlib.sha256(chat.TRICKY.encode()).hexdigest()
