"""Record files, manifests and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.sources import files
from millrace.streaming import queue

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("record_hash", StringType())])


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None), (3, "a\x1fb")], "id long, name string")
    files.append_jsonl(rows.coalesce(1), f"{tmp_path}/log")
    files.append_jsonl(rows.limit(1), f"{tmp_path}/log")
    good, bad = files.scan_jsonl(spark, f"{tmp_path}/log", SCHEMA)
    assert sorted(r["id"] for r in good.collect()) == [1, 1, 2, 3] and bad.count() == 0
    line = files.canonical_json({"id": 9, "name": "x", "record_hash": files.record_hash({"id": 9, "name": "x"})})
    broken = [line.replace('"x"', '"y"'), line[:-3], '{"id":1,"id":2}', '{"id":NaN}', line]
    (tmp_path / "more.jsonl").write_text("\n".join(broken) + "\n")
    good, bad = files.scan_jsonl(spark, f"{tmp_path}/more.jsonl", SCHEMA)
    assert [r["id"] for r in good.collect()] == [9] and bad.count() == 4


def test_evaluation_documents(spark, tmp_path):
    (tmp_path / "a_results.json").write_text(json.dumps({"results": [{"golden_answer": "A", "is_correct": True}, {"golden_answer": "B"}], "model": "m"}))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.json").write_text(json.dumps([{"golden_answer": "C"}]))
    assert files.evaluation_results(spark, f"{tmp_path}/a_results.json").where("golden_answer = 'B'").count() == 1
    assert files.evaluation_results(spark, f"{tmp_path}/b").first()["golden_answer"] == "C"


def test_manifests_and_lineage():
    a = files.manifest("split", {"seed": 42}, {"rows": 3}, [])
    b = files.manifest("plan", {"n": 2}, {"rows": 6}, [a["output_manifest_hash"]])
    held = {m["output_manifest_hash"]: m for m in (a, b)}
    assert files.check_lineage(held, b["output_manifest_hash"]) == [b["output_manifest_hash"], a["output_manifest_hash"]]
    held[a["output_manifest_hash"]] = a | {"counts": {"rows": 4}}
    with pytest.raises(ValueError):
        files.check_lineage(held, b["output_manifest_hash"])


def test_tree_manifest_and_trainer_export(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "x.txt").write_text("one")
    (tmp_path / "tree" / "y.txt").write_text("two")
    assert files.tree_manifest(spark, f"{tmp_path}/tree").count() == 2
    rows = spark.range(20).withColumn("m", F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))))
    assert files.write_trainer_parquet(rows, f"{tmp_path}/a", "id") == files.write_trainer_parquet(rows.repartition(3), f"{tmp_path}/b", "id")


def test_queue_keeps_its_state_over_micro_batches(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.lit(1).cast("long").alias("key"), "id").write.mode("append").parquet(f"{tmp_path}/in")
    stream = queue.read_stream(spark, f"{tmp_path}/in", "key long, id long", maxFilesPerTrigger=2)
    got = queue.replay(queue.bounded_queue(stream, "key", "id", 8), f"{tmp_path}/out", f"{tmp_path}/check", "update").first()
    assert (got["received"], got["dropped"], len(got["held"])) == (30, 22, 8)


def test_a_resumed_run_adds_only_what_is_new(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    run = lambda: queue.replay(queue.resumable(queue.read_stream(spark, source, "id long"), "id"), out, check)
    spark.range(5).write.mode("append").parquet(source)
    assert run().count() == 5
    spark.range(3, 8).write.mode("append").parquet(source)
    assert run().count() == 8 and run().count() == 8
