"""Contracts, adapters and record files beside their queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators import contracts as C
from millrace.sources import files


def test_order_is_compared_across_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 2, 1, 5, 9, 8, 8, 3, 4])], "at long, key long")
    monkeypatch.setattr(C, "CELL", 3)
    assert sorted(r["at"] for r in C.out_of_order(rows, "at", "key").collect()) == [3, 6, 8]
    assert C.out_of_order(rows.limit(0), "at", "key").count() == 0


def test_bootstrap_repeats_the_legacy_draws(spark):
    values = {1: [0.5, 1.0, 3.0], 2: [2.0]}
    rows = spark.createDataFrame([(g, k, v) for g, vs in values.items() for k, v in enumerate(vs)], "group long, order long, value double")
    C.register_reducer("spread", np.ptp)
    got = {(r["group"], r["reducer"]): (r["mean"], r["std"]) for r in C.bootstrap(rows, 2, ("mean", "best", "spread"), 20, 7).collect()}
    for g, vs in values.items():
        np.random.seed(7)
        samples = [[vs[i] for i in np.random.choice(len(vs), size=2, replace=True)] for _ in range(20)]
        for name, f in (("mean", np.mean), ("best", np.max), ("spread", np.ptp)):
            assert got[g, name] == pytest.approx((np.mean([f(s) for s in samples]), np.std([f(s) for s in samples])))
    with pytest.raises(ValueError, match="already"):
        C.register_reducer("spread", np.min)


def test_tool_messages_take_turns(spark):
    texts = ["a <code>x</code><interpreter> 1\n</interpreter>b<answer>2</answer>", "<answer>2</answer> tail", "<code>x", "", None, "<code>x</code><code>y</code>", "<code>a<answer>b</answer>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", C.tool_messages(F.col("t")).alias("x")).orderBy("k").collect()
    assert [tuple(m) for m in rows[0]["x"]] == [("assistant", "a", "x"), ("tool", "1", None), ("assistant", "b2", None)]
    assert all(r["x"] is None for r in rows[1:])


def test_public_fields(spark):
    cases = [({"status": "ok"}, []), ({"status": "a b"}, ["status"]), ({"shard_id": "C:/x"}, ["shard_id"]), ({"count": "1", "retry_count": "-1"}, ["retry_count"]), ({"x": "1"}, ["x"]), ({"candidate_id": None}, ["candidate_id"]), ({}, [])]
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "k long, m map<string,string>")
    assert [r["x"] for r in rows.select("k", C.public_faults(F.col("m")).alias("x")).orderBy("k").collect()] == [w for _, w in cases]


def test_windows_of_logs(spark):
    lines = spark.createDataFrame([(0, "a"), (10, "b"), (25, "c")], "at long, line string")
    assert [r["line"] for r in C.log_window(lines, 5).collect()] == ["b", "c"]
    assert [r["line"] for r in C.log_window(lines, 0, 25).collect()] == ["a", "b"]
    for start, end in ((-1, None), (5, 5), (26, None)):
        with pytest.raises(ValueError):
            C.log_window(lines, start, end)


def test_manifest_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/run/manifest.json"
    one = files.write_manifest(spark, path, {"b": 1, "a": "é", "output_manifest_hash": "x"}, "2024-01-01")
    assert files.write_manifest(spark, path, {"a": "é", "b": 1}, "2025-01-01") == one
    held = json.loads((tmp_path / "run" / "manifest.json").read_text())
    assert held == {"a": "é", "b": 1, "created_at_utc": "2025-01-01", "output_manifest_hash": one}
    with pytest.raises(ValueError):
        files.write_manifest(spark, path, {"a": float("nan")}, "x")
    assert json.loads((tmp_path / "run" / "manifest.json").read_text()) == held
    assert not list((tmp_path / "run").glob("*.partial"))


def test_crash_tails_are_put_aside(tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_bytes(b"one\ntwo\nthr")
    assert files.recover_tail(str(log)) == str(tmp_path / "log.0.quarantine") and log.read_bytes() == b"one\ntwo\n"
    assert (tmp_path / "log.0.quarantine").read_bytes() == b"thr" and files.recover_tail(str(log)) is None
    log.write_bytes(b"x")
    assert files.recover_tail(str(log)) == str(tmp_path / "log.1.quarantine") and log.read_bytes() == b""


def test_verified_records(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("record_hash", StringType())])
    line = files.canonical_json({"id": 9, "record_hash": files.record_hash({"id": 9})}) + "\n"
    (tmp_path / "a.jsonl").write_text(line)
    import hashlib

    digest = hashlib.sha256(line.encode()).hexdigest()
    assert [r["id"] for r in files.verified(spark, str(tmp_path), "a.jsonl", digest, schema, 1).collect()] == [9]
    for name, d, n in (("a.jsonl", "0" * 64, 1), ("a.jsonl", digest, 2), ("../a.jsonl", digest, 1)):
        with pytest.raises(ValueError):
            files.verified(spark, str(tmp_path), name, d, schema, n)


def test_scans_keep_the_order_of_files(spark, tmp_path):
    for name, ids in (("b", [3, 1]), ("a", [9, 8, 7])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    rows = files.read_many(spark, f"{tmp_path}/b", f"{tmp_path}/a")
    place = ("file_no", "file", "position")
    assert [r["id"] for r in rows.orderBy(*place).collect()] == [3, 1, 9, 8, 7]
    assert [r["id"] for r in files.read_many(spark, f"{tmp_path}/b", f"{tmp_path}/a", most=3).orderBy(*place).collect()] == [3, 1, 9]
    drawn = files.read_many(spark, f"{tmp_path}/b", f"{tmp_path}/a", most=3, seed=5)
    assert drawn.count() == 3 and drawn.exceptAll(files.read_many(spark, f"{tmp_path}/b", f"{tmp_path}/a", most=3, seed=5)).count() == 0
    nested = spark.createDataFrame([([[("x",)]],)], "p array<array<struct<k:string>>>")
    assert nested.select(files.walked(nested, "p", ("k",)).alias("v")).first()["v"] == "x"
    with pytest.raises(Exception, match="not one element"):
        two = spark.createDataFrame([(["a", "b"],)], "p array<string>")
        two.select(files.walked(two, "p")).collect()
