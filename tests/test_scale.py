"""Ways that only large inputs take, on small ones."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import advantage as A
from millrace.operators import batch as B
from millrace.operators import pairing as P
from millrace.operators import rank
from millrace.operators import recipes as R


def test_top_equals_a_sort(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([-5, 0, 0, 3, 2**40, -(2**62), 2**63 - 1, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(3).cache()
    for k in (0, 1, 7, 40, 150, 299, 300, 999):
        got = {r["id"] for r in df.where(rank.top(df, [F.col("x"), -F.col("id")], k)).collect()}
        assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
    assert rank.top(df.limit(0), [F.col("x")], 3) is not None


def test_batches_of_many_cells_equal_those_of_one(spark, monkeypatch):
    df = spark.range(240).select(F.col("id").alias("row_id"))
    one = {tuple(r) for r in B.minibatches(df, 12, 240, 2, 5).select("epoch", "batch", "row_id").collect()}
    monkeypatch.setattr(B, "CELL", 3)
    assert {tuple(r) for r in B.minibatches(df, 12, 240, 2, 5).select("epoch", "batch", "row_id").collect()} == one


def test_candidates_are_planned_alike_in_parts(spark, monkeypatch):
    names = spark.createDataFrame([(f"q{i:03d}" if i % 3 else f"p{i}",) for i in range(60)], "question string")
    numbers = spark.createDataFrame([(i * i - 50,) for i in range(60)], "question long")
    makers = spark.createDataFrame([("m",), ("n",)], "generator string")
    for questions in (names, numbers):
        one = sorted(map(tuple, P.plan_candidates(questions, makers, 3, 7).collect()))
        with monkeypatch.context() as m:
            m.setattr(P, "RANKED", 5)
            assert sorted(map(tuple, P.plan_candidates(questions, makers, 3, 7).collect())) == one
        assert sorted(r[3] for r in one) == list(range(360))
    assert P.plan_candidates(names.limit(0), makers, 3, 7).count() == 0


def test_queries_meet_the_corpus_in_blocks(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(50)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, P.dense_top_k(df.where("vec_id < 9"), df, 3).collect()))
    assert len(one) == 27 and sorted(map(tuple, P.dense_top_k(df.where("vec_id < 9"), df, 3, block=2).collect())) == one


def test_draws_by_ranges(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.randrange(40), i, rng.choice([0.0, 0.1, 1.0, 2.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "uid long, slot long, weight double")
    one = sorted((r["uid"], r["slot"], r["times"]) for r in R.resample(df).collect())
    assert sum(t for _, _, t in one) == 200
    total = sum(w for _, _, w in rows)
    of = {(u, s): w for u, s, w in rows}
    assert all(abs(t - 200 * of[u, s] / total) < 1 for u, s, t in one)
    monkeypatch.setattr(R, "RANGE", 3)
    assert sorted((r["uid"], r["slot"], r["times"]) for r in R.resample(df).collect()) == one
    assert sum(r["times"] for r in R.resample(df, seed=3).collect()) == 200
    assert R.resample(df.limit(0)).count() == 0


def test_a_faulty_batch_is_refused(spark):
    schema = "uid long, perm long, pslot long, tokens array<struct<score: double, mask: int>>, base double, bonus double"
    good = [(1, p, s, [(0.5 * p + s, 1), (9.0, 0)], 0.5 * p + s, 0.0) for p in (0, 1) for s in (0, 1)]
    out, summary = A.controlled_batch(spark.createDataFrame(good, schema), "eis")
    assert all(r["advantages"][1] == 0 for r in out.collect()) and summary.first()["rows"] == 4
    for odd in ([(1.0, 2)], [(1.0, 0)], [(float("nan"), 1)], [(2.0, 1)], []):
        with pytest.raises(ValueError, match="faulty rows"):
            A.controlled_batch(spark.createDataFrame([*good, (1, 0, 2, odd, 1.0, 0.0)], schema), "eis")


def test_boxes_and_objects():
    assert R._boxes("{ \\boxed{a{b}} } x") == (["\\boxed{a{b}}"], False, " } x")
    assert R._boxes("\\boxed{\\boxed{1}} \\boxed{1")[:2] == (["\\boxed{\\boxed{1}}"], True)
    assert R._find_json('x {"a":{"b":1}} y') == '{"a": {"b": 1}}'
    assert R._find_json("code { x } {'k':[1,2,],} tail {") == '{"k": [1, 2]}'
    assert R._find_json("{" * 100_000) is None
