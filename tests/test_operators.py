"""Hand values, invariances and refusals of the reference's own operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text as T
from millrace.operators import advantage as A
from millrace.operators import balance as K
from millrace.operators import batch as B
from millrace.operators import checks as C
from millrace.operators import losses as L
from millrace.operators import metrics as M
from millrace.operators import pairing as P
from millrace.operators import rewards as R

SMALL = "/root/testdata/sf0.001"


def test_controlled_advantage_hand_values(spark):
    rows = spark.createDataFrame([("p", 0, 0, -1.0), ("p", 0, 1, 1.0), ("p", 1, 0, 3.0), ("p", 1, 1, 5.0)], "uid string, perm long, pslot long, score double")
    got = A.controlled(rows, mode="alc", eps=1.0).orderBy("score").collect()
    sd = math.sqrt(5)
    assert [r["weight"] for r in got] == pytest.approx([1.0] * 4)  # the gap of 4 exceeds sqrt(5) + 1
    want = [(x - 2) / (sd + 1) + (x - m) / 2 for x, m in ((-1, 0), (1, 0), (3, 4), (5, 4))]
    assert [r["advantage"] for r in got] == pytest.approx(want)
    assert A.pair_faults(rows).count() == 0
    assert A.pair_faults(rows.limit(3)).first()["fault"] == "missing"


def test_constant_groups_and_singletons(spark):
    rows = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.1), (1, 2, 0.1), (2, 0, 7.0)], "uid long, slot long, score double")
    got = {(r["uid"], r["slot"]): r["advantage"] for r in A.controlled(rows.withColumn("perm", F.lit(0)), mode="global_only").collect()}
    assert got[1, 0] == 0 and got[2, 0] == 0
    assert A.grpo(rows).where("uid = 2").first()["advantage"] == pytest.approx(7.0 / (1 + 1e-6))
    assert A.rloo(rows, singleton="zero").where("uid = 2").first()["advantage"] == 0
    assert A.passk(rows).where("uid = 2").count() == 0


def test_estimators_do_not_depend_on_partitioning(spark):
    rng = random.Random(0)
    rows = spark.createDataFrame([(rng.randrange(9), i, rng.random(), rng.randrange(1, 9)) for i in range(120)], "uid long, slot long, score double, length long")
    for name in ("grpo", "rloo", "opo", "passk", "pair_baseline", "gpg"):
        a, b = (A.estimator(name)(x).orderBy("slot").select("advantage").collect() for x in (rows, rows.repartition(5, "slot")))
        assert [r[0] for r in a] == pytest.approx([r[0] for r in b])


def test_registries_refuse_a_second_meaning():
    with pytest.raises(ValueError):
        A.register("grpo")(lambda rows: rows)
    with pytest.raises(ValueError):
        A.estimator("none")
    with pytest.raises(ValueError):
        L.loss("none")


def test_metric_hand_values(spark):
    rows = spark.createDataFrame([(1, 0, "A", "A", True), (1, 1, "A", "B", False)], "question long, perm_index long, prediction string, golden string, correct boolean")
    assert M.accuracy(rows).first()["accuracy"] == 0.5
    assert M.pair_consistency(rows).first()["consistency"] == 0.0
    assert M.recall_spread(rows).first()["rstd"] == 0.5
    assert M.class_divergence(rows).first()["ckld"] == pytest.approx(11.16635187588189, abs=1e-6)
    assert M.accuracy(rows.limit(0)).first()["accuracy"] == 0.0


def test_best_of_n_is_the_expectation(spark):
    values = [0.0, 1.0, 4.0]
    rows = spark.createDataFrame([("s", "p", i, v) for i, v in enumerate(values)], "source string, prompt string, row_id long, value double")
    got = M.validation_cube(rows, (2,)).first()
    pairs = [(a, b) for a in values for b in values]
    assert got["best_2"] == pytest.approx(sum(map(max, pairs)) / 9) and got["worst_2"] == pytest.approx(sum(map(min, pairs)) / 9)


def test_majority_tie_goes_to_the_vote_seen_first(spark):
    rows = spark.createDataFrame([(1, 1, "b", 5.0), (1, 2, "a", 6.0), (1, 3, "a", 7.0), (1, 4, "b", 8.0)], "question long, row_id long, vote string, value double")
    assert tuple(M.majority_value(rows).first()) == (1, "b", 2, 5.0)


def test_batch_round_trips(spark):
    n = 53
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("x"))
    assert B.same_rows(B.unfold(B.fold(rows, 8)), rows)
    assert B.same_rows(B.unpad(B.pad_to_divisor(rows, 16, n)), rows)
    assert B.pad_to_divisor(rows, 16, n).count() == 64
    at = rows.select(((F.col("row_id") * 7 + 1) % n).alias("at"), "row_id")
    assert B.same_rows(B.select_rows(B.select_rows(rows, at), B.reverse_index(at)), rows)
    assert sorted(r["row_id"] for r in B.numbered(rows.drop("row_id"), "x").collect()) == list(range(n))
    with pytest.raises(ValueError):
        B.minibatches(rows, 10, n)
    with pytest.raises(Exception, match="differs"):
        B.union_columns(rows, rows.withColumn("x", F.col("x") + 1)).collect()


def test_balance():
    rng = random.Random(5)
    for equal in (False, True):
        sizes = [rng.randrange(1, 900) for _ in range(64)]
        for how in (K.differencing, K.greedy):
            parts = how(sizes, 8, equal)
            assert sorted(i for p in parts for i in p) == list(range(64))
            if equal:
                assert {len(p) for p in parts} == {8}
        sums = [sum(sizes[i] for i in p) for p in K.differencing(sizes, 8)]
        assert max(sums) - min(sums) < 100
    assert K.differencing([], 2) == [[], []]
    with pytest.raises(ValueError):
        K.differencing([1, 2, 3], 2, True)
    parts = K.micro_batches([5, 9, 1, 7, 3, 8], 16)
    assert sorted(i for p in parts for i in p) == list(range(6)) and len(parts) == 3


def test_extraction(spark):
    cases = [
        ("<answer> A </answer>", "A", 1.0), ("x Final Answer: B", "B", 0.8), ("so B.", "B", 0.6), ("the answer is a" + "z" * 120, "A", 0.5), ("ABzz" * 40, "B", 0.3),
        ("nothing", None, 0.0), ("<answer>C</answer> Final Answer: A", "A", 0.8),
    ]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    got = df.select(T.answer_with_confidence(F.col("t")).alias("x"), "t").collect()
    assert {r["t"]: (r["x"]["answer"], r["x"]["confidence"]) for r in got} == {t: (a, c) for t, a, c in cases}
    assert T.balanced_box(r"a \boxed{1} \boxed{\frac{a}{b}} c") == r"\frac{a}{b}" and T.balanced_box(r"\boxed{1") is None and T.balanced_box(None) is None


def test_judge_reward_bands(spark):
    rows = spark.createDataFrame([("<think>" + "x" * n + "</think><answer>A</answer>", g) for n, g in ((499, "A"), (500, "B"), (3500, "A"), (5001, None))], "response string, golden string")
    assert [round(r["base"], 6) for r in R.judge_base(rows).collect()] == [1.2, -0.6, 1.5, 0.0]


def test_closest_pair_against_the_full_cross(spark):
    rng = random.Random(8)
    rows = [(q, f"k{i:03}", rng.choice(["correct", "incorrect"]), rng.randrange(40)) for i, q in enumerate([rng.randrange(6) for _ in range(90)])]
    got = {r["question"]: (r["gap"], r["positive"], r["negative"]) for r in P.closest_pair(spark.createDataFrame(rows, "question long, key string, status string, tokens long")).collect()}
    want = {}
    for q, k, s, t in rows:
        for q2, k2, s2, t2 in rows:
            if q == q2 and s == "correct" and s2 == "incorrect":
                want[q] = min(want.get(q, (10**9, "", "")), (abs(t - t2), k, k2))
    assert got == want


def test_holdout_against_the_greedy_loop(spark):
    rng = random.Random(2)
    rows = [("s", f"t{rng.randrange(4)}", str(i)) for i in range(83)]
    got = P.holdout(spark.createDataFrame(rows, "source string, stratum string, id string")).where("split = 'holdout'").groupBy("stratum").count().collect()
    sizes = {}
    for _, t, _ in rows:
        sizes[t] = sizes.get(t, 0) + 1
    quota = dict.fromkeys(sizes, 1)
    while sum(quota.values()) < min(82, max(1, 88 // 10)):
        t = min((k for k in quota if quota[k] < sizes[k] - 1), key=lambda k: (quota[k] / sizes[k], k))
        quota[t] += 1
    assert {r["stratum"]: r["count"] for r in got} == quota


def test_entry_and_sql_fit_together(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names)
    out = entry.entry(spark)
    assert out.columns == ["uid", "perm", "pslot", "score", "weight", "advantage"] and out.count() > 0


def test_dispatch_refuses_unknown_sources_and_second_scorers(spark, tmp_path):
    rows = spark.createDataFrame([("numbers", "#### 4", "4"), ("boxed", r"\boxed{\$ 1,000}", "1000")], "data_source string, response string, golden string")
    assert [r["score"] for r in R.dispatch(rows).collect()] == [1.0, 1.0]
    with pytest.raises(Exception, match="no scorer for other"):
        R.dispatch(rows.withColumn("data_source", F.lit("other"))).collect()
    with pytest.raises(ValueError):
        R.register("numbers", R.search_score)
    (tmp_path / "mine.py").write_text("def score(column, factor):\n    return column * factor\n")
    f = R.custom(str(tmp_path / "mine.py"), "score", factor=3)
    assert spark.range(3).select(f(F.col("id")).alias("x")).agg(F.sum("x")).first()[0] == 9
    with pytest.raises(AttributeError):
        R.custom(str(tmp_path / "mine.py"), "none")


def test_checks_find_each_corruption(spark):
    good = spark.createDataFrame([("a" * 64, "x", 1, 0.5)], "text_hash string, id string, n long, rate double")
    faults = lambda df: {r["column"]: r["n"] for r in C.record_faults(df, ("text_hash",), ("id",), ("n",), ("rate",)).collect()}
    assert set(faults(good).values()) == {0}
    for column, value in (("text_hash", "g" * 64), ("id", "  "), ("n", -1), ("rate", float("nan")), ("rate", float("inf"))):
        assert faults(good.withColumn(column, F.lit(value)))[column] == 1
    pairs = spark.createDataFrame([("q", "p1", "n1", 4)], "question string, positive string, negative string, gap long")
    permuted = P.permutations(pairs)
    assert C.mirrored(permuted).count() == 0 and C.mirrored(permuted.where("permutation_id = 0")).count() == 1
    texts = spark.createDataFrame([("p1", "good"), ("n1", "bad")], "key string, text string")
    rows = P.trainer_rows(permuted, texts, "Judge.").orderBy("extra_info.permutation_id").collect()
    assert [r["reward_model"]["ground_truth"] for r in rows] == ["A", "B"] and "Response A:\nbad" in rows[1]["prompt"][1]["content"]


def test_rank_balance_takes_every_batch(spark):
    got = entry.queries()["par_rank_balance"](spark, "/root/testdata/sf0.01").groupBy("batch", "part").count().collect()
    assert sum(r["count"] for r in got) == 15_000
    sizes = {}
    for r in got:
        sizes.setdefault(r["batch"], []).append(r["count"])
    assert len(sizes) == 235 and all(len(x) == 8 and len(set(x)) == 1 for x in sizes.values())


def test_point_accuracy_against_the_literal_rule(spark):
    from itertools import combinations

    rng = random.Random(3)
    cases = [None, [], [(1.0, 1.0)], [(9.0, 9.0)], [(0.1, 0.3), (0.2, 0.6), (0.3, 0.9)], [(9.0, 0.0), (9.0, 1.0), (9.0, 7.0)], [(9.0, 9.0), (1.0, 2.0), (3.0, 1.0), (8.0, 1.5)]]
    cases += [[(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(rng.randrange(1, 6))] for _ in range(60)]

    def want(ps):
        if not ps or any(math.isclose((b[1] - a[1]) * (c[0] - a[0]), (c[1] - a[1]) * (b[0] - a[0])) for a, b, c in combinations(ps, 3)):
            return -1.0
        at = [k for k, (x, y) in enumerate(ps, 1) if 0 <= x <= 4 and 0 <= y <= 4]
        return 1 / math.sqrt(len(ps) * at[0]) if at else -1 / len(ps)

    df = spark.createDataFrame(list(enumerate(cases)), "i int, p array<struct<x:double,y:double>>")
    got = {r["i"]: r["s"] for r in df.select("i", R.point_accuracy(F.col("p"), F.array(*map(F.lit, (0.0, 0.0, 4.0, 4.0)))).alias("s")).collect()}
    assert got == {i: pytest.approx(want(c)) for i, c in enumerate(cases)}
    assert len({round(x, 6) for x in got.values()}) > 6
