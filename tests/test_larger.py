"""What the queries must hold on inputs of larger sizes and odd shapes, on small ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import plans
from millrace.functions import text as T
from millrace.operators import contracts as C
from millrace.operators import pairing as P
from millrace.operators import recipes
from millrace.operators import rewards as R
from millrace.operators import search
from millrace.sources import tables

SMALL = "/root/testdata/sf0.001"


def _brute(queries, corpus, k):
    out = []
    for i, q in queries:
        scored = [(-round(sum(x * y for x, y in zip(q, c, strict=True)), 6), j) for j, c in corpus]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_dense_search_takes_no_pair_by_itself(spark):
    """Vectors of one length meet as matrices; copies, near ties and odd vectors give the rows of a plain sort."""
    rng = random.Random(5)
    base = [[rng.randrange(-8, 9) / 8 for _ in range(8)] for _ in range(60)]
    rows = [(i, base[i % 60] if i % 7 else base[3]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = P.dense_top_k(df.where("vec_id < 40"), df, 5, block=15)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == _brute(rows[:40], rows, 5)
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [float("inf")] * 8), (903, [None] * 8)], df.schema)
    both = df.unionAll(odd)
    plain = P._summed(both.where("vec_id % 100 < 4").toDF("query_id", "q"), both, 100).selectExpr("*", "row_number() over (partition by query_id order by round(score, 6) desc, vec_id) as rank").where("rank <= 5")
    assert sorted(map(str, P.dense_top_k(both.where("vec_id % 100 < 4"), both, 5).collect())) == sorted(map(str, plain.collect()))
    assert P.dense_top_k(df, df.limit(0), 5).count() == 0 and P.dense_top_k(df.limit(0), df, 5).count() == 0


def test_contenders_hold_all_that_may_be_best():
    rng = np.random.RandomState(1)
    scores = np.round(rng.rand(30, 500), 2).astype(np.float32)
    qi, ci, floor = search.contenders(scores, 5, np.full(30, -np.inf), np.full(30, 1e-3))
    kth = np.sort(scores, axis=1)[:, -5]
    found = set(zip(qi.tolist(), ci.tolist(), strict=True))
    assert all((q, c) in found for q in range(30) for c in np.flatnonzero(scores[q] >= kth[q])) and (floor <= kth).all()
    kept = search.first(qi, ci, scores[qi, ci].astype(float), 5)
    best = {(q, c) for q in range(30) for c in sorted(range(500), key=lambda c: (-scores[q, c], c))[:5]}
    assert best <= {(int(qi[i]), int(ci[i])) for i in kept} and len(kept) < len(qi)


def test_bootstrap_draws_once_for_groups_of_one_size(spark, monkeypatch):
    """A call of the generator for each group and sample took milliseconds a group; results are those of the plain loop."""
    rng = random.Random(8)
    values = {g: [rng.random() for _ in range(1 + g % 7)] for g in range(300)}
    rows = spark.createDataFrame([(g, -k, v) for g, vs in values.items() for k, v in enumerate(vs)], "group long, order long, value double")
    monkeypatch.setattr(C, "SAMPLED", 500)
    out = C.bootstrap(rows, 4, ("mean", "best", "worst", "median"), 9)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["group"], r["reducer"]): (r["mean"], r["std"]) for r in out.collect()}
    assert len(got) == 1200
    for g, vs in values.items():
        draw, ordered = np.random.RandomState(42), np.array(vs[::-1])
        samples = [ordered[draw.choice(len(vs), size=4, replace=True)] for _ in range(9)]
        for name, f in (("mean", np.mean), ("best", np.max), ("worst", np.min), ("median", np.median)):
            assert got[g, name] == (np.mean([f(x) for x in samples]), np.std([f(x) for x in samples]))
    assert C.bootstrap(rows.limit(0), 4).count() == 0


def test_the_order_bonus_makes_no_texts(spark):
    """A thought's length needs no text of that length."""
    assert "lpad" not in plans.queries()["rwd_order_bonus"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    n = spark.createDataFrame([(x,) for x in (None, 0, 499, 500, 1999, 2000, 3500, 3501, 5000, 5001)], "n int")
    same = R.length_reward(F.col("n")).eqNullSafe(R.length_band(F.lpad(F.lit(""), F.col("n"), F.lit("x"))))
    assert n.where(same).count() == 10


@pytest.mark.parametrize("name", ["jn_pair_position", "jn_pair_identity", "adv_pair_faults", "adv_controlled_batch", "adv_alc"])
def test_many_rows_are_dealt_to_more_tasks(spark, monkeypatch, name):
    """A fixed number of tasks gave each of them memory in proportion to the table."""
    few = plans.queries()[name](spark, SMALL)
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    many = plans.queries()[name](spark, SMALL)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan(few) and "RepartitionByExpression" in plan(many) and "pivot" not in plan(many)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_rows_are_numbered_within_ranges(spark, monkeypatch):
    """One task read all texts to number them."""
    rng = random.Random(2)
    keys = rng.sample(range(10**15), 300)
    for kind, values in (("long", keys), ("string", [f"k{k}" for k in keys]), ("double", [k / 7 for k in keys]), ("long", [*keys[:200], *[None] * 100]), ("long", [7] * 150 + keys[:150])):
        df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
        monkeypatch.setattr(recipes, "NUMBERED", 20)
        out = recipes.numbered(df, "k")
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(out.collect(), key=lambda r: r["index"])
        assert [r["index"] for r in got] == list(range(300))
        assert [r["k"] for r in got] == sorted(values, key=lambda v: (v is not None, v if v is not None else 0))


def test_keyword_search_stores_no_pairs(spark, monkeypatch):
    """All pairs of a query and a document with a common word were grouped; now the best of each tile are."""
    rng = random.Random(9)
    bag = [f"w{j}" for j in range(40)]
    texts = [" ".join(rng.choices(bag, k=rng.randrange(0, 30))) for _ in range(150)]
    docs = [(i, texts[i % 120].upper() if i % 3 else texts[7]) for i in range(400)] + [(400, None), (401, ""), (402, "...")]
    queries = [(q, " ".join(rng.choices(bag, k=6)) + " unseen") for q in range(12)] + [(12, "nothing known"), (13, ""), (14, None)]
    df, qs = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    bags = {i: (t or "").lower().replace(".", " ").split() for i, t in docs}
    n, mean = len(docs), sum(map(len, bags.values())) / (len(docs) - 1)
    held = {w: sum(w in b for b in bags.values()) for w in bag}
    want = []
    for q, text in queries:
        scored = []
        for i, words in bags.items():
            if both := set((text or "").split()) & set(words):
                part = [np.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5)) * words.count(w) * 1.9 / (words.count(w) + 0.9 * (0.6 + 0.4 * len(words) / mean)) for w in sorted(both)]
                scored.append((-round(sum(part), 6), i))
        want += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:3])]
    out = P.keyword_top_k(qs, df.repartition(3), 3)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in out.collect()) == sorted(want)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in P.keyword_top_k(qs, df, 3, block=4).collect()) == sorted(want)
    assert P.keyword_top_k(qs.limit(0), df, 3).count() == 0 and P.keyword_top_k(qs, df.limit(0), 3).count() == 0


def test_trainer_rows_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Lineages are compared by sorting, and one task sorted all rows of its input."""
    run = plans.queries()["gat_trainer_contract"]
    few = run(spark, SMALL)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 40)
    monkeypatch.setattr(C, "CELL", 30)
    many = run(spark, SMALL)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") >= 2
    assert sorted(map(tuple, many.collect())) == want


def test_texts_are_normalised_once(spark):
    """Each golden text had its text normalised again."""
    plan = plans.queries()["str_qa_normal"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(regexp_replace(lower(text") == 1
    texts = ["The  a an\tcat's--\u00a0 the", "\u2003a\n\nthe b ", "an.a", "thea a_the the\u00e9 the", "a  b   c d\t", " ", "", None, "x" + chr(28) + " y", "the the the a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    spaces = T._SPACES
    plain = F.regexp_replace(F.lower("t"), r"[!-/:-@\[-`{-~]", "")
    bare = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    old = F.trim(F.regexp_replace(bare, f"[{spaces}]+", " "))
    assert df.where(T.qa_normal(F.col("t")).eqNullSafe(old)).count() == len(texts)
    golden = F.array(F.lit("zz"), F.concat(F.lit("The "), F.col("t")))
    got = [tuple(r) for r in df.select(T.exact_match(F.col("t"), golden), T.substring_match(F.col("t"), F.array(F.lit("a B")))).collect()]
    assert [g[0] for g in got] == [None if t is None else 1 for t in texts] and got[4][1] == 1 and got[7][1] is None


def test_answers_are_rewritten_once(spark):
    """Each step named the one before more than once, so the first steps were computed dozens of times a row."""
    x = str(T.math_normal(F.col("answer"))._jc.toString())
    assert x.count("tfrac") == 1
    answers = ["\\frac12", "\\sqrt2", "x=3", "0.5", "3/4", "\\frac", "\\sqrt", "1\\text{ m}\\text{ s}", "2\\text{ m}", None, "", "\\frac1"]
    want = ["\\frac{1}{2}", "\\sqrt{2}", "3", "\\frac{1}{2}", "\\frac{3}{4}", None, None, None, "2", None, "", "\\frac1"]
    rows = spark.createDataFrame(list(enumerate(zip(answers, strict=True))), "i int, a struct<t: string>").orderBy("i")
    assert [r[0] for r in rows.select(T.math_normal(F.col("a.t"))).collect()] == want
    assert all(r[0] is True for r in rows.select(T.math_equal(F.col("a.t"), F.col("a.t"))).collect())
