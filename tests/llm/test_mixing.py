import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def _docs(spark):
    rows = [(i, "word " * (1 + i % 40), ["en", "de", None][i % 3], f"s{i % 4 if i % 2 else 0}") for i in range(600)]
    return spark.createDataFrame([*rows, (None, None, None, None), (601, "", "en", "s0"), (602, "x" * 100_000, "en", "s1"), (602, "x" * 100_000, "en", "s1")], SCHEMA)


def test_raked_shares_meet_the_targets(spark):
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s3": 0.3}, "lang": 0.5, "topic": 1.0}
    out = mixing.mix(_docs(spark), targets)
    share = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("weight")).alias("w"))
    got = {r["source"]: r["w"] for r in share.collect()}
    total = sum(got.values())
    for k, v in targets["source"].items():
        assert got[k] / total == pytest.approx(v, abs=0.02)
    by_lang = {r["lang"]: r for r in out.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("weight")).alias("w"), F.sum("tokens").alias("n")).collect()}
    roots = {k: r["n"] ** 0.5 for k, r in by_lang.items()}
    for k, r in by_lang.items():
        assert r["w"] / total == pytest.approx(roots[k] / sum(roots.values()), abs=0.02)


def test_both_paths_agree_and_the_largest_probability_is_one(spark):
    docs = _docs(spark)
    a = mixing.mix(docs).orderBy("doc_id", "tokens").collect()
    b = mixing.mix(docs, small_cells=0).orderBy("doc_id", "tokens").collect()
    assert len(a) == len(b) == 604
    assert max(r["probability"] for r in a) == pytest.approx(1)
    for x, y in zip(a, b, strict=True):
        assert x["probability"] == pytest.approx(y["probability"]) and x["sampled"] == y["sampled"]


def test_sampling_is_stable_and_follows_probabilities(spark):
    docs = _docs(spark)
    out = mixing.mix(docs)
    again = mixing.mix(docs.repartition(7)).where("sampled").select("doc_id", "tokens").collect()
    assert sorted(map(str, again)) == sorted(map(str, out.where("sampled").select("doc_id", "tokens").collect()))
    got = out.agg(F.sum("probability").alias("p"), F.sum(F.col("sampled").cast("int")).alias("n")).first()
    assert got["n"] == pytest.approx(got["p"], rel=0.15)


def test_documents_keep_their_columns_and_empty_tables_work(spark):
    docs = _docs(spark).withColumn("topic", F.lit("mine")).withColumn("weight", F.lit(1))
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == mixing.mix(docs).where("sampled").count()
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
