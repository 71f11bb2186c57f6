import corpus_pipeline as p
from millrace.llm import decontamination, near_dedup
from millrace.llm.common import read

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = read(spark, SMALL, "documents")
    columns, at = docs.columns, {}
    for name, stage in p.STAGES:
        docs = p.Scratch(spark, "test").write(stage(spark, docs, SMALL))
        at[name] = docs
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard"])
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    n = [at[k].count() for k in at]
    assert n[0] >= n[1] >= n[2] >= n[3] == n[4] > 0
    assert near_dedup.near_duplicates(at["near_dedup"]).where("not kept").count() == 0
    assert decontamination.contamination(at["decontamination"], read(spark, SMALL, "benchmark")).where("contaminated").count() == 0


def test_run_hands_each_result_on(spark, monkeypatch):
    monkeypatch.setattr(p, "STAGES", [("first", lambda s, docs, d: docs.where("doc_id % 2 = 0")), ("second", lambda s, docs, d: docs.where("doc_id % 3 = 0").select("doc_id"))])
    got = [r["doc_id"] for r in p.run(spark, SMALL).collect()]
    assert got and all(i % 6 == 0 for i in got)


def test_odd_and_empty_documents(spark):
    docs = read(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "word " * 50_000, None, "s", 1), (10**9 + 1, "word " * 50_000, None, "s", 1)], docs.schema)
    for rows in (docs.limit(0), docs.limit(20).unionByName(odd)):
        for _, stage in p.STAGES:
            rows = p.Scratch(spark, "test").write(stage(spark, rows, SMALL))
            assert rows.columns[:5] == docs.columns
        assert rows.count() >= 0
