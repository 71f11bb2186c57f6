"""Operators that return whole documents keep columns of any name."""

from millrace.llm import decontamination, line_dedup, mixing, near_dedup, sharding, toxicity
from millrace.llm.exact_dedup import DigestIndex
from millrace.llm.common import Scratch

NAMES = ("__id", "__hash", "__h", "__p", "__keep", "__digest", "__d", "__gone", "__spans", "id", "hash", "p", "d", "gone", "spans", "digest", "keep_id", "topic", "node", "tie", "size", "words")


def test_columns_of_any_name_pass_through(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, "en", "a"), (2, line, "en", "b"), (3, "one two three", None, None), (4, None, "fr", "a")]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in NAMES)) for r in rows], ["doc_id", "text", "lang", "source", *NAMES])
    items = spark.createDataFrame([("x", "one two three")], "item_id string, text string")
    index = DigestIndex(spark, f"{Scratch(spark, 'clash').root}/index")
    index.append(docs)
    found = {
        "near": near_dedup.kept_documents(docs), "bench": decontamination.clean_documents(docs, items), "mix": mixing.mixed_documents(docs),
        "toxic": toxicity.clean_documents(docs, toxicity.Model()), "lines": line_dedup.without_repeats(docs), "digest": index.kept_rows(docs),
    }
    kept = {k: {r["doc_id"]: r for r in df.collect()} for k, df in found.items()}
    assert {k: sorted(v) for k, v in kept.items() if k != "mix"} == {"near": [1, 3, 4], "bench": [1, 2, 4], "toxic": [1, 2, 3, 4], "lines": [1, 2, 3, 4], "digest": [2, 3, 4]}
    assert all(df.columns == docs.columns for df in found.values())
    assert all(r[n] == f"{n}{i}" for v in kept.values() for i, r in v.items() for n in NAMES)
    cut = sharding.shard_documents(docs, n_shards=3)
    assert cut.columns == [*docs.columns, "shard"] and all(r[n] == f"{n}{r['doc_id']}" for r in cut.collect() for n in NAMES)
    index.forget()
