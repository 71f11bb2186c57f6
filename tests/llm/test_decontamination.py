import random
import re

from pyspark.sql import functions as F

from millrace.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items):
    wins = []
    for item_id, text in items:
        w = _words(text)
        if w and item_id is not None:
            n = min(10, len(w))
            wins += [(str(item_id), w[k : k + n]) for k in range(len(w) - n + 1)]
    out = []
    for doc_id, text in docs:
        w, hit, ids = _words(text), set(), set()
        for item_id, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    ids.add(item_id)
        out.append((doc_id, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


def _check(spark, docs, items):
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _brute(docs, items)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["aa", "bb", "CC", "dé", "É1", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(40):
        parts = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            k = rng.randrange(len(w))
            parts += w[k : k + rng.choice([8, 10, 14])]
        docs.append((i, rng.choice([" ", "-", ".\n"]).join(parts)))
    _check(spark, docs, items)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, "..."), (None, long), (4, long), (4, "x " + long + "!"), (4, long), (5, ("y " * 60_000) + long), (6, long.upper()), (7, " ".join(long.split()[:9]))]
    items = [(1, long), (1, long), (None, long), (2, None), (3, ""), (4, "only"), (5, "two words"), (10, long)]
    _check(spark, docs, items)
    _check(spark, docs, [(2, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert got.where("contaminated").count() == 0 and got.count() == len(docs)


def test_blocks_and_clean_documents(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(k, " ".join(long.split()[k : k + 12])) for k in range(15)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long, 0, "a"), (2, "clean text", 1, "b"), (3, None, 2, "c")], "doc_id long, text string, n_hit int, words string")
    one = d.find_runs(docs, items).select("doc_id", "item_id").distinct().count()
    assert d.find_runs(docs, items, vocabulary=7, prefixes=5).select("doc_id", "item_id").distinct().count() == one == 15
    clean = d.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3]
    assert d.contamination(docs, items).agg(F.sum("n_hit")).first()[0] == 26


def test_repeated_words_around_the_prefix(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 3, 4, 9, 10, 10, 11, 19, 20, 40)]
    docs = list(enumerate(texts + [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 9, 10, 30, 300)] + ["a " * 25, "- " + "b " * 25]))
    for items in (texts, [t for t in texts if len(t.split()) >= 10], ["a " * 10], ["b " * 30]):
        _check(spark, docs, list(enumerate(items)))


def _largest_method(spark, df):
    """Bytes of the largest method that Spark generates for df."""
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        parts = debug.codegenStringSeq(plan)
        return max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_hotspot_compiles_the_scans(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, "clean text")], "doc_id long, text string")
    for made in (d.contamination(docs, items), d.clean_documents(docs, items)):
        assert 0 < _largest_method(spark, made) < 8000  # HotSpot interprets larger ones for good
