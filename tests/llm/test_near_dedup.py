import random

from pyspark.sql import functions as F

from millrace.llm import near_dedup as nd


def _shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _brute(docs, n):
    sets = [(i, _shingles(t, n)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                hi, lo = sorted((root(i), root(j)), reverse=True)
                up[hi] = lo
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def _corpus(rng, groups, size):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, size)):
            words = list(base)
            for _ in range(rng.randrange(8)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            docs.append(" ".join(words))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_equal_brute_force(spark):
    docs = _corpus(random.Random(4), 60, 9)
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert sorted(map(tuple, got)) == _brute(docs, 2)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(150)] = f"v{rng.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, t) for i, (_, t) in enumerate(_corpus(rng, 10, 3))]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert sorted(map(tuple, got)) == _brute(docs, 2)


def test_odd_rows(spark):
    docs = [
        (1, "One two  three"), (2, "one two\tthree"), (3, "ONE"), (4, "one"), (5, ""), (6, None), (7, " \n"), (8, "É a"), (9, "é a"),
        (10, "a\x1cb c"), (11, "a\xa0b c"), (12, "rep " * 70_000), (13, "rep " * 3),
    ]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert sorted(map(tuple, got)) == _brute(docs, 2)
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = nd.near_duplicates(odd).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("3", 3, True), ("3", 3, True), ("4", 3, False), ("None", None, True), ("None", None, True)]


def test_kept_documents_have_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text, 1, "a"), (2, text + " x", 2, "b"), (9, None, 3, "c"), (None, text, 4, "d")], "doc_id long, text string, id int, component string")
    kept = nd.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "9", "None"]
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.kept_documents(docs.limit(0)).count() == 0


def test_no_pair_at_the_threshold_is_missed(spark):
    rng = random.Random(1)
    docs = []
    for g in range(150):  # 40 of 50 shared: similarity 0.8 exactly
        words = [f"g{g}w{i}" for i in range(45)]
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-5] + [f"z{rng.random()}" for _ in range(5)]))]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=1)
    assert got.agg(F.sum((~F.col("kept")).cast("int"))).first()[0] == 150


def test_components_of_many_tasks_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2600)] + [(k, k + 1) for k in range(5000, 5400)] + [(9000, k) for k in range(6000, 6300)]
    up = {i: i for e in edges for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        hi, lo = sorted((root(a), root(b)), reverse=True)
        up[hi] = lo
    df = spark.createDataFrame(edges, "a long, b long").repartition(13)
    got = {r["id"]: r["component"] for r in nd.components(df, nd.Scratch(spark, "test")).collect()}
    assert got == {i: root(i) for i in up if root(i) != i}
    assert nd.components(df.limit(0), nd.Scratch(spark, "test")).count() == 0


def test_recall_at_five_words(spark):
    """Pairs near the threshold, each alone in the corpus, so that no third document can join them."""
    rng = random.Random(12)
    docs = []
    for g in range(400):
        words = [f"g{g}w{i}" for i in range(104)]
        near = list(words)
        for k in rng.sample(range(0, 100, 10), rng.choice([1, 2])):
            near[k + rng.randrange(3)] = f"x{rng.random()}"
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(near))]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=5).collect()
    found = {(r["doc_id"], r["component_id"]) for r in got if not r["kept"]}
    want = {(i, c) for i, _, c, kept in _brute(docs, 5) if not kept}
    assert not found - want and len(found) >= 0.99 * len(want) > 300


def test_crowds_that_do_not_link_branch_on(spark, monkeypatch):
    """Documents that share two thirds of their words fill large nodes without being linked; a pair among them is found."""
    monkeypatch.setattr(nd, "CROWD", 8)
    monkeypatch.setattr(nd, "SMALL", 3)
    monkeypatch.setattr(nd, "LAST_DEPTH", 9)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(140)]
    docs = [(i, " ".join(shared + [f"u{i}x{k}" for k in range(40)])) for i in range(60)]
    docs += [(500 + i, t + f" more{i}") for i, t in docs[:20]]
    rng.shuffle(docs)
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=1).collect()
    assert sorted(map(tuple, got)) == _brute(docs, 1)


def test_trees_follow_the_target_recall():
    assert nd.trees_for(80, 0.9) < nd.trees_for(80, 0.99) < nd.trees_for(80, 0.999)
    assert nd.trees_for(90, 0.99) < nd.trees_for(80, 0.99)
    assert nd.least_equal(80) < nd.least_equal(90) < 64
