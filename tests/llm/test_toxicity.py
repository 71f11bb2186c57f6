import math
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import read

SMALL = "/root/testdata/sf0.1"


def test_folding_and_exceptions():
    m = toxicity.Matcher(toxicity.Model())
    assert m.features("you IDI0T")[0] > 0
    assert m.features("уou іdіоt")[0] > 0
    assert m.features("st​upid")[0] > 0
    assert m.features("put it in the trash can")[0] == 0
    assert m.features("what trash")[0] > 0
    assert m.features("foo-clownish") == m.features("foo-clown x"[:11]) or m.features("foo-clownish")[0] > 0
    assert m.features("unclown")[0] == 0
    assert m.features(None) == m.features("") == (0.0, 0.0, 0.0)
    assert m.score("a " * 5 + "idiot") > m.score("a " * 5000 + "idiot")


def test_learned_entries_reach_the_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 9 == 0
        if toxic:
            words[5], words[30] = "blorg" + rng.choice("abcdef"), "blorg" + rng.choice("ghij")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert any(e.startswith("blorg"[:3]) for e in model.weights if e not in toxicity.SEEDS)
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    spoiled = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, spoiled).weights == model.weights  # held-out labels are not read


def test_held_out_accuracy_on_documents(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "idiot moron", "y"), (2, "", "z"), (3, "word " * 100_000, "q"), (3, "word " * 100_000, "q")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.scores(docs, model)
    assert got.count() == 5 and all(0 <= r["score"] <= 1 for r in got.collect())
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and clean.count() == 4
    assert toxicity.scores(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, odd).coef == pytest.approx(toxicity.Model().coef)


def _naive(model, text):
    """Features without an automaton: every entry is tried at every beginning of a word."""
    folded = toxicity.fold(text)
    starts = [i for i in range(len(folded)) if i == 0 or not folded[i - 1].isalpha()]
    spared = set()
    for phrase in model.exceptions:
        bare = phrase.rstrip("*")
        for i in starts:
            end = i + len(bare)
            if folded[i:end] == bare and (phrase != bare or not folded[end : end + 1].isalpha()):
                spared |= set(range(i, end))
    weights = []
    for i in starts:
        fits = [e for e in model.weights if folded.startswith(e, i)]
        if fits and i not in spared:
            weights.append(model.weights[max(fits, key=len)])
    total = sum(weights)
    return math.log1p(total), math.log1p(100 * total / max(len(folded.split()), 1)), max(weights, default=0.0)


def test_features_and_scores_against_a_naive_matcher():
    rng = random.Random(5)
    model = toxicity.Model({**toxicity.Model().weights, "tras": 1.5, "trashy": 6.0, "cl0": 2.0}, (-3.0, 0.7, 0.4, 0.2))
    matcher = toxicity.Matcher(model)
    pieces = ["trash", "trash can", "can", "candidate", " ", " ", " ", "clown", "fish", "cl0wn", "1d10t", "ѕtupid", "x", ".", "trash collector", "fool", "proof", "host parasite", "s", "Garbage Cans", "é"]
    for _ in range(600):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        want = _naive(model, text)
        assert matcher.features(text) == pytest.approx(want), text
        z = model.coef[0] + sum(c * x for c, x in zip(model.coef[1:], want))
        assert matcher.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_exceptions_end_with_their_words():
    m = toxicity.Matcher(toxicity.Model())
    assert m.features("that trash can")[0] == m.features("the trash cans.")[0] == m.features("a garbage collector")[0] == 0
    assert m.features("that trash candidate")[0] > 0 and m.features("trash cannot")[0] > 0


def test_many_exceptions_take_time_in_proportion():
    m = toxicity.Matcher(toxicity.Model())
    began = time.time()
    assert m.features("trash can " * 60_000)[0] == 0
    assert time.time() - began < 10
