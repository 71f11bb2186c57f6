"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, letters of other scripts that look Latin
(homoglyphs) to Latin, and the digits and signs that stand for letters
(``1d10t``) to those letters. Lexicon entries are beginnings of words; of the
entries that begin one word the longest counts. Matches that begin inside
exception phrases (whole words, unless marked as a beginning) do not count. A document's matched weight is set against its length,
and a logistic function of (weight, weight per 100 words, heaviest entry)
gives the score.

Training: a fixed list of English insults starts the lexicon; the rest is
learned from labelled documents as log-odds of the share of toxic and of clean
documents that hold a beginning. At most ``max_labelled`` labelled documents
are used, those with the least hash of their id, and of documents that share
their least shingle hash (copies and near copies) one. The lexicon for the
calibration is learned on one part of them and the logistic function on
another, so that chance entries do not look perfect; the final lexicon uses
both. Rows whose crc32(doc_id as text) mod 4 is 2 never train.

Scoring is one pass without a shuffle; a task holds one Arrow batch, and the
model (some thousand entries) goes along with the function.

Defined cases: null and empty texts have no matches and get the score of a
text of no weight; null ids are scored and count as not held out; labels that
repeat an id count as their largest; null labels are ignored; without any
labels the starting lexicon and fixed coefficients are used; no documents give
no rows. Columns other than doc_id and text pass through ``clean_documents``,
whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.llm.common import Scratch, bounded_batches, read

MAX_LABELLED, THRESHOLD = 20_000, 0.3
SHORTEST, LONGEST = 3, 10
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS, SEED_WEIGHT = 0.005, 4, 3.0, 4.0

# Starting lexicon, exception phrases, look-alike letters, letter substitutes.
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "crap", "cretin", "cunt", "degenerate", "despicable", "dimwit", "disgusting", "douche", "dumbass",
    "filth", "fool", "fuck", "garbage", "hateful", "idiot", "imbecile", "jackass", "loathsome", "loser", "lowlife", "moron", "nitwit", "parasite",
    "pathetic", "retard", "scum", "shit", "sleaz", "slut", "stupid", "trash", "twat", "vermin", "whore", "worthless", "wretch",
)
# A phrase ends where a word ends, but for one with an asterisk, which is the beginning of a word.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bins", "trash collect*", "garbage collect*", "garbage can", "garbage cans", "class clown", "class clowns", "clown fish",
    "clownfish", "fool proof", "foolproof", "moronga*", "host parasite", "host parasites",
)
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ɑ": "a", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {c: "" for c in "​‌‍­⁠"})
_WORD = regex.compile(r"\p{L}+")


def fold(text: str | None) -> str:
    return (text or "").lower().translate(_FOLD)


@dataclass
class Model:
    """weights: entry -> weight; coef: intercept and one number per feature."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEEDS, SEED_WEIGHT))
    coef: tuple[float, ...] = (-4.0, 1.0, 1.0, 0.5)
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, model: Model):
        self.model, self.automaton = model, ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (len(entry), weight, False))
        for phrase in model.exceptions:
            bare = phrase.removesuffix("*")
            self.automaton.add_word(bare, (len(bare), None, bare == phrase))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> tuple[dict[int, tuple[int, float]], int]:
        """start -> (end, weight) in the folded text, and its number of words."""
        folded = fold(text)
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight, whole) in self.automaton.iter(folded) if self.model.weights else ():
            start = last + 1 - size
            if (start and folded[start - 1].isalpha()) or (whole and folded[last + 1 : last + 2].isalpha()):
                continue
            if weight is None:
                spared.append((start, last + 1))
            elif start not in found or found[start][0] < last + 1:
                found[start] = (last + 1, weight)
        if spared:
            spared.sort()
            starts, ends = [lo for lo, _ in spared], list(accumulate((hi for _, hi in spared), max))
            found = {s: x for s, x in found.items() if (k := bisect_right(starts, s)) == 0 or ends[k - 1] <= s}
        return found, len(folded.split())

    def features(self, text: str | None) -> tuple[float, float, float]:
        found, words = self.matches(text)
        weights = [w for _, w in found.values()]
        total = sum(weights)
        return math.log1p(total), math.log1p(100 * total / max(words, 1)), max(weights, default=0.0)

    def score(self, text: str | None) -> float:
        z = self.model.coef[0] + sum(c * x for c, x in zip(self.model.coef[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _beginnings(text: str | None) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return {w[:n] for w in words for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def _bucket(text: str | None) -> int:
    """The least hash of four words in a row: near copies mostly share it."""
    words = fold(text).split()
    return min((xxhash.xxh64_intdigest(" ".join(words[k : k + 4])) >> 1 for k in range(max(1, len(words) - 3))))


def _bucketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "part": b["part"], "text": b["text"], "bucket": [_bucket(t) for t in b["text"]]})


def _counter(only: set[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for part, text in zip(b["part"], b["text"], strict=True):
                found = _beginnings(text)
                counts.update((e, part) for e in (found if only is None else found & only))
        yield pd.DataFrame([(e, p, n) for (e, p), n in counts.items()], columns=["entry", "part", "n"])

    return run


def _featured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)
        for b in batches:
            yield pd.DataFrame([(t, *matcher.features(x)) for t, x in zip(b["toxic"], b["text"], strict=True)], columns=["toxic", "a", "b", "c"])

    return run


def _lexicon(toxic: dict, clean: dict, n_toxic: int, n_clean: int) -> dict[str, float]:
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_toxic))
    odds = {e: math.log((toxic.get(e, 0) + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1)) for e in {*toxic, *SEEDS}}
    longer = Counter()  # by beginning: the most documents that one more letter keeps
    for e, n in toxic.items():
        longer[e[:-1]] = max(longer[e[:-1]], n)
    chosen = {e: odds[e] for e, n in toxic.items() if n >= least and odds[e] >= LEAST_ODDS and longer[e] < 0.9 * n}
    seeds = {e: max(SEED_WEIGHT, odds[e]) for e in SEEDS if clean.get(e, 0) < 5 or odds[e] >= LEAST_ODDS}
    return chosen | seeds


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Newton's method; the ridge spares the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 2))
    share = min(1.0, 1.1 * max_labelled / max(known.count(), 1))  # so that tasks send little more than the limit to be ranked
    known = known.where(F.col("h") <= int(share * (1 << 62))).orderBy("h", "doc_id").limit(max_labelled).drop("h")
    part = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 3, 1).otherwise(0)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", part.alias("part"), "text")
    sample = sample.mapInPandas(_bucketed, "doc_id long, toxic int, part int, text string, bucket long")
    sample = scratch.write(sample)
    firsts = sample.groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    sample = scratch.write(sample.join(F.broadcast(firsts), ["bucket", "doc_id"], "left_semi"))
    rows = {(r["toxic"], r["part"]): r["n"] for r in sample.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = ([rows.get((k, p), 0) for p in (0, 1)] for k in (1, 0))
    if not sum(n_toxic) or not sum(n_clean):
        return Model()

    def counted(kind: int, only: set[str] | None, least: int) -> list[dict[str, int]]:
        counts = sample.where(F.col("toxic") == kind).mapInPandas(_counter(only), "entry string, part int, n long")
        both = counts.groupBy("entry").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("part") == 0, F.col("n"))).alias("first"))
        got = both.where(F.col("n") >= least).collect()  # at most the beginnings of a bounded sample that reach a share of it
        return [{r["entry"]: r["first"] or 0 for r in got}, {r["entry"]: r["n"] for r in got}]

    toxic = counted(1, None, max(LEAST_DOCS, math.ceil(LEAST_SHARE * sum(n_toxic))))
    clean = counted(0, {*toxic[1], *SEEDS}, 1)
    trial = Model(_lexicon(toxic[0], clean[0], n_toxic[0], n_clean[0]))
    held = sample.where(F.col("part") == 1).mapInPandas(_featured(trial), "toxic int, a double, b double, c double").toPandas()
    coef = Model().coef
    if held["toxic"].nunique() == 2:
        coef = _logistic(held[["a", "b", "c"]].to_numpy(), held["toxic"].to_numpy(float))
    return Model(_lexicon(toxic[1], clean[1], sum(n_toxic), sum(n_clean)), coef)


def score_of(text: Column, model: Model) -> Column:
    """The score of a text; only texts go to Python."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model)
        for texts in batches:
            yield pd.Series([matcher.score(t) for t in texts], dtype="float64")

    return run(text)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs under the threshold, with their own columns."""
    bounded_batches(docs.sparkSession)
    return docs.where(score_of(docs["text"], model) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scores(docs, train(docs, read(spark, sf_dir, "labels")))
