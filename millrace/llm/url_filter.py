"""URL filters: rules by host and path, then a trained method.

Host names are segmented into words: a unigram Viterbi search over each label
of the host picks the split of highest probability under word counts of the
corpus (unknown pieces pay for every character). Multinomial naive Bayes
scores the host words and path words against two classes.

Training: word counts come from all pages' html (markup stripped) plus the
word list of the seeds. No page is labelled, so examples come from two weak
signs: ``TEXT_MARKS`` different marks (words of unwanted trades) in the page's
own text, or a mark among the words of its host. Every other page is an allow
example (rules tell where a page is, not what it is, and train nothing). A page is never judged
by its own example: hosts fall in two halves by a hash, and the tokens of a half
are weighed by the counts of the other. What a mark itself tells is a prior
(``PRIOR``), counted as block examples, so that a host with a mark that no other
host has is judged by the prior and by whatever else its url shares with
examples on other hosts; ``held_out`` compares the verdicts
of the method with the examples that it has not seen.

Words and tokens are counted whole and stay tables: the candidate substrings of
the distinct hosts are looked up among the words, and the tokens of urls among
the tokens. Keys that make up a large share of the rows of a look-up (at most
``HOT`` by construction) are broadcast, the others are joined by key.

Rules are ``host/path``: a rule fits its host and all subdomains if the path of
the url starts with the rule's path (which begins with ``/``); the longest
rule that fits decides, else the method.

Counts combine per task. Html is scanned once and not shuffled. Odds are summed
in fixed point, so that a score does not depend on the order of rows.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule and no tokens: the method allows it; null html gives no words; ports and
user names stay part of the host, as the contract has it; rows that repeat are
all kept; a null page_id stays null; other columns are not read; no pages give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.llm.common import Scratch, ascii_lower, bounded_batches, read

LONGEST_WORD, HOT, UNIT, CHUNK = 24, 1024, 1 << 32, 100_000
#: Marks in a page's text that make it an example.
TEXT_MARKS = 3
#: Before any page is read: each mark as a token of block examples (a share of all tokens, so many at least), and block examples as a share of pages.
PRIOR, LEAST_PRIOR, PRIOR_PAGES = 0.0005, 5.0, 0.01

# Rules of the query, seed words.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SEEDS = (
    "adult", "bet", "betting", "casino", "cheap", "escort", "farm", "hack", "loan", "loans", "pharma", "pill", "pills", "poker", "porn", "replica",
    "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
#: Seeds that speak for themselves; the others only help to split names.
MARKS = frozenset(SEEDS) - {"farm", "adult", "hack", "loan", "loans"}

_LABEL = regex.compile(r"[\p{L}]+|\d+")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


@dataclass
class Segmenter:
    """costs: word -> -log probability."""

    costs: dict[str, float]
    unknown: float

    @classmethod
    def of(cls, counts: dict[str, int], total: int | None = None) -> Segmenter:
        """counts: of all words, or of those that can occur, with the total of all."""
        total = sum(counts.values()) + 1 if total is None else total
        return cls({w: -math.log(n / total) for w, n in counts.items()}, math.log(total) + 2.0)

    def split(self, name: str) -> list[str]:
        """The words of one run of letters, by the cheapest path."""
        best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST_WORD), end):
                word = name[start:end]
                cost = self.costs.get(word)
                if cost is None:  # an unknown piece: dearer than any word, and more for each letter
                    cost = self.unknown + 2.3 * len(word)
                if best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


@dataclass
class Model:
    words: DataFrame  # word, n
    floor: int  # what each seed has besides
    total: int
    tokens: DataFrame  # token, odds_0, odds_1: log P(token | block) - log P(token | allow) in UNITs, for hosts of either half
    prior: tuple[float, float]
    pages: DataFrame  # of the training
    rows: DataFrame  # their tokens


def looked_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with the columns of found, which holds every key of rows once, with its number of rows as uses."""
    least = (found.agg(F.sum("uses")).first()[0] or 0) // HOT
    hot = found.where(F.col("uses") > least).withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.where("__hot is null").select(rows.columns).join(found.where(F.col("uses") <= least), key)
    return met.where("__hot").select(rest.columns).union(rest)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for b in batches:
        for host in b["host"]:
            runs = [r for r in _LABEL.findall(host) if not r[0].isdigit()]
            rows += [(host, x) for x in {r[i:k] for r in runs for i in range(len(r)) for k in range(i + 1, min(len(r), i + LONGEST_WORD) + 1)}]
            if len(rows) > CHUNK:
                yield pd.DataFrame(rows, columns=["host", "piece"])
                rows = []
    yield pd.DataFrame(rows, columns=["host", "piece"])


def segmented(hosts: DataFrame, words: DataFrame, floor: int, total: int, scratch: Scratch) -> DataFrame:
    """hosts (host, uses) with words (array) and marked, by the counts of those words that occur in them."""
    pieces = scratch.write(hosts.select("host").mapInPandas(_pieces, "host string, piece string"))
    uses = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    found = scratch.write(uses.join(words.withColumnRenamed("word", "piece"), "piece", "left"))
    known = looked_up(pieces, "piece", found).where("n is not null").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("piece", "n"))).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = []
            for host, known in zip(b["host"], b["known"], strict=True):
                n = dict(known) if known is not None else {}
                segmenter = Segmenter.of(n | {s: n.get(s, 0) + floor for s in SEEDS}, total)
                split.append([w for r in _LABEL.findall(host) for w in (["#"] if r[0].isdigit() else segmenter.split(r))])
            yield pd.DataFrame({"host": b["host"], "uses": b["uses"], "words": split, "marked": [not MARKS.isdisjoint(w) for w in split]})

    joined = hosts.join(known, "host", "left").select("host", "uses", "known")
    return scratch.write(joined.mapInPandas(run, "host string, uses long, words array<string>, marked boolean"))


@F.pandas_udf(ArrayType(StringType()))
def page_tokens(words: pd.Series, path: pd.Series) -> pd.Series:
    out = []
    for w, p in zip(words, path, strict=True):
        out.append([f"h:{x}" for x in w] + ["p:#" if x[0].isdigit() else f"p:{x}" for x in _LABEL.findall(p.lower())])
    return pd.Series(out)


def plain_words(html: Column) -> Column:
    """The words of a page's own text, in lower case, without markup."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return F.split(F.lower(plain), r"[^\p{L}]+")


def half_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(2)).cast("int")


def tokenised(pages: DataFrame, words: DataFrame, floor: int, total: int, scratch: Scratch) -> DataFrame:
    """row, page_id, host, path, half, words, block (whether the signs make it a block example), tokens of every row of pages."""
    said = F.size(F.array_intersect(plain_words(F.col("html")), F.array(*map(F.lit, sorted(MARKS))))) >= TEXT_MARKS
    url = F.col("url")
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), said.alias("said"))
    urls = urls.withColumn("half", half_of(F.col("host")))
    urls = scratch.write(urls)  # fixes the row numbers
    hosts = scratch.write(urls.groupBy("host").agg(F.count(F.lit(1)).alias("uses")))
    rows = looked_up(urls, "host", segmented(hosts, words, floor, total, scratch)).drop("uses")
    rows = rows.withColumn("block", F.col("said") | F.col("marked")).drop("said", "marked")
    return scratch.write(rows.withColumn("tokens", page_tokens("words", "path")))


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over all html, without markup."""
    return pages.select(F.explode_outer(plain_words(F.col("html"))).alias("word")).where(F.char_length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train(pages: DataFrame) -> Model:
    bounded_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "urls")
    words = scratch.write(word_counts(pages))
    n = words.agg(F.sum("n")).first()[0] or 0
    floor = max(1, n // 1000)  # seeds are words in any corpus
    total = n + floor * len(SEEDS) + 1
    rows = tokenised(pages, words, floor, total, scratch)
    block = F.col("block").cast("long")
    own = [F.coalesce(F.sum(F.when(F.col("half") == h, c)), F.lit(0)).alias(f"{k}{h}") for h in (0, 1) for k, c in (("b", block), ("a", 1 - block))]
    tokens = scratch.write(rows.select("half", "block", F.explode("tokens").alias("token")).groupBy("token").agg(*own))
    v, *sums = tokens.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("b0", "a0", "b1", "a1")]).first()
    of = dict(zip(("b0", "a0", "b1", "a1"), sums, strict=True))
    mark = F.col("token").isin([f"{k}:{m}" for k in "hp" for m in sorted(MARKS)])
    odds, prior = [], []
    pages_of = {(r["half"], r["block"]): r["count"] for r in rows.groupBy("half", "block").count().collect()}
    for half in (0, 1):
        other = 1 - half
        most = max(LEAST_PRIOR, PRIOR * (of[f"b{other}"] + of[f"a{other}"]))
        b, a = (of[f"{k}{other}"] + 0.1 * v for k in "ba")
        apart = math.log(a / (b + 2 * len(MARKS) * most)) if v else 0.0
        seen = F.log(F.col(f"b{other}") + 0.1 + F.when(mark, most).otherwise(0.0)) - F.log(F.col(f"a{other}") + 0.1)
        odds.append(F.round((seen + apart) * UNIT).cast("long").alias(f"odds_{half}"))
        b, a = (pages_of.get((other, c), 0) for c in (True, False))
        prior.append(math.log((b + PRIOR_PAGES * (a + b) + 0.5) / (a + 0.5)))
    return Model(words, floor, total, tokens.select("token", *odds), tuple(prior), pages, rows)


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block by the method), words, example of every row of pages."""
    bounded_batches(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "urls")
    rows = model.rows if pages is model.pages else tokenised(pages, model.words, model.floor, model.total, scratch)
    seen = rows.select("row", "half", F.explode("tokens").alias("token"))
    uses = seen.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    found = scratch.write(uses.join(model.tokens, "token", "left"))  # tokens not seen in the training tell nothing
    odds = F.when(F.col("half") == 0, F.col("odds_0")).otherwise(F.col("odds_1"))
    sums = looked_up(seen, "token", found).groupBy("row").agg(F.coalesce(F.sum(odds), F.lit(0)).alias("odds"))
    prior = F.when(F.col("half") == 0, F.lit(model.prior[0])).otherwise(F.lit(model.prior[1]))
    # a page without tokens is an allow page
    score = F.when(F.size("tokens") > 0, F.col("odds") / F.lit(float(UNIT)) + prior).otherwise(F.lit(-math.inf))
    scored = rows.join(sums, "row", "left").select(
        "page_id", "host", "path", score.alias("score"), F.array_join("words", " ").alias("words"), F.when(F.col("block"), "block").otherwise("allow").alias("example")
    )
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.withColumn("rule", rule).withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "score", "words", "example")


def held_out(judged: DataFrame) -> dict[tuple[str, str], int]:
    """(example, verdict of the method) -> pages, of the pages that no rule judges; their examples did not train their scores."""
    by = judged.where("rule is null").groupBy("example", F.when(F.col("score") > 0, "block").otherwise("allow").alias("by_score")).count().collect()
    return {(r["example"], r["by_score"]): r["count"] for r in by}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, train(pages))
