"""Benchmark decontamination: a prefix-filtered set join with exact verification.

A window is ``window`` consecutive words of a benchmark item (a shorter item
is one window). Windows and documents are sets of positioned shingles of three
words. Containment of a whole window needs every shingle of it, so a prefix of
one shingle is enough to find it, and the best prefix is its rarest shingle
over all documents:

1. benchmark shingles are counted over the whole corpus (every document
   position is hashed; only positions that hit the benchmark's vocabulary
   leave the scan, and counts combine map-side);
2. per window the rarest shingle is its prefix; adjacent windows mostly share
   theirs, so an item keeps few (windows with an unseen shingle keep none);
3. document positions meet prefixes by hash. Length and positional bounds drop
   pairs whose overlap at those positions cannot reach the window;
4. the words left and right of the shingle are compared one by one, item
   against document, up to a window's reach. A run of equal words at least as
   long as the window marks all its words: each is inside an occurrence of
   some window, and every occurrence is found from its own prefix.

Steps 1 and 3 run inside one generated stage per scan; pairs that met leave it
with the words around them for step 4. With the comparison's code inside, the
stage's loop grows beyond 8,000 bytes, which HotSpot never compiles. Nothing of
a document is shuffled but its runs. The benchmark side is counted and then
broadcast in blocks, by hashes of its rows: ``VOCABULARY`` different shingles or
``PREFIXES`` prefixes with the words around them, however its items are made
up; a larger benchmark takes more scans. Runs of a document are gathered per
document only.

Defined cases: null texts have no words; items without words or id match
nothing; equal item rows count once; documents that repeat an id with another
text are kept apart by a hash of the text; empty tables give no hits; columns
other than doc_id and text pass through ``clean_documents``, whatever their
names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import Scratch, Shielded, ascii_lower, read

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Rows of a broadcast: eight bytes each, or up to twenty words each.
VOCABULARY, PREFIXES = 1_000_000, 100_000


def words_of(text: Column) -> Column:
    """The words, with an empty string before or after where a text begins or ends with other characters.

    Splitting takes less than half the time of extracting words, and an empty string equals no word of an item.
    """
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)


def count_of(words: Column) -> Column:
    first, last = F.get(words, F.lit(0)) == "", (F.size(words) > 1) & (F.get(words, F.size(words) - 1) == "")
    return (F.size(words) - first.cast("int") - last.cast("int")).cast("long")


def _shingle(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)])


def _positions(words: DataFrame, n: int) -> DataFrame:
    """One row per shingle of n words: adds at and token (outer, as Spark would else add a filter that splits the text again)."""
    rows = words.select("*", F.posexplode_outer("words").alias("at", "word"))
    return rows.where(F.col("at") <= F.size("words") - n).withColumn("token", _shingle(F.col("words"), F.col("at"), n))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    words = F.array_remove(words_of(F.col("text")), "")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    items = items.where((F.size("words") > 0) & F.col("item_id").isNotNull()).distinct()
    return items.withColumn("need", F.least(F.size("words"), F.lit(window)))


def _blocks(table: DataFrame, rows: int, size: int) -> list[DataFrame]:
    """A table of so many rows in blocks of about size, by a hash of each whole row; rows differ."""
    n = max(1, math.ceil(rows / size))
    return [table.where(F.pmod(F.xxhash64(*table.columns), F.lit(n)) == k) if n > 1 else table for k in range(n)]


def _around(window: int) -> tuple[Column, Column]:
    """The words before position at, nearest first, and those from it on, up to a window's reach."""
    back = F.reverse(F.slice("words", F.greatest(F.col("at") - (window - 2), F.lit(1)), F.least(F.col("at"), F.lit(window - 1))))
    return F.when(F.col("at") > 0, back).otherwise(F.array().cast("array<string>")), F.slice("words", F.col("at") + 1, window)


def _prefixes(items: DataFrame, docs: DataFrame, n: int, window: int, scratch: Scratch, most: int) -> DataFrame:
    """The rarest shingle of each window, with the item's words around it."""
    spots = _positions(items, n)
    vocabulary = scratch.counted(spots.select("token").distinct())
    seen = _positions(docs.select(words_of(F.col("text")).alias("words")), n).select("token")
    counts = [seen.join(F.broadcast(b), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n_seen")) for b in _blocks(*vocabulary, most)]
    counts = reduce(DataFrame.unionAll, counts)
    rarity = F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "token", "at")
    reach = W.partitionBy("item_id", "words").orderBy("at").rowsBetween(0, window - n)
    firsts = (
        spots.join(counts, "token", "left")
        .withColumn("prefix", F.min(rarity).over(reach))
        .where((F.col("at") <= F.size("words") - F.col("need")) & (F.col("prefix.n_seen") > 0))
        .select("item_id", "words", "need", "prefix.token", F.col("prefix.at").alias("at"))
        .distinct()
    )
    before, after = _around(window)
    return firsts.select("item_id", "need", "token", before.alias("before"), after.alias("after"))


def _equal_run(words: Column, other: Column) -> Column:
    """How many first words of two lists are equal."""
    differs = F.array_position(F.zip_with(words, other, lambda a, b: F.coalesce(a == b, F.lit(False))), False).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.size(words))


def find_runs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, vocabulary: int = VOCABULARY, prefixes: int = PREFIXES) -> DataFrame:
    """doc_id, text_hash, item_id, start, end (words, end exclusive) of matched runs; docs: doc_id, text."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.write(_items(benchmark, window))
    shingles = [r[0] for r in items.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()]  # some of 1, 2, 3
    found = None
    for n in sorted(shingles):
        some = items.where(F.least(F.size("words"), F.lit(SHINGLE)) == n)
        for block in _blocks(*scratch.counted(_prefixes(some, docs, n, window, scratch, vocabulary)), prefixes):
            text = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("words"))
            bound = F.least(F.col("at"), F.size("before")) + F.least(F.size("words") - F.col("at"), F.size("after"))
            met = _positions(text, n).join(F.broadcast(block), "token").where(bound >= F.col("need"))
            left, right = (_equal_run(mine, F.col(theirs)) for mine, theirs in zip(_around(window), ("before", "after"), strict=True))
            # Generated, not selected: a filter on selected columns would move into the join, and their code with it.
            both = F.inline_outer(F.array(F.struct(left.alias("left"), right.alias("right"))))
            runs = met.select("doc_id", "text_hash", "item_id", "need", "at", both)
            runs = runs.where((F.col("left") + F.col("right") >= F.col("need")) & (F.col("right") > 0))
            runs = runs.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end"))
            found = runs if found is None else found.unionAll(runs)
    if found is None:
        found = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit("").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids, sorted as strings, comma-joined) and contaminated of every row of docs."""
    runs = find_runs(docs, benchmark, window)
    ordered = F.array_sort(F.collect_set(F.struct("start", "end")))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["end"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"),
        ),
    )["n"]
    items = F.array_sort(F.collect_set("item_id"))
    hits = runs.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(covered.alias("n_hit"), items.alias("items"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"), words_of(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "__h", count_of(F.col("w")).alias("n_words"))
    met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash"))
    none = F.array().cast("array<string>")
    return rows.join(hits, met, "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.array_join(F.coalesce("items", none), ",").alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence of a window, with their own columns."""
    runs = find_runs(docs, benchmark, window).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    held = Shielded(docs)
    met = held["doc_id"].eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(held["text"], F.lit(""))) == F.col("hash"))
    return held.back(held.rows.join(runs, met, "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[s + 1 : s + l], ' ') AS w
    FROM (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS s FROM i WHERE len(ws) > 0)),
spot AS (SELECT doc_id, l, p, array_to_string(ws[p + 1 : p + l], ' ') AS w
    FROM (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT l FROM win) WHERE len(ws) >= l)),
hit AS (SELECT doc_id, item_id, p, l FROM spot JOIN win USING (l, w)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
