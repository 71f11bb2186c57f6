"""Line dedup: winnowing over line hashes, and deletion of later repeated runs.

A window is the shortest run of lines from a line on that has ``min_words``
words (one line, if it is that long). Each window selects the position of its
least line hash (of equal ones the one selected before, else the last), and a
document keeps its selected positions only: about two of w + 1 lines, if a
window has w. A passage of min_words words or more that two documents share
line by line holds a whole window in both, so both select an equal line of it:
fingerprints are guaranteed.

1. A document's selected positions leave Python with the hashes of the lines
   around them, as far as their windows and the extension can reach.
2. Positions meet by fingerprint, the hash of the selected line: those whose
   fingerprint is selected nowhere else drop out. So most of a text without
   copies ends here.
3. So that a common line does not tie a passage to some other text where that
   line came first, positions that met are told apart by a hash of each window
   that selects them. Of the positions with equal windows the first in order of
   doc_id stands, and each later one is compared with that one.
4. The match is extended line by line, to the left and to the right, while both
   documents go on alike, up to min_words words on either side (what lies
   beyond is a match of further windows). Those that go on otherwise than the
   first meet each other by hashes of the lines that follow, with the first
   position of each continuation and never in pairs, so a match ends where no
   earlier position goes on alike.

The later run is deleted. A run that overlaps its own first occurrence, in one
document, loses only what lies behind the first.

Rows shuffled are selected positions (once, against the fingerprints that are
repeated) and the windows of those that met, once to find the firsts with
map-side combine and once to join them, where adaptive execution splits a hot
fingerprint or window; continuations that leave the first likewise. Texts are
not shuffled. A document is read in time proportional to its lines times the
lines of a window, at most min_words.

Defined cases: a null text has no lines; blank lines match nothing and go only
if they lie inside a deleted run; white space at line ends does not count;
documents that repeat an id with another text are kept apart by a hash of the
text, and with the same text they are one document; a null id comes first; no
documents give no rows; columns other than doc_id and text pass through
``without_repeats``, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, Shielded, bounded_batches, read

MIN_WORDS, CHUNK = 50, 500_000


def lines_of(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of the lines that are not blank; offsets in code points, end after the line end."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        after = at + len(line) + 1
        words = len(line.split())
        if words:
            out.append((at, min(after, len(text)), words, xxhash.xxh64_intdigest(line.strip()) - (1 << 63)))
        at = after
    return out


def windows_of(lines: list[tuple[int, int, int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """(first line, last line, selected line) of every window."""
    out, end, words, kept = [], 0, 0, -1
    least: deque[int] = deque()  # lines of the window that are less than all behind them
    for start in range(len(lines)):
        while end < len(lines) and words < min_words:
            while least and lines[least[-1]][3] >= lines[end][3]:
                least.pop()
            least.append(end)
            words += lines[end][2]
            end += 1
        if words < min_words:
            break
        while least[0] < start:
            least.popleft()
        if kept < start or lines[kept][3] != lines[least[0]][3]:
            kept = least[0]
        out.append((start, end - 1, kept))
        words -= lines[start][2]
    return out


def selected(lines: list[tuple[int, int, int, int]], min_words: int) -> Iterator[tuple[int, int, list[int], list[tuple[int, int]]]]:
    """(position, first line of the context, line hashes of the context, windows that select the position) of each selected position."""
    at: dict[int, list[tuple[int, int]]] = {}
    for first, last, position in windows_of(lines, min_words):
        at.setdefault(position, []).append((first, last))
    for position, windows in at.items():
        lo, hi = windows[0][0], windows[-1][1] + 1
        words = 0
        while lo and words < min_words:
            lo -= 1
            words += lines[lo][2]
        words = 0
        while hi < len(lines) and words < min_words:
            words += lines[hi][2]
            hi += 1
        yield position, lo, [x[3] for x in lines[lo:hi]], windows


def _positions(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "text_hash", "fingerprint", "lo", "context", "firsts", "lasts"]
        for b in batches:
            rows, held = [], 0
            for doc_id, text_hash, text in zip(b["doc_id"], b["text_hash"], b["text"], strict=True):
                for position, lo, context, windows in selected(lines_of(text), min_words):
                    rows.append((doc_id, text_hash, context[position - lo], lo, context, [w[0] for w in windows], [w[1] for w in windows]))
                    held += len(context)
                    if held > CHUNK:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return run


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [lines_of(t) for t in b["text"]]
        yield pd.DataFrame({
            "doc_id": b["doc_id"], "text_hash": b["text_hash"],
            "starts": [[x[0] for x in y] for y in found], "ends": [[x[1] for x in y] for y in found],
        })


def _spans(starts, ends, runs) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the merged deleted runs."""
    out: list[tuple[int, int, int]] = []
    reach = -1
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        lo = max(lo, reach + 1)
        if lo > hi:
            continue
        if out and lo == reach + 1:
            out[-1] = (out[-1][0], int(ends[hi]), out[-1][2] + hi - lo + 1)
        else:
            out.append((int(starts[lo]), int(ends[hi]), hi - lo + 1))
        reach = hi
    return out


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text_hash, starts, ends, runs in zip(b["doc_id"], b["text_hash"], b["starts"], b["ends"], b["runs"], strict=True):
            spans = _spans(starts, ends, runs if runs is not None else ())
            rows.append((doc_id, text_hash, len(starts), sum(x[2] for x in spans), sum(x[1] - x[0] for x in spans), ",".join(f"{x[0]}:{x[1]}" for x in spans)))
        columns = ["doc_id", "text_hash", "n_lines", "n_removed", "removed_chars", "spans"]
        yield pd.DataFrame(rows, columns=columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id as a string while in Python, as pandas has no whole numbers beside nulls."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "text")


def _alike(own: str, other: str) -> Column:
    """How many lines two arrays of line hashes have in common from the beginning."""
    differs = F.array_position(F.zip_with(own, other, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(own)).otherwise(differs - 1).cast("int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, lo, hi: runs of lines (numbered without blank ones) that repeat an earlier run."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lines")
    schema = "doc_id string, text_hash long, fingerprint long, lo int, context array<long>, firsts array<int>, lasts array<int>"
    chosen = scratch.write(_keyed(docs).mapInPandas(_positions(min_words), schema).withColumn("doc_id", F.col("doc_id").cast("long")))
    repeated = chosen.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint")
    met = chosen.join(repeated, "fingerprint", "left_semi").withColumn("w", F.explode(F.arrays_zip("firsts", "lasts")))
    first, last, n = F.col("w.firsts"), F.col("w.lasts"), F.size("context")
    met = met.select(
        "doc_id", "text_hash", "fingerprint", F.xxhash64(F.slice("context", first - F.col("lo") + 1, last - first + 1)).alias("window"), first.alias("first"), last.alias("last"),
        F.reverse(F.slice("context", F.lit(1), first - F.col("lo"))).alias("lead"), F.slice("context", last - F.col("lo") + 2, n - (last - F.col("lo") + 1)).alias("tail"),
    )
    seen = scratch.write(met)
    scratch.drop(chosen)
    place = F.struct("doc_id", "text_hash", "first", "last", "lead", "tail")
    firsts = seen.groupBy("fingerprint", "window").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same_doc = F.col("doc_id").eqNullSafe(F.col("at.doc_id")) & (F.col("text_hash") == F.col("at.text_hash"))
    later = seen.join(firsts, ["fingerprint", "window"]).where(~(same_doc & (F.col("first") == F.col("at.first"))))
    left = F.when(same_doc, F.least(_alike("lead", "at.lead"), F.greatest(F.col("first") - F.col("at.last") - 1, F.lit(0)))).otherwise(_alike("lead", "at.lead"))
    own = F.when(same_doc, F.greatest("first", F.col("at.last") + 1)).otherwise(F.col("first")) - left
    later = later.select("doc_id", "text_hash", "fingerprint", "window", "first", "last", "tail", own.alias("lo"), _alike("tail", "at.tail").alias("more"))
    later = scratch.write(later)
    longer = _continued(later).select("doc_id", "text_hash", "lo", (F.col("last") + F.col("k")).alias("hi"))
    runs = later.select("doc_id", "text_hash", "lo", (F.col("last") + F.col("more")).alias("hi")).union(longer)
    return runs.where(F.col("lo") <= F.col("hi")).distinct()


def _continued(later: DataFrame) -> DataFrame:
    """later, with k: lines after the window that repeat an earlier position which, like this one, left the first after ``more`` lines.

    Two positions that left the first at different lines part where the sooner one left it, so they never share a longer continuation.
    """
    prefixes = F.transform(F.sequence(F.col("more") + 1, F.size("tail")), lambda k: F.struct(k.alias("k"), F.xxhash64(F.slice("tail", 1, k)).alias("prefix")))
    place = ["doc_id", "text_hash", "first"]
    left = later.where(F.size("tail") > F.col("more")).select("fingerprint", "window", *place, "lo", "last", F.inline(prefixes))
    firsts = left.groupBy("fingerprint", "window", "k", "prefix").agg(F.min(F.struct(*place)).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = left.join(firsts, ["fingerprint", "window", "k", "prefix"]).where(~F.struct(*place).eqNullSafe(F.col("at")))
    return met.groupBy(*place, "lo", "last").agg(F.max("k").cast("int").alias("k"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_removed, removed_chars, spans (start:end in code points, comma-joined) of every row of docs."""
    runs = repeated_runs(docs, min_words).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    runs = runs.agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    rows = _keyed(docs).mapInPandas(_places, "doc_id string, text_hash long, starts array<int>, ends array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))
    met = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    schema = "doc_id string, text_hash long, n_lines long, n_removed long, removed_chars long, spans string"
    joined = rows.join(runs, met, "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "starts", "ends", "runs")
    return joined.mapInPandas(_listed, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated runs cut out of text; other columns and rows stay."""
    cut = repeats(docs, min_words).where("n_removed > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    cut, held = Scratch(docs.sparkSession, "line-cuts").write(cut.distinct()), Shielded(docs)
    whole = held["text"]
    joined = held.rows.join(cut, held["doc_id"].eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(whole, F.lit(""))) == F.col("hash")), "left")
    ends = F.transform(F.split("spans", ","), lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("lo"), F.split(s, ":")[1].cast("int").alias("hi")))
    kept = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda a, s: F.struct(s["hi"].alias("at"), F.concat(a["text"], F.substr(whole, a["at"] + 1, s["lo"] - a["at"])).alias("text")),
    )
    rest = F.concat(kept["text"], F.substr(whole, kept["at"] + 1))
    return held.back(joined, text=F.when(F.col("spans").isNull(), whole).otherwise(rest))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents")).drop("text_hash")
