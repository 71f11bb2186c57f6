"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hex runs. The method adds
strings that no pattern names: a candidate (letters and digits mixed, 16
characters or more, of any length) in a sensitive context is compressed with
the text around it, by a zstandard compressor primed with a dictionary of the
corpus' most frequent identifiers and words. Its novelty is the marginal cost:
compressed bytes of context and candidate less those of the context, per
character. Names and repeated strings compress to little; random strings do
not. A long candidate is compressed in even pieces of at most ``PIECE``
characters, and reported whole if one of them is novel.

The context is sensitive if a word such as key, token or password stands
shortly before the candidate in its line, or in the header of the block it
opens, or if the line before ends in a candidate in sensitive context. The last
line of a block is a candidate whatever its length; it counts with the line
before, as it is too short to be measured.

The dictionary holds up to ``DICTIONARY_WORDS`` most frequent words of four to 40
characters over all documents (a documented bound of the model; counts cover
every document and combine per task). The scan itself is one pass without a
shuffle; texts are read whole.

Defined cases: a null text is empty; offsets count code points, ends are
exclusive; per kind matches are leftmost and do not overlap, and those too
short are dropped; spans of the method (kind ``novel``) never overlap a base
span; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bounded_batches, most_frequent, read

# Patterns and kinds.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "novel")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|private|signature)[^\n]{0,40}$", re.ASCII)
#: The header of a block, with lines of fields, right before its first line; HEADER is how far it is looked for.
BLOCK = re.compile(r"(?i)-----BEGIN [^\n]*(?:key|token|secret|passw|pwd|auth|credential|bearer|private|signature)[^\n]*\n(?:[A-Za-z-]+:[^\n]*\n|[\x20\t]+[^\x20\t\n][^\n]*\n)*\s*$", re.ASCII)
#: What stands between two lines of one secret: a line end, also an escaped one, quotes, joining signs and indentation.
NEXT_LINE = re.compile(r"[\"',;+.\x20\t]*(?:\\?\r?\n[\"'+#*>|\x20\t]*|\\)", re.ASCII)
LAST_LINE = re.compile(r"\s*\n[\x20\t]*([A-Za-z0-9+/_=]{1,15})(?=\s*\n[\x20\t]*(?:=[A-Za-z0-9+/]{4}\s*\n[\x20\t]*)?-----END )", re.ASCII)
DICTIONARY_WORDS, AROUND, LEVEL, PIECE, HEADER = 4096, 200, 3, 512, 600
#: Marginal compressed bytes per character from which a candidate is reported: hex costs 0.5, base64 0.75.
NOVELTY = 0.45

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _mixed(word: str) -> bool:
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    return digits >= 2 and letters >= 2


class Novelty:
    def __init__(self, words: list[str]):
        # the compressor reaches the end of the dictionary most cheaply, so the most frequent words come last
        content = "\n".join(reversed(words)).encode() or b"\n"
        # raw content, whatever it is
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """The most novel of the pieces of a span."""
        n = -(-(end - start) // PIECE)
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        return max(self._piece(text, s, e) for s, e in zip(cuts, cuts[1:], strict=False))

    def _piece(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        context = len(self.compressor.compress((before + after).encode("utf-8", "replace")))
        whole = len(self.compressor.compress((before + text[start:end] + after).encode("utf-8", "replace")))
        return (whole - context) / (end - start)


def novel_spans(text: str, taken: list[Span], novelty: Novelty) -> list[Span]:
    """Spans of the method beside the base spans."""
    found = []
    taken = sorted(taken, key=lambda x: x[1])
    at, last, carried = 0, -1, False  # first base span that can meet a candidate; end of the candidate before, and whether its context is sensitive
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        carried = carried and NEXT_LINE.fullmatch(text, last, s) is not None
        context = carried or SENSITIVE.search(text, max(0, s - 60), s) is not None or BLOCK.search(text, max(0, s - HEADER), s) is not None
        while at < len(taken) and taken[at][2] <= s and taken[at][1] < s:
            at += 1
        met, k = [], at
        while k < len(taken) and taken[k][1] < e:
            kind, lo, hi = taken[k]
            met += [(lo, hi, kind)] if s < hi else []
            k += 1
        last, carried = e, context or any(k != "hex" for _, _, k in met)
        if not context:
            continue
        for lo, hi in _beside(s, e, met):
            if hi - lo >= 16 and _mixed(text[lo:hi]) and novelty(text, lo, hi) >= NOVELTY:
                found.append(("novel", lo, hi))
        if found and found[-1][2] == e and (tail := LAST_LINE.match(text, e)) and not _meets(taken, at, *tail.span(1)):
            found.append(("novel", *tail.span(1)))
    return found


def _meets(taken: list[Span], at: int, start: int, end: int) -> bool:
    """Whether a base span, from number ``at`` on, covers a part of start to end."""
    while at < len(taken) and taken[at][1] < end:
        if start < taken[at][2]:
            return True
        at += 1
    return False


def _beside(start: int, end: int, met: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a span that no base span covers."""
    out = []
    for lo, hi, _ in met:
        out.append((start, lo))
        start = max(start, hi)
    return [x for x in [*out, (start, end)] if x[0] < x[1]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def frequent_words(docs: DataFrame, n: int = DICTIONARY_WORDS) -> list[str]:
    """The n most frequent words of all documents (see ``most_frequent``), the most frequent first. Strings that could be candidates stay out, however often they are copied."""
    words = F.split(F.coalesce(F.col("text"), F.lit("")), r"[^A-Za-z0-9_]+")
    counts = docs.select(F.explode_outer(words).alias("word")).where(F.length("word").between(4, 40))
    like_a_secret = (F.length("word") >= 16) & F.col("word").rlike("[0-9].*[0-9]") & F.col("word").rlike("[A-Za-z].*[A-Za-z]")
    counts = counts.where(~like_a_secret).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in most_frequent(counts.where("n > 1"), n, Scratch(docs.sparkSession, "words"))]


def scan(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(words)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty)
                n = Counter(k for k, _, _ in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc_id, n["assign"], n["access"], n["hex"], len(more), digest, joined(base + more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    schema = "doc_id string, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))  # pandas has no whole numbers beside nulls


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, frequent_words(docs))
