"""Text functions as column expressions: extraction, normalisation, scoring.

Built-in expressions throughout; Python is used only where no built-in exists
(Unicode normalisation, balanced braces), as pandas functions over Arrow.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType


def _null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it. An expression that is named twice is computed twice, and in a chain of such steps ever more often."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def as_it_stands(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) as it stands, for what comes from Python, which may not stand beside a lambda."""
    return f(x)


# --- answers -----------------------------------------------------------------


# Fixed value: white space as Unicode text functions see it (also the four separators below the space).
_SPACES = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(text: Column) -> Column:
    """text without white space at its ends, line ends included."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{_SPACES}]+", ""), f"(?<![{_SPACES}])[{_SPACES}]+\\z", "")


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start and the first end behind it; null if one is missing. Linear in the text, whatever it repeats."""
    at = F.position(F.lit(start), text)
    upto = F.position(F.lit(end), text, at + len(start))
    return F.when((at > 0) & (upto > 0), F.substr(text, at + len(start), upto - at - len(start)))


def tagged_letter(text: Column, letters: str = "ABCD") -> Column:
    """The letter in the first <answer> tag that holds one alone, in either case; null if there is none."""
    return _null_if_empty(F.upper(F.regexp_extract(text, rf"(?i)<answer>[{_SPACES}]*+([{letters}])[{_SPACES}]*+</answer>", 1)))


def _after_final(text: Column) -> Column:
    """A or B right after the first "Final Answer:"; empty if something else stands there."""
    at = F.position(F.lit("Final Answer:"), text)
    return F.when(at > 0, F.regexp_extract(F.substr(text, at + 13), f"^[{_SPACES}]*([AB])", 1)).otherwise("")


def judge_letter(text: Column) -> Column:
    """First <answer> tag exactly A or B, else the first character after "Final Answer:"."""
    tag = strip(between(text, "<answer>", "</answer>"))
    return F.when(tag.isin("A", "B"), tag).otherwise(_null_if_empty(_after_final(text)))


# A letter alone near the end, and the phrases that announce one.
_ALONE = rf"(?:^|[{_SPACES}.:,;!?])(A|B)(?:[{_SPACES}.:,;!?]|$)"
_PHRASE = rf"(?i)(?:answer[{_SPACES}]+is|choose|选择|选)[{_SPACES}]*+:?[{_SPACES}]*+(A|B)"


def answer_with_confidence(text: Column) -> Column:
    """struct<answer, confidence, method> by a cascade from the tag to the last A or B of the text."""
    tag = strip(between(text, "<answer>", "</answer>"))
    tail = F.when(F.char_length(text) > 100, F.right(text, F.lit(100))).otherwise(text)
    steps = (
        ("answer_tag", 1.0, F.when(tag.isin("A", "B"), tag)),
        ("final_answer", 0.8, _after_final(text)),
        ("tail_standalone", 0.6, F.regexp_extract(tail, _ALONE, 1)),
        ("pattern_match", 0.5, F.upper(F.regexp_extract(text, _PHRASE, 1))),
        ("last_occurrence", 0.3, F.regexp_extract(text, r"(?s)^.*([AB])", 1)),
    )
    # each step is computed once and only where the ones before gave nothing
    found = F.coalesce(*[F.nullif(F.concat(answer, F.lit(str(k))), F.lit(str(k))) for k, (_, _, answer) in enumerate(steps)], F.lit(str(len(steps))))
    at = F.right(found, F.lit(1)).cast("int")
    confidence = F.array(*[F.lit(c) for _, c, _ in steps], F.lit(0.0))
    method = F.array(*[F.lit(m) for m, _, _ in steps], F.lit("not_found"))
    return F.struct(
        F.when(F.char_length(found) == 2, F.left(found, F.lit(1))).alias("answer"), F.get(confidence, at).alias("confidence"), F.get(method, at).alias("method")
    )


def thinking(text: Column, tags: tuple[str, ...] = ("thinking", "think")) -> Column:
    """Text inside the first of the tags that is there, stripped; null without any."""
    return F.coalesce(*[strip(between(text, f"<{tag}>", f"</{tag}>")) for tag in tags])


def controlled_letter(text: Column, letters: str = "AB", mode: str = "thinking") -> Column:
    """The letter, in either case, of exactly one <answer> tag, or in mode direct of the whole text; null otherwise."""
    if mode not in ("direct", "think", "thinking"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "direct":
        body = F.upper(strip(text))
        return F.when(body.isin(*letters), body)
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    one = (count(rf"(?i)<[{_SPACES}]*+answer[{_SPACES}]*+>") == 1) & (count(rf"(?i)<[{_SPACES}]*+/[{_SPACES}]*+answer[{_SPACES}]*+>") == 1)
    body = F.upper(F.regexp_extract(text, rf"(?i)<answer>[{_SPACES}]*+([{letters}])[{_SPACES}]*+</answer>", 1))
    return F.when(one & (body != ""), body)


def final_marker(text: Column) -> Column:
    """struct<status, answer>: exactly one distinct ``Final Answer: X`` and nothing after it is parsed."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"Final Answer: ([A-D])"), F.lit(1)))
    ends = text.rlike(r"Final Answer: [A-D]\s*$")
    status = F.when(F.size(marks) == 0, "invalid").when(F.size(marks) > 1, "ambiguous").when(ends, "parsed").otherwise("invalid")
    return F.struct(status.alias("status"), F.when(status == "parsed", F.get(marks, F.lit(0))).alias("answer"))


def last_number(text: Column, strict: bool = True) -> Column:
    """Of the last 300 characters: the number after the last ``####`` (strict), or the last number."""
    end = F.when(F.char_length(text) > 300, F.right(text, F.lit(300))).otherwise(text)
    pattern = r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9.,]*[0-9][0-9.,]*)"
    return F.replace(F.replace(F.try_element_at(F.regexp_extract_all(end, F.lit(pattern), F.lit(1)), F.lit(-1)), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))


def option_letter(label: Column) -> Column:
    """0 to 3, as number or digit, or a letter in either case, to A to D; null otherwise."""
    x = F.upper(F.trim(label.cast("string")))
    return F.when(x.rlike("^[0-3]$"), F.translate(x, "0123", "ABCD")).when(x.rlike("^[A-D]$"), x)


# --- normalisation -----------------------------------------------------------


def qa_normal(text: Column) -> Column:
    """Lower case without ASCII punctuation, articles and doubled spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]+", "")
    bare = F.regexp_replace(plain, r"(?=[at])(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")  # most places fail at the first letter
    # a single space stays as it is
    return F.trim(F.regexp_replace(bare, f" [{_SPACES}]+|[{_SPACES}&&[^ ]][{_SPACES}]*", " "))


def exact_match(text: Column, golden: Column) -> Column:
    """1 if the text equals one of golden after qa_normal."""
    return _once(qa_normal(text), lambda t: normal_match(t, golden))


def substring_match(text: Column, golden: Column) -> Column:
    return _once(qa_normal(text), lambda t: normal_substring(t, golden))


def normal_match(normal: Column, golden: Column) -> Column:
    """exact_match of a text that has gone through qa_normal."""
    return F.exists(golden, lambda g: qa_normal(g) == normal).cast("int")


def normal_substring(normal: Column, golden: Column) -> Column:
    """substring_match of a text that has gone through qa_normal."""
    return F.exists(golden, lambda g: F.contains(normal, qa_normal(g))).cast("int")


def title_cleanup(text: Column) -> Column:
    """Strips, turns `` [title]`` to a stop, removes brackets and doubled spaces."""
    return F.replace(F.regexp_replace(F.replace(strip(text), F.lit(" [title]"), F.lit(". ")), r"(?d)\[[^\]\n]*+\]", ""), F.lit("  "), F.lit(" "))


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal_v1(text: Column) -> Column:
    """NFC, LF line ends, without outer Unicode white space; ASCII texts pass by Python."""
    nfc = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(_nfc(text))
    lines = F.regexp_replace(nfc, r"\r\n?", "\n")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def balanced_box(text: str | None) -> str | None:
    """Content of the last \\boxed{...} with balanced braces."""
    at = (text or "").rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for k in range(at + 6, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if not depth:
            return text[at + 7 : k]
    return None


@F.pandas_udf(StringType())
def last_box(x: pd.Series) -> pd.Series:
    return x.map(balanced_box)


# Rewrites of final answers, in this order, and what is removed from them.
_REWRITES = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
)


def minerva_normal(answer: Column) -> Column:
    """Text after the last equals sign with the rewrites, without units and wrappers, shorthand fractions and roots in braces, digits without commas."""
    x = F.substring_index(answer, "=", -1)
    for old, new in (*_REWRITES, *((word, "") for word in _REMOVED)):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.when(F.contains(x, F.lit("$")), F.regexp_replace(x, r"(?d)(.*?)\$(.*?)\$(.*)", r"\$$2\$")).otherwise(x)
    for wrapper in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"(?d)\\{wrapper}\{{(.*?)\}}", "$1")
    x = F.regexp_replace(x, r"(?d)\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"(?d)frac([^{])(.)", r"frac{$1}{$2}"), r"sqrt([^{])", r"sqrt{$1}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    plain = F.replace(x, F.lit(","), F.lit(""))
    return strip(F.when(plain.rlike(r"^\d+\z"), plain).otherwise(x))


# Rewrites of boxed answers, in this order.
_BOX_REWRITES = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)


def math_normal(answer: Column, once: Callable[[Column, Callable[[Column], Column]], Column] = _once) -> Column:
    """A boxed answer in one spelling: no units, braces around what follows \\sqrt and \\frac, plain fractions and 0.5 as \\frac.

    Null where the rule has no result: units named twice, or a root or fraction of nothing.
    """
    x = answer
    for old, new in _BOX_REWRITES:
        x = F.replace(x, F.lit(old), F.lit(new))
    x = once(x, lambda t: F.when(F.size(F.split(t, r"\\text\{ ", -1)) <= 2, F.substring_index(t, "\\text{ ", 1)))
    for old, new in (("\\\\%", ""), ("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.regexp_replace(x, r"\A\.", "0.")
    x = F.regexp_replace(x, r"(?s)\A[^=]{0,2}=([^=]*)\z", "$1")  # a name of up to two characters before the only equals sign
    x = once(x, lambda t: F.when(~t.rlike(r"\\sqrt(?:\\sqrt|\z)"), F.regexp_replace(t, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")))
    return once(F.replace(x, F.lit(" "), F.lit("")), lambda t: _fractions(t, once))


def _fractions(x: Column, once: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """Braces around the parts of shorthand fractions; plain ones and 0.5 as \\frac."""
    whole = F.regexp_replace(F.regexp_replace(x, r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"(?s)\\frac([^{])\{", r"\\frac{$1}{")
    short = F.regexp_extract(x, r"(?s)\\frac([^{]?)(?=\\frac|\z)", 0)  # the first fraction that lacks its second part
    x = once(short, lambda s: F.when(s == "", whole).when(s != "\\frac", x))
    x = once(x, lambda t: F.when(t == "0.5", F.lit("\\frac{1}{2}")).otherwise(t))
    return F.regexp_replace(x, r"\A(0|-?[1-9]\d*)/(0|-?[1-9]\d*)\z", r"\\frac{$1}{$2}")


def math_equal(answer: Column, truth: Column, once: Callable[[Column, Callable[[Column], Column]], Column] = _once) -> Column:
    """Whether two boxed answers have one spelling; where one has none, whether they are the same text. Two nulls are equal."""
    return once(math_normal(answer, once), lambda x: once(math_normal(truth, once), lambda y: spelled_alike(x, y, answer, truth)))


def spelled_alike(x: Column, y: Column, answer: Column, truth: Column) -> Column:
    """math_equal of two answers with their math_normal, x and y."""
    spelled = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(answer.eqNullSafe(truth))
    return spelled & (answer.isNull() == truth.isNull())


_FRACTION = re.compile(r"(-?)\\[dt]?frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}|(-?[\d.]+)/([\d.]+)")
_BRACKETS = {"(": ")", "[": "]"}
CLOSE = 1e-4


def _number(text: str) -> float | None:
    """A number, with thousands commas, a percent sign, or as a plain fraction."""
    plain = text.strip().replace(",", "").removesuffix("\\").strip()
    percent = plain.endswith("%")
    plain = plain.rstrip("%").rstrip("\\")
    if m := _FRACTION.fullmatch(plain):
        sign, a, b, c, d = m.groups()
        above, below = (a, b) if a is not None else (c, d)
        try:
            return (-1 if sign else 1) * float(above) / float(below)
        except (ValueError, ZeroDivisionError):
            return None
    try:
        return float(plain) / (100 if percent else 1)
    except ValueError:
        return None


def _elements(text: str) -> list[str]:
    """The parts between the commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _matrix(text: str) -> list[list[str]] | None:
    """The cells of a pmatrix, or of a list of lists."""
    text = text.strip()
    if m := re.fullmatch(r"(?s)\\begin\{pmatrix\}(.*)\\end\{pmatrix\}", text):
        return [[cell.strip() for cell in row.split("&")] for row in re.split(r"\\\\", m[1]) if row.strip()]
    rows = _elements(text[1:-1]) if text[:1] == "[" and text[-1:] == "]" else []
    rows = [r.strip() for r in rows]
    if rows and all(r[:1] == "[" and r[-1:] == "]" for r in rows):
        return [[cell.strip() for cell in _elements(r[1:-1])] for r in rows]
    return None


def same_answer(answer: str | None, truth: str | None) -> bool:
    """Equal text but for case and spaces; equal numbers within one in 10^4, also if one is the other's hundredth or hundredfold (percent); intervals, tuples and
    lists of such in order, with the same brackets; matrices cell by cell. Other symbolic forms are only equal as text."""
    if answer is None or truth is None:
        return False
    x, y = answer.strip(), truth.strip()
    if x.lower() == y.lower() or x.replace(" ", "") == y.replace(" ", ""):
        return True
    a, b = _number(x), _number(y)
    if a is not None and b is not None:
        return any(math.isclose(a, c, rel_tol=CLOSE) for c in (b / 100, b, b * 100))
    if (rows := _matrix(x)) is not None and (others := _matrix(y)) is not None:
        return [len(r) for r in rows] == [len(r) for r in others] and all(same_answer(c, d) for r, o in zip(rows, others, strict=True) for c, d in zip(r, o, strict=True))
    inside = x[:1] in _BRACKETS and x[-1:] in _BRACKETS.values() and y[:1] in _BRACKETS and y[-1:] in _BRACKETS.values()
    if inside and (x[0], x[-1]) != (y[0], y[-1]):
        return False
    parts, others = (_elements(z[1:-1] if inside else z) for z in (x, y))
    return len(parts) == len(others) and (inside or len(parts) > 1) and all(same_answer(p, q) for p, q in zip(parts, others, strict=True))


@F.pandas_udf(BooleanType())
def answers_equal(answer: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([same_answer(a, t) for a, t in zip(answer, truth, strict=True)], dtype=bool)


# How a prompt states its options.
_CUE = re.compile(r"\b(?:answer|reply|respond|choose|select|single\s+letter)\b|\bX\s+is\b", re.IGNORECASE)
_NO_MORE = r"(?!\s*(?:(?:,\s*)?(?:or|and)\s+|[,/|]\s*)[A-Z]\b)"
_LISTS = {
    2: re.compile(rf"\bA\s+or\s+B\b{_NO_MORE}", re.IGNORECASE),
    4: re.compile(rf"\bA(?:\s+or\s+B\s*,?\s*or\s+C\s+or\s+D|\s*,\s*B\s*,\s*C\s*,?\s*(?:or|and)\s*D)\b{_NO_MORE}", re.IGNORECASE),
}
_OPTION = re.compile(r"[^\S\n]*(?:option\s+)?([A-Z])\s*[\).:\]]", re.IGNORECASE)
_CUE_REACH = 120


def options_of(messages: list[str]) -> int | None:
    """2 or 4, as the prompt says it has; None if it says neither, both, or names options beyond D.

    An instruction counts if a list of the letters follows a cue within 120 characters and is not itself an option; a
    paragraph of lines labelled A to D counts as four. Of a comparison of two answers only what precedes the query is read.
    """
    texts = []
    for text in messages:
        parts = [re.search(rf"###\s*{name}\s*:", text, re.IGNORECASE) for name in (r"A\s+Answer", r"B\s+Answer", "Query")]
        cut = len(text)
        if parts[0] and parts[1]:
            cut = parts[2].start() if parts[2] else min(parts[0].start(), parts[1].start())
        texts.append(text[:cut])
    text = "\n".join(texts)
    said = set()
    for n, listed in _LISTS.items():
        for at in (m.start() for m in listed.finditer(text)):
            line = max((end + len(mark) for mark in ("\n", r"\n") if (end := text.rfind(mark, 0, at)) >= 0), default=0)
            label = _OPTION.match(text[line:at])
            option = label is not None and label.group(1).upper() in "ABCD"
            if not option and _CUE.search(text[max(0, at - _CUE_REACH) : at]):
                said.add(n)
                break
    for paragraph in re.split(r"\n\s*\n", text):
        labels = {m.group(1) for m in map(_OPTION.match, paragraph.split("\n")) if m}
        if {*"ABCD"} <= labels:
            if labels - {*"ABCD"}:
                return None
            said.add(4)
            break
    return said.pop() if len(said) == 1 else None


@F.pandas_udf(IntegerType())
def n_options(messages: pd.Series) -> pd.Series:
    """options_of for arrays of message texts; null for no messages."""
    return pd.Series([None if m is None or not len(m) else options_of([t or "" for t in m]) for m in messages], dtype="Int32")


def canonical_json(**columns: Column) -> Column:
    """Text of an object with sorted keys; values are strings, longs or booleans, nulls are kept."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(columns[k])).substr(F.lit(2), F.length(F.to_json(F.array(columns[k]))) - 2), F.lit("null"))) for k in sorted(columns)]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def content_id(prefix: str, schema: str, **columns: Column) -> Column:
    """prefix and 40 hex digits of the digest of the tagged canonical text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(schema_version=F.lit(schema), **columns), 256), 1, 40))


def set_hash(hashes: Column) -> Column:
    """Order-free digest of a group's row hashes."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), "\n"), 256)


def passages(titles_and_texts: Column) -> Column:
    """``Doc i(Title: first line) rest`` blocks of an array of texts."""
    return F.array_join(
        F.transform(
            titles_and_texts,
            lambda t, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.substring_index(t, "\n", 1), F.lit(") "), F.regexp_replace(t, r"(?s)^[^\n]*\n?", ""), F.lit("\n")),
        ),
        "",
    )
