import random
import time

from pyspark.sql import functions as F

from millrace.llm import line_dedup as ld


def _brute(docs, min_words):
    """Every two positions of all documents, line by line: (lines, deleted lines, text left) of each. Lines are compared as text."""
    split = {}
    for i, text in docs:
        at, rows = 0, []
        for line in (text or "").split("\n"):
            if line.split():
                rows.append((line.strip(), len(line.split()), at, min(at + len(line) + 1, len(text))))
            at += len(line) + 1
        split[i] = rows
    cut = {i: set() for i, _ in docs}
    order = sorted(split)
    for i in order:
        for j in (k for k in order if k <= i):
            a, b = split[i], split[j]
            for x in range(len(a)):
                for y in range(x if i == j else len(b)):
                    n = words = need = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n][0] == b[y + n][0]:
                        words += a[x + n][1]
                        n += 1
                    if words >= min_words:
                        while sum(r[1] for r in b[y : y + need]) < min_words:
                            need += 1  # the least that a first occurrence holds
                        cut[i] |= set(range(max(x, y + need) if i == j else x, x + n))
    left = {}
    for i, text in docs:
        gone = {c for k in cut[i] for c in range(split[i][k][2], split[i][k][3])}
        for k in cut[i]:
            if k + 1 in cut[i]:
                gone |= set(range(split[i][k][3], split[i][k + 1][2]))
        left[i] = "".join(c for k, c in enumerate(text or "") if k not in gone)
    return {i: (len(split[i]), len(cut[i])) for i in split}, left


def test_random_documents_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 7]))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(25)))) for i in range(50)]
    got = ld.repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    want, left = _brute(docs, 8)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == want
    out = ld.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    assert {r["doc_id"]: r["text"] for r in out} == left


def test_passages_in_other_places_are_cut_after_their_first_document(spark):
    passage = "\n".join(" ".join(f"p{i}w{k}" for k in range(9)) for i in range(7))
    common = "a common line"
    docs = [(1, common), (2, f"x\n{common}\n{passage}\nend two"), (3, f"{passage}\n{common}\nend three"), (4, f"one\n{passage}"), (5, " ".join(f"s{i}" for i in range(60))), (6, "head\n" + " ".join(f"s{i}" for i in range(60)) + "  \ntail")]
    out = ld.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: common, 2: docs[1][1], 3: f"{common}\nend three", 4: "one\n", 5: docs[4][1], 6: "head\ntail"}


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, 0), (2, "", 1), (3, "\n \n", 2), (4, line, 3), (4, line, 3), (4, line + "\nmore", 4), (None, "z\n" + line, 5), (7, "\n".join(["same words here"] * 60), 6), (8, "word " * 90_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = ld.repeats(docs)
    assert got.count() == 9
    by = {(r["doc_id"], r["n_lines"]): r["n_removed"] for r in got.collect()}
    assert by[None, 2] == 0  # a null id comes first
    assert by[4, 1] == 1 and by[4, 2] == 1
    assert by[7, 60] == 43  # all but the first window of 17 lines
    out = ld.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 9
    assert out.where("doc_id = 8").select(F.length("text")).first()[0] == 450_000
    assert ld.repeats(docs.limit(0)).count() == 0 and ld.without_repeats(docs.limit(0)).count() == 0


def test_random_documents_against_all_earlier_positions(spark):
    rng = random.Random(16)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 9]))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randrange(25)))) for i in range(60)]
    got = ld.repeats(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got} == _brute(docs, 8)[0]


def test_a_run_that_repeats_a_later_document_than_the_first(spark):
    x, y1, y2 = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("x", 60), ("y", 20), ("z", 20)))
    docs = [(1, f"{x}\nother"), (2, f"{x}\n{y1}\n{y2}\nb"), (3, f"{x}\n{y1}\n{y2}\nc"), (4, f"{x}\n{y1}\nd"), (5, f"{x}\nother\ne")]
    got = {r["doc_id"]: r["text"] for r in ld.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: f"{y1}\n{y2}\nb", 3: "c", 4: "d", 5: "e"}


def test_windows_select_few_positions_in_time_proportional_to_the_lines():
    rng = random.Random(4)
    text = "\n".join(f"{rng.random()}" for _ in range(100_000))
    began = time.time()
    lines = ld.lines_of(text)
    windows = ld.windows_of(lines, 50)
    assert len(windows) == 100_000 - 49
    assert all(lines[p][3] == min(x[3] for x in lines[a : b + 1]) for a, b, p in windows[::997])
    assert len({p for _, _, p in windows}) < 0.05 * len(lines)
    assert sum(len(c) for _, _, c, _ in ld.selected(lines, 50)) < 10 * len(lines)
    assert time.time() - began < 20
    same = ld.lines_of("x\n" * 100_000)  # equal lines select no more
    assert len({p for _, _, p in ld.windows_of(same, 50)}) <= 100_000 / 50 + 1


def test_a_text_of_many_lines_repeats(spark):
    rng = random.Random(14)
    body = [f"{rng.random()}" for _ in range(100_000)]
    docs = [(1, "\n".join(body)), (2, "\n".join(["head", *body[500:60_000], "tail"]))]
    got = {r["doc_id"]: r["n_removed"] for r in ld.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 59_500}
