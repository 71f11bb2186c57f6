import random

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import rewards as R


def _column(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", column(F.col("t")).alias("x"))
    return [r["x"] for r in rows.orderBy("k").collect()]


def test_white_space_is_stripped_as_in_unicode(spark):
    texts = ["\n\x1c a b\x85\t", "\xa0　x  ", "", " \n", None, "a" + " " * 50_000 + "b" + " \n" * 20_000]
    assert _column(spark, texts, T.strip) == [None if t is None else t.strip() for t in texts]


def test_answers_with_line_ends_and_case(spark):
    texts = [
        "<answer>\nA\n</answer>", "<answer>C</answer> Final Answer:\n\tB.", "x\nanswer is:\nb" + "z" * 120, "我选择 A吧" + "z" * 120, "选b" + "z" * 120, "xAx" + "z" * 120,
        "none", "", "Final Answer: AB", "choose" + " " * 60_000, "ab" * 40_000,
    ]
    got = _column(spark, texts, T.answer_with_confidence)
    assert [(r["answer"], r["confidence"], r["method"]) for r in got] == [
        ("A", 1.0, "answer_tag"), ("B", 0.8, "final_answer"), ("B", 0.5, "pattern_match"), ("A", 0.5, "pattern_match"), ("B", 0.5, "pattern_match"),
        ("A", 0.3, "last_occurrence"), (None, 0.0, "not_found"), (None, 0.0, "not_found"), ("A", 0.8, "final_answer"), (None, 0.0, "not_found"), (None, 0.0, "not_found"),
    ]
    assert _column(spark, texts[:2], T.judge_letter) == ["A", "B"]
    assert _column(spark, ["<answer>" * 30_000, "<thinking>\n x </thinking>", "<thinking> <think>\ty\n</think>", "<THINK>no</THINK>"], T.thinking) == [None, "x", "y", None]


def test_controlled_answers(spark):
    texts = ["<answer> b\n</answer>", "<ANSWER>A</Answer>", "<answer>A</answer><answer>", "< answer >A</answer>", "<answer>C</answer>", " b\n", "AB", None]
    assert _column(spark, texts, T.controlled_letter) == ["B", "A", None, None, None, None, None, None]
    assert _column(spark, texts, lambda c: T.controlled_letter(c, "ABCD")) == ["B", "A", None, None, "C", None, None, None]
    assert _column(spark, texts, lambda c: T.controlled_letter(c, mode="direct")) == [None] * 5 + ["B", None, None]


def test_answers_in_one_spelling(spark):
    minerva = {
        "x = 5 dollars": "5", "$1,200$ meters": "1200", "\\text{7}": "7", "\\textbf{a}\\overline{b}": "ab", "\\boxed{\\frac{1}{2}}": "\\frac{1}{2}", "\\frac12": "\\frac{1}{2}",
        "\\sqrt3": "\\sqrt{3}", "90^\\circ": "90", "the $a$ b $c$": "a", "12\n": "12", "(1,2)": "(1,2)", "3 \\text{m}^2": "3",
    }
    assert _column(spark, list(minerva), T.minerva_normal) == list(minerva.values())
    boxed = {
        "\\dfrac12": "\\frac{1}{2}", "\\frac1{72}": "\\frac{1}{72}", "\\frac{a}{b}": "\\frac{a}{b}", "3/4": "\\frac{3}{4}", "03/4": "03/4", "-3/4": "\\frac{-3}{4}", "0.5": "\\frac{1}{2}", ".5": "\\frac{1}{2}",
        "x = 5": "5", "abc=5": "abc=5", "5 \\text{ cm}": "5", "\\text{ a}\\text{ b}": None, "\\sqrt2": "\\sqrt{2}", "\\sqrt": None, "1\\frac": None, "\\frac1": "\\frac1", "\\left( 1,\\! 2\\right)": "(1,2)",
        "30^\\circ": "30", "5\\%": "5", "": "", "a\nb": "ab",
    }
    assert _column(spark, list(boxed), T.math_normal) == list(boxed.values())
    rows = spark.createDataFrame([("so \\boxed{\\dfrac{1}{2}}", "0.5"), ("\\boxed{3}", "4"), ("3", "3"), ("\\boxed{\\sqrt}", "\\sqrt")], "response string, golden string")
    assert [r[0] for r in rows.select(R.math_score(F.col("response"), F.col("golden"))).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_articles_stand_between_characters_of_words(spark):
    assert _column(spark, ["The ça, an éa a b—the!", "A  the x"], T.qa_normal) == ["ça éa b—", "x"]


def test_option_counts(spark):
    assert T.options_of(["answer a or b", "noise"]) == 2
    assert T.options_of(["answer A or B " + "or C"]) is None
    assert T.options_of(["A) x\nB) y\nC) z\nD) w"]) == 4 and T.options_of(["A) x\nB) y\nC) z\nD) w\nE) v"]) is None
    assert T.options_of(["reply" + " " * 130 + "A or B"]) is None
    rng = random.Random(2)
    words = ["answer", "A or B", "A, B, C or D", "A)", "\n", "\n\n", "x", "D.", "B.", "C."]
    assert {T.options_of([" ".join(rng.choices(words, k=9))]) for _ in range(300)} == {2, 4, None}


def test_equal_answers():
    for a, b in (("1,000", "1000"), ("-\\frac{1}{4}", "-0.25"), ("(2, 3)", "(2,3)"), ("[0,\\frac{1}{2})", "[0,0.5)"), ("12.5\\%", "0.125"), ("\\begin{pmatrix} 1 \\\\ 2 \\end{pmatrix}", "[[1],[2]]")):
        assert T.same_answer(a, b) and T.same_answer(b, a), (a, b)
    for a, b in (("1", "2"), ("(1,2)", "(2,1)"), ("(1,2]", "(1,2)"), ("1,2", "12x"), ("[[1],[2]]", "[[1,2]]"), ("x", "y"), ("", "0"), ("1/0", "1")):
        assert not T.same_answer(a, b), (a, b)
