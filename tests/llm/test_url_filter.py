import math
import random

from pyspark.sql import functions as F

from millrace.llm import url_filter as u


def test_viterbi_splits_joined_words():
    s = u.Segmenter.of({"cheap": 50, "pills": 40, "the": 900, "rapist": 5, "therapist": 60, "a": 500, "p": 3})
    assert s.split("cheappills") == ["cheap", "pills"]
    assert s.split("therapist") == ["therapist"]
    assert s.split("thecheapxq")[:2] == ["the", "cheap"]
    assert s.split("") == [] and "".join(s.split("zzzqqqthe")) == "zzzqqqthe"


def test_viterbi_is_the_best_split():
    rng = random.Random(2)
    s = u.Segmenter.of({w: rng.randrange(1, 90) for w in ("a", "b", "ab", "ba", "aab", "bba", "abab")})

    def cost(ws):
        return sum(s.costs.get(w, s.unknown + 2.3 * len(w)) for w in ws)

    def splits(x):
        return [[]] if not x else [[x[:k], *r] for k in range(1, len(x) + 1) for r in splits(x[k:])]

    for _ in range(60):
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        assert abs(cost(s.split(x)) - min(map(cost, splits(x)))) < 1e-9


def _pages(spark):
    rows = []
    for i in range(300):
        bad = i % 10 == 0
        host = f"www.{'cheappills' if bad else 'goodnews'}{i % 3}.example.net"
        rows.append((i, f"http://{host}/{'offer/deal' if bad else 'read/story'}/{i}", "<p>good news offer deal cheap pills read story</p>"))
    rows += [
        (900, "HTTP://Example.ORG/es/x?y", None), (901, "https://a.example.org/en/12", ""), (902, "x://b.com/fr/1#z", None), (903, "x://com/de/", None),
        (904, None, None), (905, "no scheme", None), (906, "x://org", None), (907, "x://notexample.org/es/", None), (908, "a://u:p@h.COM:80/p", None), (909, "x://y.net/offer/deal/5", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_and_parts(spark):
    pages = _pages(spark)
    got = {r["page_id"]: r for r in u.judge(pages, u.train(pages)).collect()}
    assert len(got) == 310
    part = lambda k: (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"])
    assert part(900) == ("example.org", "/es/x", "example.org/es/", "block")
    assert part(901) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert part(902) == ("b.com", "/fr/1", "com/fr/", "allow")
    assert part(903) == ("com", "/de/", "com/de/", "block")
    assert part(904) == part(905) == ("", "", None, "allow")
    assert part(906) == ("org", "", None, "allow")
    assert part(907) == ("notexample.org", "/es/", "org/", "allow")
    assert part(908)[:3] == ("u:p@h.com:80", "/p", None)


def test_method_blocks_what_looks_like_the_marked_hosts(spark):
    pages = _pages(spark)
    got = {r["page_id"]: r for r in u.judge(pages, u.train(pages)).collect()}
    assert all(got[i]["verdict"] == ("block" if i % 10 == 0 else "allow") for i in range(300))
    assert got[909]["score"] > got[908]["score"]  # path words alone move the score


def test_empty_table(spark):
    pages = _pages(spark).limit(0)
    assert u.judge(pages, u.train(pages)).count() == 0


def _all_words(n):
    """n words of letters, none the start of another."""
    letters = "bcdfghjklmnpqrst"
    return ["z" + "".join(letters[i >> 4 * k & 15] for k in range(4)) for i in range(n)]


def test_rare_words_of_a_large_vocabulary_split_hosts(spark):
    words = _all_words(60_000)  # one class of more words than any fixed dictionary
    long = "".join(words[7:80])  # a label of more than 256 letters
    rows = [(i, f"http://{words[i]}{words[59_990 - i]}.example.net/x", " ".join(words[i * 6000 : (i + 1) * 6000])) for i in range(10)]
    pages = spark.createDataFrame([*rows, (10, f"http://{long}.net/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["words"].split() for r in u.judge(pages, u.train(pages)).collect()}
    assert all(got[i][:2] == [words[i], words[59_990 - i]] for i in range(10))
    assert got[10][:73] == words[7:80]


def test_scores_against_whole_counts(spark):
    rows = [(i, f"http://{'casino' if i % 7 == 0 else 'news'}{'abcdefgh'[i % 8]}.net/t{i % 50}k/{'' if i % 3 else 'offer'}", "casino news net") for i in range(400)]
    rows = [(i, url.replace(f"t{i % 50}k", "".join(chr(97 + int(c)) for c in f"{i % 50:02}")), html) for i, url, html in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = u.train(pages)
    got = {r["page_id"]: r for r in u.judge(pages, model).collect()}
    tokens = {i: [f"h:{w}" for w in got[i]["words"].split()] + [f"p:{w}" for w in url.split(".net/")[1].split("/") if w] for i, url, _ in rows}
    hosts = spark.createDataFrame([(r["host"],) for r in got.values()], "host string").distinct()
    half = {r["host"]: r["half"] for r in hosts.withColumn("half", u.half_of(F.col("host"))).collect()}
    vocabulary = {t for ts in tokens.values() for t in ts}
    marks = {f"{k}:{m}" for k in "hp" for m in u.MARKS}
    for i, ts in tokens.items():
        others = [k for k in tokens if half[got[k]["host"]] != half[got[i]["host"]]]  # a page is weighed by the other half's hosts
        n = {c: {} for c in (True, False)}
        for k in others:
            for t in tokens[k]:
                n[k % 7 == 0][t] = n[k % 7 == 0].get(t, 0) + 1
        most = max(u.LEAST_PRIOR, u.PRIOR * sum(sum(x.values()) for x in n.values()))
        whole = {c: sum(n[c].values()) + 0.1 * len(vocabulary) + (2 * len(u.MARKS) * most if c else 0) for c in n}
        want = math.log((sum(k % 7 == 0 for k in others) + u.PRIOR_PAGES * len(others) + 0.5) / (sum(k % 7 != 0 for k in others) + 0.5))
        for t in ts:
            want += math.log((n[True].get(t, 0) + 0.1 + (most if t in marks else 0)) / whole[True]) - math.log((n[False].get(t, 0) + 0.1) / whole[False])
        assert abs(got[i]["score"] - want) < 1e-6
    other = u.judge(pages.where("page_id < 50"), model).collect()  # other pages by the same model
    assert {r["page_id"]: r["score"] for r in other} == {i: got[i]["score"] for i in range(50)}


def test_a_page_is_not_judged_by_its_own_example(spark):
    """Marks of a host are a prior; what unmarked hosts share with marked ones is learned from other hosts, and so are pages whose text gives them away."""
    rows = [(i, f"http://{'casino' if i % 2 else 'poker'}{i}.net/offer/win/{i}", "<p>plain</p>") for i in range(60)]
    rows += [(100 + i, f"http://nice{i}.net/read/story/{i}", "<p>plain</p>") for i in range(200)]
    rows += [(400 + i, f"http://nice{300 + i}.net/offer/win/{i}", "<p>plain words</p>") for i in range(6)]
    rows += [(500 + i, f"http://nice{i}.net/lucky/draw/{i}", "<p>Casino! poker, slots</p>") for i in range(0, 60)]
    rows += [(600 + i, f"http://nice{400 + i}.net/lucky/draw/{i}", "<script>casino poker slots</script>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = u.judge(pages, u.train(pages))
    got = {r["page_id"]: r for r in judged.collect()}
    assert all(got[i]["verdict"] == "block" for i in [*range(60), *range(400, 406), *range(600, 606)])
    assert all(got[i]["verdict"] == "allow" for i in range(100, 300))
    assert all(got[i]["example"] == ("block" if i < 60 or 500 <= i < 600 else "allow") for i in got)
    n = u.held_out(judged)
    assert sum(n.values()) == len(rows) and n.get(("block", "allow"), 0) == 0


def test_odd_rows(spark):
    long = "http://" + "casinonews" * 2_000 + ".net/" + "deal/" * 20_000
    rows = [(1, "http://a.net/x", None, 7), (1, "http://a.net/x", None, 7), (None, "http://b.net/y", "", 8), (2, long, "<p>" + "word " * 50_000, 9), (3, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = u.judge(pages, u.train(pages)).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "2", "3", "None"]
    assert [r["host"] for r in got if r["page_id"] is None] == ["b.net"]
    assert [len(r["path"]) for r in got if r["page_id"] == 2] == [100_001]
