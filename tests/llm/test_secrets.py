import hashlib
import math
import random
import re
import string
import time

import zstandard

from millrace.llm import secrets as s

RNG = random.Random(7)
KEY = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(40))


def _plain(text):
    """The base rule, read literally."""
    found = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        found += [("assign", *m.span())] if len(m[2]) >= 8 else []
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_against_the_literal_rule():
    texts = [
        "password = 'abcdefgh'", "TOKEN:short", "api_key=ABCDEFGH apikey: 12345678", "é token = \"" + "a1" * 20 + '"', "AKIA" + "A" * 12, "AKIA" + "A" * 11,
        "f" * 31, "f" * 32 + "g" + "0" * 33, "secretsecret=aaaaaaaaa", "passwd==abcdefghi", "ſecret=abcdefghi", "toKen=abcdefghi", "", "AKIAAKIA" + "Z" * 20,
    ]
    for _ in range(300):
        texts.append("".join(RNG.choice(["token", "=", " ", ":", '"', "abcdefgh", "0f" * 9, "AKIA", "X" * 9, "é", "\n", "secret"]) for _ in range(12)))
    for t in texts:
        assert sorted(s.base_spans(t)) == _plain(t)


def test_method_reports_random_strings_in_sensitive_context_only():
    novelty = s.Novelty(["connection", "configuration", "public_key_identifier", "authorization_header_value_2024"])
    for text, want in [
        (f"client auth_header value {KEY} end", True),
        (f"the picture of {KEY} end", False),
        ("credential authorization_header_value_2024 is a name", False),
        (f"seen {KEY} before; private {KEY} again", False),  # a repeat tells nothing new
        ("bearer key a1b2a1b2a1b2a1b2a1b2a1b2a1b2a1b2a1b2a1b2", False),
    ]:
        assert bool(s.novel_spans(text, s.base_spans(text), novelty)) is want, text


def test_query_columns_and_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, f"private key {KEY} end", "z"), (4, "word " * 50_000 + "token=abcdefgh1", "q"), (5, f"é token={KEY}", "q"), (5, f"é token={KEY}", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = s.scan(docs, s.frequent_words(docs)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 6
    assert got[1]["base_sha256"] == got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["spans"] == f"novel:12:{12 + len(KEY)}" and got[None]["n_novel"] == 1
    assert got[4]["spans"] == "assign:250000:250015"
    assert got[5]["spans"] == f"assign:2:{8 + len(KEY)}"
    assert s.scan(docs.limit(0), s.frequent_words(docs.limit(0))).count() == 0


def _base64(n):
    return "".join(RNG.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))


def test_long_secrets_are_one_span():
    novelty = s.Novelty(["connection"])
    for n in (500, 513, 1600, 9000):
        text = f"private: {_base64(n)} end"
        assert s.novel_spans(text, [], novelty) == [("novel", 9, 9 + n)]
    text = f"private: {_base64(300)}{'ab12' * 400} end"  # the secret part makes the whole a secret
    assert s.novel_spans(text, [], novelty) == [("novel", 9, 1909)]
    assert s.novel_spans(f"private: {'ab12' * 400} end", [], novelty) == []
    key = _base64(700)
    text = f"private: {key}{'0f' * 20}G{key[::-1]}"
    base = s.base_spans(text)
    assert [k for k, _, _ in base] == ["hex"]
    assert s.novel_spans(text, base, novelty)[0][1] == 9 and s.novel_spans(text, base, novelty)[-1][2] == len(text)


def test_context_goes_on_over_lines_of_a_block():
    novelty = s.Novelty(["connection"])
    lines = [_base64(64) for _ in range(6)] + ["aB3+d9=="]
    for head in ("-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n", "private key: "):
        text = head + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n"
        assert [text[a:b] for _, a, b in s.novel_spans(text, [], novelty)] == lines
    text = "private key:\t'" + "' +\n    '".join(lines[:6]) + "'\nend of it"
    assert [text[a:b] for _, a, b in s.novel_spans(text, [], novelty)] == lines[:6]
    text = f"private key: {lines[0]}\nand some words, {lines[1]}"
    assert [text[a:b] for _, a, b in s.novel_spans(text, [], novelty)] == lines[:1]
    text = f"token={lines[0]}\n{lines[1]}\n"
    assert [text[a:b] for _, a, b in s.novel_spans(text, s.base_spans(text), novelty)] == lines[1:2]


def _naive_novel(text, words):
    """The method read literally, over texts without blocks or lines that follow: candidates character by character, context by plain search."""
    held = zstandard.ZstdCompressionDict(("\n".join(reversed(words)) or "\n").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x: len(zstandard.ZstdCompressor(level=s.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x.encode()))
    covered = {i for _, a, b in _plain(text) for i in range(a, b)}
    found, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "+/_=-"):
            end += 1
        line = text[max(text.rfind("\n", 0, at) + 1, at - 60) : at].lower()
        marks = ("key", "token", "secret", "passw", "pwd", "auth", "credential", "bearer", "private", "signature")
        if end - at >= 16 and any(m in line and len(line) - line.rindex(m) - len(m) <= 40 for m in marks):
            k = at
            while k < end:  # parts that no base span covers
                stop = k
                while stop < end and stop not in covered:
                    stop += 1
                part = text[k:stop]
                if len(part) >= 16 and sum(c.isdigit() for c in part) >= 2 and sum(c.isalpha() for c in part) >= 2:
                    n = math.ceil(len(part) / s.PIECE)
                    cuts = [k + len(part) * i // n for i in range(n + 1)]
                    cost = lambda a, b: (size(text[max(0, a - s.AROUND) : a] + text[a:b] + text[b : b + s.AROUND]) - size(text[max(0, a - s.AROUND) : a] + text[b : b + s.AROUND])) / (b - a)
                    if max(cost(a, b) for a, b in zip(cuts, cuts[1:])) >= s.NOVELTY:
                        found.append(("novel", k, stop))
                k = stop + 1
        at = max(end, at + 1)
    return found


def test_method_against_a_naive_version():
    rng, words = random.Random(21), ["connection", "public_key_identifier", "configuration_value"]
    novelty = s.Novelty(words)
    pieces = ["token", "auth ", "secret=", "key: ", " ", " the ", ". ", "\n words; ", "configuration_value", "0f" * 20, "password: abcdefgh9 ", "picture of ", "a1" * 12, "é"]
    found = 0
    for _ in range(500):
        text = "".join(rng.choice(pieces) if rng.random() < 0.8 else " " + _base64(rng.randrange(10, 40)) + " " for _ in range(12))
        want = _naive_novel(text, words)
        assert s.novel_spans(text, s.base_spans(text), novelty) == want, text
        found += len(want)
    assert found > 100


def test_many_spans_take_time_in_proportion():
    novelty = s.Novelty(["connection"])
    text = "".join(f"token=abcdefgh{k:06d} x{k:015d}y\n" for k in range(20_000))
    began = time.time()
    base = s.base_spans(text)
    s.novel_spans(text, base, novelty)
    assert len(base) == 20_000 and time.time() - began < 30


def test_the_dictionary_is_filled_to_its_bound(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words * 3)), (2, " ".join([*words[60:], "often often often often"] * 1))], "doc_id long, text string")
    assert s.frequent_words(docs, 50) == ["often", *words[60:], *words[:9]]
    assert s.frequent_words(docs, 1000) == ["often", *words[60:], *words[:60]]
    assert s.frequent_words(docs, 0) == []
