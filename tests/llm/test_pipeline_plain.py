"""The pipeline's rows against a plain version of every stage: loops over texts, no code of the operators but the trained toxicity model."""

import hashlib
import math
import re

import corpus_pipeline as p
from millrace.llm import toxicity
from millrace.llm.common import read

SMALL = "/root/testdata/sf0.001"


def _toxic(model, text):
    folded = toxicity.fold(text)
    starts = [i for i in range(len(folded)) if i == 0 or not folded[i - 1].isalpha()]
    spared = set()
    for phrase in model.exceptions:
        bare = phrase.rstrip("*")
        for i in starts:
            if folded.startswith(bare, i) and (phrase != bare or not folded[i + len(bare) : i + len(bare) + 1].isalpha()):
                spared |= set(range(i, i + len(bare)))
    weights = []
    for i in starts:
        fits = [e for e in model.weights if folded.startswith(e, i)]
        if fits and i not in spared:
            weights.append(model.weights[max(fits, key=len)])
    total, (bias, *coef) = sum(weights), model.coef
    found = math.log1p(total), math.log1p(100 * total / max(len(folded.split()), 1)), max(weights, default=0.0)
    return 1 / (1 + math.exp(-(bias + sum(c * x for c, x in zip(coef, found))))) >= 0.3


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _first_of_near_groups(docs):
    sets = {}
    for i, r in docs.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", _lower(r["text"])) if w]
        n = min(5, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                hi, lo = sorted((root(i), root(j)), reverse=True)
                up[hi] = lo
    return {i: r for i, r in docs.items() if root(i) == i}


def _words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text)) if w]


def _without_benchmark(docs, items):
    windows = set()
    for text in items:
        w = _words(text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    out = {}
    for i, r in docs.items():
        w = _words(r["text"])
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            out[i] = r
    return out


def _topic(t):
    if "License" in t:
        return "legal"
    if " | " in t:
        return "table"
    if "{" in t or "def " in t or "=" in t:
        return "code"
    return "brief" if len(t) < 600 else "article" if len(t) < 4000 else "long"


def _mixed(docs):
    cells = {}
    key = lambda r: (r["source"], r["lang"], _topic(r["text"] or ""))
    for r in docs.values():
        cells[key(r)] = cells.get(key(r), 0) + len([w for w in re.split(r"[ \n]+", r["text"] or "") if w])
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    shares = [{v: sum(x for c, x in w.items() if c[d] == v) for v in {c[d] for c in w}} for d in range(3)]
    goals = []
    for d, power in enumerate((0.85, 0.9, 0.95)):
        raised = {v: s**power if s > 0 else 0.0 for v, s in shares[d].items()}
        goals.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(60):
        for d in range(3):
            have = {v: sum(x for c, x in w.items() if c[d] == v) for v in goals[d]}
            w = {c: x * goals[d][c[d]] / have[c[d]] if have[c[d]] > 0 else 0.0 for c, x in w.items()}
    factor = {c: w[c] / n if n else 0.0 for c, n in cells.items()}
    top = max(factor.values())

    def drawn(r):
        name = f"17:{r['doc_id']}:{len(r['text'] or '')}"
        return int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52 < factor[key(r)] / top

    return {i: r for i, r in docs.items() if drawn(r)}


def test_run_equals_the_plain_stages(spark):
    table, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    model = toxicity.train(table, labels)
    docs = {r["doc_id"]: r.asDict() for r in table.collect()}
    steps = [docs]
    steps.append({i: r for i, r in docs.items() if not _toxic(model, r["text"])})
    steps.append(_first_of_near_groups(steps[-1]))
    steps.append(_without_benchmark(steps[-1], [r["text"] for r in read(spark, SMALL, "benchmark").collect()]))
    steps.append(_mixed(steps[-1]))
    assert [len(a) > len(b) for a, b in zip(steps, steps[1:])] == [True] * 4  # every stage has something to do
    got = {r["doc_id"]: r.asDict() for r in p.run(spark, SMALL).collect()}
    assert got.keys() == steps[-1].keys()
    assert all({k: v for k, v in got[i].items() if k != "shard"} == r for i, r in steps[-1].items())
    sizes = [0] * p.SHARDS
    for r in got.values():
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 1
    largest = max(len((r["text"] or "").encode()) + 1 for r in got.values())
    assert max(sizes) - min(sizes) <= 3 * largest
