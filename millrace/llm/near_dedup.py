"""MinHash near-dedup: a chosen-path set similarity join.

A document is the set of its distinct shingles (two words in the query; five
in the pipeline). Equal sets become one representative first, so copies never
meet as pairs. Each representative has a signature of ``SIGNATURE`` minwise
tokens. In each of several independent trees a node picks, by its own name
only, one token position (with chance 1/4 a second, so that about 1/0.8
branches leave it), and documents go to the child named by their token there.
Nodes of one document end; nodes of up to ``SMALL`` are leaves; larger ones
branch on, to depth ``DEPTH``, and beyond it, to ``LAST_DEPTH``, while more
than ``CROWD`` of their members are not linked with the rest. Nodes above
depth 5 are not listed: unrelated documents would fill them.

The number of trees follows from the target recall (``trees_for``): a pair at
the threshold stays together in one tree with chance 0.52 to depth 5 and 0.44
to depth 7, and as all trees draw from the same ``SIGNATURE`` positions, the
chance that all miss it is averaged over the number of its equal positions.
At similarity 0.8 and a recall of 0.998, 17 trees. A pair that only meets in
crowds beyond depth 7 has a lower chance (about 0.99).

A pair is weighed on its signatures first: fewer equal bytes than
``least_equal`` (34 of 64 at 0.8) happen once in a million pairs at the
threshold. Links are confirmed on the full sets: 100 * intersection >=
percent * union.

Nodes are compared exhaustively, but for what is already known:

1. large nodes first, an eighth of them before the others: each member outside
   a node's largest component sends one edge to a member inside, chosen by one
   of two draws, so that the many nodes of one group mostly send the same
   edges. Edges never tested before are weighed and confirmed, and the links
   join components. A node whose members are in one component sends nothing;
2. small nodes then do the same, and what is still in different components of
   a small node is compared in all pairs;
3. members of large nodes outside the largest component are compared with all
   members, on full sets, in blocks of about ``BLOCK`` by ``BLOCK``; nodes with
   the same largest component are one cluster, so each member meets it once. A
   block sends one link for each two components that it finds linked.

So a node whose members are all linked costs at most one edge per member,
however large it is, and no step lists the pairs of a group. In the end every
two members of a node are in one component or were compared.

Shuffles carry ids and node names; signatures travel once per level for large
nodes only; full sets once for documents in some tested pair, picked by a
semi-join that Catalyst turns into a broadcast if the ids are few. Components
are found by contraction: each task replaces its edges by stars, ids hang
below the least centre, and rounds go on between the tops only, each step
written to the shared folder.

Defined cases: words are runs of other than ASCII white space, A-Z lowered; a
text of fewer words than a shingle is one shingle; texts without words or
null have an empty set and link with nothing; rows without doc_id are
components of their own (component_id null, kept); rows that repeat a doc_id
are one document with all their texts' links; empty tables give no rows.
Columns other than doc_id and text pass through ``kept_documents``, whatever
their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, Shielded, bounded_batches, read

SIGNATURE, FIRST_DEPTH, DEPTH, LAST_DEPTH, SMALL, BLOCK = 64, 5, 7, 16, 16, 256
#: One node in so many has two children; beyond DEPTH more have, so that similar pairs do not thin out.
ONE_IN, ONE_IN_DEEP = 4, 2
#: Large nodes with more members than this outside their largest component branch on.
CROWD = 2048
#: The share of the large nodes (one in so many) whose links are found first.
FIRST_OF = 8
RECALL = 0.998
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (xor-shift and odd multiplies)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_ODD = _mixed(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)


def _chances(percent: int) -> list[tuple[float, float]]:
    """(chance, share equal) by the number of signature positions that are equal, for a pair at the threshold."""
    p = percent / 100
    return [(math.comb(SIGNATURE, k) * p**k * (1 - p) ** (SIGNATURE - k), k / SIGNATURE) for k in range(SIGNATURE + 1)]


def trees_for(percent: int, recall: float) -> int:
    """The least number of trees that brings a pair at the threshold together with this chance, if its nodes go to DEPTH."""

    def together(equal: float) -> float:
        chance = 1.0
        for _ in range(DEPTH):
            one = equal * chance
            chance = 1 - (1 - one) * (1 - one / ONE_IN)
        return chance

    known = [(chance, 1 - together(equal)) for chance, equal in _chances(percent)]
    return next(t for t in itertools.count(1) if sum(chance * apart**t for chance, apart in known) <= 1 - recall or t == 1 << 10)


def least_equal(percent: int) -> int:
    """Fewer equal positions happen once in a million pairs at the threshold."""
    below = itertools.accumulate(chance for chance, _ in _chances(percent))
    return next(k for k, total in enumerate(below) if total > 1e-6)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of n words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((words[w] for w in found), np.uint64, len(found))
    k = min(n, len(h))
    at = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        at = _mixed(at + h[i : i + len(at)]) + np.uint64(k)
    return np.unique(at)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SIGNATURE, _MASK)
    for lo in range(0, len(shingles), 4096):
        best = np.minimum(best, (shingles[lo : lo + 4096, None] * _ODD[None, :]).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def _sketch(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, n, words)
                has = len(s) and doc_id is not None
                sig = signature(s) if has else None
                out.append((doc_id, len(s), *((xxhash.xxh3_128_digest(s.tobytes()), sig.tobytes(), (sig & 255).astype(np.uint8).tobytes()) if has else (None,) * 3)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "sig", "brief"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            yield pd.DataFrame({"id": batch["doc_id"], "shingles": [shingle_set(t, n, words).tobytes() for t in batch["text"]]})

    return run


def _children(nodes: np.ndarray, rows: np.ndarray, sigs: np.ndarray, one_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of (node, row) pairs; rows point into sigs; one node in one_in has two children."""
    name = _mixed(nodes)
    first = (name % np.uint64(SIGNATURE)).astype(np.int64)
    second = ((name >> np.uint64(16)) % np.uint64(SIGNATURE)).astype(np.int64)
    more = ((name >> np.uint64(40)) % np.uint64(one_in) == 0) & (second != first)

    def child(of: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return _mixed(_mixed(of + np.uint64(1) + at.astype(np.uint64)) + sigs[row, at].astype(np.uint64))

    return (
        np.concatenate([child(nodes, first, rows), child(nodes[more], second[more], rows[more])]),
        np.concatenate([rows, rows[more]]),
    )


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, SIGNATURE)


def _frame(nodes: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"node": nodes.view(np.int64), "id": ids})


def _roots(trees: int):
    """Nodes of the first depth: above it, nodes hold whoever shares a shingle or two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sigs = _signatures(batch["sig"])
            rows = np.tile(np.arange(len(batch)), trees)
            nodes = np.repeat(_mixed(np.arange(1, trees + 1, dtype=np.uint64)), len(batch))
            for _ in range(FIRST_DEPTH):
                nodes, rows = _children(nodes, rows, sigs, ONE_IN)
            yield _frame(nodes, batch["id"].to_numpy()[rows])

    return run


def _branches(one_in: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            nodes, rows = _children(batch["node"].to_numpy().view(np.uint64), np.arange(len(batch)), _signatures(batch["sig"]), one_in)
            yield _frame(nodes, batch["id"].to_numpy()[rows])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["shingles_a"], batch["shingles_b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return run


def _alike(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, SIGNATURE) for c in ("brief_a", "brief_b"))
                yield batch.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    return run


def _nodes(reps: DataFrame, scratch: Scratch, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """Members (node, id) of the leaves of all trees: small leaves, each once however many trees have it; large ones, if there are any."""
    rows = scratch.write(reps.select("id", "sig").mapInPandas(_roots(trees), "node long, id long"))
    small = None
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        leaves, large = _by_size(rows, scratch)
        scratch.drop(rows)
        small = leaves if small is None else small.unionAll(leaves)
        if large is None:
            break
        if depth < DEPTH:
            rows = _branched(large, reps, scratch, ONE_IN)
    return _listed_once(small, scratch), large if large is None else scratch.write(large.distinct())


def _by_size(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """ids (sorted) of the nodes of up to SMALL members; (node, id) of larger ones, None without any. Nodes of one member end."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized, n = scratch.counted(rows.join(sizes, "node"), F.col("n") > SMALL)
    leaves = sized.where(F.col("n") <= SMALL).groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("ids")
    return leaves, sized.where(F.col("n") > SMALL).select("node", "id") if n else None


def _branched(rows: DataFrame, reps: DataFrame, scratch: Scratch, one_in: int) -> DataFrame:
    """Members of the children of nodes."""
    met = rows.join(reps.select("id", "sig"), "id").select("node", "id", "sig")
    return scratch.write(met.mapInPandas(_branches(one_in), "node long, id long"))


def _listed_once(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    once = leaves.distinct().where(F.size("ids") > 1)
    return scratch.write(once.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("id")))


class _Confirmer:
    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch, n: int, percent: int):
        self.docs, self.reps, self.scratch, self.n, self.percent = docs.select("doc_id", "text"), reps, scratch, n, percent

    def weighed(self, pairs: DataFrame) -> DataFrame:
        """The pairs of similar signatures."""
        briefs = [self.reps.select(F.col("id").alias(e), F.col("brief").alias(f"brief_{e}")) for e in ("a", "b")]
        rows = pairs.join(briefs[0], "a").join(briefs[1], "b").select("a", "b", "brief_a", "brief_b")
        return rows.mapInPandas(_alike(least_equal(self.percent)), "a long, b long")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """id, shingles of the documents of ids (doc_id, each once; a written table, so that its size decides how it is joined)."""
        return self.docs.join(ids, "doc_id", "left_semi").mapInPandas(_sets(self.n), "id long, shingles binary")

    def __call__(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The pairs (a written table, each given once) whose full sets are similar enough, and their number."""
        ids = self.scratch.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
        sets = self.scratch.write(self.sets_of(ids))
        rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("shingles_b")), "b")
        rows = rows.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("shingles_a")), "a")
        out, n = self.scratch.counted(rows.select("a", "b", "shingles_a", "shingles_b").mapInPandas(_confirm(self.percent), "a long, b long"))
        self.scratch.drop(sets)
        return out, n


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's edges as stars: each id with the least id that it reaches by them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(up)]
    yield pd.DataFrame([x for x in found if x[0] != x[1]], columns=["id", "up"])


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges between the components of their ends, those inside one component left out."""
    for e in ("a", "b"):
        label = labels.select(F.col("id").alias(e), F.col("component").alias("to"))
        edges = edges.join(label, e, "left").select(F.coalesce("to", e).alias(e), "b" if e == "a" else "a")
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the least id reachable) of every id in edges (a, b) but the least ones themselves.

    Each round replaces the edges of a task by stars, hangs every id below the least centre it has (pointers jump to the
    top), and goes on with the edges between different tops only: ids that hang below another never come back, so rounds
    work on ever smaller graphs.
    """
    edges, rounds = edges.where("a != b").select("a", "b"), []
    while True:
        stars, n = scratch.counted(edges.mapInPandas(_forest, "id long, up long"))
        if not n:
            break
        above = scratch.write(stars.groupBy("id").agg(F.min("up").alias("component")))
        while True:
            jump = above.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
            if not above.join(jump, "component", "left_semi").limit(1).count():
                break
            late = scratch.write(above.join(jump, "component", "left").select("id", F.coalesce("beyond", "component").alias("component")))
            scratch.drop(above)
            above = late
        rounds.append(above)
        edges = _relabelled(stars.select(F.col("id").alias("a"), F.col("up").alias("b")), above)
    labels = rounds.pop() if rounds else stars.withColumnRenamed("up", "component")
    while rounds:
        labels = scratch.write(_moved(rounds.pop(), labels))
    return labels


def _moved(labels: DataFrame, late: DataFrame) -> DataFrame:
    """labels after their components were joined as late (id, component) says."""
    to = late.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")).unionAll(late.select("id", "component"))


class _Linker:
    """Confirmed links so far, as labels (id, component); ids without a label are components of their own, or the least of theirs."""

    def __init__(self, confirm: _Confirmer, scratch: Scratch):
        self.confirm, self.scratch = confirm, scratch
        nothing = confirm.reps.limit(0)
        self.labels = nothing.select("id", F.col("id").alias("component"))
        self.tested = nothing.select(F.col("id").alias("a"), F.col("id").alias("b"))

    def add(self, links: DataFrame) -> None:
        self.labels = self.scratch.write(_moved(self.labels, components(_relabelled(links, self.labels), self.scratch)))

    def test(self, pairs: DataFrame) -> None:
        """Weigh, confirm and add the pairs that were not tested before."""
        pairs, n = self.scratch.counted(self.confirm.weighed(pairs.join(self.tested, ["a", "b"], "left_anti")))
        if n:
            self.tested = self.tested.unionAll(pairs)
            links, n = self.confirm(pairs)
        if n:
            self.add(links)

    def open(self, members: DataFrame) -> DataFrame:
        """node, id, component, top (the node's largest component), n, m (members in and out of it) where components are several."""
        rows = members.join(self.labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("n"))
        top = sizes.groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("m"))
        return rows.join(top.where("m > 0"), "node")

    def star(self, members: DataFrame) -> None:
        """Test an edge from each member outside a node's largest component to one inside, of least hash by one of two hashes."""
        rows, n = self.scratch.counted(self.open(members))
        if not n:
            return
        inside = F.col("component") == F.col("top")
        draw = F.xxhash64(F.pmod("node", F.lit(2)), "id")
        centre = rows.where(inside).groupBy("node").agg(F.min_by("id", draw).alias("centre"))
        edges = rows.where(~inside).join(centre, "node").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        self.test(edges.distinct())
        self.scratch.drop(rows)


def _across(least: int):
    """Pairs of similar signatures across components of small nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for members in batch["members"]:
                ids, comps = np.array([m["id"] for m in members]), np.array([m["component"] for m in members])
                briefs = np.frombuffer(b"".join(m["brief"] for m in members), np.uint8).reshape(-1, SIGNATURE)
                x, y = np.nonzero(np.triu((briefs[:, None] == briefs[None]).sum(axis=2) >= least, 1) & (comps[:, None] != comps[None]))
                out += zip(np.minimum(ids[x], ids[y]).tolist(), np.maximum(ids[x], ids[y]).tolist(), strict=True)
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _block_links(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Links of the block's outer members with its members, one for each two components."""
        sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
        ids, comps, outer = block["id"].tolist(), block["component"].tolist(), block["outer"].tolist()
        inner = [k for k, o in enumerate(outer) if not o]
        sizes = np.array([len(sets[k]) for k in inner])
        tokens, owners = np.concatenate([sets[k] for k in inner] or [np.empty(0, np.uint64)]), np.repeat(np.arange(len(inner)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        up = {c: c for c in comps}

        def root(c):
            while up[c] != c:
                c = up[c]
            return c

        found = []
        for k in (k for k, o in enumerate(outer) if o):
            lo, hi = np.searchsorted(tokens, sets[k], "left"), np.searchsorted(tokens, sets[k], "right")
            spots = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(owners[spots], minlength=len(inner))
            for j in np.nonzero(100 * both >= percent * (sizes + len(sets[k]) - both))[0]:
                x, y = root(comps[k]), root(comps[inner[j]])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    found.append((ids[k], ids[inner[j]]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _cluster_links(confirm: _Confirmer, rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links of the members of open nodes outside the largest component; rows as by ``_Linker.open``.

    Nodes with the same largest component are one cluster; its members outside meet all its members, in blocks.
    """
    rows = scratch.write(rows.select(F.col("top").alias("node"), "id", "component", (F.col("component") != F.col("top")).alias("outer")).distinct())
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outer").cast("long")).alias("m"))
    sets = confirm.sets_of(scratch.write(rows.select(F.col("id").alias("doc_id")).distinct()))
    rows = rows.join(sizes, "node").join(sets, "id")
    many, few = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("n", "m"))
    zero, held = F.lit(0).cast("long"), ("node", "id", "component", "shingles")
    inner = rows.select(*held, F.lit(False).alias("outer"), F.pmod(F.xxhash64("id"), many).alias("at"), F.explode(F.sequence(zero, few - 1)).alias("by"))
    outer = rows.where("outer").select(*held, F.lit(True).alias("outer"), F.explode(F.sequence(zero, many - 1)).alias("at"), F.pmod(F.xxhash64("id"), few).alias("by"))
    return scratch.write(inner.unionByName(outer).groupBy("node", "at", "by").applyInPandas(_block_links(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id long, text)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    schema = "doc_id string, n_shingles long, set_key binary, sig binary, brief binary"
    sketches = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_sketch(words), schema)
    sketches = scratch.write(sketches.withColumn("doc_id", F.col("doc_id").cast("long")))  # pandas has no whole numbers beside nulls
    reps = sketches.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("brief").alias("brief"))
    reps = scratch.write(reps)
    small, large = _nodes(reps, scratch, trees_for(percent, recall))
    confirm = _Confirmer(docs, reps, scratch, words, percent)
    linker = _Linker(confirm, scratch)
    part, done, depth = F.pmod(F.xxhash64("node"), F.lit(FIRST_OF)), None, DEPTH
    while large is not None:
        for members in (large.where(part == 0), large.where(part != 0)):  # what some nodes link, the others need not test
            linker.star(members)
        late = scratch.write(linker.open(large))
        crowded = (F.col("m") > CROWD) if depth < LAST_DEPTH else F.lit(False)
        kept = late.where(~crowded).select("node", "id")
        done = kept if done is None else done.unionAll(kept)
        crowds = late.where(crowded).select("node", "id")
        if depth == LAST_DEPTH or not crowds.limit(1).count():
            break
        leaves, large = _by_size(_branched(crowds, reps, scratch, ONE_IN_DEEP), scratch)
        small, large, depth = small.unionAll(_listed_once(leaves, scratch)), large if large is None else scratch.write(large.distinct()), depth + 1
    linker.star(small)
    across = linker.open(small).join(reps.select("id", "brief"), "id").groupBy("node")
    across = across.agg(F.collect_list(F.struct("id", "component", "brief")).alias("members")).select("members")
    linker.test(across.mapInPandas(_across(least_equal(percent)), "a long, b long").distinct())
    rest, n = scratch.counted(linker.open(done)) if done is not None else (None, 0)
    if n:
        linker.add(_cluster_links(confirm, rest, scratch, percent))
    of_set = reps.select("set_key", "id").join(linker.labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs per group of near-duplicates, with its own columns, and all rows without doc_id."""
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    gone, held = Scratch(docs.sparkSession, "near-gone").write(gone.distinct()), Shielded(docs)
    return held.back(held.rows.join(gone, held["doc_id"] == F.col("gone"), "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keyed AS (SELECT doc_id, n, g FROM s JOIN n USING (doc_id)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM keyed a JOIN keyed b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM x WHERE 100 * common >= 80 * (na + nb - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.c), d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(min(r.c), d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n.n
"""
