"""Contracts of trainer rows and logs, and small adapters beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as T
from millrace.sources.tables import dealt

# Names and formats of the trainer contract.
ABILITIES = ("math", "logical_reasoning")
SYSTEM = "Reply with only A or B."
HASH = r"\A[0-9a-f]{64}\z"
RUNS = ("split_manifest_hash", "generation_run_id", "pair_run_id", "permutation_run_id")
SHARED = ("original_question_id", "source", "split", *RUNS)
CELL = 1_000_000


def out_of_order(rows: DataFrame, at: str, *keys: str) -> DataFrame:
    """Rows whose keys are less than those of the row before, in order of ``at`` (whole numbers).

    Rows are compared within ranges of ``CELL`` numbers; of each range only its last row meets the next one's first.
    """
    key = F.struct(*keys)
    cells = rows.select(F.col(at).alias("at"), key.alias("key")).withColumn("cell", F.floor(F.col("at") / CELL))
    cells = dealt(cells, "cell")
    own = cells.withColumn("was", F.lag("key").over(W.partitionBy("cell").orderBy("at"))).where("key < was").select("at")
    ends = cells.groupBy("cell").agg(F.min_by("key", "at").alias("first"), F.min("at").alias("at"), F.max_by("key", "at").alias("last"))
    between = ends.withColumn("was", F.lag("last").over(W.orderBy("cell"))).where("first < was").select("at")
    return own.unionAll(between)


def trainer_faults(rows: DataFrame, source: str) -> DataFrame:
    """rows: row_id, data_source, prompt, ability, reward_model (style, ground_truth), extra_info. Every rule with the number of rows (pairs) that break it."""
    e, p, r = F.col("extra_info"), F.col("prompt"), F.col("reward_model")
    k = e["permutation_id"]
    good = {
        "source": (F.col("data_source") == source) & F.col("ability").isin(*ABILITIES),
        "prompt": (F.size(p) == 2) & (F.get(p, F.lit(0))["role"] == "system") & (F.get(p, F.lit(0))["content"] == SYSTEM) & (F.get(p, F.lit(1))["role"] == "user") & F.get(p, F.lit(1))["content"].isNotNull(),
        "reward_model": (r["style"] == "rule") & r["ground_truth"].isin("A", "B"),
        "pair_id": e["pair_id"].rlike(HASH),
        "permutation_id": k.isin(0, 1),
        "surface": (e["permutation_label"] == F.when(k == 0, "AB").otherwise("BA")) & (r["ground_truth"] == F.when(k == 0, "A").otherwise("B")),
        "question": e["original_question_id"] != "",
        **{run: e[run].rlike(HASH) for run in RUNS},
    }
    own = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in good.items()])
    lineage = F.struct(*[e[c].alias(c) for c in SHARED])
    # texts are compared by sorting, so rows are dealt out before: the first of two steps would else sort all that one task reads
    k_, said = F.col("k"), F.col("lineage")
    pairs = dealt(rows.select(e["pair_id"].alias("pair_id"), k.alias("k"), lineage.alias("lineage")), "pair_id").groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(k_).alias("k"), F.count_if(k_.isin(0, 1)).alias("known"), (F.min(said) != F.max(said)).alias("mixed")
    )
    both = pairs.agg(
        F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("duplicate_identity"), F.count_if((F.col("n") != 2) | (F.col("k") != 2) | (F.col("known") != 2)).alias("incomplete_pair"),
        F.count_if("mixed").alias("lineage"),
    )
    order = out_of_order(rows.select("row_id", e["original_question_id"].alias("q"), k.alias("k")), "row_id", "q", "k").agg(F.count(F.lit(1)).alias("order"))
    one = own.crossJoin(F.broadcast(both)).crossJoin(F.broadcast(order))  # one row each
    return one.unpivot([], [*own.columns, *both.columns, "order"], "fault", "n")


def log_window(lines: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """lines: at (byte offset of the line's beginning), line. Those that begin in [start, end); a window with nothing in it raises."""
    if start < 0 or (end is not None and end <= start):
        raise ValueError(f"no window from {start} to {end}")
    inside = F.col("at") >= start
    got = lines.where(inside if end is None else inside & (F.col("at") < end))
    if not got.limit(1).count():
        raise ValueError(f"the log has nothing from {start} on")
    return got


def identity_report(base: DataFrame, checks: DataFrame, manifest: DataFrame, rollouts: int = 2) -> DataFrame:
    """Per block of a reward log what its rows and pair checks make of the manifest.

    base: block, at, pair_id, permutation, source; checks: block, pair_id, slot, idx0, idx1; manifest: pair_id, permutation,
    row_index, place (the pair's number). Every pair of the manifest is expected with every permutation, each ``rollouts``
    times in a row; a check is joined if its two indices are the two permutations of the pair it names.
    """
    looked = manifest.select("row_index", F.struct("pair_id", "permutation").alias("held"))
    first, second = (looked.select(F.col("row_index").alias(f"idx{k}"), F.col("held").alias(f"held{k}")) for k in (0, 1))
    met = checks.join(first, "idx0", "left").join(second, "idx1", "left")
    of_pair = lambda k: F.col(f"held{k}.pair_id") == F.col("pair_id")
    joined = of_pair(0) & of_pair(1) & (F.col("held0.permutation") + F.col("held1.permutation") == 1)
    expected = manifest.select("pair_id", F.col("permutation").alias("slot"), F.lit(True).alias("expected"))
    keys = met.withColumn("bad", ~F.coalesce(joined, F.lit(False))).groupBy("block", "pair_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"))
    n_expected = expected.agg(F.count(F.lit(1)).alias("n_expected"))
    by_check = keys.join(expected, ["pair_id", "slot"], "left").groupBy("block").agg(
        F.sum("n").alias("pair_checks"), F.sum(F.col("n") - 1).alias("duplicate_check_keys"), F.count("expected").alias("seen"), F.count_if(F.col("expected").isNull()).alias("unexpected_check_keys"),
        F.sum("bad").alias("bad_pair_joins"),
    )
    canonical = manifest.select("pair_id", "permutation", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))).alias("r"), "place")
    canonical = canonical.select("pair_id", "permutation", ((F.col("place") * 2 + F.col("permutation")) * rollouts + F.col("r")).cast("long").alias("spot"))
    spot = F.row_number().over(W.partitionBy("block").orderBy("at")).cast("long") - 1
    rows = base.withColumn("spot", spot).join(canonical.withColumnsRenamed({"pair_id": "pair_c", "permutation": "perm_c"}), "spot", "left")
    same = (F.col("pair_id") == F.col("pair_c")) & (F.col("permutation") == F.col("perm_c"))
    known = rows.join(manifest.select(F.col("row_index").alias("source"), F.lit(1).alias("known")), "source", "left")
    by_base = known.groupBy("block").agg(
        F.count(F.lit(1)).alias("base_rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("misplaced"), F.count_if(F.col("known").isNull()).alias("unknown_sources")
    )
    out = by_base.join(by_check, "block", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.crossJoin(F.broadcast(n_expected))  # one row
    out = out.withColumn("n_rows", F.col("n_expected") * rollouts).withColumn("missing_check_keys", F.col("n_expected") - F.coalesce("seen", F.lit(0)))
    moved = (F.coalesce("base_rows", F.lit(0)) > 0) & ((F.col("misplaced") > 0) | (F.col("base_rows") != F.col("n_rows")))
    counts = ("base_rows", "pair_checks", "duplicate_check_keys", "missing_check_keys", "unexpected_check_keys", "bad_pair_joins", "unknown_sources")
    return out.select("block", *map(zero, counts), F.coalesce(moved, F.lit(False)).alias("placement_reordered"))


def identity_verdict(report: DataFrame, blocks: int) -> DataFrame:
    """Named failures over all blocks of an identity report, with how many blocks have each; none fail in a clean log."""
    bad = {
        "duplicate_check_keys": F.col("duplicate_check_keys") > 0, "missing_check_keys": F.col("missing_check_keys") > 0, "unexpected_check_keys": F.col("unexpected_check_keys") > 0,
        "bad_pair_joins": F.col("bad_pair_joins") > 0, "unknown_sources": F.col("unknown_sources") > 0,
    }
    one = report.agg(
        *[F.count_if(c).alias(k) for k, c in bad.items()], F.abs(F.count(F.lit(1)) - blocks).alias("block_count"),
        F.when(F.count_if("placement_reordered") == 0, F.count(F.lit(1))).otherwise(0).alias("never_reordered"),
    )
    rows = one.unpivot([], [*bad, "block_count", "never_reordered"], "check", "n")
    return rows.withColumn("verdict", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"))


# What a public log may hold.
PUBLIC_KEYS = ("candidate_id", "original_question_id", "generator_id", "shard_id", "status", "error_type", "retry_count", "count", "elapsed_seconds")
_COUNTS, _CODES = ("count", "retry_count"), ("status", "error_type")
ERROR_NAMES = {
    "timeout": ("TimeoutError", "Timeout", "TimeoutException", "ReadTimeout", "ConnectTimeout"), "oom": ("MemoryError", "OutOfMemoryError"), "dependency_error": ("ImportError", "DependencyError"),
    "access_denied": ("PermissionError", "GatedRepoError", "AuthenticationError", "AccessDeniedError"),
}


def public_faults(fields: Column) -> Column:
    """The keys of a map<string, string> that a public log may not have, or whose values are not safe, sorted."""

    def safe(k: Column, v: Column) -> Column:
        plain = v.rlike(r"\A[A-Za-z0-9_.+@=,()\-]+\z") & ~F.lower(v).contains("hf_") & (v != "..")
        count = v.rlike(r"\A[0-9]+\z")
        number = v.rlike(r"\A[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z")
        code = plain & v.rlike(r"\A[A-Za-z0-9_.\-]+\z")
        kind = F.when(k.isin(*_COUNTS), count).when(k == "elapsed_seconds", number).when(k.isin(*_CODES), code).otherwise(plain)
        return k.isin(*PUBLIC_KEYS) & F.coalesce(kind, F.lit(False))

    return F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: ~safe(k, v))))


def error_category(names: Column) -> Column:
    """The category of an error by the names of its classes; messages are never read."""
    out = F.lit("unexpected_error")
    for category in ("dependency_error", "access_denied", "oom", "timeout"):
        out = F.when(F.arrays_overlap(names, F.array(*map(F.lit, ERROR_NAMES[category]))), category).otherwise(out)
    return out


def group_id(question: Column, original_index: Column, index: Column, position: Column) -> Column:
    """A row's group as text: its question, else its original index, else half its index, else half its place."""
    half = lambda x: F.floor(x / 2).cast("string")
    return F.coalesce(F.nullif(question, F.lit("")), original_index.cast("string"), half(index), half(position))


def tool_messages(text: Column) -> Column:
    """array<struct<role, content, code>> of a tagged text: assistant turns that end in <code>, tool turns of <interpreter>, and an <answer>.

    A segment runs up to its closing tag. Turns must take turns, an assistant first; a text that does not, or that ends in
    an open turn, gives null.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s).*?<(code|answer|interpreter)>.*?</\1>"), F.lit(0))
    kind = lambda p: F.regexp_extract(p, "<(code|answer|interpreter)>", 1)

    def turn(p: Column) -> Column:
        code = F.regexp_extract(p, r"(?s)<code>(.*?)</code>", 1)
        fenced = F.regexp_extract(code, r"(?s)```python(.*?)```", 1)
        return (
            F.when(kind(p) == "code", F.struct(F.lit("assistant").alias("role"), T.strip(F.substring_index(p, "<code>", 1)).alias("content"), F.when(fenced != "", T.strip(fenced)).otherwise(code).alias("code")))
            .when(kind(p) == "interpreter", F.struct(F.lit("tool").alias("role"), T.strip(F.replace(F.replace(p, F.lit("<interpreter>"), F.lit("")), F.lit("</interpreter>"), F.lit(""))).alias("content"), F.lit(None).cast("string").alias("code")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), T.strip(F.replace(F.replace(p, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit(""))).alias("content"), F.lit(None).cast("string").alias("code")))
        )

    turns = F.transform(parts, turn)
    whole = F.char_length(F.array_join(parts, "")) == F.char_length(text)
    closed = F.forall(parts, lambda p: p.endswith(F.concat(F.lit("</"), kind(p), F.lit(">"))))  # no segment opens what it does not close
    alternate = closed & F.forall(F.transform(turns, lambda t, i: t["role"] == F.when(i % 2 == 0, "assistant").otherwise("tool")), lambda ok: ok)
    return F.when(whole & alternate & (F.size(turns) > 0), turns)


def preference_row(chosen: Column, rejected: Column, width: int, pad: int = 0) -> Column:
    """struct<ids, mask>: token ids of both responses, cut or padded on the right to one width, chosen first."""
    fit = lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(pad), width)), 1, width)
    seen = lambda x: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= F.size(x)).cast("int"))
    return F.struct(F.array(fit(chosen), fit(rejected)).alias("ids"), F.array(seen(chosen), seen(rejected)).alias("mask"))


def dense_flops(batches: DataFrame, hidden: int, vocabulary: int, layers: int, heads: int, key_value_heads: int, inner: int, head_size: int | None = None) -> DataFrame:
    """batches: batch, length, seconds. Teraflops a second of forward and backward passes of a dense gated decoder, by batch."""
    size = head_size or hidden // heads
    weights = layers * (3 * hidden * inner + hidden * size * (2 * heads + 2 * key_value_heads)) + 2 * vocabulary * hidden
    tokens, squares = F.sum("length"), F.sum(F.col("length").cast("double") * F.col("length"))
    flops = tokens * float(6 * weights) + squares * float(12 * size * heads * layers)
    return batches.groupBy("batch").agg((flops / F.max("seconds") / 1e12).alias("teraflops"))


_REDUCERS: dict[str, Callable[[np.ndarray], float]] = {"mean": np.mean, "best": np.max, "worst": np.min, "median": np.median}


def register_reducer(name: str, f: Callable[[np.ndarray], float]) -> None:
    """Names a function from a sample's values to a number."""
    if _REDUCERS.setdefault(name, f) is not f:
        raise ValueError(f"reducer {name!r} is already registered")


#: These take all samples at once, along the last axis; others take one sample after the other.
_BY_AXIS = (np.mean, np.max, np.min, np.median)
#: Sampled numbers held at once.
SAMPLED = 1_000_000


def bootstrap(rows: DataFrame, size: int, reducers: tuple[str, ...] = ("mean", "best", "worst"), times: int = 1000, seed: int = 42) -> DataFrame:
    """rows: group, order, value. Per group and reducer the mean and deviation over ``times`` samples of ``size`` with replacement.

    Draws repeat the legacy generator from the seed for each group, so groups of one number of rows have the same draws, which
    are made once and applied to all of them. A group is what one prompt has, a bounded number of rows.
    """
    chosen, by_axis, held = {r: _REDUCERS[r] for r in reducers}, _BY_AXIS, SAMPLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[int, np.ndarray] = {}
        for batch in batches:
            group, lists = batch.column(0), batch.column(1)
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes):
                if n not in draws:
                    draw = np.random.RandomState(seed)
                    draws[n] = np.stack([draw.choice(n, size=size, replace=True) for _ in range(times)])
                of = np.flatnonzero(sizes == n)
                for some in np.array_split(of, -(-len(of) * times * size // held)):
                    samples = values[starts[some][:, None, None] + draws[n]]
                    for name, f in chosen.items():
                        got = f(samples, axis=-1) if f in by_axis else np.array([[f(x) for x in g] for g in samples])
                        yield pa.RecordBatch.from_arrays([group.take(pa.array(some)), pa.array([name] * len(some), pa.string()), pa.array(np.mean(got, axis=-1), pa.float64()), pa.array(np.std(got, axis=-1), pa.float64())], ["group", "reducer", "mean", "std"])

    placed = F.array_sort(F.collect_list(F.struct(F.col("order").isNull().alias("none"), "order", F.col("value").cast("double").alias("value"))))
    groups = rows.groupBy(F.col("group").cast("long").alias("group")).agg(placed["value"].alias("value"))
    return groups.mapInArrow(run, "group long, reducer string, mean double, std double")


def statistical_gate(plans: DataFrame, outcomes: DataFrame, pairs: DataFrame) -> DataFrame:
    """rule, severity (FAIL or WARN) of every broken rule, by whole-number comparisons.

    plans: question, source, generator; outcomes: source, generator, status of the successful candidates (correct, incorrect,
    ambiguous, invalid, error); pairs: question, source, positive_generator, negative_generator, one for each question.
    Of each cell of source and generator at most a fifth may be bad, and not all of its decided ones right or wrong; of a
    source's planned questions a fifth must have a pair and three tenths should; no generator should give more than seven
    tenths of a side, and none may give nine tenths of all pairs.
    """

    def said(rows: DataFrame, rule: Column, condition: Column, severity: str) -> DataFrame:
        return rows.where(condition).select(rule.alias("rule"), F.lit(severity).alias("severity"))

    status = F.col("status")
    cells = outcomes.groupBy("source", "generator").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(status.isin("invalid", "error")).alias("bad"), F.count_if(status == "correct").alias("right"), F.count_if(status.isin("correct", "incorrect")).alias("decided")
    )
    cell = F.concat_ws("/", "source", "generator")
    planned = plans.select("question", "source").distinct()
    chosen = pairs.join(planned, ["question", "source"], "left_semi")
    of_source = planned.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(chosen.groupBy("source").agg(F.count(F.lit(1)).alias("k")), "source", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_generator").alias("generator")) for side in ("positive", "negative")])
    given = chosen.select("source", F.inline(sides)).select(F.explode(F.array(F.lit("pooled"), F.col("source"))).alias("scope"), "side", "generator")
    shares = given.groupBy("scope", "side", "generator").agg(F.count(F.lit(1)).alias("k")).withColumn("n", F.sum("k").over(W.partitionBy("scope", "side")))
    share = F.concat(F.lit("generator_share:"), F.concat_ws("/", "scope", "side", "generator"))
    pooled = F.col("scope") == "pooled"
    n, k = F.col("n"), F.col("k")
    named = lambda name, of, end: F.concat(F.lit(f"{name}:"), of, F.lit(f":{end}"))
    parts = (
        said(cells, named("invalid_error_rate", cell, "above_20_percent"), F.col("bad") * 5 > n, "FAIL"),
        said(cells, named("correct_rate", cell, "binary_extreme"), (F.col("decided") > 0) & ((F.col("right") == 0) | (F.col("right") == F.col("decided"))), "WARN"),
        said(of_source, named("pair_yield", F.col("source"), "below_20_percent"), k * 5 < n, "FAIL"),
        said(of_source, named("pair_yield", F.col("source"), "below_30_percent"), k * 10 < n * 3, "WARN"),
        said(shares, F.concat(share, F.lit(":at_least_90_percent")), pooled & (k * 10 >= n * 9), "FAIL"),
        said(shares, F.concat(share, F.lit(":above_70_percent")), k * 10 > n * 7, "WARN"),
        said(shares, F.concat(share, F.lit(":strong_at_least_90_percent")), ~pooled & (k * 10 >= n * 9), "WARN"),
    )
    return reduce(DataFrame.unionAll, parts)


def gate_status(faults: DataFrame) -> DataFrame:
    """One row: FAIL with any failure, else PASS_WITH_WARNINGS with any warning, else PASS."""
    worst = F.when(F.count_if(F.col("severity") == "FAIL") > 0, "FAIL").when(F.count(F.lit(1)) > 0, "PASS_WITH_WARNINGS").otherwise("PASS")
    return faults.agg(worst.alias("status"))


def partial_spans(rows: DataFrame) -> DataFrame:
    """rows: version_start, version_end. How many trajectories span versions, their share, and the widest span."""
    span = F.abs(F.col("version_end") - F.col("version_start"))
    return rows.agg(F.count_if(span > 0).alias("partial"), F.avg((span > 0).cast("int")).alias("ratio"), F.max(span).alias("widest"))


def result_groups(rows: DataFrame, judged: bool = True) -> DataFrame:
    """Adds group: the question that a result belongs to.

    rows: question_id, id, extra (struct of question_id, pair_id, id, original_index), row_index. The first that is there, cut
    at ``_perm_``; row_index counts only without extra. Where fewer than a tenth of several groups have two rows, judged
    results go by original_index instead, if all have it.
    """
    e = F.col("extra")
    name = F.coalesce("question_id", "id", e["question_id"], e["pair_id"], e["id"], F.when(e.isNull(), F.col("row_index")), F.lit(""))
    out = rows.withColumn("group", F.substring_index(name, "_perm_", 1))
    if not judged:
        return out
    groups = out.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count(e["original_index"]).alias("k"))
    few = groups.agg(((F.count_if(F.col("n") >= 2) * 10 < F.count(F.lit(1))) & (F.count(F.lit(1)) > 1) & (F.sum("n") == F.sum("k"))).alias("few"))
    out = out.crossJoin(F.broadcast(few))  # one row
    return out.withColumn("group", F.when(F.col("few"), e["original_index"].cast("string")).otherwise(F.col("group"))).drop("few")
