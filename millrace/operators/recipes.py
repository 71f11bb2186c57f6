"""Dataset builders and smaller scorers of recipes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType
from pyspark.sql.window import Window as W

from millrace.functions import text as T


#: Rows numbered by one task.
NUMBERED = 20_000


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds index: the place of each row in the given order, from 0.

    Rows fall in ranges of the order, whose bounds are taken from the keys alone; what precedes a range is counted first, so no
    task numbers or holds more than the rows of its ranges. Equal keys share a range; missing ones come first.
    """
    keys, ranges = rows.select(F.col(order).alias("key")), -(-rows.count() // NUMBERED)
    key = F.col(order)
    if ranges <= 1:
        return rows.withColumn("index", F.row_number().over(W.orderBy(key)).cast("long") - 1)
    found = keys.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("last")).where("last is not null").orderBy("last").select("last").collect()
    bounds = F.array(*[F.lit(r["last"]).cast(keys.schema["key"].dataType) for r in found[:-1]])
    part = lambda k: F.size(F.filter(bounds, lambda last: last < k)) if len(found) > 1 else F.lit(0)
    sizes, before = keys.groupBy(part(F.col("key")).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect(), {}
    for r in sizes:
        before[r["part"]] = sum(x["n"] for x in sizes if x["part"] < r["part"])
    ahead = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before) + 1)])
    dealt = rows.withColumn("__part", part(key)).repartition(ranges, "__part")
    place = F.row_number().over(W.partitionBy("__part").orderBy(key)).cast("long") - 1
    return dealt.withColumn("index", F.get(ahead, F.col("__part")) + place).drop("__part")


def five_fields(rows: DataFrame, source: str, ability: str, prompt: Column, truth: Column, order: str, split: str) -> DataFrame:
    """Any source row as a trainer row; the index follows the given total order within its source."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    fields = rows.select(F.array(message).alias("prompt"), truth.alias("truth"), F.col(order).alias("__order"))
    return numbered(fields, "__order").select(
        F.lit(source).alias("data_source"), "prompt", F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("truth").alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), F.col("index")).alias("extra_info"),
    )


def unpivot_preferences(rows: DataFrame) -> DataFrame:
    """rows: prompt, chosen, rejected. Two rows each: prompt, response, chosen (boolean)."""
    both = F.array(F.struct(F.col("chosen").alias("response"), F.lit(True).alias("chosen")), F.struct(F.col("rejected").alias("response"), F.lit(False).alias("chosen")))
    return rows.select("prompt", F.inline(both))


def media_segments(content: Column) -> Column:
    """Typed segments of a content: <image> and <video> stand alone, other text stays together."""
    parts = F.filter(F.split(content, r"(?=<image>|<video>)|(?<=<image>|<video>)"), lambda p: p != "")
    kind = lambda p: F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text")
    return F.transform(parts, lambda p: F.struct(kind(p).alias("type"), F.when(kind(p) == "text", p).alias("text")))


def collapse_interaction(rows: DataFrame, system: str, keep: tuple[str, ...]) -> DataFrame:
    """rows: prompt (messages), answer columns ground_truth, single_turn_completion, completion, and others. The first answer that is
    not empty; a system message in front; the columns named by keep nested; a stable id from the content."""
    truth = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("ground_truth", "single_turn_completion", "completion")], F.lit(""))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    prompt = F.concat(first, "prompt")
    return rows.select(
        prompt.alias("prompt"), truth.alias("ground_truth"), F.struct(*keep).alias("extra_info"), F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.sha2(F.to_json(F.struct(prompt.alias("p"), truth.alias("t"))), 256).alias("index"),
    )


def shuffled_options(options: Column, gold: Column, key: Column, seed: int) -> Column:
    """struct<options, letter>: options in an order drawn from seed and key, and the letter of gold."""
    ranked = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, o)).alias("h"), o.alias("o"))))
    drawn = F.transform(ranked, lambda r: r["o"])
    return F.struct(drawn.alias("options"), F.char(F.array_position(drawn, gold) + 64).alias("letter"))


def config_counts(configs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per config, with 0 for those without."""
    n = rows.groupBy("config").agg(F.count(F.lit(1)).alias("n"))
    return configs.join(n, "config", "left").select("config", F.coalesce("n", F.lit(0)).alias("n"))


def too_long(length: Column, most: int) -> Column:
    """A length that is not known counts as too long."""
    return F.coalesce(length, F.lit(most + 1)) > most


def official_letter(text: Column, mode: str, letters: str = "ABCD") -> Column:
    """thinking: the tag's letter, else that of the last line which is a letter or begins with one and a stop or colon.
    direct: a letter alone, at the beginning, or anywhere first."""
    if mode == "direct":
        up = F.upper(F.trim(text))
        return F.nullif(F.regexp_extract(up, f"([{letters}])", 1), F.lit(""))
    tag = T.tagged_letter(text, "A-D")
    lines = F.transform(F.split(F.trim(text), "\n"), lambda x: F.regexp_extract(F.trim(x), rf"^([{letters}])(?:$|[.:])", 1))
    last = F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(-1))
    return F.coalesce(F.when(tag.isin(*letters), tag), last)


def choice_score(text: Column, golden: Column) -> Column:
    return F.when(F.regexp_extract(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1) == golden, 1.0).otherwise(0.0)


def new_words(messages: Column, prompt_turns: Column) -> Column:
    """Words of the turns behind the prompt."""
    later = F.slice(messages, prompt_turns + 1, F.greatest(F.size(messages) - prompt_turns, F.lit(0)))
    return F.aggregate(later, F.lit(0), lambda a, m: a + F.size(F.filter(F.split(m["content"], r"\s+"), lambda w: w != "")))


_BRACES = re.compile(r"\\boxed\{|[{}]")


def _boxes(text: str | None) -> tuple[list[str], bool, str]:
    """The outermost boxes of a text, whether the last one stays open, and what follows the last closed one."""
    text, boxes, start, depth, end = text or "", [], 0, 0, 0
    for m in _BRACES.finditer(text):
        if m[0] == "}":
            if depth == 1:
                end = m.end()
                boxes.append(text[start:end])
            depth -= depth > 0
        elif depth or m[0] != "{":  # a brace outside of boxes opens nothing
            start = start if depth else m.start()
            depth += 1
    return boxes, depth > 0, text[end:]


_FOUND = StructType().add("boxes", ArrayType(StringType())).add("open", BooleanType()).add("rest", StringType())


@F.pandas_udf(_FOUND)
def _found_boxes(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_boxes(t) for t in x], columns=["boxes", "open", "rest"])


def terminal_box(text: Column | str) -> Column:
    """status|box by the rule: exactly one balanced box, and nothing but white space after it."""
    found = _found_boxes(F.col(text) if isinstance(text, str) else text)
    boxes = found["boxes"]
    return (
        F.when(found["open"], "invalid:math_parse_failure|")
        .when(F.size(boxes) == 0, "invalid:missing_final_marker|")
        .when(F.size(F.array_distinct(boxes)) > 1, "ambiguous:conflicting_markers|")
        .when(F.size(boxes) > 1, "invalid:duplicate_same_marker|")
        .when(T.strip(found["rest"]) != "", "invalid:prompt_contract_mismatch|")
        .otherwise(F.concat(F.lit("parsed|"), F.get(boxes, F.lit(0))))
    )


_OPENING = re.compile(r"\{(?=\s*[\"'}])")


def _object_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the balanced pairs of braces that can begin an object, by their starts; quotes are not read."""
    opened, spans, likely = [], [], {m.start() for m in _OPENING.finditer(text)}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened and (start := opened.pop()) in likely:
            spans.append((start, m.end()))
    return sorted(spans)


def _object(body: str) -> str | None:
    """A JSON object with sorted keys, as it is or with single quotes and trailing commas repaired."""
    for quoted in (body, body.replace("'", '"')):
        for tidy in (quoted, re.sub(r",\s*([}\]])", r"\1", quoted)):
            try:
                return json.dumps(json.loads(tidy), sort_keys=True, ensure_ascii=False)
            except ValueError:
                continue
    return None


def _find_json(text: str | None) -> str | None:
    """The last outermost JSON object in free text, with sorted keys; single quotes and trailing commas are repaired.

    Objects are tried from the end of the text, each outermost pair of braces before the pairs inside it.
    """
    text = text or ""
    spans = _object_spans(text)
    outer: list[list[tuple[int, int]]] = []
    for span in spans:
        if outer and span[0] < outer[-1][0][1]:
            outer[-1].append(span)
        else:
            outer.append([span])
    for group in reversed(outer):
        for start, end in group:
            if (found := _object(text[start:end])) is not None:
                return found
    decoder = json.JSONDecoder()
    for start in reversed([m.start() for m in _OPENING.finditer(text)]):  # braces within strings upset the pairs
        try:
            return json.dumps(decoder.raw_decode(text, start)[0], sort_keys=True, ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def tolerant_json(x: pd.Series) -> pd.Series:
    return x.map(_find_json)


def box_is_error_step(box: Column) -> Column:
    """Whether a boxed number differs from -1; text is never evaluated."""
    return F.try_to_number(box, F.lit("S999999999")).cast("int") != -1


def geometry_score(text: Column, box: Column, golden: Column, share: float = 0.1) -> Column:
    """Accuracy and format, weighted; numbers are equal as numbers, other answers as text."""
    form = text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    same = (box == golden) | F.coalesce(box.try_cast("double") == golden.try_cast("double"), F.lit(False))
    return (1 - share) * F.coalesce(same, F.lit(False)).cast("double") + share * form


def kl_reward(tokens: DataFrame, beta: float, kl: Column) -> DataFrame:
    """Adds reward: score less beta times the masked KL."""
    return tokens.withColumn("reward", F.col("score") - beta * kl * F.col("mask"))


def resampling_weights(rows: DataFrame, method: str, power: float = 2.0) -> DataFrame:
    """Adds weight by pow, max_min or max_random."""
    one = rows.agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    x = rows.crossJoin(F.broadcast(one))  # one row
    weight = {
        "pow": F.pow(F.abs("score"), power), "max_min": F.when((F.col("score") == F.col("hi")) | (F.col("score") == F.col("lo")), 1.0).otherwise(0.0),
        "max_random": F.when(F.col("score") == F.col("hi"), 0.4).otherwise(0.1),
    }[method]
    return x.withColumn("weight", weight + 1e-8).drop("hi", "lo")


RANGE = 1_000_000


def resample(rows: DataFrame, seed: int = 0) -> DataFrame:
    """As many rows as given, drawn in proportion to weight by systematic sampling: a row appears floor or ceil of n * share times.

    Row i covers an interval of the running weight, in order of uid and slot; draws fall at u, u + 1, ... of n. Weights are
    summed as whole numbers of billionths, so the draw does not depend on how rows are spread. The running weight is summed
    within ranges of uid of about ``RANGE`` groups, so only the totals of ranges meet in one task.
    """
    lo, hi, total, n = rows.agg(F.min("uid"), F.max("uid"), F.sum(F.round(F.col("weight") * 1e9).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    if not n or not total:
        return rows.withColumn("times", F.lit(0).cast("long"))
    x = rows.withColumn("w", F.round(F.col("weight") * 1e9).cast("decimal(38,0)")).withColumn("range", F.floor((F.col("uid") - F.lit(lo)) / max(1, min(RANGE, hi - lo + 1))))
    before = F.coalesce(F.sum("g").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = x.groupBy("range").agg(F.sum("w").alias("g")).select("range", before.alias("before"))
    own = F.sum("w").over(W.partitionBy("range").orderBy("uid", "slot").rowsBetween(W.unboundedPreceding, 0))
    upto = x.withColumn("own", own).join(ranges, "range").withColumn("upto", (F.col("before") + F.col("own")).cast("decimal(38,0)"))
    late = 1000 - int((0.5 + seed * 0.6180339887498949) % 1.0 * 1000)  # where the first draw falls, in thousandths from behind
    drawn = lambda at: f"(cast(({at}) * {n}BD * 1000 + {late}BD * {int(total)}BD as decimal(38,0)) div ({int(total)}BD * 1000))"
    times = F.expr(f"{drawn('upto')} - {drawn('upto - w')}")
    return upto.withColumn("times", times.cast("long")).drop("w", "range", "own", "before", "upto")


def prime_rloo(tokens: DataFrame) -> DataFrame:
    """tokens: uid, rollout, slot, score, mask. Adds value: masked token scores less the leave-one-out baseline of rollout means; returns: sums from each token on."""
    per = W.partitionBy("uid", "rollout")
    mean = F.avg(F.when(F.col("mask") == 1, F.col("score"))).over(per)
    x = tokens.withColumn("m", mean)
    rolls = x.groupBy("uid", "rollout").agg(F.max("m").alias("m")).groupBy("uid").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    x = x.drop("m").join(rolls, "uid")
    value = F.when(F.col("mask") == 1, F.col("score") * F.col("n") / (F.col("n") - 1) - F.col("s") / (F.col("n") - 1)).otherwise(0.0)
    x = x.withColumn("value", value).drop("s", "n")
    return x.withColumn("returns", F.sum(F.col("value") * F.col("mask")).over(per.orderBy("slot").rowsBetween(0, W.unboundedFollowing)))


def contract_faults(rows: DataFrame) -> DataFrame:
    """Trainer rows: pair_id, permutation_id, label, truth. One row per violated rule with its count."""
    bad = {
        "label": F.col("label") != F.when(F.col("permutation_id") == 0, "AB").otherwise("BA"),
        "truth": F.col("truth") != F.when(F.col("permutation_id") == 0, "A").otherwise("B"),
    }
    own = rows.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    pairs = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("permutation_id").alias("k"))
    pairs = pairs.agg(F.count_if((F.col("n") != 2) | (F.col("k") != 2)).alias("incomplete_pair"))
    return own.crossJoin(F.broadcast(pairs)).unpivot([], ["label", "truth", "incomplete_pair"], "fault", "n")


def rank_balance(sizes: list[int], ranks: int) -> list[list[int]]:
    """Equal parts by differencing; within a part small rows at both ends."""
    from millrace.operators.balance import differencing

    parts = [sorted(p, key=lambda i: (sizes[i], i)) for p in differencing(sizes, ranks, True)]
    return [p[::2] + p[1::2][::-1] for p in parts]


_PARSERS: dict[str, object] = {}


def register_parser(name: str, f) -> None:
    """Names a function from text to an array of call structs."""
    if _PARSERS.setdefault(name, f) is not f:
        raise ValueError(f"parser {name!r} is already registered")


def tool_calls(text: Column, name: str = "tagged_json") -> Column:
    return _PARSERS[name](text)


register_parser(
    "tagged_json",
    lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1)), lambda c: F.from_json(F.trim(c), "name string, arguments map<string,string>")),
)
