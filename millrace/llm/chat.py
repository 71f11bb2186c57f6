"""Chat formatting: reply trees to training conversations.

Messages point to their parents. Iterative self-joins double the reach of each
message's ancestor pointer (2**k steps up after k joins), summing branch
scores on the way, so a tree of depth d takes log2(d) joins, each over the
messages only that have not reached their root. Leaves of a tree
are ranked by the score of their root-to-leaf path; the chosen leaves then
collect their ancestors by the stored pointers, again in log2(d) joins, and
only these messages meet their texts. Rows grow with the output: each chosen
path is listed once, and no other path is.

Template: a turn is ``### role: text</turn>\\n``. Control strings inside roles
and texts are escaped by one more backslash in their middle, which one less
undoes: ``</turn>`` becomes ``<\\/turn>`` (and ``<\\/turn>`` ``<\\\\/turn>``),
``### `` becomes ``##\\# ``, and in roles ``: `` becomes ``:\\ ``. Other
characters stay. ``loss_spans`` gives the code points of each assistant text
inside the formatted string.

Defined cases: messages without a tree or an id belong to no conversation and
are left out; null texts and roles are empty; a message whose parent is null
or missing is a root; messages that repeat an id within a tree are one message
(the least by role and text stays); cycles have no root and yield nothing;
ties in score go to the smaller leaf id; no messages give no conversations. A
conversation stored as rows by turn is a chain; rows that share a turn follow
each other by role, then text, and rows that repeat are all kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.llm.common import Scratch, read

END = "</turn>\n"
TRICKY = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>"), r"##(\\*)# ", r"##\\$1# ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"##\\(\\*)# ", r"##$1# "), r"<\\(\\*)/turn>", r"<$1/turn>")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(\\*) ", r":\\$1 ")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(\\*) ", r":$1 "))


def chosen_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """messages: tree_id, id, parent_id, score. tree_id, leaf_id, path_rank, id, depth (0 at the root) of the top_k paths of each tree."""
    scratch = Scratch(messages.sparkSession, "paths")
    known = messages.select("tree_id", F.col("id").alias("parent_id"), F.lit(True).alias("held")).distinct()
    rows = messages.groupBy("tree_id", "id").agg(F.min("parent_id").alias("parent_id"), F.max("score").alias("score"))
    rows = rows.join(known, ["tree_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("held"), F.col("parent_id"))).drop("held")
    own = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    state = scratch.write(rows.select("tree_id", "id", F.col("parent_id").alias("up"), own.alias("sum"), F.lit(1).cast("long").alias("steps")))
    going, done = state.where(F.col("up").isNotNull()), [state.where(F.col("up").isNull())]
    links, last = [going], None
    while (left := going.count()) and not (left == last and len(links) > 40):  # only a cycle goes on for 2**40 steps
        last = left
        known = reduce(DataFrame.unionAll, done, going)
        above = known.select("tree_id", F.col("id").alias("up"), F.col("up").alias("far"), F.col("sum").alias("far_sum"), F.col("steps").alias("far_steps"))
        late = scratch.write(
            going.join(above, ["tree_id", "up"], "left").select(
                "tree_id", "id", F.col("far").alias("up"), (F.col("sum") + F.coalesce("far_sum", F.lit(0.0))).alias("sum"),
                (F.col("steps") + F.coalesce("far_steps", F.lit(0))).alias("steps"),
            )
        )
        going = late.where(F.col("up").isNotNull())
        done.append(late.where(F.col("up").isNull()))
        links.append(going)
    state = reduce(DataFrame.unionAll, done)
    parents = links[0].select("tree_id", F.col("up").alias("id")).distinct()
    leaves = state.join(parents, ["tree_id", "id"], "left_anti")
    best = F.row_number().over(W.partitionBy("tree_id").orderBy(F.col("sum").desc(), "id"))
    paths = leaves.withColumn("path_rank", best).where(F.col("path_rank") <= top_k)
    paths = scratch.write(paths.select("tree_id", F.col("id").alias("leaf_id"), "path_rank", "id", (F.col("steps") - 1).alias("depth")))
    for k in reversed(range(len(links) - 1)):
        up = links[k].select("tree_id", "id", "up")
        more = paths.join(up, ["tree_id", "id"]).select("tree_id", "leaf_id", "path_rank", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = scratch.write(paths.unionAll(more))  # read twice by the next join
    return paths


def format_trees(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """messages: tree_id, id, parent_id, role, text, score. tree_id, leaf_id, path_rank, formatted, loss_spans of each chosen path."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = messages.groupBy("tree_id", "id").agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("m"))
    head = F.concat(F.lit("### "), _escape_role(F.col("m.role")), F.lit(": "))
    turn = F.struct("depth", head.alias("head"), escape(F.col("m.text")).alias("text"), (F.col("m.role") == "assistant").alias("learn"))
    paths = chosen_paths(messages, top_k).join(body, ["tree_id", "id"]).groupBy("tree_id", "leaf_id", "path_rank")
    turns = paths.agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(t["head"]) + F.char_length(t["text"]) + len(END)).alias("at"),
            F.when(
                t["learn"],
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["at"] + F.char_length(t["head"])).alias("start"),
                        (a["at"] + F.char_length(t["head"]) + F.char_length(t["text"])).alias("end"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return turns.select("tree_id", "leaf_id", "path_rank", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    head = r"(?s)^### (.*?): (.*)$"
    return F.transform(
        turns,
        lambda t: F.struct(_unescape_role(F.regexp_extract(t, head, 1)).alias("role"), unescape(F.regexp_extract(t, head, 2)).alias("text")),
    )


def masked(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees with one branch."""
    at = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(at).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree_id"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), "role", "text",
        F.lit(1.0).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    out = format_trees(chains(rows.unionByName(extra)))
    turns = read_back(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    loss = masked(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), digest.alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *,
    length(regexp_replace(regexp_replace(regexp_replace(role, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g'), ':(\\*) ', ':\\\1 ', 'g'))
    + length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '##(\\*)# ', '##\\\1# ', 'g')) + 14 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
