"""Queries of the batch algebra, over orders as a batch in key order."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import batch as B
from millrace.sources.tables import table

QUERIES, SQL = {}, {}
BATCH = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey AS cust, o_orderstatus AS status FROM orders)"
W_ = f"WITH {BATCH}"


def _batch(s, d):
    rows = B.numbered(table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")), "k")
    return rows.select("row_id", "cust", "status")


def _n(s, d):
    return table(s, d, "orders").count()


def _longs(df):
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def _add(name, run, sql):
    QUERIES[name], SQL[name] = (lambda s, d: _longs(run(s, d))), sql


_add("bat_select", lambda s, d: _batch(s, d).select("row_id", "cust"), f"{W_} SELECT row_id, cust FROM b")
_add("bat_pop_rename", lambda s, d: _batch(s, d).drop("status").withColumnsRenamed({"cust": "customer"}), f"{W_} SELECT row_id, cust AS customer FROM b")
_add("bat_gather", lambda s, d: B.select_rows(_batch(s, d), s.range(5000).select(F.col("id").alias("at"), F.pmod(F.col("id") * 7919, F.lit(_n(s, d))).alias("row_id"))),
     f"{W_}, i AS (SELECT range AS at, range * 7919 % (SELECT count(*) FROM orders) AS row_id FROM range(5000)) SELECT i.at AS row_id, cust, status FROM b JOIN i USING (row_id)")
_add("bat_slice", lambda s, d: B.slice_rows(_batch(s, d), 5, 900, 7), f"{W_} SELECT (row_id - 5) // 7 AS row_id, cust, status FROM b WHERE row_id >= 5 AND row_id < 900 AND (row_id - 5) % 7 = 0")
_add("bat_reorder", lambda s, d: B.select_rows(_batch(s, d), _batch(s, d).select((F.lit(_n(s, d) - 1) - F.col("row_id")).alias("at"), "row_id")), f"{W_} SELECT (SELECT count(*) FROM b) - 1 - row_id AS row_id, cust, status FROM b")
_add("bat_restore", lambda s, d: B.reverse_index(_batch(s, d).select(F.pmod(F.col("row_id") + 11, F.lit(_n(s, d))).alias("at"), "row_id")), f"{W_} SELECT row_id AS at, (row_id + 11) % (SELECT count(*) FROM b) AS row_id FROM b")
_add("bat_repeat_interleave", lambda s, d: B.repeat(_batch(s, d), 3), f"{W_} SELECT row_id * 3 + range AS row_id, cust, status, range AS slot FROM b, range(3)")
_add("bat_repeat_tile", lambda s, d: B.repeat(_batch(s, d), 3, False, _n(s, d)), f"{W_} SELECT row_id + range * (SELECT count(*) FROM b) AS row_id, cust, status, range AS slot FROM b, range(3)")
_add("bat_repeat_each", lambda s, d: B.repeat_each(_batch(s, d).withColumn("times", F.col("cust") % 4), "times"), f"{W_} SELECT row_id, cust, status, cust % 4 AS times, unnest(range(cust % 4)) AS slot FROM b")
_add("bat_unfold_chunks", lambda s, d: B.unfold_chunks(_batch(s, d).withColumn("a", F.array(*[F.col("row_id") * k for k in range(6)])), "a", 3).select("row_id", "chunk", F.get("a", F.lit(0)).alias("first"), F.size("a").alias("n")),
     f"{W_} SELECT row_id, range AS chunk, row_id * range * 2 AS first, CAST(2 AS BIGINT) AS n FROM b, range(3)")
_add("bat_fold", lambda s, d: B.fold(_batch(s, d), 16).select("group", F.size("rows").alias("n"), F.expr("aggregate(rows, 0L, (a, r) -> a + r.cust)").alias("total")), f"{W_} SELECT row_id // 16 AS \"group\", count(*) AS n, CAST(sum(cust) AS BIGINT) AS total FROM b GROUP BY row_id // 16")
_add("bat_fold_unfold", lambda s, d: B.unfold(B.fold(_batch(s, d), 10)), f"{W_} SELECT row_id, cust, status FROM b")
_add("bat_pad_divisor", lambda s, d: B.pad_to_divisor(_batch(s, d), 97, _n(s, d)), f"""{W_}, n AS (SELECT count(*) AS n FROM b) SELECT row_id, cust, status, false AS is_pad FROM b
UNION ALL SELECT n + range, cust, status, true FROM n, range(96), b WHERE range < (97 - n % 97) % 97 AND b.row_id = range % n""")
_add("bat_unpad", lambda s, d: B.unpad(B.pad_to_divisor(_batch(s, d), 97, _n(s, d))), f"{W_} SELECT row_id, cust, status FROM b")
_add("bat_pad_last", lambda s, d: B.pad_with(_batch(s, d), 5, _n(s, d), False), f"{W_}, n AS (SELECT count(*) AS n FROM b) SELECT row_id, cust, status FROM b UNION ALL SELECT n + range, cust, status FROM n, range(5), b WHERE b.row_id = n - 1")
_add("bat_chunk", lambda s, d: B.chunk(_batch(s, d), 7, _n(s, d)), f"{W_} SELECT row_id, cust, status, row_id // (((SELECT count(*) FROM b) + 6) // 7) AS chunk FROM b")
_add("bat_split", lambda s, d: B.split(_batch(s, d), 100), f"{W_} SELECT row_id, cust, status, row_id // 100 AS chunk FROM b")
_add("bat_minibatch", lambda s, d: B.minibatches(_batch(s, d), 50, _n(s, d), 2, 9).select("epoch", "batch", "row_id"),
     f"{W_} SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY md5('9:' || epoch || ':' || row_id), row_id) - 1) // 50 AS batch, row_id FROM b, (SELECT range AS epoch FROM range(2))")
_add("bat_union_columns", lambda s, d: B.union_columns(_batch(s, d), _batch(s, d).select("row_id", "status", (F.col("cust") * 2).alias("twice"))), f"{W_} SELECT row_id, cust, status, cust * 2 AS twice FROM b")
_add("bat_concat", lambda s, d: B.concat(B.slice_rows(_batch(s, d), 0, 40), B.slice_rows(_batch(s, d), 40, 90)), f"{W_} SELECT row_id % 40 AS row_id, cust, status FROM b WHERE row_id < 40 UNION ALL SELECT row_id - 40, cust, status FROM b WHERE row_id >= 40 AND row_id < 90")
_add("bat_difference", lambda s, d: _batch(s, d).select("cust").exceptAll(B.slice_rows(_batch(s, d), 0, None, 2).select("cust")), f"{W_} SELECT cust FROM b EXCEPT ALL SELECT cust FROM b WHERE row_id % 2 = 0")
_add("bat_intersection", lambda s, d: _batch(s, d).select("cust").intersect(table(s, d, "customer").select(F.col("c_custkey").alias("cust")).where("cust % 3 = 0")), f"{W_} SELECT cust FROM b INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
_add("bat_sample", lambda s, d: _batch(s, d).orderBy(F.md5(F.concat(F.lit("5:"), F.col("row_id").cast("string"))), "row_id").limit(100), f"{W_} SELECT * FROM b ORDER BY md5('5:' || row_id), row_id LIMIT 100")
_add("bat_head", lambda s, d: _batch(s, d).orderBy("row_id").limit(50), f"{W_} SELECT * FROM b WHERE row_id < 50")
_add("bat_describe", lambda s, d: _batch(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cust").alias("customers"), F.min("cust").alias("lo"), F.max("cust").alias("hi")), f"{W_} SELECT count(*) AS n, count(DISTINCT cust) AS customers, min(cust) AS lo, max(cust) AS hi FROM b")
_add("bat_columns_to_lists", lambda s, d: _batch(s, d).groupBy("status").agg(F.size(F.collect_list("cust")).alias("n"), F.expr("aggregate(collect_list(cust), 0L, (a, x) -> a + x)").alias("total")), f"{W_} SELECT status, count(*) AS n, CAST(sum(cust) AS BIGINT) AS total FROM b GROUP BY status")


def _ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_SEQ = "CASE WHEN row_id % 9 = 0 THEN [] ELSE range(row_id % 9) END"


def _arrays(s, d):
    x = F.when(F.col("row_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("row_id") % 9 - 1, F.lit(0))))
    return _batch(s, d).select("row_id", x.alias("x"))


def _joined(expr):
    return f"array_to_string({expr}, ',')"


_add("arr_pad_right", lambda s, d: _arrays(s, d).select("row_id", _ints(B.pad_array(F.col("x"), 6, F.lit(-1).cast("long"))).alias("x")), f"{W_} SELECT row_id, {_joined(f'list_resize({_SEQ}, 6, -1)')} AS x FROM b")
_add("arr_pad_left", lambda s, d: _arrays(s, d).select("row_id", _ints(B.pad_array(F.col("x"), 6, F.lit(-1).cast("long"), True)).alias("x")), f"{W_}, a AS (SELECT row_id, {_SEQ} AS x FROM b) SELECT row_id, {_joined('list_concat([-1 FOR i IN range(greatest(6 - len(x), 0))], x[greatest(len(x) - 6, 0) + 1:])')} AS x FROM a")
for _how, _cut in (("left", "x[len(x) - 3:]"), ("right", "x[:4]"), ("middle", "list_concat(x[:2], x[len(x) - 1:])")):
    _add(f"arr_truncate_{_how}", lambda s, d, h=_how: _arrays(s, d).select("row_id", _ints(B.truncate(F.col("x"), 4, h)).alias("x")), f"{W_}, a AS (SELECT row_id, {_SEQ} AS x FROM b) SELECT row_id, {_joined(f'CASE WHEN len(x) > 4 THEN {_cut} ELSE x END')} AS x FROM a")
_add("arr_first_eos_mask", lambda s, d: _arrays(s, d).select("row_id", _ints(B.mask_to_first(F.transform("x", lambda v: v % 5), F.lit(3).cast("long"))).alias("m")),
     f"{W_}, a AS (SELECT row_id, [v % 5 FOR v IN {_SEQ}] AS x FROM b) SELECT row_id, {_joined('[CASE WHEN NOT list_contains(x, 3) OR i <= list_position(x, 3) THEN 1 ELSE 0 END FOR i IN range(1, len(x) + 1)]')} AS m FROM a")
_add("arr_position_ids", lambda s, d: _arrays(s, d).select("row_id", _ints(B.position_ids(F.transform("x", lambda v: (v > 1).cast("int")))).alias("p")), f"{W_}, a AS (SELECT row_id, {_SEQ} AS x FROM b) SELECT row_id, {_joined('[greatest(v - 2, 0) FOR v IN x]')} AS p FROM a")
_add("arr_mask_slice", lambda s, d: _arrays(s, d).where(F.size("x") >= 3).select("row_id", _ints(F.slice("x", -3, 3)).alias("x")), f"{W_}, a AS (SELECT row_id, {_SEQ} AS x FROM b) SELECT row_id, {_joined('x[len(x) - 2:]')} AS x FROM a WHERE len(x) >= 3")


def _messages(s, d):
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))


_add("arr_loss_mask", lambda s, d: _messages(s, d).select("conv_id", F.size(B.loss_mask(F.col("messages"))).alias("n"), F.aggregate(B.loss_mask(F.col("messages")), F.lit(0), lambda a, x: a + x).alias("on")),
     "SELECT conv_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n, CAST(sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END) AS BIGINT) AS \"on\" FROM conversations GROUP BY conv_id")
_add("src_multiturn", lambda s, d: _messages(s, d).select("conv_id", F.size("messages").alias("turns"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), 256).alias("digest")),
     "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
_add("str_conversation_clean", lambda s, d: _messages(s, d).select("conv_id", F.md5(F.array_join(F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.concat(m["role"], F.lit(": "), F.trim(m["content"]))), "\n")).alias("digest")),
     "SELECT conv_id, md5(coalesce(string_agg(role || ': ' || trim(text, ' '), chr(10) ORDER BY turn) FILTER (role <> 'system'), '')) AS digest FROM conversations GROUP BY conv_id")
