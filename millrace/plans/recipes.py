"""Queries of recipe builders and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import recipes as R
from millrace.sources.tables import TRAJ, r6, s6, table, trajectories

QUERIES, SQL = {}, {}


def _docs(s, d):
    return table(s, d, "documents")


def _add(name, run, sql):
    QUERIES[name], SQL[name] = run, sql


_add("rcp_five_fields", lambda s, d: R.five_fields(_docs(s, d), "corpus", "read", F.concat(F.lit("Q: "), "text"), F.col("lang"), "doc_id", "train").select("data_source", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), "reward_model.ground_truth", "extra_info.index", "extra_info.split"),
     "SELECT 'corpus' AS data_source, md5('Q: ' || text) AS prompt, lang AS ground_truth, row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", 'train' AS split FROM documents")
_add("rcp_unpivot_preferences", lambda s, d: R.unpivot_preferences(_docs(s, d).select(F.col("doc_id").alias("prompt"), F.md5("text").alias("chosen"), F.md5("lang").alias("rejected"))),
     "SELECT doc_id AS prompt, md5(text) AS response, true AS chosen FROM documents UNION ALL SELECT doc_id, md5(lang), false FROM documents")
_add("rcp_media_segments", lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.transform(R.media_segments(F.concat(F.lit("<image>"), F.col("lang"), F.lit("<video><image>x"), F.col("source"))), lambda p: F.concat_ws("=", p["type"], p["text"])), "|").alias("x")),
     "SELECT doc_id, 'image|text=' || lang || '|video|image|text=x' || source AS x FROM documents")
_add("rcp_shuffled_options", lambda s, d: _docs(s, d).select("doc_id", R.shuffled_options(F.array(F.lit("w"), F.lit("x"), F.lit("y"), F.col("lang")), F.col("lang"), F.col("doc_id").cast("string"), 4).alias("o")).select("doc_id", F.array_join("o.options", ",").alias("options"), "o.letter"),
     """WITH o AS (SELECT doc_id, lang, unnest(['w', 'x', 'y', lang]) AS o FROM documents), l AS (SELECT doc_id, any_value(lang) AS lang, list(o ORDER BY md5('4:' || doc_id || ':' || o), o) AS l FROM o GROUP BY doc_id)
SELECT doc_id, array_to_string(l, ',') AS options, chr(CAST(64 + list_position(l, lang) AS INT)) AS letter FROM l""")
_add("rcp_config_counts", lambda s, d: R.config_counts(s.createDataFrame([("en",), ("fr",), ("xx",)], "config string"), _docs(s, d).withColumnRenamed("lang", "config")),
     "SELECT c AS config, (SELECT count(*) FROM documents WHERE lang = c) AS n FROM (VALUES ('en'), ('fr'), ('xx')) t(c)")
_add("flt_too_long", lambda s, d: _docs(s, d).where(~R.too_long(F.size(F.split("text", " ")), 300)).select("doc_id"), "SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 300")
_add("flt_labelled", lambda s, d: _docs(s, d).join(table(s, d, "labels"), "doc_id", "left").where(F.length(F.coalesce(F.col("quality").cast("string"), F.lit(""))) > 0).select("doc_id"), "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
_LINES = "CASE doc_id % 4 WHEN 0 THEN 'x' || chr(10) || 'B. because' || chr(10) || 'end' WHEN 1 THEN '<answer>c</answer>' WHEN 2 THEN 'A' || chr(10) || 'D:' ELSE lower(text) END"


def _lines(s, d):
    k = F.col("doc_id") % 4
    return _docs(s, d).select("doc_id", F.when(k == 0, "x\nB. because\nend").when(k == 1, "<answer>c</answer>").when(k == 2, "A\nD:").otherwise(F.lower("text")).alias("t"))


_add("str_official_thinking", lambda s, d: _lines(s, d).select("doc_id", R.official_letter(F.col("t"), "thinking").alias("x")), rf"""WITH r AS (SELECT doc_id, {_LINES} AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_extract(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^([ABCD])($|[.:])', 1)), lambda x: x <> '') AS found FROM r)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)<answer>\s*[ABCD]\s*</answer>') THEN upper(regexp_extract(t, '(?i)<answer>\s*([ABCD])\s*</answer>', 1)) ELSE found[-1] END AS x FROM l""")
_add("str_official_direct", lambda s, d: _lines(s, d).select("doc_id", R.official_letter(F.col("t"), "direct").alias("x")), f"SELECT doc_id, nullif(regexp_extract(upper({_LINES}), '([ABCD])', 1), '') AS x FROM documents")
_add("rwd_choice", lambda s, d: _docs(s, d).select("doc_id", R.choice_score(F.concat("text", F.lit("\nANSWER: $"), F.when(F.col("doc_id") % 2 == 0, "B").otherwise("C"), F.lit("$")), F.lit("B")).alias("score")), "SELECT doc_id, CAST(doc_id % 2 = 0 AS DOUBLE) AS score FROM documents")


def _conv(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("m"))


_add("rwd_new_words", lambda s, d: _conv(s, d).select("conv_id", R.new_words(F.col("m"), F.lit(2)).cast("long").alias("n")),
     r"SELECT conv_id, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) FILTER (k > 2), 0) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
_BOX = "CASE o_orderkey % 5 WHEN 0 THEN 'a \\boxed{' || o_custkey || '} ' WHEN 1 THEN '\\boxed{1} \\boxed{2}' WHEN 2 THEN '\\boxed{1} \\boxed{1}' WHEN 3 THEN '\\boxed{x' ELSE '\\boxed{1} tail' END"


def _boxes(s, d):
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.concat(F.lit("a \\boxed{"), F.col("o_custkey").cast("string"), F.lit("} "))).when(k == 1, "\\boxed{1} \\boxed{2}").when(k == 2, "\\boxed{1} \\boxed{1}").when(k == 3, "\\boxed{x").otherwise("\\boxed{1} tail")
    return table(s, d, "orders").select("o_orderkey", t.alias("t"))


_add("str_terminal_box", lambda s, d: _boxes(s, d).select("o_orderkey", R.terminal_box("t").alias("x")), """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'parsed|\\boxed{' || o_custkey || '}' WHEN 1 THEN 'ambiguous:conflicting_markers|' WHEN 2 THEN 'invalid:duplicate_same_marker|'
WHEN 3 THEN 'invalid:math_parse_failure|' ELSE 'invalid:prompt_contract_mismatch|' END AS x FROM orders""")
_add("str_tolerant_json", lambda s, d: table(s, d, "events").select("event_id", R.tolerant_json(F.concat(F.lit("noise { x "), F.replace("props", F.lit('"'), F.lit("'")), F.lit(" end"))).alias("x")), "SELECT event_id, props AS x FROM events")
_add("rwd_error_step", lambda s, d: table(s, d, "orders").select("o_orderkey", R.box_is_error_step((F.col("o_custkey") % 4 - 2).cast("string")).alias("x")), "SELECT o_orderkey, o_custkey % 4 - 2 <> -1 AS x FROM orders")
_add("rwd_geometry", lambda s, d: table(s, d, "orders").select("o_orderkey", r6(R.geometry_score(F.lit("<think>a</think> \\boxed{1}"), (F.col("o_custkey") % 3).cast("string"), F.lit("1.0"))).alias("x")), f"SELECT o_orderkey, {s6('CASE WHEN o_custkey % 3 = 1 THEN 1.0 ELSE 0.1 END')} AS x FROM orders")
_add("rwd_kl_penalty", lambda s, d: R.kl_reward(trajectories(s, d), 0.3, F.col("old_lp") - F.col("new_lp")).select("uid", "slot", r6("reward").alias("reward")), f"WITH {TRAJ} SELECT uid, slot, {s6('score - 0.3 * (old_lp - new_lp) * mask')} AS reward FROM traj")
for _m, _w in {"pow": "pow(abs(score), 2)", "max_min": "CASE WHEN score = max(score) OVER () OR score = min(score) OVER () THEN 1 ELSE 0 END", "max_random": "CASE WHEN score = max(score) OVER () THEN 0.4 ELSE 0.1 END"}.items():
    _add(f"adv_resampling_{_m}", lambda s, d, m=_m: R.resampling_weights(trajectories(s, d), m).select("uid", "slot", r6("weight").alias("weight")), f"WITH {TRAJ} SELECT uid, slot, {s6(f'{_w} + 1e-8')} AS weight FROM traj")
_add("adv_resample", lambda s, d: R.resample(R.resampling_weights(trajectories(s, d), "max_random")).select("uid", "slot", F.col("times").cast("long").alias("times")), f"""WITH {TRAJ},
w AS (SELECT uid, slot, CASE WHEN score = max(score) OVER () THEN 40000001 ELSE 10000001 END::HUGEINT AS w FROM traj), r AS (SELECT *, sum(w) OVER (ORDER BY uid, slot) AS upto, sum(w) OVER () AS total, count(*) OVER () AS n FROM w)
SELECT uid, slot, CAST((2 * upto * n + total) // (2 * total) - (2 * (upto - w) * n + total) // (2 * total) AS BIGINT) AS times FROM r""")
_add("adv_prime_rloo", lambda s, d: R.prime_rloo(trajectories(s, d).select("uid", F.col("perm").alias("rollout"), "slot", "score", "mask")).select("uid", "slot", r6("value").alias("value"), r6("returns").alias("returns")),
     f"""WITH {TRAJ}, m AS (SELECT uid, perm, avg(CASE WHEN mask = 1 THEN score END) AS m FROM traj GROUP BY ALL), g AS (SELECT uid, sum(m) AS s, count(*) AS n FROM m GROUP BY uid HAVING count(*) > 1),
v AS (SELECT uid, perm, slot, mask, CASE WHEN mask = 1 THEN score * n / (n - 1) - s / (n - 1) ELSE 0 END AS v FROM traj JOIN g USING (uid))
SELECT uid, slot, {s6("v")} AS value, {s6("sum(v * mask) OVER (PARTITION BY uid, perm ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")} AS returns FROM v""")
_add("gat_row_contract", lambda s, d: R.contract_faults(table(s, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") % 2).alias("permutation_id"), F.when(F.col("l_linestatus") == "F", "AB").otherwise("BA").alias("label"), F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("truth"))),
     """WITH r AS (SELECT l_orderkey AS p, l_linenumber % 2 AS k, CASE WHEN l_linestatus = 'F' THEN 'AB' ELSE 'BA' END AS label, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS truth FROM lineitem)
SELECT 'label' AS fault, count(*) FILTER (label <> CASE WHEN k = 0 THEN 'AB' ELSE 'BA' END) AS n FROM r UNION ALL SELECT 'truth', count(*) FILTER (truth <> CASE WHEN k = 0 THEN 'A' ELSE 'B' END) FROM r
UNION ALL SELECT 'incomplete_pair', count(*) FROM (SELECT p FROM r GROUP BY p HAVING count(*) <> 2 OR count(DISTINCT k) <> 2)""")
_add("udf_tool_calls", lambda s, d: table(s, d, "events").select("event_id", R.tool_calls(F.concat(F.lit("go <tool_call> {\"name\": \"f\", \"arguments\": "), "props", F.lit("} </tool_call>")))[0].alias("c")).select("event_id", "c.name", F.element_at("c.arguments", "k").alias("k")), "SELECT event_id, 'f' AS name, props->>'$.k' AS k FROM events")


def _collapsed(s, d):
    msg = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")))
    rows = _docs(s, d).select(msg.alias("prompt"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("g").alias("ground_truth"), F.lit(None).cast("string").alias("single_turn_completion"), F.col("source").alias("completion"), "doc_id")
    return R.collapse_interaction(rows, "Help.", ("doc_id",)).select(F.col("extra_info.doc_id").alias("doc_id"), "ground_truth", F.size("prompt").alias("turns"), F.col("prompt")[0]["content"].alias("system"))


_add("rcp_collapse", _collapsed, "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'g' END AS ground_truth, CAST(2 AS INT) AS turns, 'Help.' AS system FROM documents")
