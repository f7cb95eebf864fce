"""Queries on replies, conversations, definitions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import audit as A
from vellum.operators import grounding as G
from vellum.plans.fixtures import ctes, load
from vellum.plans.registry import query
from vellum.plans.scalars import _TOK
from vellum.sources.shared import shared_dir
from vellum.streaming.conversations import conversation_stream, latest_states


@query("f1_chatty_json", ctes("replies") + "SELECT r.event_id, CASE WHEN r.event_id % 10 <> 0 THEN CASE WHEN r.event_id % 10 <> 1 AND r.event_id % 3 = 0 THEN substring(props, 1, length(props) - 1) || '}' ELSE props END END AS json_text FROM replies r JOIN events e USING (event_id)")
def f1(spark, d):
    return load(spark, d, "replies").select("event_id", T.chatty_json(F.col("reply")).alias("json_text"))


@query("f2_conversation_state", "SELECT conv_id, turn, role, text, count(*) OVER w AS n_messages, CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)")
def f2(spark, d):
    return G.conversation_state(load(spark, d, "conversations"))


@query("f2_conversation_stream", "SELECT conv_id, turn, role, text, count(*) OVER w AS n_messages, CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS n_chars FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)")
def f2s(spark, d):
    """Turns as a stream in two lots with a restart between them: first those of odd number, then all, so that the even ones are late and the odd ones come again."""
    arrived, states, state = (shared_dir(spark, n) for n in ("turns", "states", "state"))
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    for lot in (turns.filter("turn % 2 = 1"), turns):
        lot.write.mode("append").parquet(arrived)
        conversation_stream(spark, spark.readStream.schema(turns.schema).parquet(arrived), states, state).awaitTermination()
    return latest_states(spark, states)


@query("f2_final_state", "SELECT conv_id, count(*) AS n_messages, list(role || ': ' || text ORDER BY turn, role, text) AS messages, last(role ORDER BY turn, role, text) AS last_role FROM conversations GROUP BY conv_id")
def f2f(spark, d):
    return G.final_state(load(spark, d, "conversations"))


@query("f3_citations", ctes("chunks") + "SELECT chunk_id, source AS source_file, page_number, substring(clean_text, 1, 120) AS blurb FROM chunks")
def f3(spark, d):
    return G.citations(load(spark, d, "chunks"))


@query("f3_cell_citations", ctes("cells") + "SELECT doc, sheet, chr((64 + col_no)::INT) || row_no AS native_id, value AS blurb FROM cells WHERE value IS NOT NULL")
def f3c(spark, d):
    return G.cell_citations(load(spark, d, "cells"))


_DEFS = """defs AS (SELECT doc, clause_no, unnest(regexp_extract_all(text, '"([^"]+)" means ([^.]+)\\.', 1)) AS term, unnest(regexp_extract_all(text, '"([^"]+)" means ([^.]+)\\.', 2)) AS meaning FROM clauses)"""


@query("f4_definitions_extract", ctes("clauses").rstrip() + f", {_DEFS} SELECT doc, clause_no, term, meaning FROM defs")
def f4(spark, d):
    return G.definitions_extract(load(spark, d, "clauses"))


@query(
    "f5_term_injection",
    r"""WITH c AS (SELECT 'k' || p_partkey AS chunk_id, ' ' || array_to_string(list_filter(string_split_regex(lower('The ' || p_name || ' of ' || p_brand), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM part),
    d AS (SELECT DISTINCT p_name AS term, 'a kind of ' || p_name AS meaning, array_to_string(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{Nd}]+'), lambda x: x <> ''), ' ') AS k FROM part)
    SELECT DISTINCT chunk_id, term, meaning FROM c JOIN d ON contains(c.t, ' ' || d.k || ' ')""",
)
def f5(spark, d):
    part = load(spark, d, "part")
    chunks = part.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_brand").alias("clean_text"))
    definitions = part.select(F.col("p_name").alias("term"), F.concat(F.lit("a kind of "), "p_name").alias("meaning"))
    return G.term_injection(chunks, definitions)


@query("f6_context_budget", ctes("chunks") + f"SELECT * FROM (SELECT source AS query_id, chunk_id, seq AS rank, token_count, CAST(sum(token_count) OVER (PARTITION BY source ORDER BY seq) AS BIGINT) AS used FROM (SELECT *, len({_TOK.format('clean_text')}) AS token_count FROM chunks)) WHERE used <= 4000")
def f6(spark, d):
    ranked = G.token_counted(load(spark, d, "chunks")).select(F.col("source").alias("query_id"), "chunk_id", F.col("seq").alias("rank"), "token_count")
    return G.context_budget(ranked, 4000)


@query("f7_ratio_calculator", "SELECT o_custkey AS entity, round(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18, 2)) END)::DOUBLE / nullif(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18, 2)) END), 0)::DOUBLE, 6) AS ratio FROM orders GROUP BY o_custkey")
def f7(spark, d):
    metrics = load(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").alias("metric"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    exact = metrics.groupBy("entity", "metric").agg(F.sum("value").cast("double").alias("value"))
    return A.ratios(exact, "open", "filled").withColumn("ratio", F.round("ratio", 6))


@query("f8_cost_rollup", ctes("chunks") + f"SELECT doc_hash, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n * CASE type WHEN 'text' THEN 0.001::DOUBLE WHEN 'visual' THEN 0.004::DOUBLE ELSE 0 END), 6) AS cost FROM (SELECT *, len({_TOK.format('clean_text')}) AS n FROM chunks) GROUP BY doc_hash")
def f8(spark, d):
    prices = spark.createDataFrame([("text", 0.001), ("visual", 0.004)], "type string, per_token double")
    return A.cost_rollup(G.token_counted(load(spark, d, "chunks")), prices).withColumn("cost", F.round("cost", 6))


_MONEY = "CAST(round({}, 2) AS DECIMAL(18, 4))"


@query(
    "f9_summation_audit",
    f"""SELECT key, coalesce(s, 0)::DOUBLE AS segment_sum, total::DOUBLE AS total, (total - coalesce(s, 0))::DOUBLE AS gap, CASE WHEN total - coalesce(s, 0) > 0.01 THEN 'Other/Unlabeled' WHEN total - coalesce(s, 0) < -0.01 THEN 'double count' ELSE 'balanced' END AS verdict
    FROM (SELECT o_orderkey AS key, {_MONEY.format('o_totalprice')} AS total FROM orders) LEFT JOIN (SELECT l_orderkey AS key, sum({_MONEY.format('l_extendedprice')}) AS s FROM lineitem GROUP BY l_orderkey) USING (key)""",
)
def f9(spark, d):
    exact = lambda c: F.round(c, 2).cast("decimal(18,4)")
    segments = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), exact("l_extendedprice").alias("value"))
    totals = load(spark, d, "orders").select(F.col("o_orderkey").alias("key"), exact("o_totalprice").alias("total"))
    return A.summation_audit(segments, totals).withColumns({c: F.col(c).cast("double") for c in ("segment_sum", "total", "gap")})


_STEPS = """steps AS (SELECT user_id AS key, event_id AS step, cents AS delta, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS BIGINT) AS level FROM (SELECT user_id, event_id, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents FROM events))"""


@query("f10_bridge_audit", f"WITH {_STEPS} SELECT *, off = 0 AS holds FROM (SELECT key, count(*) AS n_steps, arg_min(level, step) AS start, arg_max(level, step) AS last, count(*) FILTER (WHERE abs(before + delta - level) > 0.01) AS off FROM (SELECT *, lag(level) OVER (PARTITION BY key ORDER BY step) AS before FROM steps) GROUP BY key)")
def f10(spark, d):
    cents = F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")
    from pyspark.sql import Window

    run = F.sum("delta").over(Window.partitionBy("key").orderBy("step"))
    steps = load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), cents.alias("delta"))
    return A.bridge_audit(steps.withColumn("level", run + F.when(F.col("step") % 97 == 0, 5).otherwise(0)))


_LABEL = "CASE o_orderkey % 5 WHEN 0 THEN '''' || strftime(o_orderdate, '%y') WHEN 1 THEN 'FY' || year(o_orderdate) || 'E' WHEN 2 THEN 'LTM ' || year(o_orderdate) WHEN 3 THEN 'Q1 ''' || strftime(o_orderdate, '%y') ELSE CAST(year(o_orderdate) AS VARCHAR) END"
_TITLE = "CASE WHEN o_orderkey % 7 = 0 THEN 'Outlook' ELSE o_orderpriority END"


@query(
    "f11_period_tag",
    f"""SELECT o_orderkey, year, shown, kind FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 IN (0, 3) THEN '20' || strftime(o_orderdate, '%y') ELSE CAST(year(o_orderdate) AS VARCHAR) END AS INT) AS year,
        CASE o_orderkey % 5 WHEN 0 THEN '20' || strftime(o_orderdate, '%y') WHEN 1 THEN 'FY' || year(o_orderdate) || 'E' WHEN 2 THEN 'Last Twelve Months ' || year(o_orderdate) WHEN 3 THEN 'Q1 20' || strftime(o_orderdate, '%y') ELSE CAST(year(o_orderdate) AS VARCHAR) END AS shown,
        CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 7 = 0 THEN 'Projected' ELSE 'Actual' END AS kind FROM orders)""",
)
def f11(spark, d):
    yy, yyyy, k = F.date_format("o_orderdate", "yy"), F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    label = F.when(k == 0, F.concat(F.lit("'"), yy)).when(k == 1, F.concat(F.lit("FY"), yyyy, F.lit("E"))).when(k == 2, F.concat(F.lit("LTM "), yyyy)).when(k == 3, F.concat(F.lit("Q1 '"), yy)).otherwise(yyyy)
    title = F.when(F.col("o_orderkey") % 7 == 0, "Outlook").otherwise(F.col("o_orderpriority"))
    tags = A.period_tag(F.col("label"), F.col("title"))
    return load(spark, d, "orders").select("o_orderkey", label.alias("label"), title.alias("title")).select("o_orderkey", *(v.alias(n) for n, v in tags.items()))


@query("f12_magnitude_check", ctes("shapes") + "SELECT *, largest_block = largest_value AS agrees FROM (SELECT figure_id AS key, first(seq ORDER BY area DESC, seq DESC) AS largest_block, first(seq ORDER BY value DESC, seq DESC) AS largest_value FROM (SELECT figure_id, seq, (x1 - x0) * (y1 - y0) AS area, seq * 7 % 101 AS value FROM shapes) GROUP BY figure_id)")
def f12(spark, d):
    shapes = load(spark, d, "shapes")
    return A.magnitude_check(shapes.select(F.col("figure_id").alias("key"), F.col("seq").alias("block"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), (F.col("seq") * 7 % 101).alias("value")))
