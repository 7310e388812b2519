"""The driver's tables seen as the engine's model: calls, messages, cases, judged rows and span trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.runtime import table


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: a session is a user, a trace a user's day, a tool an event type; calls last ``value`` minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("session"), F.date_format("ts", "yyyy-MM-dd").alias("trace_id"), F.col("event_type").alias("tool"), F.row_number().over(w).alias("pos"),
        start.alias("start"), (start + F.floor(F.col("value") * 60_000_000).cast("long")).alias("end"), F.col("value").alias("duration"),
        (F.col("event_type") == "error").alias("failed"), "props", "event_id", "ts",
    )


CALLS_SQL = """calls as (select user_id as session, strftime(ts, '%Y-%m-%d') as trace_id, event_type as tool,
  row_number() over (partition by user_id order by ts, event_id) as pos, epoch_us(ts) as "start",
  epoch_us(ts) + cast(floor(value * 60000000) as bigint) as "end", value as duration, event_type = 'error' as failed, props, event_id, ts from events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged rows: a case is a source, a row a document; unlabelled documents were not judged."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.select("doc_id", "source").join(l, "doc_id", "left")
    known = F.col("quality").isNotNull()
    return rows.select(
        F.col("source").alias("case_name"), F.col("doc_id").alias("row_pos"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("doc_id") % 3 != 0).alias("test_pass"),
        F.when(known & (F.col("quality") == 0), F.concat(F.lit("low "), F.col("doc_id").cast("string"))).when(known, F.lit("")).alias("reason"),
        F.when(~known, F.lit("not_applicable")).alias("label"),
    )


JUDGED_SQL = """judged as (select d.source as case_name, d.doc_id as row_pos, coalesce(cast(l.quality as double), 0.0) as score,
  case when l.quality is null then d.doc_id % 3 <> 0 else l.quality = 1 and l.toxic = 0 end as test_pass,
  case when l.quality = 0 then 'low ' || d.doc_id when l.quality is not null then '' end as reason,
  case when l.quality is null then 'not_applicable' end as label from documents d left join labels l on d.doc_id = l.doc_id)"""


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adversarial runs: a case is a customer and a strategy, a row an order judged by its priority."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    score = F.round((F.col("o_orderkey") % 11) / 10, 1)
    return rows.select(
        F.concat(F.lit("c"), "c_custkey", F.lit("__"), "c_mktsegment").alias("case_name"), F.concat(F.lit("c"), "c_custkey").alias("base"), F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("evaluator"), score.alias("score"), (score < 0.3).alias("test_pass"), F.concat(F.lit("order "), "o_orderkey").alias("reason"),
        F.col("r_name").alias("risk_category"), F.col("c_mktsegment").alias("strategy"),
    )


ATTACKS_SQL = """attacks as (select 'c' || c_custkey || '__' || c_mktsegment as case_name, 'c' || c_custkey as base, o_orderkey as pos, o_orderpriority as evaluator,
  round((o_orderkey % 11) / 10.0, 1)::double as score, round((o_orderkey % 11) / 10.0, 1)::double < 0.3::double as test_pass, 'order ' || o_orderkey as reason,
  r_name as risk_category, c_mktsegment as strategy
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree per order: a line hangs under the line of half its number, which may be missing; line 1 and some others
    are agents."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("rf"), F.min("l_shipdate").alias("sd"), F.min("l_partkey").alias("pk"))
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").cast("string").alias("trace_id"), n.cast("string").alias("span_id"), F.when(n > 1, F.floor(n / 2).cast("int").cast("string")).alias("parent_span_id"),
        n.cast("long").alias("span_pos"), F.when((n == 1) | (F.col("pk") % 4 == 0), "invoke_agent").when(F.col("rf") == "N", "execute_tool").otherwise("inference").alias("span_type"),
        (F.col("pk") % 5 != 0).alias("has_content"), F.unix_micros(F.col("sd").cast("timestamp")).alias("start"),
    )


TREE_SQL = """tree as (select cast(l_orderkey as varchar) as trace_id, cast(l_linenumber as varchar) as span_id,
  case when l_linenumber > 1 then cast(l_linenumber // 2 as varchar) end as parent_span_id, cast(l_linenumber as bigint) as span_pos,
  case when l_linenumber = 1 or min(l_partkey) % 4 = 0 then 'invoke_agent' when min(l_returnflag) = 'N' then 'execute_tool' else 'inference' end as span_type,
  min(l_partkey) % 5 <> 0 as has_content, epoch_us(min(l_shipdate)) as "start" from lineitem group by l_orderkey, l_linenumber)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
