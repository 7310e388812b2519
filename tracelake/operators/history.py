"""Joins and windows that turn ordered calls and messages into evaluation inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_turn(rows: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(session).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def turn_history(messages: DataFrame, session: str, pos: str) -> DataFrame:
    """How many messages and characters stand before and with each turn: the running history as events, not arrays."""
    w = Window.partitionBy(session).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("history_size", F.count("*").over(w)).withColumn("history_chars", F.sum(F.length("text")).over(w))


def session_history(messages: DataFrame, session: str, pos: str) -> DataFrame:
    """The running history as an array of (role, text) per turn; meant for the rows that reach a judge."""
    w = Window.partitionBy(session).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("session_history", F.collect_list(F.struct("role", "text")).over(w))


def prior_executions(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each call the number of calls of its trace that ended by its start; of those that end at that very time
    only the ones that stand before it. Columns: pos, start, end.

    Two sorted event streams in one window instead of a pairwise join: every end adds one, every start reads the sum.
    """
    end = F.greatest("start", "end")
    ends = calls.select(*keys, F.col("pos").alias("p"), end.alias("at"), F.lit(0).alias("kind"))
    starts = calls.select(*keys, F.col("pos").alias("p"), F.col("start").alias("at"), F.lit(1).alias("kind"))
    # at one time: ends come before starts unless the end's own place is not before the start's, so order by place
    w = Window.partitionBy(*keys).orderBy("at", "p", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = ends.unionByName(starts).withColumn("prior", F.sum(1 - F.col("kind")).over(w))
    return done.where("kind = 1").select(*keys, F.col("p").alias("pos"), "prior")


def carry_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """The last value that was not null so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def recent(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def first_later_result(calls: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each call with the first result of its keys that stands after it, or null. Both have ``pos``.

    A window over both streams from the far end: no pairwise join, whatever the number of results of a key.
    """
    both = calls.select(*keys, "pos", F.lit(None).cast("long").alias("r")).unionByName(results.select(*keys, "pos", F.col("pos").alias("r")))
    w = Window.partitionBy(*keys).orderBy(F.col("pos").desc(), F.col("r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("result_pos", F.last("r", ignorenulls=True).over(w)).where("r is null")
    return seen.select(*keys, "pos", "result_pos")


def last_result(calls: DataFrame, results: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The first call and the last result of each key, wherever they stand; a missing result is empty text."""
    c = calls.groupBy(*keys).agg(F.min("pos").alias("call_pos"))
    r = results.groupBy(*keys).agg(F.max_by(value, "pos").alias("result"))
    return c.join(r, list(keys), "left").withColumn("result", F.coalesce("result", F.lit("")))


def bounded_result(rows: DataFrame, keys: Sequence[str], is_call: Column, is_result: Column) -> DataFrame:
    """Each call with the next result strictly after it and strictly before the next call of any kind."""
    w = Window.partitionBy(*keys).orderBy("pos")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    marked = rows.withColumn("__next_call", F.first(F.when(is_call, F.col("pos")), ignorenulls=True).over(ahead)).withColumn(
        "__next_result", F.first(F.when(is_result, F.col("pos")), ignorenulls=True).over(ahead)
    )
    inside = F.col("__next_call").isNull() | (F.col("__next_result") < F.col("__next_call"))
    return marked.where(is_call).select(*keys, "pos", F.when(inside, F.col("__next_result")).alias("result_pos"))


def handoffs(nodes: DataFrame) -> DataFrame:
    """(session, pos, source, target): each node of a run hands over to the one after it; the last hands over to none.
    nodes: session, pos, node."""
    after = F.lead("node").over(Window.partitionBy("session").orderBy("pos"))
    return nodes.select("session", "pos", F.col("node").alias("source"), after.alias("target"))


def incoming(nodes: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Each node's senders in order, repeats kept, as joined text. handoffs: session, pos, source, target."""
    got = handoffs.where("target is not null").groupBy("session", F.col("target").alias("node")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]), ",").alias("dependencies")
    )
    return nodes.join(got, ["session", "node"], "left").withColumn("dependencies", F.coalesce("dependencies", F.lit("")))


def tool_metrics(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(
        F.count("*").alias("call_count"), F.count_if(~F.col("failed")).alias("success_count"), F.count_if("failed").alias("error_count"), F.sum("duration").alias("total_time")
    )


def swarm_handoffs(results: DataFrame, tool: str = "handoff_to_agent") -> DataFrame:
    """A row per handoff among a node's tool metrics, or one without a target. results: session, pos, node, and calls, an
    array of (tool, target)."""
    hits = F.filter("calls", lambda c: c["tool"] == tool)
    return results.select("session", "pos", F.col("node").alias("source"), F.explode_outer(hits).alias("c")).select("session", "pos", "source", F.col("c.target").alias("target"))


def graph_interactions(nodes: DataFrame) -> DataFrame:
    """Interactions of a graph run in the order of execution; nodes without a result are left out. nodes: session, place,
    node, dependencies, messages, result."""
    return nodes.where("result is not null").select("session", "place", "node", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"), "messages")


def conversation(messages: DataFrame, session: str, pos: str) -> DataFrame:
    """``ROLE: text`` blocks of a session in order, empty ones skipped."""
    said = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct(F.col(pos), F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("said")))
    return messages.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n\n").alias("conversation"))
