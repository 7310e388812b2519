"""Streams of calls: sessions closed by a gap, scored as they close, and a bounded memory of recent calls."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions import scoring
from tracelake.operators.experiments import merged
from tracelake.runtime import broadcast_if_small


def session_scores(calls: DataFrame, expected: list[str], gap: str = "30 minutes", late: str = "10 minutes", score=scoring.in_order_match) -> DataFrame:
    """A row per closed session (columns session, ts, event_id, tool): calls in order of time, and their score.

    Works on a stream, where the watermark closes sessions and bounds the state, and on a batch alike.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool"))), lambda x: x["tool"])
    closed = calls.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(steps.alias("actual"), F.count("*").alias("n_calls"))
    want: Column = F.array(*map(F.lit, expected))
    return closed.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_calls", score(F.col("actual"), want).alias("score"))


def windowed_metrics(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and total duration per tool and window of event time."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool").agg(
        F.count("*").alias("call_count"), F.count_if("failed").alias("error_count"), F.sum("duration").alias("total_time")
    ).select(F.col("w.start").alias("start"), "tool", "call_count", "error_count", "total_time")


def recent_per_key(calls: DataFrame, keep: int = 20) -> DataFrame:
    """Per key (session, tool) the ids of its last ``keep`` calls after each batch; the state never holds more."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: list[int] = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        known = (known + rows["event_id"].tolist())[-keep:]
        state.update((known,))
        yield pd.DataFrame({"session": [key[0]], "tool": [key[1]], "recent": [",".join(map(str, known))], "n": [len(known)]})

    return calls.groupBy("session", "tool").applyInPandasWithState(step, "session long, tool string, recent string, n int", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


# --- spans and conversations as streams ------------------------------------------------------------------------------------


def stamped(spans: DataFrame, context: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Spans of a stream with the context (session and other tags) under which their run was started, as attributes that a
    span's own ones beat. ``context`` is a static table of few runs: keys, and ``baggage``, a map."""
    joined = spans.join(broadcast_if_small(context), list(keys), "left")
    return joined.withColumn("attributes", merged(F.col("baggage"), F.col("attributes"))).drop("baggage")


def span_log(spans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of spans as a growing table by session; the micro-batches' files are complete or absent."""
    return spans.writeStream.format("parquet").partitionBy("session_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_spans(spark: SparkSession, path: str, session: str) -> DataFrame:
    """One session's spans of a growing table; other sessions' folders are not read, so cases need no cleared buffer."""
    return spark.read.parquet(path).where(F.col("session_id") == session)


def attempts_kept(turns: DataFrame, keys: tuple[str, ...] = ("case_name",)) -> DataFrame:
    """The conversation that stands at the end of each case, where ``restore`` rows put it back to an earlier state. turns:
    keys, turn, event (``say`` or ``restore``), text, and to, the number of messages to go back to. What was taken back is
    in ``pruned``."""
    steps = F.array_sort(F.collect_list(F.struct("turn", "event", "text", "to")))
    texts = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        back = x["event"] == "restore"
        n = F.coalesce(x["to"], F.lit(0))
        kept = F.slice(a["kept"], F.lit(1), n)
        gone = F.slice(a["kept"], n + 1, F.greatest(F.size(a["kept"]) - n, F.lit(0)))
        return F.struct(F.when(back, kept).otherwise(F.concat(a["kept"], F.array(x["text"]))).alias("kept"), F.when(back, F.concat(a["pruned"], gone)).otherwise(a["pruned"]).alias("pruned"))

    folded = F.aggregate(steps, F.struct(texts.alias("kept"), texts.alias("pruned")), step)
    return turns.groupBy(*keys).agg(folded.alias("r")).select(*keys, "r.kept", "r.pruned")


def judge_conversations(interactions: DataFrame, keys: tuple[str, ...] = ("case_name",), order: str = "pos") -> DataFrame:
    """What a judge that sees a case's interactions one after the other has read at each: all prompts and answers before
    it, and its own prompt."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = F.collect_list(F.struct("prompt", "answer")).over(w)
    lines = F.transform(told, lambda x: F.concat_ws("\n", x["prompt"], x["answer"]))
    return interactions.withColumn("conversation", F.concat_ws("\n", F.array_join(lines, "\n"), "prompt"))


def joined_deltas(deltas: DataFrame, keys: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Answers that came in pieces, joined in their order: keys, at, delta."""
    return deltas.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "delta"))), lambda x: x["delta"]), "").alias("response"))
