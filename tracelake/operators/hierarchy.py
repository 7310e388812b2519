"""Span trees: nearest marked ancestors, owners of tool calls, and pruning to failing paths.

Nearest ancestors are found by pointer jumping: each round every open span takes over its pointer's pointer, so a
tree of depth d takes log2(d) joins on (trace, span). Rounds are written out, which cuts the lineage. Spans on a cycle
never resolve and have no ancestor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.runtime import Scratch

#: Rounds of pointer jumping (trees of a million levels).
MOST_ROUNDS = 20


def nearest_ancestor(spans: DataFrame, stop: Column, of: Column | None = None) -> DataFrame:
    """(trace_id, span_id, ancestor): for spans where ``of`` holds, the nearest ancestor where ``stop`` holds, or null.
    ``spans`` has trace_id, span_id, parent_span_id."""
    scratch = Scratch(spans.sparkSession, "ancestors")
    kind = spans.schema["span_id"].dataType
    asked = F.coalesce(F.lit(True) if of is None else of, F.lit(False)).alias("asked")
    tree = scratch.keep(spans.where("span_id is not null").select("trace_id", "span_id", "parent_span_id", F.coalesce(stop, F.lit(False)).alias("stops"), asked), "tree")
    above = tree.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("stops").alias("parent_stops"))
    now = tree.join(above, ["trace_id", "parent_span_id"], "left").select(
        "trace_id", "span_id", "asked", F.when(~F.col("parent_stops"), F.col("parent_span_id")).alias("pointer"), F.when(F.col("parent_stops"), F.col("parent_span_id")).alias("ancestor")
    )
    now = scratch.keep(now, "round")
    done: list[DataFrame] = []  # spans without a pointer, by the round that closed them; a round writes open ones only
    for _ in range(MOST_ROUNDS):
        done.append(now.where("pointer is null"))
        open_ = now.where("pointer is not null")
        if open_.isEmpty():
            break
        known = reduce(DataFrame.unionByName, [*done, open_])
        step = known.select("trace_id", F.col("span_id").alias("pointer"), F.col("pointer").alias("next"), F.col("ancestor").alias("found"))
        now = scratch.keep(open_.join(step, ["trace_id", "pointer"], "left").select("trace_id", "span_id", "asked", F.col("next").alias("pointer"), F.coalesce("ancestor", "found").alias("ancestor")), "round")
    else:
        done.append(now)  # spans on a cycle
    return reduce(DataFrame.unionByName, done).where("asked").select("trace_id", "span_id", F.col("ancestor").cast(kind).alias("ancestor"))


def bridge_parents(spans: DataFrame, kept: Column) -> DataFrame:
    """Kept spans with their nearest kept ancestor as parent."""
    found = nearest_ancestor(spans, kept, kept)
    return found.withColumnRenamed("ancestor", "bridged_parent")


def root_span(spans: DataFrame) -> DataFrame:
    """One span per trace: parentless with content before parentless before any; then the earliest, then by place."""
    tier = F.when(F.col("parent_span_id").isNull() & F.col("has_content"), 0).when(F.col("parent_span_id").isNull(), 1).otherwise(2)
    w = Window.partitionBy("trace_id").orderBy(tier, "start", "span_pos")
    return spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tool_owner(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, owner) of every tool span: its nearest agent above, else the trace's root agent, else null.
    Spans have span_type, has_content, start and span_pos besides the ids."""
    agents = spans.where("span_type = 'invoke_agent'")
    roots = root_span(agents).select("trace_id", F.col("span_id").alias("root_agent"))
    found = nearest_ancestor(spans, F.col("span_type") == "invoke_agent", F.col("span_type") == "execute_tool")
    return found.join(roots, "trace_id", "left").select("trace_id", "span_id", F.coalesce("ancestor", "root_agent").alias("owner"))


def failure_paths(spans: DataFrame, failing: DataFrame, most_below: int = 10) -> DataFrame:
    """(trace_id, span_id) of failing spans, all their ancestors, and the first ``most_below`` spans below each in
    order of depth and place. ``failing`` has trace_id and span_id."""
    scratch = Scratch(spans.sparkSession, "paths")
    tree = scratch.keep(spans.where("span_id is not null").select("trace_id", "span_id", "parent_span_id", "span_pos"), "tree")
    seeds = scratch.keep(tree.join(failing.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"]), "seeds")
    tree = tree.join(seeds.select("trace_id").distinct(), "trace_id", "left_semi")
    kept = seeds.select("trace_id", "span_id")
    # pointers 1, 2, 4, ... levels up: a round without a new ancestor is the last one, on cycles as well
    above = tree.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("up"))
    jump = scratch.keep(tree.join(above, ["trace_id", "parent_span_id"]).select("trace_id", "span_id", "up").distinct(), "jump")
    while True:
        found = kept.join(jump, ["trace_id", "span_id"]).select("trace_id", F.col("up").alias("span_id")).distinct()
        found = scratch.keep(found.join(kept, ["trace_id", "span_id"], "left_anti"), "up")
        if found.isEmpty():
            break
        kept = scratch.keep(kept.unionByName(found), "kept")
        step = jump.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"))
        jump = scratch.keep(jump.join(step, ["trace_id", "up"]).select("trace_id", "span_id", F.col("next").alias("up")).distinct(), "jump")
    below = None
    down = seeds.select("trace_id", F.col("span_id").alias("seed"), F.col("span_id").alias("at"))
    for depth in range(1, most_below + 1):  # the tenth descendant lies ten levels below at most
        level = tree.select("trace_id", "span_id", F.col("parent_span_id").alias("at"), "span_pos").join(down, ["trace_id", "at"]).where("span_id <> seed")
        # beyond the first few of a level nothing counts, nor what lies below them
        few = F.row_number().over(Window.partitionBy("trace_id", "seed").orderBy("span_pos", "span_id")) <= most_below
        level = level.select("trace_id", "seed", "span_id", "span_pos", F.lit(depth).alias("depth")).withColumn("few", few).where("few").drop("few")
        level = scratch.keep(level, "down")
        if level.isEmpty():
            break
        below = level if below is None else below.unionByName(level)
        down = level.select("trace_id", "seed", F.col("span_id").alias("at"))
    if below is not None:
        w = Window.partitionBy("trace_id", "seed").orderBy("depth", "span_pos")
        kept = kept.unionByName(below.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most_below).select("trace_id", "span_id"))
    return kept.distinct()
