"""Diagnosis of sessions: failure detection in one prompt or chunk by chunk, root causes in three tiers, and both joined.

A detector is a judge (see ``judging``) whose answer stands in ``response``; it may leave ``error`` where a prompt was too
long for it. Spans have session, pos, trace_id, span_id, parent_span_id and text, the JSON that a prompt shows of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import detection, hierarchy
from tracelake.runtime import Scratch

Detector = Callable[[DataFrame], DataFrame]
MAX_TOKENS = 200_000
LEAST_SPANS = 2
LEAST_WINDOW = 5
#: Texts in an error that tell of a context that was too long (fixed values).
TOO_LONG = ("context window", "context length", "context_length", "too long", "max_tokens", "input_limit", "input too large")
ROOT_CAUSES = (
    "root_causes array<struct<failure_span_id:string,location:string,failure_causality:string,failure_propagation_impact:array<string>,failure_detection_timing:string,"
    "completion_status:string,root_cause_explanation:string,fix_recommendation:struct<fix_type:string,recommendation:string>>>"
)


def context_exceeded(error: Column) -> Column:
    """Whether an error's text says that a prompt was too long."""
    hit = F.lit(False)
    for text in TOO_LONG:
        hit = hit | F.contains(F.lower(error), F.lit(text))
    return F.coalesce(hit, F.lit(False))


def span_json(columns: Sequence[str]) -> Column:
    """What a prompt shows of a span: its fields as indented JSON, nulls left out."""
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def session_json(spans: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, body, tokens): the spans' texts in order, as one JSON list, and its estimated tokens."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    body = F.concat(F.lit("["), F.array_join(texts, ",\n"), F.lit("]"))
    return spans.groupBy(*keys).agg(body.alias("body"), F.count("*").alias("n_spans")).withColumn("tokens", scoring.token_estimate(F.col("body")))


def detect_failures(spans: DataFrame, detector: Detector, level: str = "low", max_tokens: int = MAX_TOKENS, overhead: int = 0) -> DataFrame:
    """(session, span_id, category, confidence, evidence): what the detector finds in whole sessions, or in chunks of
    those that are too long. Sessions too long with ``LEAST_SPANS`` spans or fewer are given up; chunks that are still
    too long are passed over; what chunks find twice is merged; categories below the confidence level go."""
    scratch = Scratch(spans.sparkSession, "diagnosis")
    whole = scratch.keep(session_json(spans), "sessions")
    long = scoring.exceeds_context(F.col("tokens") + overhead, max_tokens)
    short = detector(whole.where(~long).select("session", F.lit(0).alias("chunk"), F.col("body").alias("prompt")))
    split = whole.where(long & (F.col("n_spans") > LEAST_SPANS)).select("session")
    parts = spans.join(split, "session", "left_semi").withColumn("tokens", scoring.token_estimate(F.col("text")))
    chunks = detection.token_chunks(parts, "session", "pos", "tokens", max_tokens, overhead).join(parts, ["session", "pos"])
    bodies = session_json(chunks, ["session", "chunk"]).select("session", "chunk", F.col("body").alias("prompt"))
    answers = short.unionByName(detector(bodies), allowMissingColumns=True)
    if "error" in answers.columns:
        answers = answers.where(~context_exceeded(F.col("error")))
    return merged_answers(answers, level)


def merged_answers(answers: DataFrame, level: str = "low") -> DataFrame:
    """Failures from the answers (session, chunk, response) of a detector."""
    items = answers.select("session", "chunk", F.posexplode(detection.parse_response(F.col("response"))).alias("item", "e"))
    zipped = F.arrays_zip("e.category", "e.confidence", "e.evidence")
    rows = items.select("session", "chunk", "item", F.col("e.location").alias("span_id"), F.posexplode(zipped).alias("at", "x"))
    rows = rows.select("session", "chunk", (F.col("item") * 1000 + F.col("at")).alias("pos"), "span_id", "x.category", scoring.confidence(F.lower("x.confidence")).alias("confidence"), "x.evidence")
    first = F.struct(F.col("confidence"), -F.col("chunk"), -F.col("pos"))
    best = rows.groupBy("session", "span_id", "category").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", first).alias("evidence"))
    return detection.over_threshold(best, F.lit(level))


def rca_tier(direct: Column, pruned: Column, n_pruned: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """How root causes are looked for: ``direct`` in the whole session if its prompt fits, ``pruned`` to the failures'
    paths if that does, else in windows of these; ``none`` if there are too few spans for windows."""
    fits = lambda tokens: ~scoring.exceeds_context(tokens, max_tokens)
    return F.when(fits(direct), "direct").when(fits(pruned), "pruned").when(n_pruned > LEAST_WINDOW, "chunked").otherwise("none")


def failure_spans(spans: DataFrame, failures: DataFrame) -> DataFrame:
    """The spans of sessions on their failures' paths: failing spans, those above, and the first below."""
    named = spans.withColumn("trace_key", F.concat_ws("/", "session", "trace_id"))
    tree = named.select(F.col("trace_key").alias("trace_id"), "span_id", "parent_span_id", F.col("pos").alias("span_pos"))
    failing = named.join(failures.select("session", "span_id").distinct(), ["session", "span_id"], "left_semi").select(F.col("trace_key").alias("trace_id"), "span_id")
    kept = hierarchy.failure_paths(tree, failing).withColumnRenamed("trace_id", "trace_key")
    return named.join(kept, ["trace_key", "span_id"], "left_semi").drop("trace_key")


def window_failures(windows: DataFrame, failures: DataFrame) -> DataFrame:
    """(session, trace_id, rca_window, span_id): each window's own failures, or all of its session where it has none.
    ``windows`` are spans with their window (see ``detection.index_windows``)."""
    keys = ["session", "trace_id", "rca_window"]
    known = failures.select("session", "span_id").distinct()
    own = windows.join(known, ["session", "span_id"]).select(*keys, "span_id").distinct()
    bare = windows.select(*keys).distinct().join(own.select(*keys).distinct(), keys, "left_anti")
    return own.unionByName(bare.join(known, "session").select(*keys, "span_id"))


def root_cause_items(answers: DataFrame) -> DataFrame:
    """Rows from structured answers (session, response): the nested fix becomes two columns; malformed answers give none."""
    found = answers.select("session", F.posexplode(F.from_json("response", ROOT_CAUSES)["root_causes"]).alias("item", "r"))
    return found.select(
        "session", "item", "r.failure_span_id", "r.location", F.col("r.failure_causality").alias("causality"), F.col("r.failure_propagation_impact").alias("propagation_impact"),
        "r.failure_detection_timing", "r.completion_status", "r.root_cause_explanation", "r.fix_recommendation.fix_type", F.col("r.fix_recommendation.recommendation").alias("fix_recommendation"))


def analyze_root_cause(spans: DataFrame, failures: DataFrame, analyst: Detector, merger: Detector, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``root_cause_items`` of sessions with failures, each by its tier. Windows' answers are merged by ``merger`` where
    there is more than one; an answer that says its window was too long is passed over."""
    scratch = Scratch(spans.sparkSession, "causes")
    told = failures.groupBy("session").agg(F.to_json(F.array_sort(F.collect_set(F.struct("span_id", "category")))).alias("failures"))
    spans = spans.join(told.select("session"), "session", "left_semi")
    pruned = scratch.keep(failure_spans(spans, failures), "pruned")
    direct = session_json(spans).select("session", F.col("body").alias("whole"), F.col("tokens").alias("whole_tokens"))
    small = session_json(pruned).select("session", "body", "tokens", "n_spans")
    tiers = direct.join(small, "session", "left").join(told, "session")
    own = scoring.token_estimate(F.col("failures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tiers = scratch.keep(tiers.withColumn("tier", rca_tier(F.col("whole_tokens") + own, zero("tokens") + own, zero("n_spans"), max_tokens)), "tiers")
    single = tiers.where("tier in ('direct', 'pruned')").select("session", F.concat(F.when(F.col("tier") == "direct", F.col("whole")).otherwise(F.col("body")), F.lit("\n"), "failures").alias("prompt"))
    windows = detection.index_windows(pruned.join(tiers.where("tier = 'chunked'").select("session"), "session", "left_semi"), "trace_id", ["pos"], LEAST_WINDOW)
    keys = ["session", "trace_id", "rca_window"]
    listed = window_failures(windows, failures).groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_set("span_id"))).alias("failures"))
    parts = analyst(session_json(windows, keys).join(listed, keys).select(*keys, F.concat("body", F.lit("\n"), "failures").alias("prompt")))
    if "error" in parts.columns:
        parts = parts.where(~context_exceeded(F.col("error")))
    each = F.transform(F.array_sort(F.collect_list(F.struct("trace_id", "rca_window", "response"))), lambda x: x["response"])
    merged = parts.groupBy("session").agg(each.alias("all"))
    alone = merged.where(F.size("all") == 1).select("session", F.col("all")[0].alias("response"))
    several = merger(merged.where(F.size("all") > 1).select("session", F.array_join("all", "\n").alias("prompt"))).select("session", "response")
    return root_cause_items(analyst(single).select("session", "response").unionByName(alone).unionByName(several))


def diagnose(spans: DataFrame, detector: Detector, analyst: Detector, merger: Detector, level: str = "low", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per session: its failures, the root causes of those that have any, and the distinct recommendations."""
    scratch = Scratch(spans.sparkSession, "diagnose")
    failures = scratch.keep(detect_failures(spans, detector, level, max_tokens), "failures")
    causes = analyze_root_cause(spans, failures, analyst, merger, max_tokens)
    return diagnosed(spans.select("session").distinct(), failures, causes)


def diagnosed(sessions: DataFrame, failures: DataFrame, causes: DataFrame) -> DataFrame:
    """Sessions with the lists of their failures and root causes, empty where there are none, and recommendations."""
    f = failures.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("span_id", "category", "confidence", "evidence"))).alias("failures"))
    items = F.array_sort(F.collect_list(F.struct("item", "failure_span_id", "location", "root_cause_explanation", "fix_type", "fix_recommendation")))
    c = causes.groupBy("session").agg(items.alias("root_causes"))
    out = sessions.join(f, "session", "left").join(c, "session", "left")
    said = F.transform("root_causes", lambda r: r["fix_recommendation"])
    return out.select(
        "session", "failures", "root_causes", F.when(F.col("failures").isNull(), 0).otherwise(F.size("failures")).alias("n_failures"),
        F.coalesce(detection.recommendations(said), F.array().cast("array<string>")).alias("recommendations"))

