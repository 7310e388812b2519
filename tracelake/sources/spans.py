"""Raw spans: shape normalization, dialect choice and session filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scope names of the producers that the dialect choice knows (fixed values).
SCOPES = {
    "openinference.instrumentation.langchain": "openinference", "openinference.instrumentation.claude_agent_sdk": "openinference", "openinference.instrumentation.smolagents": "openinference",
    "opentelemetry.instrumentation.langchain": "langchain", "opentelemetry.instrumentation.openai_agents": "openai_agents", "gcp.vertex.agent": "adk",
    "pydantic-ai": "genai", "autogen-core": "genai",
}


def flat_spans(records: DataFrame, column: str = "record") -> DataFrame:
    """One row per span of a flat list, a list of ``{spans: []}`` wrappers, or a map from trace to spans (``column`` is a
    variant). ``span_pos`` numbers the spans in the order met; items that are not objects are dropped."""
    one = records.select(F.monotonically_increasing_id().alias("at"), F.col(column).cast("string").alias("raw"))
    as_list = F.from_json("raw", "array<string>")
    items = one.select("at", F.posexplode_outer(F.when(F.startswith(F.col("raw"), F.lit("[")), as_list).otherwise(F.array("raw"))).alias("i", "item"))
    inner = F.coalesce(F.from_json(F.get_json_object("item", "$.spans"), "array<string>"), F.when(
        F.get_json_object("item", "$.span_id").isNull() & F.get_json_object("item", "$.name").isNull() & F.get_json_object("item", "$.attributes").isNull(),
        F.flatten(F.map_values(F.from_json("item", "map<string,array<string>>")))), F.array("item"))
    spans = items.select("at", "i", F.posexplode_outer(inner).alias("j", "span")).where(F.startswith(F.col("span"), F.lit("{")))
    # the steps above keep the rows' order, so identifiers that grow within and over partitions number them
    return spans.select(F.monotonically_increasing_id().alias("span_pos"), F.parse_json("span").alias("span"))


def dialect(scope: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in SCOPES.items():
        out = F.when(scope == name, kind).otherwise(out)
    return out


def choose_dialect(spans: DataFrame, session: str) -> DataFrame:
    """(session, dialect): the first span with a known scope decides; else message bodies, else generic operation
    names, else spans kept in memory. Columns: scope, has_body, operation, span_pos."""
    known = dialect(F.col("scope"))
    found = spans.groupBy(session).agg(
        F.min_by(known, F.when(known.isNotNull(), F.col("span_pos"))).alias("first"), F.bool_or("has_body").alias("body"), F.bool_or(F.col("operation").isNotNull()).alias("op")
    )
    return found.select(session, F.coalesce("first", F.when(F.col("body"), "log_body").when(F.col("op"), "genai").otherwise("in_memory")).alias("dialect"))


def filter_session(spans: DataFrame, trace: str, tag: str, session: str) -> DataFrame:
    """Spans of the traces that have any span tagged with the session, without those tagged otherwise."""
    w = Window.partitionBy(trace)
    hit = F.max(F.when(F.col(tag) == session, 1).otherwise(0)).over(w) == 1
    return spans.withColumn("__hit", hit).where(F.col("__hit") & (F.col(tag).isNull() | (F.col(tag) == session))).drop("__hit")


def filter_tagged(spans: DataFrame, tag: str, session: str) -> DataFrame:
    """If any span is tagged only those tagged with the session stay, else all."""
    any_tag = spans.agg(F.bool_or(F.col(tag).isNotNull()).alias("any_tag"))
    return spans.crossJoin(F.broadcast(any_tag)).where(~F.coalesce("any_tag", F.lit(False)) | (F.col(tag) == session)).drop("any_tag")
