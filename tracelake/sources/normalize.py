"""Span dialects into one table of spans (schema on read).

``raw`` has span_pos and span (a variant: trace_id, span_id, parent_span_id, name, start_time, end_time, attributes,
scope, status, span_events). All dialects end in ``SPANS``; fields that a dialect lacks are null. A span whose kind or
whose needed parts cannot be read is left out, the others stay; ``rejected`` has those left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scoring import blank_to_null, parse_time
from tracelake.sources.spans import dialect
from tracelake.sources.variants import attributes, first_of, kept, last_of, messages

BASE = ("session_id", "trace_id", "span_id", "parent_span_id", "span_pos", "name", "start_time", "end_time", "scope", "status", "status_text", "operation")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("span", path, kind)


def attribute(name: str, kind: str = "string") -> Column:
    """A dotted attribute of a span; the dots belong to its name."""
    return F.try_variant_get("span", f"$.attributes['{name}']", kind)


def attribute_any(*names: str) -> Column:
    """The first of several attributes that is neither missing nor empty."""
    return F.coalesce(*(blank_to_null(attribute(n)) for n in names))


def base(raw: DataFrame) -> DataFrame:
    """The fields that all dialects share. ``0x`` in front of ids is dropped; times may be numbers, digits or ISO."""
    plain = lambda c: F.regexp_replace(blank_to_null(c), "^0x", "")
    return raw.select(
        "span_pos", "span", F.coalesce(attribute_any("gen_ai.conversation.id", "session.id"), F.lit("unknown")).alias("session_id"),
        plain(F.coalesce(_get("$.trace_id"), _get("$.context.trace_id"))).alias("trace_id"), plain(F.coalesce(_get("$.span_id"), _get("$.context.span_id"))).alias("span_id"),
        plain(F.coalesce(_get("$.parent_span_id"), _get("$.parent_id"))).alias("parent_span_id"), _get("$.name").alias("name"),
        parse_time(_get("$.start_time")).alias("start_time"), parse_time(_get("$.end_time")).alias("end_time"),
        F.coalesce(blank_to_null(_get("$.scope.name")), attribute("event.name")).alias("scope"), F.coalesce(_get("$.status.code"), F.lit("UNSET")).alias("status"),
        _get("$.status.description").alias("status_text"), attribute("gen_ai.operation.name").alias("operation"),
    )


def kind_of(spans: DataFrame) -> Column:
    """inference, execute_tool or invoke_agent, from whatever the dialect says."""
    said = F.lower(F.coalesce(F.col("operation"), attribute_any("openinference.span.kind", "traceloop.span.kind", "llm.request.type"), F.lit("")))
    return F.when(said.isin("chat", "generate_content", "text_completion", "llm", "call_llm"), "inference").when(said.isin("execute_tool", "tool"), "execute_tool").when(
        said.isin("invoke_agent", "agent", "workflow"), "invoke_agent").when(F.startswith(F.coalesce("name", F.lit("")), F.lit("call_llm")), "inference")


def _last_text(raw: Column, role: str | None = None, first: bool = False) -> Column:
    """Text of the last (or first) message with text, of a JSON list of messages with parts, content blocks or plain
    content; thoughts are left out, texts of one message join without a sign."""
    message = "array<struct<role:string,content:string,parts:array<struct<type:string,content:string,text:string,thought:boolean>>>>"
    listed = F.from_json(raw, message)

    def text(m: Column) -> Column:
        blocks = F.from_json(m["content"], "array<struct<type:string,text:string,content:string,thought:boolean>>")
        join = lambda parts: F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], p["content"], F.lit(""))), "")
        of_content = F.when(F.startswith(m["content"], F.lit("[")), join(blocks)).otherwise(m["content"])
        return F.coalesce(blank_to_null(join(m["parts"])), blank_to_null(of_content))

    fits = F.filter(listed, lambda m: text(m).isNotNull() & (F.lit(True) if role is None else m["role"].isin(*role.split("|"))))
    return text(F.try_element_at(fits, F.lit(1 if first else -1)))


def _body_messages(events: Column, side: str) -> Column:
    """Messages of the first event whose body has an input or an output, else of the span's own body."""
    part = lambda e, p, kind="variant": F.try_variant_get(e, p, kind)
    body = F.try_element_at(F.filter(events, lambda e: part(e, "$.body.input").isNotNull() | part(e, "$.body.output").isNotNull()), F.lit(1))
    return F.to_json(F.coalesce(part(body, f"$.body.{side}.messages"), F.when(body.isNull(), _get(f"$.body.{side}.messages", "variant"))))


def _event_value(events: Column, event: str, field: str, shown=lambda c: c, place: int = -1) -> Column:
    """An attribute of the last (or first) event of a name that has it."""
    get = lambda e, p: F.try_variant_get(e, p, "string")
    own = F.filter(events, lambda e: F.coalesce(get(e, "$.event_name"), get(e, "$.name")) == event)
    return F.try_element_at(F.filter(F.transform(own, lambda e: blank_to_null(shown(get(e, f"$.attributes['{field}']")))), lambda t: t.isNotNull()), F.lit(place))


def _blocks_text(raw: Column) -> Column:
    """The texts of a JSON list of content blocks, or the text itself if it is no list."""
    blocks = F.from_json(raw, "array<struct<text:string>>")
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")).otherwise(raw)


def _event_told(events: Column) -> Column:
    details = _event_value(events, "gen_ai.client.inference.operation.details", "gen_ai.input.messages", lambda c: _last_text(c, "user|human", first=True), 1)
    return F.coalesce(_event_value(events, "gen_ai.user.message", "content", _blocks_text), details)


def _event_answer(events: Column) -> Column:
    """The last choice (an agent's as it stands, like the reference's), else an inference's last assistant message, else
    the first answer in the details."""
    details = _event_value(events, "gen_ai.client.inference.operation.details", "gen_ai.output.messages", lambda c: _last_text(c, "assistant|model", first=True), 1)
    choice = F.when(F.col("span_type") == "invoke_agent", _event_value(events, "gen_ai.choice", "message")).otherwise(_event_value(events, "gen_ai.choice", "message", _blocks_text))
    said = F.when(F.col("span_type") == "inference", _event_value(events, "gen_ai.assistant.message", "content", _blocks_text))
    return F.coalesce(choice, said, details)


def normalize(raw: DataFrame) -> DataFrame:
    """Spans of any dialect: the shared fields, ``span_type``, ``dialect``, and the parts that the type has."""
    b = base(raw)
    kind = kind_of(b)
    spans = b.withColumn("span_type", kind).withColumn("dialect", F.coalesce(dialect(F.col("scope")), F.when(F.col("operation").isNotNull(), "genai").otherwise("in_memory")))
    names = attributes()
    told_in = F.filter(messages(names, "llm.input_messages"), lambda m: m["role"].isin("user", "human"))
    older = F.filter(messages(names, "gen_ai.prompt"), lambda m: m["role"] == "user")
    flat_response = first_of(F.filter(messages(names, "llm.output_messages"), lambda m: m["idx"] == 0))["content"]
    flat_prompt, old_prompt = first_of(told_in)["content"], last_of(older)["content"]
    inputs, outputs = attribute_any("gen_ai.input.messages", "input.value"), attribute_any("gen_ai.output.messages", "output.value")
    events = F.try_variant_get("span", "$.span_events", "array<variant>")
    event_in, event_out = _body_messages(events, "input"), _body_messages(events, "output")
    told, answer = _event_told(events), _event_answer(events)
    failed = F.upper("status") == "ERROR"
    error = F.coalesce(attribute_any("error.type"), F.when(failed, F.coalesce(blank_to_null(F.col("status_text")), F.lit("ERROR"))), F.when(
        ~F.lower(F.coalesce(attribute("gen_ai.tool.status"), F.lit("success"))).isin("success", "ok"), attribute("gen_ai.tool.status")))
    is_tool = F.col("span_type") == "execute_tool"
    tool = F.coalesce(is_tool, F.lit(False))
    called = F.coalesce(_event_value(events, "gen_ai.tool.message", "content"), F.when(F.startswith(told, F.lit("{")), told))
    return spans.select(
        *BASE, "span_type", "dialect",
        F.coalesce(blank_to_null(flat_prompt), blank_to_null(old_prompt), F.when(~tool, told), _last_text(inputs, "user|human"), _last_text(event_in, "user|human"), F.when(~F.startswith(inputs, F.lit("[")), inputs)).alias("user_prompt"),
        F.coalesce(blank_to_null(flat_response), F.when(~tool, answer), _last_text(outputs), _last_text(event_out), F.when(~F.startswith(outputs, F.lit("[")), outputs), F.when(failed, F.col("status_text"))).alias("agent_response"),
        attribute_any("gen_ai.system_instructions", "system_prompt").alias("system_prompt"),
        F.when(is_tool, F.coalesce(attribute_any("gen_ai.tool.name", "tool.name"), F.col("name"))).alias("tool_name"),
        F.when(is_tool, F.coalesce(called, attribute_any("gen_ai.tool.call.arguments", "input.value"), F.to_json(attribute("gen_ai.tool.call.arguments", "variant")))).alias("tool_arguments"),
        F.when(is_tool, F.coalesce(answer, attribute_any("gen_ai.tool.call.result", "output.value"), F.to_json(attribute("gen_ai.tool.call.result", "variant")))).alias("tool_result"),
        F.when(is_tool, attribute_any("gen_ai.tool.call.id")).alias("tool_call_id"), F.when(is_tool, error).alias("tool_error"),
        attribute_any("gen_ai.tool.definitions", "llm.tools").alias("tool_definitions"),
    )


def accepted(spans: DataFrame) -> DataFrame:
    """Spans with a type; tool spans need a name, agent spans a prompt or a response."""
    def fits(r: Column) -> Column:
        tool = (r["span_type"] == "execute_tool") & r["tool_name"].isNotNull()
        return (r["span_type"] == "inference") | tool | ((r["span_type"] == "invoke_agent") & (r["user_prompt"].isNotNull() | r["agent_response"].isNotNull()))

    return kept(spans, fits)


def rejected(spans: DataFrame) -> DataFrame:
    return spans.join(accepted(spans).select("span_pos"), "span_pos", "left_anti")


def trace_order(spans: DataFrame) -> DataFrame:
    """``trace_seq``: traces in the order of their first span."""
    first = spans.groupBy("session_id", "trace_id").agg(F.min("span_pos").alias("__first"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("__first")) - 1
    return spans.join(first.withColumn("trace_seq", seq).drop("__first"), ["session_id", "trace_id"])


def backfill_agents(spans: DataFrame) -> DataFrame:
    """Agent spans without prompt or response take the first user text and the last answer of their child inferences."""
    kids = spans.where("span_type = 'inference'").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(
        F.min_by("user_prompt", F.when(blank_to_null(F.col("user_prompt")).isNotNull(), F.struct("start_time", "span_pos"))).alias("__p"),
        F.max_by("agent_response", F.when(blank_to_null(F.col("agent_response")).isNotNull(), F.struct("start_time", "span_pos"))).alias("__r"))
    agent = F.col("span_type") == "invoke_agent"
    joined = spans.join(kids, ["trace_id", "span_id"], "left")
    return joined.withColumns({c: F.when(agent, F.coalesce(blank_to_null(F.col(c)), F.col(k))).otherwise(F.col(c)) for c, k in (("user_prompt", "__p"), ("agent_response", "__r"))}).drop("__p", "__r")


def tool_catalogue(spans: DataFrame) -> DataFrame:
    """Distinct tool names of a trace: those defined, and those called, in order of name."""
    defined = F.transform(F.from_json("tool_definitions", "array<struct<name:string,function:struct<name:string>>>"), lambda t: F.coalesce(t["name"], t["function"]["name"]))
    names = F.concat(F.coalesce(defined, F.array().cast("array<string>")), F.when(F.col("tool_name").isNotNull(), F.array("tool_name")).otherwise(F.array().cast("array<string>")))
    return spans.select("trace_id", F.explode(names).alias("tool")).groupBy("trace_id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))


def final_output(spans: DataFrame, skip_empty: bool = False) -> DataFrame:
    """The last agent span's response per session; with ``skip_empty`` the last that is not empty."""
    agents = spans.where("span_type = 'invoke_agent'")
    agents = agents.where("coalesce(agent_response, '') <> ''") if skip_empty else agents
    return agents.groupBy("session_id").agg(F.max_by("agent_response", "span_pos").alias("output"))


# --- logs ------------------------------------------------------------------------------------------------------------


def parse_logs(records: DataFrame) -> DataFrame:
    """Raw spans from log records (``pos``, ``record`` variant): events are told first, then spans, others are ignored.
    Events join the span they name; without any span at all, spans are made of the events."""
    get = lambda p, k="string": F.try_variant_get("record", p, k)
    kind = F.when(get("$.attributes['event.name']").isNotNull() & get("$.body", "variant").isNotNull(), "event").when(get("$.startTimeUnixNano").isNotNull() & get("$.spanId").isNotNull(), "span")
    r = records.withColumn("kind", kind).where("kind is not null").withColumn("tid", get("$.traceId")).withColumn("sid", get("$.spanId"))
    events = r.where("kind = 'event'").groupBy("tid", "sid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("record").alias("e")))), lambda x: x["e"]).alias("events"), F.min("pos").alias("event_pos"))
    body = lambda: F.concat(F.lit("["), F.array_join(F.col("events"), ","), F.lit("]"))
    spans = r.where("kind = 'span'").join(events, ["tid", "sid"], "left").select(
        "pos", F.to_json(F.struct(
            F.col("tid").alias("trace_id"), F.col("sid").alias("span_id"), get("$.parentSpanId").alias("parent_span_id"), get("$.name").alias("name"), get("$.startTimeUnixNano").alias("start_time"),
            get("$.endTimeUnixNano").alias("end_time"), get("$.attributes", "variant").alias("attributes"), get("$.scope", "variant").alias("scope"), get("$.status", "variant").alias("status"),
            F.coalesce(F.parse_json(body()), F.parse_json(F.lit("[]"))).alias("span_events"))).alias("span"))
    any_span = r.agg(F.coalesce(F.bool_or(F.col("kind") == "span"), F.lit(False)).alias("has_spans"))
    made = events.crossJoin(F.broadcast(any_span)).where("not has_spans").select(F.col("event_pos").alias("pos"), F.to_json(F.struct(
        F.col("tid").alias("trace_id"), F.col("sid").alias("span_id"), F.get_json_object(F.col("events")[0], "$.timeUnixNano").alias("start_time"), F.parse_json(body()).alias("span_events"))).alias("span"))
    return spans.unionByName(made).select(F.col("pos").alias("span_pos"), F.parse_json("span").alias("span"))


def enrich_parents(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Parents replaced where the hierarchy (span_id, parent) has one."""
    return spans.join(known.select("span_id", F.col("parent").alias("__p")), "span_id", "left").withColumn("parent_span_id", F.coalesce("__p", "parent_span_id")).drop("__p")


def flatten_blocks(blocks: Column) -> Column:
    """Tool-result blocks as text: texts, JSON in sorted keys, a mark for media; empty ones skipped, joined by lines."""
    kind = "array<struct<text:string,json:variant,image:variant,document:variant,video:variant>>"
    shown = F.transform(F.from_json(blocks, kind), lambda b: F.coalesce(b["text"], F.to_json(b["json"]), F.when(b["image"].isNotNull(), "[image]"), F.when(b["document"].isNotNull(), "[document]"), F.when(b["video"].isNotNull(), "[video]"), F.lit("")))
    return F.array_join(F.filter(shown, lambda x: x != ""), "\n")
