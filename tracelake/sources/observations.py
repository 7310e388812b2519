"""Observations of a tracing service as spans: generations, tools, chains, agents and plain spans by their names.

``observations`` has pos and obs, a variant with id, traceId, parentObservationId, type, name, startTime, endTime, input,
output and metadata. All rules are expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scoring import parse_time
from tracelake.sources.variants import decoded, first_of, get, is_array, is_object, is_string, items, objects, shown, sub

PART = "array<struct<kind:string,text:string,name:string,arguments:string,call_id:string,error:string>>"
CALL_KEYS = ("toolUse", "toolResult")


def kind_of(obs: Column) -> Column:
    """inference, execute_tool or invoke_agent; null for observations that are none of these."""
    kind, name = get(obs, "$.type"), F.coalesce(get(obs, "$.name"), F.lit(""))
    root = get(obs, "$.parentObservationId").isNull()
    plain = kind == "SPAN"
    return (
        F.when(kind == "GENERATION", "inference").when(kind == "TOOL", "execute_tool").when(kind.isin("CHAIN", "AGENT") & root, "invoke_agent")
        .when(plain & F.startswith(name, F.lit("execute_tool")), "execute_tool").when(plain & F.startswith(name, F.lit("invoke_agent")), "invoke_agent")
    )


def content_text(content: Column) -> Column:
    """Text of a message's content: a string, or the first text of a list, also of one that is encoded as JSON."""
    listed = decoded(content)
    texts = F.filter(F.transform(objects(listed), lambda x: get(x, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(first_of(texts), F.when(is_string(content), get(content, "$")), F.when(is_array(content), F.lit("")), F.to_json(content), F.lit(""))


def _by_type(messages: Column, *types: str, last: bool = False) -> Column:
    """Content of the first (or last) message of a type, else of the very last message."""
    listed = objects(messages)
    fits = F.filter(listed, lambda m: get(m, "$.type").isin(*types))
    chosen = F.coalesce(F.try_element_at(fits, F.lit(-1 if last else 1)), F.try_element_at(listed, F.lit(-1)))
    return shown(sub(chosen, "$.content"))


def prompt_of(value: Column) -> Column:
    """An agent's prompt: a text, the first text or user message of a list, or the text, input or messages of an object."""
    fits = F.filter(objects(value), lambda x: sub(x, "$.text").isNotNull() | get(x, "$.role").isin("user", "human"))
    listed = first_of(F.transform(fits, lambda x: F.coalesce(get(x, "$.text"), content_text(sub(x, "$.content")))))
    of_object = F.coalesce(get(value, "$.text"), shown(sub(value, "$.input")), _by_type(sub(value, "$.messages"), "human", "user"))
    return F.coalesce(F.when(is_string(value), get(value, "$")).when(is_array(value), listed).when(is_object(value), of_object), F.to_json(value), F.lit(""))


def response_of(value: Column) -> Column:
    """An agent's answer: a text, the last answer of a list, or the text, message, output, content or messages of an object."""
    fits = F.filter(objects(value), lambda x: get(x, "$.role").isin("assistant", "ai"))
    listed = F.try_element_at(F.transform(fits, lambda x: content_text(sub(x, "$.content"))), F.lit(-1))
    content = sub(value, "$.content")
    texts = first_of(F.filter(F.transform(objects(content), lambda x: get(x, "$.text")), lambda t: t.isNotNull()))
    of_object = F.coalesce(
        get(value, "$.text"), shown(sub(value, "$.message")), shown(sub(value, "$.output")), texts, F.when(is_string(content), get(content, "$")),
        _by_type(sub(value, "$.messages"), "ai", "assistant", last=True))
    return F.coalesce(F.when(is_string(value), get(value, "$")).when(is_array(value), listed).when(is_object(value), of_object), F.to_json(value), F.lit(""))


def _part(kind: str, text: Column | None = None, name: Column | None = None, arguments: Column | None = None, call_id: Column | None = None, error: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    values = (F.lit(kind), text, name, arguments, call_id, error)
    return F.struct(*((none if v is None else v).alias(c) for v, c in zip(values, ("kind", "text", "name", "arguments", "call_id", "error"))))


def message_parts(message: Column) -> Column:
    """Parts of a message. An assistant's texts and calls in order, then calls that stand beside the content; a user's
    texts; of other roles the tool results, each with the first of its texts only."""
    role, content = F.coalesce(get(message, "$.role"), F.lit("")), sub(message, "$.content")
    none = F.array().cast(PART)
    text = F.when(is_string(content), F.array(_part("text", get(content, "$")))).otherwise(none)
    listed = objects(content)
    said = F.transform(F.filter(listed, lambda x: sub(x, "$.text").isNotNull() | is_object(sub(x, "$.toolUse"))), lambda x: F.when(
        sub(x, "$.text").isNotNull(), _part("text", get(x, "$.text"))).otherwise(
        _part("tool_call", None, get(x, "$.toolUse.name"), F.to_json(sub(x, "$.toolUse.input")), get(x, "$.toolUse.toolUseId"))))
    beside = F.transform(F.filter(objects(sub(message, "$.tool_calls")), lambda c: get(c, "$.name").isNotNull()), lambda c: _part(
        "tool_call", None, get(c, "$.name"), F.coalesce(F.to_json(sub(c, "$.args")), F.to_json(sub(c, "$.input")), F.lit("{}")), get(c, "$.id")))
    asked = F.transform(F.filter(listed, lambda x: sub(x, "$.text").isNotNull()), lambda x: _part("text", get(x, "$.text")))

    def result(x: Column) -> Column:
        inner = sub(x, "$.toolResult.content")
        first = F.when(is_array(inner), F.coalesce(get(first_of(items(inner)), "$.text"), F.lit(""))).otherwise(F.coalesce(shown(inner), F.lit("")))
        return _part("tool_result", first, None, None, get(x, "$.toolResult.toolUseId"), get(x, "$.toolResult.error"))

    results = F.transform(F.filter(listed, lambda x: is_object(sub(x, "$.toolResult"))), result)
    return F.when(role == "assistant", F.concat(F.when(is_array(content), said).otherwise(text), beside)).when(
        role == "user", F.when(is_array(content), asked).otherwise(text)).otherwise(results).cast(PART)


def generation_messages(given: Column, told: Column) -> Column:
    """(role, parts) of a generation: its list of input messages and its one output message, empty ones left out."""
    both = F.concat(objects(given), F.when(is_object(told), F.array(told)).otherwise(F.array().cast("array<variant>")))
    rows = F.transform(both, lambda m: F.struct(F.when(get(m, "$.role") == "assistant", "assistant").otherwise("user").alias("role"), message_parts(m).alias("parts")))
    return F.filter(rows, lambda m: F.size(m["parts"]) > 0)


def tool_parts(obs: Column, given: Column, out: Column) -> Column:
    """(name, arguments, call_id, result, error) of a tool's observation, whichever of three layouts its payload has: an
    input that names its tool; arguments as an object, a JSON text or a list of tool messages; or none."""
    named = is_object(given) & sub(given, "$.name").isNotNull()
    is_tool = get(obs, "$.type") == "TOOL"
    of_text = F.try_parse_json(get(given, "$"))
    of_list = F.try_parse_json(get(first_of(F.filter(objects(given), lambda m: get(m, "$.role") == "tool")), "$.content"))
    wrapped = F.to_json(F.struct(F.coalesce(get(given, "$"), F.to_json(given)).alias("input")))
    arguments = (
        F.when(named, F.coalesce(F.to_json(sub(given, "$.arguments")), F.lit("{}"))).when(~is_tool | given.isNull(), "{}").when(is_object(given), F.to_json(given))
        .when(is_array(given), F.when(is_object(of_list), F.to_json(of_list)).otherwise("{}")).when(is_object(of_text), F.to_json(of_text)).otherwise(wrapped)
    )
    # a result may be a text, an object with a result or content, or a message with an encoded list of texts
    encoded = decoded(sub(out, "$.message"))
    texts = F.filter(F.transform(objects(encoded), lambda x: get(x, "$.text")), lambda t: t.isNotNull())
    result = F.coalesce(
        F.when(is_string(out), get(out, "$")), F.when(is_array(encoded), first_of(texts)), shown(sub(out, "$.result")), shown(sub(out, "$.content")),
        shown(sub(out, "$.message")), F.to_json(out), F.lit(""))
    failed = F.lower(get(out, "$.status")).isin("error", "failed")
    error = F.coalesce(get(out, "$.error"), F.when(failed, result))
    return F.struct(
        F.when(named, get(given, "$.name")).when(is_tool, F.coalesce(get(obs, "$.name"), F.lit(""))).otherwise("").alias("name"), arguments.alias("arguments"),
        F.when(named, get(given, "$.toolUseId")).alias("call_id"), result.alias("result"), error.alias("error"))


def listed_tools(metadata: Column) -> Column:
    """Names of tools in the metadata, a list or its JSON text; what is no string is left out."""
    names = F.transform(F.filter(items(decoded(sub(metadata, "$.tools"))), is_string), lambda x: get(x, "$"))
    return F.when(is_object(metadata), names).otherwise(F.array().cast("array<string>"))


def spans(observations: DataFrame, session: Column | None = None) -> DataFrame:
    """Observations that are spans, with the parts that their kind has; the others are left out."""
    obs = F.col("obs")
    agent, tool = F.col("span_type") == "invoke_agent", F.col("span_type") == "execute_tool"
    # in steps, as each is used many times over in the next
    marked = observations.withColumn("span_type", kind_of(obs)).where("span_type is not null")
    marked = marked.withColumns({"given": sub(obs, "$.input"), "told": sub(obs, "$.output"), "metadata": sub(obs, "$.metadata")})
    given, told = F.col("given"), F.col("told")
    marked = marked.withColumn("tool", F.when(tool, tool_parts(obs, given, told)))
    return marked.select(
        F.col("pos").alias("span_pos"), F.coalesce(get(obs, "$.sessionId") if session is None else session, F.lit("unknown")).alias("session_id"),
        get(obs, "$.traceId").alias("trace_id"), get(obs, "$.id").alias("span_id"), get(obs, "$.parentObservationId").alias("parent_span_id"),
        parse_time(get(obs, "$.startTime")).alias("start_time"), parse_time(get(obs, "$.endTime")).alias("end_time"), "span_type",
        F.when(agent, prompt_of(given)).alias("user_prompt"), F.when(agent, response_of(told)).alias("agent_response"),
        F.when(agent, listed_tools(F.col("metadata"))).alias("available_tools"), F.col("tool.name").alias("tool_name"), F.col("tool.arguments").alias("tool_arguments"),
        F.col("tool.result").alias("tool_result"), F.col("tool.error").alias("tool_error"), F.col("tool.call_id").alias("tool_call_id"),
        F.when(F.col("span_type") == "inference", generation_messages(given, told)).alias("messages"),
    )
