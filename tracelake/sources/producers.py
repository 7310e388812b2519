"""Rules of single producers of spans, where they differ from the shared ones of ``normalize``.

``raw`` has span_pos and span (a variant). What a rule needs of its own span is an expression on the row; what it needs of
children or of a whole subtree is a join or the pointer jumping of ``hierarchy``.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scoring import blank_to_null
from tracelake.operators import hierarchy
from tracelake.sources import normalize
from tracelake.sources.variants import (
    attributes, decoded, first_of, first_text, get, is_array, is_object, is_string, items, kept, last_of, messages, numbered, objects, parsed, shown, sub,
)

#: Scopes by family (fixed values).
FAMILIES = {
    "openinference": (
        "openinference.instrumentation.langchain", "openinference.instrumentation.claude_agent_sdk", "openinference.instrumentation.smolagents",
        "openinference.instrumentation.openai_agents"),
    "langchain": ("opentelemetry.instrumentation.langchain",),
    "adk": ("gcp.vertex.agent",),
}
SMOLAGENTS = "openinference.instrumentation.smolagents"
#: Tool statuses that are no error (fixed values).
FINE = ("success", "ok", "completed")
MERGED_TOOLS = "(merged tools)"


def of_family(spans: DataFrame, family: str) -> DataFrame:
    """Spans of a family's scopes; the agent toolkit's family takes spans without a scope as well. Columns: scope."""
    own = F.col("scope").isin(*FAMILIES[family])
    return spans.where(own | (F.coalesce("scope", F.lit("")) == "") if family == "adk" else own)


def tool_literal(text: Column) -> Column:
    """Arguments as JSON from a text that is JSON or the literal of a dict; ``{}`` for other texts. The literals need
    a parser, so these texts, and no others, go through an Arrow function."""

    @F.pandas_udf("string")
    def literal(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            try:
                value = ast.literal_eval(t)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return "{}"
            return json.dumps(value, separators=(",", ":"), default=str) if isinstance(value, dict) else "{}"

        return texts.map(one, na_action="ignore")

    json_value = F.try_parse_json(text)
    return F.when(json_value.isNotNull(), F.to_json(json_value)).otherwise(literal(F.when(json_value.isNull(), text)))


# --- message bodies ----------------------------------------------------------------------------------------------------


def body_messages(side: str, family: str | None = None) -> Column:
    """Messages of the first event, of the family if one is named, whose body has any; null without."""
    events = F.try_variant_get("span", "$.span_events", "array<variant>")
    has = lambda e: F.size(items(sub(e, "$.body.input.messages"))) + F.size(items(sub(e, "$.body.output.messages"))) > 0
    named = lambda e: F.lit(True) if family is None else F.coalesce(get(e, "$.event_name"), F.lit("")).isin(*FAMILIES[family])
    event = first_of(F.filter(events, lambda e: has(e) & named(e)))
    found = objects(sub(event, f"$.body.{side}.messages"))
    return F.when(F.size(found) > 0, found)


def wrapped_value(names: Column, side: str) -> Column:
    """The value of an attribute as a list of one message: inputs count if they are JSON objects, outputs in any case."""
    text = blank_to_null(F.try_element_at(names, F.lit(f"{side}.value")))
    fits = is_object(F.try_parse_json(text)) if side == "input" else F.lit(True)
    role = "user" if side == "input" else "assistant"
    made = F.array(F.parse_json(F.to_json(F.struct(F.lit(role).alias("role"), text.alias("content")))))
    return F.when(text.isNotNull() & F.coalesce(fits, F.lit(False)), made)


def serialized(message: Column) -> Column:
    """(type, text) of a serialized chat message: constructor arguments or plain fields, content as text or blocks."""
    inner = F.coalesce(sub(message, "$.kwargs"), message)
    content = sub(inner, "$.content")
    texts = F.filter(F.transform(objects(content), lambda b: get(b, "$.text")), lambda t: t.isNotNull())
    text = F.when(is_array(content), first_of(texts)).when(is_string(content), get(content, "$"))
    kind = F.coalesce(get(inner, "$.type"), get(inner, "$.role"), F.lower(F.regexp_extract(F.coalesce(get(message, "$.id[2]"), F.lit("")), "^(Human|AI|Tool|System)", 1)))
    return F.struct(F.lower(kind).alias("type"), blank_to_null(text).alias("text"))


def chat(value: Column) -> Column:
    """Serialized messages of a list, of which the first may be a list itself."""
    inner = F.when(is_array(first_of(items(value))), first_of(items(value))).otherwise(value)
    return F.transform(objects(inner), serialized)


def said_by(messages_: Column, *types: str, last: bool = False) -> Column:
    fits = F.filter(messages_, lambda m: m["type"].isin(*types) & m["text"].isNotNull())
    return F.try_element_at(fits, F.lit(-1 if last else 1))["text"]


# --- OpenInference -------------------------------------------------------------------------------------------------------


def openinference(raw: DataFrame) -> DataFrame:
    """Spans of the family: user and system text, answers with their tool calls, tools by name, and tool spans. Agents need
    a prompt and a response (an error's text counts); tool spans a name, arguments and a result; others are left out."""
    b = of_family(normalize.base(raw), "openinference").withColumn("a", attributes())
    a = F.col("a")
    at = lambda k: blank_to_null(F.try_element_at(a, F.lit(k)))
    kind = F.upper(F.coalesce(at("openinference.span.kind"), F.lit("")))
    b = b.withColumn("span_type", F.when(kind == "LLM", "inference").when(kind == "TOOL", "execute_tool").when(kind == "AGENT", "invoke_agent")).where("span_type is not null")
    b = b.withColumns({"ins": F.coalesce(body_messages("input", "openinference"), wrapped_value(a, "input")), "outs": F.coalesce(body_messages("output", "openinference"), wrapped_value(a, "output"))})
    # in steps, as each is used many times over in the next
    b = b.withColumns({"last_in": last_of(F.col("ins")), "last_out": last_of(F.col("outs")), "flat": messages(a, "llm.input_messages"), "value": F.try_parse_json(at("output.value"))})
    b = b.withColumns({"given": decoded(sub(F.col("last_in"), "$.content")), "told": decoded(sub(F.col("last_out"), "$.content"))})
    given, told, flat, value = (F.col(c) for c in ("given", "told", "flat", "value"))
    b = b.withColumns({"chats": chat(F.coalesce(sub(given, "$.messages"), given)), "said": chat(F.coalesce(sub(told, "$.messages"), sub(told, "$.outputs.messages")))})
    b = b.withColumn("user", F.try_element_at(F.filter(flat, lambda m: m["role"].isin("user", "human") & (m["content"] != "")), F.lit(1)))
    chats, said, user = F.col("chats"), F.col("said"), F.col("user")
    # user text: flattened attributes, else serialized messages, else the raw text
    system = F.try_element_at(F.filter(flat, lambda m: (m["role"] == "system") & (user.isNull() | (m["idx"] < user["idx"]))), F.lit(1))
    raw_text = get(F.col("last_in"), "$.content")
    prompt = F.coalesce(user["content"], said_by(chats, "human", "user"), F.when(~is_object(given), raw_text))
    # answers: the first message of the attributes, with its calls only if it has text; else the first generation
    answer = first_of(messages(a, "llm.output_messages"))["content"]
    calls = F.transform(numbered(a, r"^llm\.output_messages\.0\.message\.tool_calls\.(\d+)\."), lambda i: F.struct(
        F.try_element_at(a, F.format_string("llm.output_messages.0.message.tool_calls.%d.tool_call.function.name", i)).alias("name"),
        F.try_element_at(a, F.format_string("llm.output_messages.0.message.tool_calls.%d.tool_call.function.arguments", i)).alias("arguments")))
    generation = F.coalesce(get(told, "$.generations[0][0].text"), serialized(sub(told, "$.generations[0][0].message"))["text"])
    final = F.coalesce(get(told, "$.final_answer"), said_by(said, "ai", "assistant", last=True), generation)
    plain = F.when(~is_object(told), get(F.col("last_out"), "$.content"))
    failed = F.when(F.upper("status") == "ERROR", F.coalesce(blank_to_null(F.col("status_text")), F.lit("error")))
    task = F.when(F.col("scope") == SMOLAGENTS, get(F.try_parse_json(at("input.value")), "$.task"))
    schemas = F.transform(numbered(a, r"^llm\.tools\.(\d+)\.tool\.json_schema$"), lambda i: F.try_parse_json(F.try_element_at(a, F.format_string("llm.tools.%d.tool.json_schema", i))))
    tools = F.array_sort(F.filter(F.transform(schemas, lambda s: F.coalesce(get(s, "$.name"), get(s, "$.function.name"))), lambda n: n.isNotNull()))
    # tool spans
    out = at("output.value")
    result = F.when(is_object(value), F.coalesce(F.when(is_array(sub(value, "$.content")), normalize.flatten_blocks(F.to_json(sub(value, "$.content")))), F.when(
        is_string(sub(value, "$.content")), get(value, "$.content")), F.to_json(value))).when(is_string(value), get(value, "$")).when(is_array(value), normalize.flatten_blocks(out)).otherwise(out)
    event_out, event_in = told, F.when(get(F.col("last_in"), "$.role") == "user", raw_text)
    result = F.coalesce(result, F.when(is_object(event_out), get(event_out, "$.content")), failed)
    status = F.coalesce(get(value, "$.status"), F.when(out.isNull(), get(event_out, "$.status")), F.when(failed.isNotNull() & out.isNull(), "error"), F.lit("success"))
    name = F.coalesce(at("tool.name"), F.when(~F.col("name").isin(*FAMILIES["openinference"]), blank_to_null(F.col("name"))), get(event_out, "$.name"))
    agent, tool, model = (F.col("span_type") == t for t in ("invoke_agent", "execute_tool", "inference"))
    spans = b.select(
        *normalize.BASE, "span_type",
        F.when(agent, F.coalesce(task, at("input.value"), prompt)).when(model, prompt).alias("user_prompt"), F.when(~tool, system["content"]).alias("system_prompt"),
        F.when(agent, F.coalesce(at("output.value"), final, plain, failed)).when(model, first_text(answer, generation, plain)).alias("agent_response"),
        F.when(model & (F.coalesce(answer, F.lit("")) != ""), calls).alias("tool_calls"), tools.alias("tools"), F.when(tool, name).alias("tool_name"),
        F.when(tool, F.coalesce(tool_literal(at("input.value")), F.to_json(F.try_parse_json(event_in)))).alias("tool_arguments"), F.when(tool, result).alias("tool_result"),
        F.when(tool & ~F.lower(status).isin(*FINE), status).alias("tool_error"))
    return kept(spans, _whole)


def _whole(r: Column) -> Column:
    """Whether a span has what its kind needs: agents a prompt and a response, tools a name, arguments and a result."""
    agent = (r["span_type"] == "invoke_agent") & first_text(r["user_prompt"]).isNotNull() & first_text(r["agent_response"]).isNotNull()
    tool = (r["span_type"] == "execute_tool") & r["tool_name"].isNotNull() & r["tool_arguments"].isNotNull() & r["tool_result"].isNotNull()
    return (r["span_type"] == "inference") | agent | tool


# --- LangChain -----------------------------------------------------------------------------------------------------------


def langchain(raw: DataFrame) -> DataFrame:
    """Spans of the family, from event bodies or entity attributes. Of a message list the last one counts: prompts and
    answers are the last text that is no tool's. Of a trace's agents only the last stays."""
    b = of_family(normalize.base(raw), "langchain").withColumn("a", attributes())
    a = F.col("a")
    at = lambda k: blank_to_null(F.try_element_at(a, F.lit(k)))
    said = F.lower(F.coalesce(at("traceloop.span.kind"), F.lit("")))
    kind = F.when(at("llm.request.type").isNotNull(), "inference").when(said == "tool", "execute_tool").when(said.isin("workflow", "agent"), "invoke_agent")
    b = b.withColumn("span_type", kind).where("span_type is not null").withColumns({"ins": body_messages("input"), "outs": body_messages("output")})
    entity = lambda side: parsed(at(f"traceloop.entity.{side}"))
    # in steps, as each is used many times over in the next
    b = b.withColumns({"last_in": sub(last_of(F.col("ins")), "$.content"), "last_out": sub(last_of(F.col("outs")), "$.content")})
    b = b.withColumns({"given": F.coalesce(decoded(F.col("last_in")), entity("input")), "told": F.coalesce(decoded(F.col("last_out")), entity("output")), "flat": messages(a, "gen_ai.prompt")})
    given, told, flat = F.col("given"), F.col("told"), F.col("flat")
    b = b.withColumns({"inputs": sub(given, "$.inputs"), "in_text": sub(given, "$.input_str"), "answer": F.coalesce(sub(told, "$.output.kwargs"), sub(told, "$.outputs.kwargs")),
                       "value_outputs": sub(told, "$.outputs"), "value_output": sub(told, "$.output")})
    inputs, answer = F.col("inputs"), F.col("answer")
    b = b.withColumns({"call": F.when(get(inputs, "$.__type") == "tool_call_with_context", sub(inputs, "$.tool_call")), "in_value": decoded(F.col("in_text"))})
    call, in_text = F.col("call"), F.col("in_value")

    def last_said(value: Column) -> Column:
        fits = F.filter(chat(value), lambda m: m["text"].isNotNull() & (F.coalesce(m["type"], F.lit("")) != "tool"))
        return F.try_element_at(fits, F.lit(-1))["text"]

    def answer_under(key: str) -> Column:
        value = F.col(f"value_{key}")
        return first_text(F.when(is_string(value), get(value, "$")), last_said(sub(value, "$.messages")), serialized(value)["text"], last_said(value))

    flat_prompt = F.try_element_at(F.filter(flat, lambda m: m["role"].isin("user", "human")), F.lit(-1))["content"]
    flat_answer = last_of(messages(a, "gen_ai.completion"))["content"]
    tool_answers = F.transform(F.filter(flat, lambda m: m["role"] == "tool"), lambda m: m["content"])
    defined = F.transform(numbered(a, r"^llm\.request\.functions\.(\d+)\.name$"), lambda i: F.try_element_at(a, F.format_string("llm.request.functions.%d.name", i)))
    # tool spans: a call with its context, direct inputs, or inputs as text; results from constructor arguments
    arguments = F.coalesce(sub(call, "$.args"), F.when(is_object(inputs) & call.isNull(), inputs), F.when(is_object(in_text), in_text))
    name = first_text(at("traceloop.entity.name"), get(call, "$.name"), get(answer, "$.name"), get(told, "$.kwargs.name"))
    status = F.coalesce(get(answer, "$.status"), F.lit("success"))
    agent, tool, model = (F.col("span_type") == t for t in ("invoke_agent", "execute_tool", "inference"))
    spans = b.select(
        *normalize.BASE, "span_type",
        F.when(agent, last_said(sub(inputs, "$.messages"))).when(model, first_text(flat_prompt, last_said(sub(given, "$.messages")))).alias("user_prompt"),
        F.when(agent, first_text(answer_under("outputs"), answer_under("output"))).when(model, first_text(flat_answer, answer_under("outputs"), answer_under("output"))).alias("agent_response"),
        F.when(model, tool_answers).alias("tool_answers"), F.when(model, defined).alias("tools"), F.when(tool, name).alias("tool_name"), F.when(tool, F.to_json(arguments)).alias("tool_arguments"),
        F.when(tool, shown(sub(answer, "$.content"))).alias("tool_result"), F.when(tool & (status != "success"), status).alias("tool_error"),
        F.when(tool, F.coalesce(get(call, "$.id"), get(answer, "$.tool_call_id"))).alias("tool_call_id"))
    good = kept(spans, _whole)
    last = F.max(F.when(agent, F.struct("start_time", "span_pos"))).over(Window.partitionBy("session_id", "trace_id"))
    return good.withColumn("last_agent", last["span_pos"]).where(~agent | (F.col("span_pos") == F.col("last_agent"))).drop("last_agent")


def langchain_tools(spans: DataFrame) -> DataFrame:
    """(session_id, trace_id, tools): those that inferences define, else those that were called, in order of name."""
    g = spans.groupBy("session_id", "trace_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("defined"), F.array_sort(F.collect_set("tool_name")).alias("called"))
    return g.select("session_id", "trace_id", F.when(F.size("defined") > 0, F.col("defined")).otherwise(F.col("called")).alias("tools"))


# --- agent toolkit -------------------------------------------------------------------------------------------------------


def _texts(content: Column) -> Column:
    """Texts of a content's parts that are no thoughts, joined without a sign."""
    parts = F.filter(objects(sub(content, "$.parts")), lambda p: ~F.coalesce(get(p, "$.thought", "boolean"), F.lit(False)))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(get(p, "$.text"), F.lit(""))), "")


def adk(raw: DataFrame) -> DataFrame:
    """Agent and tool spans of the toolkit. An agent's system text and tools come from its first model call, its prompt from
    the last one, as does its answer unless that one calls a function; then the last tool result below it counts, not
    crossing other agents. Agents without prompt and answer, merged tools and tools without a name are left out."""
    b = of_family(normalize.base(raw), "adk").withColumn("a", attributes())
    at = lambda k: blank_to_null(F.try_element_at(F.col("a"), F.lit(k)))
    is_call = F.startswith(F.coalesce("name", F.lit("")), F.lit("call_llm"))
    kind = F.when(F.col("operation") == "invoke_agent", "invoke_agent").when(F.col("operation") == "execute_tool", "execute_tool").when(is_call, "call_llm").otherwise("other")
    b = b.withColumn("span_type", kind)
    b = b.withColumns({"request": F.try_parse_json(at("gcp.vertex.agent.llm_request")), "response": F.try_parse_json(at("gcp.vertex.agent.llm_response"))})
    request, response = F.col("request"), F.col("response")
    asked = last_of(F.filter(F.transform(F.filter(objects(sub(request, "$.contents")), lambda c: get(c, "$.role") == "user"), _texts), lambda t: t != ""))
    functions = F.flatten(F.transform(objects(sub(request, "$.config.tools")), lambda t: F.transform(objects(sub(t, "$.function_declarations")), lambda f: get(f, "$.name"))))
    calls_function = F.exists(objects(sub(response, "$.content.parts")), lambda p: sub(p, "$.function_call").isNotNull())
    order = F.struct("start_time", "span_pos")
    called = b.where("span_type = 'call_llm'").select(
        "trace_id", F.col("parent_span_id").alias("span_id"), "start_time", "span_pos", shown(sub(request, "$.config.system_instruction")).alias("system"), functions.alias("functions"),
        F.coalesce(asked, F.lit("")).alias("asked"), F.when(calls_function, "").otherwise(_texts(sub(response, "$.content"))).alias("answered"))
    kids = called.groupBy("trace_id", "span_id").agg(
        F.min_by("system", order).alias("system_prompt"), F.min_by("functions", order).alias("tools"), F.max_by("asked", order).alias("user_prompt"), F.max_by("answered", order).alias("answered"))
    # the nearest agent above a tool owns it; so a subtree does not reach into other agents' trees
    tool = b.where((F.col("span_type") == "execute_tool") & at("gen_ai.tool.name").isNotNull() & (at("gen_ai.tool.name") != MERGED_TOOLS))
    owner = hierarchy.nearest_ancestor(b.select("trace_id", "span_id", "parent_span_id", "span_type"), F.col("span_type") == "invoke_agent", F.col("span_type") == "execute_tool")
    results = tool.withColumn("result", at("gcp.vertex.agent.tool_response")).join(owner, ["trace_id", "span_id"]).groupBy("trace_id", F.col("ancestor").alias("span_id")).agg(F.max_by("result", order).alias("last_result"))
    agents = b.where("span_type = 'invoke_agent'").join(kids, ["trace_id", "span_id"], "left").join(results, ["trace_id", "span_id"], "left")
    none = F.lit(None).cast("string")
    said = first_text(F.col("answered"), F.col("last_result"))
    agents = agents.where(first_text(F.col("user_prompt")).isNotNull() | said.isNotNull()).select(
        *normalize.BASE, "span_type", F.coalesce("user_prompt", F.lit("")).alias("user_prompt"), "system_prompt", F.coalesce(said, F.lit("")).alias("agent_response"),
        F.coalesce("tools", F.array().cast("array<string>")).alias("tools"), *(none.alias(c) for c in ("tool_name", "tool_arguments", "tool_result", "tool_error")))
    arguments = F.try_parse_json(at("gcp.vertex.agent.tool_call_args"))
    error = F.coalesce(at("error.type"), F.when(F.col("status") == "ERROR", F.coalesce(blank_to_null(F.col("status_text")), F.lit("error"))))
    tools = tool.select(
        *normalize.BASE, "span_type", none.alias("user_prompt"), none.alias("system_prompt"), none.alias("agent_response"), F.array().cast("array<string>").alias("tools"),
        at("gen_ai.tool.name").alias("tool_name"), F.when(is_object(arguments), F.to_json(arguments)).otherwise("{}").alias("tool_arguments"),
        F.coalesce(at("gcp.vertex.agent.tool_response"), F.lit("")).alias("tool_result"), error.alias("tool_error"))
    return agents.unionByName(tools)


# --- search index --------------------------------------------------------------------------------------------------------


def with_child_tools(spans: DataFrame) -> DataFrame:
    """Agent spans with the distinct names of the tools right below them, in order; agents with neither prompt nor response
    are left out."""
    tools = spans.where("span_type = 'execute_tool' and coalesce(tool_name, '') <> ''").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.array_sort(F.collect_set("tool_name")).alias("available_tools"))
    agents = spans.where((F.col("span_type") == "invoke_agent") & first_text(F.col("user_prompt"), F.col("agent_response")).isNotNull())
    return agents.join(tools, ["trace_id", "span_id"], "left").withColumn("available_tools", F.coalesce("available_tools", F.array().cast("array<string>")))


# --- conventions and prompts of a trace ------------------------------------------------------------------------------------


def convention(raw: DataFrame) -> DataFrame:
    """(session_id, convention): ``latest`` if the first span of a session says its provider by the newer attribute, else
    ``legacy``; the first span decides alone."""
    b = normalize.base(raw).select("session_id", "span_pos", F.when(normalize.attribute("gen_ai.provider.name").isNotNull(), "latest").otherwise("legacy").alias("convention"))
    return b.groupBy("session_id").agg(F.min_by("convention", "span_pos").alias("convention"))


def with_system_prompt(spans: DataFrame) -> DataFrame:
    """Agent spans without a system prompt take the first of their trace."""
    w = Window.partitionBy("session_id", "trace_id").orderBy("span_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(blank_to_null(F.col("system_prompt")), ignorenulls=True).over(w)
    agent = F.col("span_type") == "invoke_agent"
    return spans.withColumn("system_prompt", F.when(agent, F.coalesce(blank_to_null(F.col("system_prompt")), first)).otherwise(F.col("system_prompt")))
