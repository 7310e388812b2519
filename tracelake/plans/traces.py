"""Registered queries of span producers, observations, logs, tool histories and skills."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracelake.operators import extraction, history, skills
from tracelake.plans import adapters as A
from tracelake.plans.registry import register
from tracelake.runtime import table
from tracelake.sources import normalize, observations, producers, spans, store


def _json(**fields: Column) -> Column:
    """JSON text of an object; fields that are null are left out."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def _map(**fields: Column) -> Column:
    """A map of dotted names (written with two underscores) to texts, nulls left out."""
    pairs = [x for k, v in fields.items() for x in (F.lit(k.replace("__", ".")), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _raw(rows, pos: Column, span_id: Column, attributes: Column, scope: str | None = None, name: Column | None = None, parent: Column | None = None, trace: Column | None = None, start: Column | None = None, **more: Column):
    none = F.lit(None).cast("string")
    body = F.struct(
        span_id.cast("string").alias("span_id"), (F.lit("t") if trace is None else trace).cast("string").alias("trace_id"), (none if parent is None else parent).cast("string").alias("parent_span_id"),
        (F.lit("span") if name is None else name).alias("name"), (none if start is None else start).alias("start_time"), F.struct(F.lit(scope).alias("name")).alias("scope"), attributes.alias("attributes"), *(c.alias(k) for k, c in more.items()))
    return rows.select(pos.cast("long").alias("span_pos"), F.parse_json(F.to_json(body)).alias("span"))


def _turns(spark, sf_dir):
    """User turns with the text before them and the answer after them."""
    m = A.messages(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = m.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"), F.first("text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_text"))
    return t.where("role = 'user'").withColumn("answer", F.when(F.col("next_role") == "assistant", F.col("next_text"))).withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))


_TURNS = """asked as (select *, conv_id * 1000 + turn as pos, case when next_role = 'assistant' then next_text end as answer from (select *, lead(role) over w as next_role, lead(text) over w as next_text, first(text) over w as first_text
  from conversations window w as (partition by conv_id order by turn)) where role = 'user')"""


# --- producers ---------------------------------------------------------------------------------------------------------


@register(
    """select pos as span_pos, 'inference' as span_type, text as user_prompt, 'be kind' as system_prompt, coalesce(answer, '') as agent_response, case when answer is null then 0 else 1 end as calls, 'add,sub' as tools from asked
    union all select pos + 100000000, 'invoke_agent', 'do ' || turn, null, coalesce(answer, 'broken'), 0, '' from asked""", _TURNS,
)
def openinference_spans(spark, sf_dir):
    t = _turns(spark, sf_dir)
    tool = lambda n: _json(name=F.lit(n))
    chat = _raw(t, F.col("pos"), F.col("pos"), _map(
        openinference__span__kind=F.lit("LLM"), llm__input_messages__0__message__role=F.lit("system"), llm__input_messages__0__message__content=F.lit("be kind"), llm__input_messages__1__message__role=F.lit("user"),
        llm__input_messages__1__message__content=F.col("text"), llm__input_messages__2__message__role=F.lit("user"), llm__input_messages__2__message__content=F.lit("later"), llm__output_messages__0__message__role=F.lit("assistant"),
        llm__output_messages__0__message__content=F.col("answer"), **{"llm.output_messages.0.message.tool_calls.0.tool_call.function.name": F.lit("add"), "llm.output_messages.0.message.tool_calls.0.tool_call.function.arguments": F.lit("{}")},
        **{"llm.tools.0.tool.json_schema": tool("sub"), "llm.tools.1.tool.json_schema": tool("add")}), "openinference.instrumentation.langchain")
    failed = F.when(F.col("answer").isNull(), F.struct(F.lit("ERROR").alias("code"), F.lit("broken").alias("description")))
    agent = _raw(t, F.col("pos") + 100_000_000, F.col("pos"), _map(openinference__span__kind=F.lit("AGENT"), input__value=_json(task=F.concat(F.lit("do "), "turn")), output__value=F.col("answer")),
                 "openinference.instrumentation.smolagents", status=failed)
    bare = _raw(t, F.col("pos") + 200_000_000, F.col("pos"), _map(openinference__span__kind=F.lit("AGENT"), input__value=F.lit("no answer")), "openinference.instrumentation.langchain")
    out = producers.openinference(chat.unionByName(agent).unionByName(bare))
    n = F.when(F.col("tool_calls").isNull(), 0).otherwise(F.size("tool_calls"))
    return out.select("span_pos", "span_type", "user_prompt", "system_prompt", F.coalesce("agent_response", F.lit("")).alias("agent_response"), n.alias("calls"), F.array_join("tools", ",").alias("tools"))


@register(
    """select event_id as span_pos, event_type as tool_name, case when event_id % 4 = 1 then '{"k":"v"}' else replace(props, ' ', '') end as tool_arguments,
    case event_id % 4 when 0 then 'plain ' || user_id when 1 then 'content ' || user_id when 2 then 'a' || chr(10) || 'b' else 'boom' end as tool_result, case when event_id % 4 = 3 then 'error' when event_id % 4 = 1 and event_type = 'error' then 'failed' end as tool_error
    from events where event_type <> 'signup'"""
)
def openinference_tools(spark, sf_dir):
    """Arguments as JSON or as a literal; results as text, as an object with content, as blocks, or only an error. Spans
    without arguments are left out."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    given = F.when(F.col("event_type") != "signup", F.when(k == 1, F.lit("{'k': 'v'}")).otherwise(F.col("props")))
    user = F.col("user_id").cast("string")
    value = F.when(k == 0, F.concat(F.lit("plain "), user)).when(k == 1, _json(content=F.concat(F.lit("content "), user), status=F.when(F.col("event_type") == "error", "failed").otherwise("success"))).when(k == 2, F.lit('[{"text":"a"},{"text":"b"}]'))
    status = F.when(k == 3, F.struct(F.lit("ERROR").alias("code"), F.lit("boom").alias("description")))
    raw = _raw(e, F.col("event_id"), F.col("event_id"), _map(openinference__span__kind=F.lit("TOOL"), tool__name=F.col("event_type"), input__value=given, output__value=value), "openinference.instrumentation.langchain", status=status)
    return producers.openinference(raw).select("span_pos", "tool_name", "tool_arguments", "tool_result", "tool_error")


@register(
    """with a as (select *, row_number() over (partition by conv_id order by turn desc) as back from asked where answer is not null) select pos as span_pos, 'invoke_agent' as span_type, text as user_prompt, answer as agent_response from a where back = 1
    union all select pos + 100000000, 'inference', 'last', answer from asked""", _TURNS,
)
def langchain_spans(spark, sf_dir):
    """Agents from entity attributes, of which each trace's last counts; inferences from numbered attributes."""
    t = _turns(spark, sf_dir)
    said = lambda kind, text: F.struct(F.struct(F.lit(kind).alias("type"), text.alias("content")).alias("kwargs"))
    given = _json(inputs=F.struct(F.array(said("human", F.lit("first")), said("human", F.col("text"))).alias("messages")))
    told = F.when(F.col("answer").isNotNull(), _json(outputs=F.struct(F.array(said("ai", F.lit("draft")), said("ai", F.col("answer")), said("tool", F.lit("tool text"))).alias("messages"))))
    start = F.col("pos").cast("string")
    agent = _raw(t, F.col("pos"), F.col("pos"), _map(traceloop__span__kind=F.lit("workflow"), traceloop__entity__input=given, traceloop__entity__output=told), "opentelemetry.instrumentation.langchain", trace=F.col("conv_id"), start=start)
    chat = _raw(t, F.col("pos") + 100_000_000, F.col("pos"), _map(
        llm__request__type=F.lit("chat"), gen_ai__prompt__0__role=F.lit("user"), gen_ai__prompt__0__content=F.col("text"), gen_ai__prompt__1__role=F.lit("user"), gen_ai__prompt__1__content=F.lit("last"),
        gen_ai__completion__0__role=F.lit("assistant"), gen_ai__completion__0__content=F.col("answer")), "opentelemetry.instrumentation.langchain", trace=F.col("conv_id"), start=start)
    return producers.langchain(agent.unionByName(chat)).select("span_pos", "span_type", "user_prompt", "agent_response")


@register(
    """select event_id as span_pos, event_type as tool_name, '{"k":' || event_id || '}' as tool_arguments, 'r' || user_id as tool_result, case when event_type = 'error' then 'error' end as tool_error, 'c' || event_id as tool_call_id from events where event_id % 4 <> 3"""
)
def langchain_tools(spark, sf_dir):
    """Arguments of a call with its context, direct ones, and ones in a text; other layouts are left out."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    arguments = F.struct(F.col("event_id").alias("k"))
    call = F.struct(F.lit("tool_call_with_context").alias("__type"), F.struct(F.col("event_type").alias("name"), arguments.alias("args"), F.concat(F.lit("c"), "event_id").alias("id")).alias("tool_call"))
    given = F.when(k == 0, _json(inputs=call)).when(k == 1, _json(inputs=arguments)).when(k == 2, _json(input_str=F.to_json(arguments))).otherwise("nothing")
    answer = F.struct(F.concat(F.lit("r"), "user_id").alias("content"), F.concat(F.lit("c"), "event_id").alias("tool_call_id"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    raw = _raw(e, F.col("event_id"), F.col("event_id"), _map(traceloop__span__kind=F.lit("tool"), traceloop__entity__name=F.col("event_type"), traceloop__entity__input=given, traceloop__entity__output=_json(output=F.struct(answer.alias("kwargs")))),
               "opentelemetry.instrumentation.langchain")
    return producers.langchain(raw).select("span_pos", "tool_name", "tool_arguments", "tool_result", "tool_error", "tool_call_id")


@register(
    """with c as (select conv_id, arg_max(text, turn) as last, arg_max(answer, turn) as answer, count(answer) as n_answers, max(turn) as turn from asked group by conv_id), l as (select conv_id, answer, text from asked a where turn = (select max(turn) from asked b where b.conv_id = a.conv_id))
    select c.conv_id as span_pos, 'invoke_agent' as span_type, l.text as user_prompt, 'sys' as system_prompt, coalesce(l.answer, 'tool of ' || c.conv_id) as agent_response, 'f1,f2' as tools, null as tool_name from c join l using (conv_id)
    union all select conv_id + 500000, 'execute_tool', null, null, null, '', 'look' from c""", _TURNS,
)
def adk_spans(spark, sf_dir):
    """Agents from their model calls; where the last call only asks for a function, the last tool's result answers."""
    t = _turns(spark, sf_dir)
    conv = t.select("conv_id").distinct()
    scope = "gcp.vertex.agent"
    parts = lambda text: F.struct(F.array(F.struct(F.lit("hidden").alias("text"), F.lit(True).alias("thought")), F.struct(text.alias("text"), F.lit(False).alias("thought"))).alias("parts"), F.lit("user").alias("role"))
    function = F.struct(F.array(F.struct(F.lit("f1").alias("name")), F.struct(F.lit("f2").alias("name"))).alias("function_declarations"))
    asked = _json(contents=F.array(parts(F.col("text"))), config=F.struct(F.lit("sys").alias("system_instruction"), F.array(function).alias("tools")))
    called = F.lit('{"content":{"parts":[{"text":"preamble"},{"function_call":{"name":"f1"}}]}}')
    told = F.when(F.col("answer").isNull(), called).otherwise(_json(content=F.struct(F.array(F.struct(F.col("answer").alias("text"))).alias("parts"))))
    key = lambda c: F.concat(F.lit(c), F.col("conv_id").cast("string"))
    agents = _raw(conv, F.col("conv_id"), key("a"), _map(gen_ai__operation__name=F.lit("invoke_agent")), scope, trace=F.col("conv_id"))
    calls = _raw(t, F.col("pos") + 1_000_000, F.concat(F.lit("m"), "pos"), _map(gcp__vertex__agent__llm_request=asked, gcp__vertex__agent__llm_response=told), scope, F.lit("call_llm"), key("a"), F.col("conv_id"), F.col("pos").cast("string"))
    inner = _raw(conv, F.col("conv_id") + 600_000, key("x"), _map(other=F.lit("x")), scope, F.lit("step"), key("a"), F.col("conv_id"))
    tools = _raw(conv, F.col("conv_id") + 500_000, key("t"), _map(gen_ai__operation__name=F.lit("execute_tool"), gen_ai__tool__name=F.lit("look"), gcp__vertex__agent__tool_response=F.concat(F.lit("tool of "), F.col("conv_id").cast("string"))), scope, F.lit("t"), key("x"), F.col("conv_id"))
    merged = _raw(conv, F.col("conv_id") + 700_000, key("z"), _map(gen_ai__operation__name=F.lit("execute_tool"), gen_ai__tool__name=F.lit(producers.MERGED_TOOLS), gcp__vertex__agent__tool_response=F.lit("no")), scope, F.lit("t"), key("x"), F.col("conv_id"))
    raw = agents.unionByName(calls).unionByName(inner).unionByName(tools).unionByName(merged)
    return producers.adk(raw).select("span_pos", "span_type", "user_prompt", "system_prompt", "agent_response", F.array_join("tools", ",").alias("tools"), "tool_name")


@register(
    """select user_id as trace_id, 'root' as span_id, string_agg(distinct event_type, ',' order by event_type) filter (where event_id % 2 = 0 and event_type <> 'signup') as available_tools from events group by user_id having bool_or(event_id % 2 = 0 and event_type <> 'signup')
    union all select user_id, 'root', '' from events group by user_id having not bool_or(event_id % 2 = 0 and event_type <> 'signup')"""
)
def child_tools(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    tools = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.when(F.col("event_id") % 2 == 0, "root").otherwise("other").alias("parent_span_id"), F.lit("execute_tool").alias("span_type"),
                     F.when(F.col("event_type") != "signup", F.col("event_type")).alias("tool_name"), none.alias("user_prompt"), none.alias("agent_response"))
    users = e.select(F.col("user_id").alias("trace_id")).distinct()
    agents = users.select("trace_id", F.lit("root").alias("span_id"), none.alias("parent_span_id"), F.lit("invoke_agent").alias("span_type"), none.alias("tool_name"), F.lit("hi").alias("user_prompt"), none.alias("agent_response"))
    empty = users.select("trace_id", F.lit("bare").alias("span_id"), none.alias("parent_span_id"), F.lit("invoke_agent").alias("span_type"), none.alias("tool_name"), none.alias("user_prompt"), F.lit("").alias("agent_response"))
    found = producers.with_child_tools(tools.unionByName(agents).unionByName(empty))
    return found.select("trace_id", "span_id", F.array_join("available_tools", ",").alias("available_tools"))


@register("select 'u' || user_id as session_id, case when arg_min(event_type, event_id) in ('view', 'click') then 'latest' else 'legacy' end as convention from events group by user_id")
def conventions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = _raw(e, F.col("event_id"), F.col("event_id"), _map(session__id=F.concat(F.lit("u"), "user_id"), gen_ai__provider__name=F.when(F.col("event_type").isin("view", "click"), F.lit("p"))))
    return producers.convention(raw)


@register(
    """with f as (select user_id, arg_min(event_id, event_id) filter (where event_type = 'signup') as first from events group by user_id)
    select event_id as span_pos, case when event_type = 'signup' then 'prompt ' || event_id when event_type = 'purchase' and first is not null then 'prompt ' || first end as system_prompt from events join f using (user_id)"""
)
def system_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("session_id"), F.lit("t").alias("trace_id"), F.col("event_id").alias("span_pos"), F.when(F.col("event_type") == "purchase", "invoke_agent").otherwise("inference").alias("span_type"),
                    F.when(F.col("event_type") == "signup", F.concat(F.lit("prompt "), "event_id")).when(F.col("event_type") == "purchase", F.lit("")).alias("system_prompt"))
    out = producers.with_system_prompt(rows)
    return out.select("span_pos", F.nullif("system_prompt", F.lit("")).alias("system_prompt"))


@register("select event_id, case when event_type in ('view', 'click') then 'langchain' when event_type = 'purchase' then 'adk' when event_type = 'error' then 'adk' end as family from events where event_type <> 'signup'")
def scope_families(spark, sf_dir):
    scope = F.when(F.col("event_type").isin("view", "click"), "opentelemetry.instrumentation.langchain").when(F.col("event_type") == "purchase", "gcp.vertex.agent").when(F.col("event_type") == "error", "").otherwise("http")
    e = table(spark, sf_dir, "events").withColumn("scope", scope)
    parts = [producers.of_family(e, f).select("event_id", F.lit(f).alias("family")) for f in ("langchain", "adk", "openinference")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- observations ------------------------------------------------------------------------------------------------------


@register(
    """select pos as span_pos, cast(conv_id as varchar) as session_id, 'invoke_agent' as span_type, text as user_prompt, coalesce(answer, '') as agent_response, 'a,b' as tools, '' as parts from asked
    union all select pos + 100000000, cast(conv_id as varchar), 'inference', null, null, null, 'user:text=' || text || '|user:tool_result=one|assistant:text=' || coalesce(answer, 'hm') || ',tool_call=f{"x":1}' from asked""", _TURNS,
)
def observation_spans(spark, sf_dir):
    t = _turns(spark, sf_dir)
    session = F.col("conv_id").cast("string")
    agent = F.to_json(F.struct(
        F.col("pos").cast("string").alias("id"), F.lit("t").alias("traceId"), F.lit("CHAIN").alias("type"), session.alias("sessionId"), F.struct(F.array(F.struct(F.lit("human").alias("type"), F.col("text").alias("content"))).alias("messages")).alias("input"),
        F.struct(F.coalesce("answer", F.lit("")).alias("output")).alias("output"), F.struct(F.lit('["a", 3, "b"]').alias("tools")).alias("metadata")))
    blocks = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.col("text").alias("text"))).alias("content")))
    result = F.lit('{"role":"tool","content":[{"toolResult":{"toolUseId":"c","content":[{"text":"one"},{"text":"two"}]}}]}')
    odd = F.lit('{"role":"user","content":[]}')
    said = F.to_json(F.struct(F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("hm")).alias("content"), F.array(F.struct(F.lit("f").alias("name"), F.struct(F.lit(1).alias("x")).alias("args"))).alias("tool_calls")))
    generation = F.concat(F.lit('{"id":"g","traceId":"t","type":"GENERATION","sessionId":"'), session, F.lit('","input":['), blocks, F.lit(","), result, F.lit(","), odd, F.lit('],"output":'), said, F.lit("}"))
    skipped = F.lit('{"id":"e","type":"EVENT","traceId":"t"}')
    rows = t.select(F.explode(F.array(F.struct(F.col("pos").alias("pos"), agent.alias("obs")), F.struct((F.col("pos") + 100_000_000).alias("pos"), generation.alias("obs")), F.struct((F.col("pos") + 200_000_000).alias("pos"), skipped.alias("obs")))).alias("x"))
    out = observations.spans(rows.select("x.pos", F.parse_json("x.obs").alias("obs")))
    part = lambda p: F.concat(p["kind"], F.lit("="), F.coalesce(p["text"], F.concat(p["name"], p["arguments"])))
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["parts"], part), ","))), "|")
    return out.select("span_pos", "session_id", "span_type", "user_prompt", "agent_response", F.array_join("available_tools", ",").alias("tools"), F.coalesce(shown, F.lit("")).alias("parts"))


@register(
    """select event_id as span_pos, event_type as tool_name, case event_id % 5 when 3 then '{"input":"free text"}' when 4 then '{}' else '{"k":' || event_id || '}' end as tool_arguments,
    case event_id % 5 when 0 then 'r' || user_id when 1 then 'first' else 'text' end as tool_result, case when event_id % 5 = 0 and event_type = 'error' then 'r' || user_id end as tool_error from events"""
)
def observation_tools(spark, sf_dir):
    """Payloads that name their tool, are objects, lists of tool messages, texts, or missing."""
    e = table(spark, sf_dir, "events")
    k, tool = F.col("event_id") % 5, F.col("event_type")
    arguments = F.struct(F.col("event_id").alias("k"))
    given = F.when(k == 0, F.to_json(F.struct(tool.alias("name"), arguments.alias("arguments")))).when(k == 1, F.to_json(F.array(F.struct(F.lit("tool").alias("role"), F.to_json(arguments).alias("content"))))).when(
        k == 2, F.to_json(arguments)).when(k == 3, F.lit('"free text"')).otherwise("null")
    told = F.when(k == 0, _json(result=F.concat(F.lit("r"), "user_id"), status=F.when(tool == "error", "error").otherwise("success"))).when(k == 1, _json(message=F.lit('[{"text": "first"}, {"text": "second"}]'))).otherwise('"text"')
    head = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","traceId":"t","parentObservationId":"p","type":"'), F.when(k == 0, "SPAN").otherwise("TOOL"), F.lit('","name":"'), F.when(k == 0, F.concat(F.lit("execute_tool "), tool)).otherwise(tool))
    body = F.concat(head, F.lit('","input":'), given, F.lit(',"output":'), told, F.lit("}"))
    out = observations.spans(e.select(F.col("event_id").alias("pos"), F.parse_json(body).alias("obs")))
    return out.select("span_pos", "tool_name", "tool_arguments", "tool_result", "tool_error")


# --- logs and shapes ---------------------------------------------------------------------------------------------------


@register(
    """select event_id as span_pos, cast(event_id as varchar) as span_id, 'u' || user_id as trace_id, case when event_type = 'view' then 1 else 0 end as n_events from events where event_type in ('view', 'click')"""
)
def log_spans(spark, sf_dir):
    """Span records with and without an event, events of no span, and other records."""
    e = table(spark, sf_dir, "events")
    ids = dict(traceId=F.concat(F.lit("u"), "user_id"), spanId=F.col("event_id").cast("string"))
    span = _json(**ids, name=F.lit("s"), startTimeUnixNano=F.lit(10**18), endTimeUnixNano=F.lit(10**18 + 5))
    event = _json(**ids, timeUnixNano=F.lit(10**18), attributes=F.create_map(F.lit("event.name"), F.lit("x")), body=F.struct(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages")).alias("input")))
    records = F.when(F.col("event_type") == "view", F.array(span, event)).when(F.col("event_type") == "click", F.array(span)).when(F.col("event_type") == "error", F.array(event)).otherwise(F.array(_json(message=F.lit("started"))))
    rows = e.select((F.col("event_id") * 1).alias("pos"), F.explode(records).alias("r")).select("pos", F.parse_json("r").alias("record"))
    out = normalize.parse_logs(rows)
    got = lambda p: F.try_variant_get("span", p, "string")
    return out.select("span_pos", got("$.span_id").alias("span_id"), got("$.trace_id").alias("trace_id"), F.size(F.try_variant_get("span", "$.span_events", "array<variant>")).alias("n_events"))


@register("select cast(event_id as varchar) as span_id, case when event_type = 'view' then 'p' || event_id else 'old' end as parent_span_id from events")
def enriched_parents(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("span_id", F.col("event_id").cast("string"))
    known = e.where("event_type = 'view'").select("span_id", F.concat(F.lit("p"), "span_id").alias("parent"))
    return normalize.enrich_parents(e.select("span_id", F.lit("old").alias("parent_span_id")), known)


@register("select user_id, count(*) as n from events where event_type <> 'signup' group by user_id")
def flat_spans(spark, sf_dir):
    """Spans from lists, from wrappers around lists, and from maps by trace; what is no object is dropped."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    one = F.struct(F.col("event_id").cast("string").alias("span_id"), F.lit("s").alias("name"), F.col("user_id").cast("string").alias("user"))
    g = e.groupBy("user_id").agg(F.to_json(F.collect_list(one)).alias("all"))
    k = F.col("user_id") % 3
    body = F.when(k == 0, F.col("all")).when(k == 1, F.concat(F.lit('[{"spans":'), "all", F.lit("}]"))).otherwise(F.concat(F.lit('{"t1":'), "all", F.lit("}")))
    out = spans.flat_spans(g.select(F.parse_json(body).alias("record")))
    return out.groupBy(F.try_variant_get("span", "$.user", "long").alias("user_id")).agg(F.count("*").alias("n"))


@register("select p_partkey, p_name || chr(10) || '[image]' || case when p_partkey % 2 = 0 then chr(10) || '{\"size\":' || p_size || '}' else '' end as text from part")
def result_texts(spark, sf_dir):
    block = lambda **f: F.concat(F.lit("{"), *[x for k, v in f.items() for x in (F.lit(f'"{k}":'), v)], F.lit("}"))
    text = F.regexp_extract(F.to_json(F.array("p_name")), r"^\[(.*)\]$", 1)
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("["), block(text=text), F.lit(',{"text":""},'), block(image=F.lit('{"format":"png"}')), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(","), block(json=_json(size=F.col("p_size"))))).otherwise(""), F.lit("]"))
    return p.select("p_partkey", normalize.flatten_blocks(body).alias("text"))


@register("select user_id as trace_id, string_agg(distinct event_type, ',' order by event_type) as tools from events group by user_id")
def tool_catalogues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    defined = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.struct(F.struct(F.col("event_type").alias("name")).alias("function")))))
    rows = e.select(F.col("user_id").alias("trace_id"), defined.alias("tool_definitions"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("tool_name"))
    return normalize.tool_catalogue(rows).select("trace_id", F.array_join("tools", ",").alias("tools"))


@register(
    """with k as (select trace_id, arg_min(user_prompt, pos) filter (where user_prompt <> '') as p, arg_max(answer, pos) filter (where answer <> '') as r from (select user_id as trace_id, event_id as pos, case when event_type = 'view' then 'ask ' || event_id end as user_prompt, case when event_type = 'click' then 'said ' || event_id end as answer from events where event_type in ('view', 'click')) group by trace_id)
    select u.user_id as trace_id, coalesce(case when u.user_id % 2 = 0 then 'own' end, p) as user_prompt, r as agent_response from (select distinct user_id from events) u left join k on u.user_id = k.trace_id"""
)
def backfilled_agents(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("string")
    kids = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit("a").alias("parent_span_id"), F.col("event_id").alias("span_pos"), F.col("ts").alias("start_time"), F.lit("inference").alias("span_type"),
                                                             F.when(F.col("event_type") == "view", F.concat(F.lit("ask "), "event_id")).alias("user_prompt"), F.when(F.col("event_type") == "click", F.concat(F.lit("said "), "event_id")).alias("agent_response"))
    kids = kids.withColumn("start_time", F.timestamp_seconds("span_pos"))
    agents = e.select(F.col("user_id").alias("trace_id")).distinct().select("trace_id", F.lit("a").alias("span_id"), none.alias("parent_span_id"), F.lit(-1).cast("long").alias("span_pos"), F.timestamp_seconds(F.lit(0)).alias("start_time"), F.lit("invoke_agent").alias("span_type"),
                                                                            F.when(F.col("trace_id") % 2 == 0, "own").otherwise("").alias("user_prompt"), none.alias("agent_response"))
    out = normalize.backfill_agents(kids.unionByName(agents)).where("span_type = 'invoke_agent'")
    return out.select("trace_id", "user_prompt", "agent_response")


@register("select event_id, event_type <> 'signup' as found, case when event_type <> 'signup' then user_id end as output from events")
def looked_up_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cases = e.select("event_id", F.col("event_id").cast("string").alias("session_id"))
    outputs = e.where("event_type <> 'signup'").select(F.col("event_id").cast("string").alias("session_id"), F.col("user_id").alias("output"))
    return store.lookup(cases, outputs).select("event_id", "found", "output")


@register("select p_partkey, case p_partkey % 4 when 0 then 'data' when 1 then 'base64' when 2 then 'url' else 'path' end as kind, case when p_partkey % 4 < 2 then p_name end as text from part")
def image_payloads(spark, sf_dir):
    k, coded = F.col("p_partkey") % 4, F.base64(F.col("p_name").cast("binary"))
    source = F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), coded)).when(k == 1, coded).when(k == 2, F.lit("https://example.org/x.png")).otherwise("/images/x.png")
    p = table(spark, sf_dir, "part").withColumn("source", source)
    return p.select("p_partkey", store.image_kind(F.col("source")).alias("kind"), F.when(k < 2, store.image_bytes(F.col("source"))).cast("string").alias("text"))


# --- histories ---------------------------------------------------------------------------------------------------------


def _agent_spans(spark, sf_dir):
    """Days of a user as traces: purchases are agents (some without prompt or answer), other calls but sign-ups tools."""
    c = A.calls(spark, sf_dir).where("tool <> 'signup'")
    agent = F.col("tool") == "purchase"
    e = F.col("event_id")
    seq = F.dense_rank().over(Window.partitionBy("session").orderBy("trace_id"))
    rows = c.select(
        F.col("session").alias("session_id"), seq.alias("trace_seq"), e.cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("pos").alias("span_pos"), "start", "end",
        F.when(agent, "invoke_agent").otherwise("execute_tool").alias("span_type"), F.lit(True).alias("has_content"), F.when(agent & (e % 3 != 0), F.concat(F.lit("ask "), e)).alias("user_prompt"),
        F.when(agent & (e % 2 == 0), F.concat(F.lit("said "), e)).alias("agent_response"), F.when(agent & (e % 4 != 0), F.array(F.concat(F.lit("tool "), e))).alias("available_tools"),
        F.when(~agent, F.col("tool")).alias("tool_name"), "trace_id")
    first = F.min(F.when(F.col("span_type") == "invoke_agent", F.struct("span_pos", "span_id"))).over(Window.partitionBy("session_id", "trace_seq"))
    owner = F.when((F.col("span_type") == "execute_tool") & (F.col("span_id").cast("long") % 2 == 0), first["span_id"])
    return rows.withColumn("owner", owner)


_AGENTS = """days as (select *, dense_rank() over (partition by session order by trace_id) as seq from calls where tool <> 'signup'),
roots as (select session, seq, arg_min(event_id, (start, pos)) as e, arg_min(event_id, pos) as first_agent, count(*) as n_agents from days where tool = 'purchase' group by all),
traces as (select d.session, d.seq, count(*) filter (where tool <> 'purchase') as n_tools, any_value(r.e) as e, any_value(first_agent) as first_agent, coalesce(any_value(n_agents), 0) as n_agents from days d left join roots r on d.session = r.session and d.seq = r.seq group by all),
t as (select *, case when e % 3 <> 0 then 1 else 0 end as has_prompt, (case when e % 3 <> 0 then 1 else 0 end) + (case when n_tools > 0 then 1 else 0 end) + (case when e % 2 = 0 then 1 else 0 end) as entries, case when e % 4 <> 0 then 'tool ' || e end as own from traces)"""


@register(
    """with prior as (select a.session, a.seq, a.pos, count(b.pos) as n from days a left join days b on a.session = b.session and a.seq = b.seq and b.tool <> 'purchase' and (greatest(b."end", b.start) < a.start or (greatest(b."end", b.start) = a.start and b.pos < a.pos)) where a.tool <> 'purchase' group by all)
    select cast(d.event_id as varchar) as span_id, (select coalesce(sum(entries), 0) from t x where x.session = d.session and x.seq < d.seq)::bigint + t.has_prompt + (case when p.n > 0 then 1 else 0 end) as history_size, p.n as prior,
    case when d.event_id % 2 = 0 and t.n_agents > 1 then case when first_agent % 4 <> 0 then 'tool ' || first_agent else '' end else coalesce((select arg_max(x.own, x.seq) from t x where x.session = d.session and x.seq <= d.seq and x.own is not null), '') end as tools,
    row_number() over (partition by d.session order by d.seq, d.pos) - 1 as position
    from days d join t on d.session = t.session and d.seq = t.seq join prior p on p.session = d.session and p.seq = d.seq and p.pos = d.pos where d.tool <> 'purchase'""", A.CALLS_SQL, _AGENTS,
)
def tool_inputs(spark, sf_dir):
    rows = extraction.tool_inputs(_agent_spans(spark, sf_dir))
    return rows.select("span_id", F.col("history_size").cast("long").alias("history_size"), "prior", F.array_join("available_tools", ",").alias("tools"), "position")


@register(
    """with e as (select session, seq, 0 as r, 'ask ' || e as said from t where e % 3 <> 0 union all select d.session, d.seq, 1, string_agg(d.tool, '+' order by d.pos) from days d where tool <> 'purchase' group by all union all select session, seq, 2, 'said ' || e from t where e % 2 = 0)
    select cast(d.event_id as varchar) as span_id, coalesce(string_agg(e.said, '|' order by e.seq, e.r), '') as told from days d left join e on e.session = d.session and (e.seq < d.seq or (e.seq = d.seq and e.r = 0)) where d.tool = 'error' and d.event_id % 4 = 0 group by d.event_id""", A.CALLS_SQL, _AGENTS,
)
def tool_histories(spark, sf_dir):
    """Histories spelled out for the failed calls that a judge would look at."""
    s = _agent_spans(spark, sf_dir)
    picked = extraction.tool_inputs(s).where("tool_name = 'error' and cast(span_id as long) % 4 = 0").select("session_id", "trace_seq", "span_id")
    h = extraction.tool_histories(picked, s)
    told = F.transform("session_history", lambda e: F.array_join(e["texts"], "+"))
    return h.select("span_id", F.coalesce(F.array_join(told, "|"), F.lit("")).alias("told"))


@register("select conv_id, turn, case when turn % 3 = 1 then '' else text end as prompt from conversations")
def history_prompts(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    entry = F.struct(F.when(F.col("turn") % 3 == 1, "tool").otherwise("user").alias("event"), "text")
    earlier = F.struct(F.lit("user").alias("event"), F.lit("earlier").alias("text"))
    return m.select("conv_id", "turn", extraction.user_prompt(F.array(earlier, entry)).alias("prompt"))


@register(
    """with h as (select session, pos, tool, case when tool in ('click', 'view') then lead(tool) over (partition by session order by pos) end as target from calls) select session, pos, tool as source, target from h""", A.CALLS_SQL,
)
def swarm_handoffs(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    after = F.lead("tool").over(Window.partitionBy("session").orderBy("pos"))
    rows = c.select("session", "pos", F.col("tool").alias("node"), F.array(F.struct(F.when(F.col("tool").isin("click", "view"), "handoff_to_agent").otherwise("other").alias("tool"), after.alias("target"))).alias("calls"))
    return history.swarm_handoffs(rows)


@register("select session, pos as place, tool as node, case when pos > 1 then 'before' else '' end as dependencies from calls where tool <> 'error'", A.CALLS_SQL)
def graph_interactions(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    rows = c.select("session", F.col("pos").alias("place"), F.col("tool").alias("node"), F.when(F.col("pos") > 1, F.array(F.lit("before"))).alias("dependencies"), F.array("props").alias("messages"), F.when(F.col("tool") != "error", F.col("props")).alias("result"))
    return history.graph_interactions(rows).select("session", "place", "node", F.array_join("dependencies", ",").alias("dependencies"))


# --- skills ------------------------------------------------------------------------------------------------------------


def _skill_messages(spark, sf_dir):
    """For each event a call of a harness's own shape and, two times of three, its result; ids or none by harness."""
    e = table(spark, sf_dir, "events")
    k, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    skill = F.concat(F.lit("skill-"), (F.col("event_id") % 5).cast("string"))
    said = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Skill '"), skill, F.lit("' not found. Available: none"))).otherwise(F.concat(F.lit("# How to\nuse "), skill))
    arr = lambda role, block: F.concat(F.lit('{"role":"' + role + '","content":['), block, F.lit("]}"))
    wrapped = arr("assistant", _json(toolUse=F.struct(F.lit("skills").alias("name"), i.alias("toolUseId"), F.struct(skill.alias("skill_name")).alias("input"))))
    wrapped_result = arr("user", _json(toolResult=F.struct(i.alias("toolUseId"), F.lit("success").alias("status"), F.array(F.struct(said.alias("text"))).alias("content"))))
    typed = arr("assistant", _json(type=F.lit("tool_use"), id=i, name=F.lit("Skill"), input=F.struct(skill.alias("skill"))))
    typed_result = arr("user", _json(type=F.lit("tool_result"), tool_use_id=i, content=said))
    coded = _json(type=F.lit("function_call"), call_id=i, name=F.lit("exec_command"), arguments=_json(cmd=F.concat(F.lit("bash -lc 'cat skills/"), skill, F.lit("/SKILL.md | head -20'"))))
    coded_result = _json(type=F.lit("function_call_output"), call_id=i, output=F.concat(F.lit("Wall time: 0.1 seconds\nProcess exited with code "), F.when(F.col("event_id") % 3 == 1, "1").otherwise("0"), F.lit("\nOutput:\n"), said))
    bare = arr("assistant", _json(name=F.lit("load_skill"), args=F.struct(skill.alias("skill_name"))))
    bare_result = _json(type=F.lit("tool_response"), content=said)
    call = F.when(k == 0, wrapped).when(k == 1, typed).when(k == 2, coded).otherwise(bare)
    result = F.when(k == 0, wrapped_result).when(k == 1, typed_result).when(k == 2, coded_result).otherwise(bare_result)
    items = F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.lit(0).alias("at"), call.alias("item")))).otherwise(F.array(F.struct(F.lit(0).alias("at"), call.alias("item")), F.struct(F.lit(1).alias("at"), result.alias("item"))))
    rows = e.select(F.col("user_id").alias("session_id"), "event_id", F.explode(items).alias("x"))
    return rows.select("session_id", (F.col("event_id") * 2 + F.col("x.at")).cast("long").alias("msg_pos"), "x.item")


@register(
    """select user_id as session_id, event_id * 2 as position, 'skill-' || event_id % 5 as name, case event_id % 3 when 0 then 'attempted' when 1 then 'failed' else 'loaded' end as status,
    case when event_id % 3 = 2 then '# How to' || chr(10) || 'use skill-' || event_id % 5 end as body, case when event_id % 3 = 1 then 'Skill ''skill-' || event_id % 5 || ''' not found. Available: none' end as error from events where event_id % 4 <> 2
    union all select user_id, event_id * 2, 'skill-' || event_id % 5, 'loaded', '# How to' || chr(10) || 'use skill-' || event_id % 5, null from events where event_id % 4 = 2 and event_id % 3 = 2"""
)
def skill_loads(spark, sf_dir):
    """Loads of skills in message histories of four harnesses; reads of a skill's file count if they give its text."""
    return skills.list_events(_skill_messages(spark, sf_dir)).select("session_id", "position", "name", "status", "body", "error")


@register(
    """with l as (select user_id, event_id, 'skill-' || event_id % 5 as name, case event_id % 3 when 0 then 'attempted' when 1 then 'failed' else 'loaded' end as status from events where event_id % 4 <> 2 or event_id % 3 = 2)
    select user_id as session_id, name, case when bool_or(status = 'loaded') then 'loaded' else arg_min(status, event_id) end as status, min(event_id) * 2 as first_position from l group by user_id, name"""
)
def invoked_skills(spark, sf_dir):
    events = skills.list_events(_skill_messages(spark, sf_dir))
    return extraction.invoked_skills(events).select("session_id", "name", "status", "first_position")


@register(
    """with l as (select user_id, event_id, 'skill-' || event_id % 5 as name, event_id % 3 as s from events where event_id % 4 <> 2 or event_id % 3 = 2), g as (select user_id, coalesce(bool_or(name = 'skill-2' and s = 2), false) as hit, count(*) filter (where name = 'skill-2') as tries from l group by user_id)
    select u.user_id as session_id, coalesce(hit, false)::int::double as score, case when g.user_id is null then 'no skill was invoked' when hit then 'invoked' when tries > 0 then 'failed' else 'not among' end as reason from (select distinct user_id from events) u left join g on u.user_id = g.user_id"""
)
def skill_verdicts(spark, sf_dir):
    events = skills.list_events(_skill_messages(spark, sf_dir))
    sessions_ = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"))
    v = extraction.skill_invoked(events, sessions_, "skill-2")
    shown = F.when(F.col("reason").rlike("was invoked$") & (F.col("score") > 0), "invoked").when(F.col("reason").rlike("failed in"), "failed").when(F.col("reason").rlike("not among"), "not among").otherwise(F.col("reason"))
    return v.select("session_id", "score", shown.alias("reason"))


@register(
    """select p_partkey, case when p_partkey % 8 in (0, 1, 2, 7) then replace(p_name, ' ', '-') end as skill from part"""
)
def skill_reads(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, path = F.col("p_partkey") % 8, F.concat(F.lit("skills/"), F.translate("p_name", " ", "-"), F.lit("/SKILL.md"))
    command = (
        F.when(k == 0, F.concat(F.lit("sudo env A=b cat "), path)).when(k == 1, F.concat(F.lit('/bin/sh -c "ls && head -5 '), path, F.lit('"'))).when(k == 2, F.concat(F.lit("type \""), path, F.lit('"')))
        .when(k == 3, F.concat(F.lit("cat draft.md > "), path)).when(k == 4, F.concat(F.lit("sed -i 's/a/b/' "), path)).when(k == 5, F.concat(F.lit("cat data.csv; ls -l "), path)).when(k == 6, F.concat(F.lit("more "), path))
        .otherwise(F.concat(F.lit("nohup sed -n 1,5p "), path)))
    return p.select("p_partkey", extraction.skill_read(command).alias("skill"))


@register(
    """select n_regionkey as session_id, n_name as name, case when n_regionkey % 2 = 0 then 'about <' || n_nationkey || '>' else 'about ' || n_nationkey end as description, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos from nation"""
)
def listed_skills(spark, sf_dir):
    """Catalogues as marked-up blocks and as Markdown; an empty one before them does not count."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    marked = F.concat(F.lit("<skill><name> "), "n_name", F.lit(" </name><description>about &lt;"), k, F.lit("&gt;</description></skill>"))
    plain = F.concat(F.lit("- "), "n_name", F.lit(": about "), k, F.lit(" (file: x/SKILL.md)"))
    lines = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", c.alias("s")))), lambda x: x["s"])
    g = n.groupBy("n_regionkey").agg(lines(marked).alias("m"), lines(plain).alias("p"))
    body = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("You may.\n<available_skills>"), F.array_join("m", "\n"), F.lit("</available_skills>"))).otherwise(F.concat(F.lit("Intro\n### Available skills\n"), F.array_join("p", "\n"), F.lit("\n### Rules\n- none: at all")))
    items = F.array(_json(role=F.lit("system"), content=F.lit("<available_skills></available_skills>")), _json(role=F.lit("system"), content=body))
    rows = g.select(F.col("n_regionkey").alias("session_id"), F.posexplode(items).alias("msg_pos", "item"))
    return skills.listed_skills(rows).select("session_id", "name", "description", F.col("pos").cast("long").alias("pos"))


@register("select n_nationkey as session_id, n_nationkey % 3 <> 0 as advertised from nation")
def advertised_skills(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "no skills here").when(k == 1, "<available_skills>\n</available_skills>").otherwise("x\n### Available skills\n- a: b")
    return extraction.advertised(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("session_id"), text.alias("text")))


@register(
    """select user_id as session_id, event_id * 2 as msg_pos, event_type as name, case when event_id % 3 <> 0 then 'result ' || event_id end as tool_result, case when event_id % 3 <> 0 then event_type = 'error' end as is_error from events"""
)
def tools_used_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id").cast("string")
    call = F.to_json(F.array(F.struct(F.struct(F.col("event_type").alias("name"), i.alias("toolUseId"), F.struct(F.col("user_id").alias("u")).alias("input")).alias("toolUse"))))
    status = F.when(F.col("event_type") == "error", "error").otherwise("success")
    result = F.to_json(F.array(F.struct(F.struct(i.alias("toolUseId"), status.alias("status"), F.array(F.struct(F.concat(F.lit("result "), i).alias("text"))).alias("content")).alias("toolResult"))))
    both = F.array(F.struct(F.lit(0).alias("at"), F.lit("assistant").alias("role"), call.alias("content")), F.struct(F.lit(1).alias("at"), F.lit("user").alias("role"), result.alias("content")))
    rows = e.select(F.col("user_id").alias("session_id"), "event_id", F.explode(F.when(F.col("event_id") % 3 == 0, F.slice(both, 1, 1)).otherwise(both)).alias("x"))
    m = rows.select("session_id", (F.col("event_id") * 2 + F.col("x.at")).alias("msg_pos"), "x.role", "x.content")
    return extraction.tools_used(m).select("session_id", "msg_pos", "name", "tool_result", "is_error")


@register(
    """with t as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as position from events)
    select user_id as session_id, 'pdf' as name, case when event_type = 'error' then 'failed' else 'loaded' end as status, position from t where event_type in ('click', 'error') union all
    select user_id, 'csv', 'loaded', position from t where event_type = 'view'"""
)
def skill_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    rows = e.select(F.col("user_id").alias("session_id"), F.lit(0).alias("trace_seq"), F.col("event_id").alias("span_pos"), F.when(t.isin("click", "error"), "skills").when(t == "view", "bash").otherwise("search").alias("tool_name"),
                    F.when(t == "view", F.lit('{"command":"cat skills/csv/SKILL.md"}')).otherwise('{"skill_name":"pdf"}').alias("tool_arguments"), F.lit("text").alias("tool_result"), F.when(t == "error", "denied").alias("tool_error"))
    return extraction.skill_events(rows).select("session_id", "name", "status", F.col("position").cast("long").alias("position"))
