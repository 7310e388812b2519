"""Self-written spans and logs in the producers' shapes."""

import json

from pyspark.sql import functions as F

from tracelake.sources import normalize, spans, variants


def raw(spark, items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "span_pos long, s string")
    return df.select("span_pos", F.parse_json("s").alias("span"))


def span(kind, sid, parent=None, scope="my-app", start="2024-01-01T00:00:00Z", **attributes):
    a = {k.replace("__", "."): v for k, v in attributes.items()}
    return {"trace_id": "t1", "span_id": sid, "parent_span_id": parent, "name": f"{kind} {sid}", "start_time": start, "end_time": 1704067205000000000, "scope": {"name": scope}, "status": {"code": "UNSET"}, "attributes": a | {"gen_ai.conversation.id": "s1"}}


def test_generic_spans(spark):
    told = json.dumps([{"role": "user", "parts": [{"type": "text", "content": "hi"}]}])
    answer = json.dumps([{"role": "assistant", "parts": [{"type": "thinking", "content": "hm", "thought": True}, {"type": "text", "content": "hello"}]}])
    items = [
        span("invoke_agent", "0xa1", gen_ai__operation__name="invoke_agent"), span("chat", "c1", "a1", gen_ai__operation__name="chat", gen_ai__input__messages=told, gen_ai__output__messages=answer),
        span("tool", "x1", "a1", gen_ai__operation__name="execute_tool", gen_ai__tool__name="search", gen_ai__tool__call__arguments='{"q": 1}', gen_ai__tool__call__result="found", gen_ai__tool__call__id="7"),
        span("odd", "o1", "a1", gen_ai__operation__name="create_agent"),
    ]
    items[2]["status"] = {"code": "ERROR", "description": "boom"}
    out = normalize.normalize(raw(spark, items))
    got = {r.span_id: r for r in normalize.backfill_agents(out).collect()}
    assert got["a1"].span_type == "invoke_agent" and got["a1"].user_prompt == "hi" and got["a1"].agent_response == "hello" and got["a1"].dialect == "genai"
    assert got["x1"].tool_name == "search" and got["x1"].tool_error == "boom" and got["x1"].tool_result == "found" and json.loads(got["x1"].tool_arguments) == {"q": 1}
    assert [r.span_id for r in normalize.rejected(normalize.backfill_agents(out)).collect()] == ["o1"]
    assert normalize.final_output(normalize.backfill_agents(out)).first().output == "hello"
    assert normalize.tool_catalogue(out).first().tools == ["search"]
    assert got["a1"].end_time.year == 2024 and got["a1"].session_id == "s1"


def test_bodies_of_later_events(spark):
    """The first event whose body has input or output counts, wherever it stands; else the span's own body."""
    body = lambda q, a: {"input": {"messages": [{"role": "user", "content": q}]}, "output": {"messages": [{"role": "assistant", "content": a}]}}
    items = [span("invoke_agent", x, gen_ai__operation__name="invoke_agent") for x in ("a", "b", "c")]
    items[0]["span_events"] = [{"body": {"other": 1}}, {"attributes": {}}, {"body": body("q", "r")}, {"body": body("late", "late")}]
    items[1]["body"] = body("q2", "r2")
    items[2]["span_events"] = []
    out = normalize.normalize(raw(spark, items))
    assert {r.span_id: (r.user_prompt, r.agent_response) for r in out.collect()} == {"a": ("q", "r"), "b": ("q2", "r2"), "c": (None, None)}
    assert {r.span_id for r in normalize.accepted(out).collect()} == {"a", "b"}


def test_messages_in_event_attributes(spark):
    event = lambda name, **a: {"event_name": f"gen_ai.{name}", "attributes": a}
    blocks = lambda *t: json.dumps([{"text": x} for x in t])
    listed = lambda role, t: json.dumps([{"role": role, "parts": [{"type": "text", "content": t}]}])
    details = event("client.inference.operation.details", **{"gen_ai.input.messages": listed("user", "dq"), "gen_ai.output.messages": listed("assistant", "dr")})
    kinds = {"a": "invoke_agent", "b": "invoke_agent", "c": "chat", "x": "execute_tool"}
    items = [span(k, i, gen_ai__operation__name=k, **({"gen_ai__tool__name": "t"} if i == "x" else {})) for i, k in kinds.items()]
    items[0]["span_events"] = [event("system.message", content="s"), event("user.message", content=blocks("q")), event("choice", message="r")]
    items[1]["span_events"] = [{"event_name": "other"}, details, event("client.inference.operation.details", **{"gen_ai.input.messages": listed("user", "later")})]
    items[2]["span_events"] = [event("user.message", content=blocks("one", " two")), event("choice", message=blocks("three"))]
    items[3]["span_events"] = [event("tool.message", content='{"k": 1}'), event("choice", message=blocks("found"))]
    out = normalize.normalize(raw(spark, items))
    got = {r.span_id: r for r in normalize.accepted(out).collect()}
    assert {i: (got[i].user_prompt, got[i].agent_response) for i in got} == {"a": ("q", "r"), "b": ("dq", "dr"), "c": ("one two", "three"), "x": (None, None)}
    assert (got["x"].tool_arguments, got["x"].tool_result) == ('{"k": 1}', "found")


def test_flattened_messages(spark):
    items = [span("llm", "c", scope="openinference.instrumentation.langchain", openinference__span__kind="LLM", **{
        "llm__input_messages__0__message__role": "system", "llm__input_messages__0__message__content": "be kind", "llm__input_messages__1__message__role": "user", "llm__input_messages__1__message__content": "first",
        "llm__input_messages__2__message__role": "user", "llm__input_messages__2__message__content": "second", "llm__input_messages__4__message__role": "user", "llm__input_messages__4__message__content": "after a gap",
        "llm__output_messages__0__message__role": "assistant", "llm__output_messages__0__message__content": "ok"})]
    r = normalize.normalize(raw(spark, items)).first()
    assert (r.dialect, r.span_type, r.user_prompt, r.agent_response) == ("openinference", "inference", "first", "ok")
    listed = raw(spark, items).select(variants.messages(variants.attributes(), "llm.input_messages").alias("m")).first().m
    assert [(m.idx, m.role) for m in listed] == [(0, "system"), (1, "user"), (2, "user")]


def test_logs(spark):
    event = {"traceId": "t", "spanId": "s", "timeUnixNano": 5, "attributes": {"event.name": "e"}, "body": {"input": {"messages": []}, "output": {"messages": []}}}
    log = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": 1, "endTimeUnixNano": 2, "attributes": {}, "scope": {}, "status": {}}
    orphan = event | {"spanId": "z"}

    def parsed(*records):
        df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "pos long, s string").select("pos", F.parse_json("s").alias("record"))
        return [json.loads(r.s) for r in normalize.parse_logs(df).select(F.to_json("span").alias("s")).collect()]

    both = parsed(event, log, orphan, {"message": "app log"})
    assert [x["span_id"] for x in both] == ["s"] and len(both[0]["span_events"]) == 1
    assert [x["span_id"] for x in parsed(event, orphan)] == ["s", "z"]
    assert parsed({"message": "x"}) == []


def test_shapes_and_dialects(spark):
    rows = [(json.dumps([{"span_id": "a", "name": "x"}, 5]),), (json.dumps([{"spans": [{"span_id": "b"}]}]),), (json.dumps({"t1": [{"span_id": "c"}], "t2": [{"span_id": "d"}]}),)]
    df = spark.createDataFrame(rows, "s string").coalesce(1).select(F.parse_json("s").alias("record"))
    assert [json.loads(r.s)["span_id"] for r in spans.flat_spans(df).orderBy("span_pos").select(F.to_json("span").alias("s")).collect()] == ["a", "b", "c", "d"]
    rows = [("a", 0, "other", False, None), ("a", 1, "gcp.vertex.agent", False, None), ("b", 0, "other", True, "chat"), ("c", 0, "other", False, "chat"), ("d", 0, None, False, None)]
    df = spark.createDataFrame(rows, "session string, span_pos int, scope string, has_body boolean, operation string")
    assert dict(map(tuple, spans.choose_dialect(df, "session").collect())) == {"a": "adk", "b": "log_body", "c": "genai", "d": "in_memory"}


def test_result_blocks(spark):
    df = spark.createDataFrame([('[{"text": "a"}, {"json": {"b": 1, "a": 2}}, {"image": {}}, {"text": ""}, {"odd": 1}]',)], "b string")
    assert df.select(normalize.flatten_blocks(F.col("b")).alias("t")).first().t == 'a\n{"a":2,"b":1}\n[image]'
