"""Further registered queries: judges, extraction levels, span dialects, event-time windows and replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import detection, extraction, judging, reports
from tracelake.plans import adapters as A
from tracelake.plans.registry import register
from tracelake.runtime import table
from tracelake.sources import normalize, spans, store
from tracelake.streaming import sessions


@register(
    """select doc_id, case when toxic = 1 then 0.0 when toxic = 0 then 1.0 else 0.0 end::double as score, coalesce(toxic = 0, false) as test_pass,
    case when toxic is null then 'Evaluator error: unknown label none' else '' end as reason from documents left join labels using (doc_id)"""
)
def judge_harmfulness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "Harmful").when(F.col("toxic") == 0, "Not Harmful")
    return judging.scored(rows.withColumn("label", label), "harmfulness").select("doc_id", "score", "test_pass", "reason")


@register("select event_id, least(1.0, greatest(0.0, value / 50 - 0.1))::double as score, least(1.0, greatest(0.0, value / 50 - 0.1)) < 0.3 as test_pass from events")
def judge_attack_success(spark, sf_dir):
    return judging.scored(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 50 - 0.1).alias("score")), "attack_success").select("event_id", "score", "test_pass")


@register(
    """select doc_id, '<Output>' || text || '</Output>' || chr(10) || case when lang = 'en' then '<ExpectedOutput>' || source || '</ExpectedOutput>' || chr(10) else '' end || '<ExpectedAssertion>' || lang || '</ExpectedAssertion>' as prompt from documents"""
)
def case_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("actual_output"), F.when(F.col("lang") == "en", F.col("source")).alias("expected_output"), F.col("lang").alias("expected_assertion"))
    return d.select("doc_id", judging.case_prompt(include_input=False).alias("prompt"))


def conversation_spans(spark, sf_dir):
    """Turns as normalized spans: a user message and the answer after it are one agent span in a trace of its own."""
    m = A.messages(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    answer = F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))
    users = m.withColumn("agent_response", answer).where("role = 'user'")
    none = F.lit(None).cast("string")
    return users.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.row_number().over(w) - 1).alias("trace_seq"), F.col("turn").cast("string").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"),
        F.col("turn").alias("span_pos"), F.lit("invoke_agent").alias("span_type"), F.col("text").alias("user_prompt"), "agent_response",
        *(none.alias(c) for c in ("tool_name", "tool_arguments", "tool_result", "tool_error", "tool_definitions", "owner")),
    )


_TURNS = """nexts as (select *, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as next_text from conversations),
turns as (select conv_id, turn, text as user_prompt, case when next_role = 'assistant' then next_text end as agent_response from nexts where role = 'user')"""


@register(
    """select cast(a.conv_id as varchar) as session_id, a.conv_id || '-' || a.turn as span_id, 2 * count(b.turn) + 1 as entries,
    cast(length(a.user_prompt) + coalesce(sum(length(b.user_prompt) + coalesce(length(b.agent_response), 0)), 0) as bigint) as chars
    from turns a left join turns b on a.conv_id = b.conv_id and b.turn < a.turn group by a.conv_id, a.turn, a.user_prompt""", _TURNS,
)
def trace_inputs(spark, sf_dir):
    rows = extraction.trace_inputs(conversation_spans(spark, sf_dir))
    chars = F.aggregate("session_history", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0)))
    return rows.select("session_id", "span_id", F.size("session_history").cast("long").alias("entries"), chars.alias("chars"))


@register("select cast(conv_id as varchar) as session_id, count(t.turn) as contexts, case when count(t.turn) = 0 then 'no agent span' end as error from (select distinct conv_id from turns) c join turns t using (conv_id) group by conv_id", _TURNS)
def session_inputs(spark, sf_dir):
    return extraction.session_inputs(conversation_spans(spark, sf_dir)).select("session_id", F.size("contexts").cast("long").alias("contexts"), "error")


@register("select cast(conv_id as varchar) as session_id, arg_max(agent_response, turn) filter (where agent_response <> '') as output from turns group by conv_id having count(*) filter (where agent_response <> '') > 0", _TURNS)
def final_outputs(spark, sf_dir):
    return normalize.final_output(conversation_spans(spark, sf_dir), skip_empty=True)


@register(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id) as n from g),
    i as (select *, row_number() over (partition by user_id, n order by ts, event_id) as i from s),
    a as (select user_id, n, min(ts) as t0, max(ts) as t1, count(*) as n_calls, min(case when event_type = 'view' then i end) as p1 from i group by all)
    select a.user_id as session, epoch_us(t0) as "start", epoch_us(t1) + 1800000000 as "end", n_calls, cast((p1 is not null)::int + (count(case when event_type = 'click' and i.i > p1 then 1 end) > 0)::int as double) / 2 as score
    from a join i on a.user_id = i.user_id and a.n = i.n group by a.user_id, a.n, t0, t1, n_calls, p1"""
)
def session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("tool"))
    s = sessions.session_scores(e, ["view", "click"])
    return s.select("session", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n_calls", "score")


@register("""select epoch_us(date_trunc('hour', ts)) as "start", event_type as tool, count(*) as call_count, count(*) filter (where event_type = 'error') as error_count, round(sum(value), 6) as total_time from events group by all""")
def windowed_metrics(spark, sf_dir):
    c = A.calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions.windowed_metrics(c).select(F.unix_micros("start").alias("start"), "tool", "call_count", "error_count", F.round("total_time", 6).alias("total_time"))


@register(
    """select cast(evaluator as varchar) as evaluator, case_name, round(avg(score), 9) as score, count(*) filter (where test_pass) as passed, count(*) as n from (select row_pos % 5 as evaluator, case_name, score, test_pass from judged)
    group by grouping sets ((evaluator, case_name), (evaluator), (case_name), ())""", A.JUDGED_SQL,
)
def metric_records(spark, sf_dir):
    rows = A.judged(spark, sf_dir).withColumn("evaluator", (F.col("row_pos") % 5).cast("string"))
    return store.metric_records(rows).select("evaluator", "case_name", F.round("score", 9).alias("score"), "passed", "n")


@register(
    """with s as (select event_id, case event_type when 'view' then 'inference' when 'click' then 'execute_tool' when 'purchase' then 'invoke_agent' end as span_type, 'u' || user_id as session_id, event_type from events)
    select event_id as span_pos, session_id, span_type, case when span_type = 'execute_tool' then 'tool ' || event_id % 3 end as tool_name, case when event_type = 'purchase' then 'ask ' || event_id end as user_prompt from s where span_type is not null"""
)
def normalized_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "chat").when(F.col("event_type") == "click", "execute_tool").when(F.col("event_type") == "purchase", "invoke_agent").otherwise("unknown")
    told = F.when(F.col("event_type") == "purchase", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("ask "), "event_id").alias("content")))))
    attributes = F.map_filter(F.create_map(
        F.lit("gen_ai.operation.name"), op, F.lit("gen_ai.conversation.id"), F.concat(F.lit("u"), "user_id"), F.lit("gen_ai.tool.name"), F.concat(F.lit("tool "), (F.col("event_id") % 3).cast("string")), F.lit("gen_ai.input.messages"), told,
    ), lambda _, v: v.isNotNull())
    raw = e.select(F.col("event_id").alias("span_pos"), F.parse_json(F.to_json(F.struct(F.col("event_id").cast("string").alias("span_id"), F.lit("t").alias("trace_id"), attributes.alias("attributes")))).alias("span"))
    return normalize.accepted(normalize.normalize(raw)).select("span_pos", "session_id", "span_type", "tool_name", "user_prompt")


@register(
    """select user_id as session, case when bool_or(event_type in ('view', 'click')) then arg_min(case event_type when 'view' then 'adk' when 'click' then 'genai' end, event_id) filter (where event_type in ('view', 'click'))
    when bool_or(event_type = 'error') then 'log_body' when bool_or(event_type = 'purchase') then 'genai' else 'in_memory' end as dialect from events group by user_id"""
)
def dialect_choice(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("span_pos"), F.when(t == "view", "gcp.vertex.agent").when(t == "click", "pydantic-ai").otherwise("other").alias("scope"),
        (t == "error").alias("has_body"), F.when(t == "purchase", "chat").alias("operation"))
    return spans.choose_dialect(e, "session")


@register(
    """with t as (select session, trace_id, pos, failed, round(least(1.0, duration / 30), 3) as score from calls),
    c as (select *, coalesce(count(*) filter (where not failed) over w, 0) as turns, coalesce(count(*) filter (where failed) over w, 0) as backs, coalesce(bool_or(not failed and score >= 0.7) over w, false) as hit
      from t window w as (partition by session, trace_id order by pos rows between unbounded preceding and 1 preceding)),
    k as (select *, not hit and turns < 3 and backs < 2 as live from c)
    select session, trace_id, cast(count(*) filter (where live and not failed) as int) as turns, cast(count(*) filter (where live and failed) as int) as backtracks,
    coalesce(max(score) filter (where live and not failed), 0.0)::double as best, coalesce(bool_or(live and not failed and score >= 0.7), false) as hit from k group by session, trace_id""", A.CALLS_SQL,
)
def attack_replay(spark, sf_dir):
    c = A.calls(spark, sf_dir).select("session", "trace_id", F.col("pos").alias("turn"), F.round(F.least(F.lit(1.0), F.col("duration") / 30), 3).alias("score"), F.col("failed").alias("refused"))
    return reports.replay(c, ["session", "trace_id"], 0.7, 3, 2)


@register("select doc_id, quality::varchar as category, 'doc ' || doc_id as evidence from labels where doc_id % 3 = 0")
def parsed_responses(spark, sf_dir):
    item = F.struct(F.col("doc_id").cast("string").alias("location"), F.array(F.col("quality").cast("string")).alias("category"), F.array(F.lit("low")).alias("confidence"),
                    F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.concat(F.lit("doc "), F.col("doc_id").cast("string")))).alias("evidence"))
    body = F.to_json(F.struct(F.array(item).alias("errors")))
    raw = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("oops "), body)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    found = table(spark, sf_dir, "labels").select("doc_id", F.explode(detection.parse_response(raw)).alias("e"))
    return found.select("doc_id", F.col("e.category")[0].alias("category"), F.col("e.evidence")[0].alias("evidence"))
