"""Registered queries of experiments, diagnosis, attacks, generated cases and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import detection, diagnosis, expansion, experiments, generation, judging, reports
from tracelake.plans import adapters as A
from tracelake.plans.registry import register
from tracelake.runtime import table
from tracelake.streaming import sessions

# --- chaos -----------------------------------------------------------------------------------------------------------


@register(
    """select p_partkey, '{"name":' || to_json(left(p_name, 8))::varchar || ',"info":{"brand":' || to_json(left(p_brand, 8))::varchar || ',"size":' || p_size || '},"types":[' || to_json(p_type || ' and more')::varchar || ']}' as value from part"""
)
def chaos_nested_truncate(spark, sf_dir):
    info = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    body = F.to_json(F.struct(F.col("p_name").alias("name"), info.alias("info"), F.array(F.concat("p_type", F.lit(" and more"))).alias("types")))
    return table(spark, sf_dir, "part").select("p_partkey", expansion.apply_effect(body, "truncate_fields", 8).alias("value"))


_KEYS = """k as (select p_partkey, unnest(['name', 'brand', 'type']) as k, unnest([p_name, p_brand, p_type]) as v, unnest([1, 2, 3]) as place from part),
ranked as (select *, row_number() over (partition by p_partkey order by md5('7:' || k)) as n from k)"""


@register("select p_partkey, '{' || string_agg(to_json(k)::varchar || ':' || to_json(v)::varchar, ',' order by place) || '}' as value from ranked where n > 2 group by p_partkey", _KEYS)
def chaos_blocks_removed(spark, sf_dir):
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", expansion.apply_effect(body, "remove_fields", 0.5, 7).alias("value"))


@register("select conv_id, turn, left(text, 25) as text from conversations where not json_valid(text)")
def chaos_plain_blocks(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    return m.where(F.try_parse_json("text").isNull()).select("conv_id", "turn", expansion.apply_effect(F.col("text"), "truncate_fields", 25).alias("text"))


@register(
    """select n_nationkey, case when n_nationkey % 3 = 0 then 'unknown effect categories: model_effects' when n_nationkey % 3 = 2 then 'more than one effect for: ' || lower(n_name) end as error from nation"""
)
def chaos_effect_errors(spark, sf_dir):
    n = F.col("n_nationkey")
    effects = F.slice(F.array(F.lit("timeout"), F.lit("slow")), F.lit(1), (n % 3).cast("int"))
    category = F.when(n % 3 == 0, "model_effects").otherwise("tool_effects")
    by_tool = F.create_map(category, F.create_map(F.lower("n_name"), effects))
    return table(spark, sf_dir, "nation").select("n_nationkey", expansion.effect_errors(by_tool).alias("error"))


# --- experiments -----------------------------------------------------------------------------------------------------


def _cases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_pos"), F.col("c_name").alias("case_name"), F.concat(F.lit("s"), "c_custkey").alias("session_id"), F.col("c_mktsegment").alias("input"))


def _task(case: dict) -> object:
    """Answers with the input in lower case; every seventh case fails, every fifth answers with a dict."""
    if case["case_pos"] % 7 == 0:
        raise RuntimeError(f"no answer for {case['case_name']}")
    said = case["input"].lower()
    return {"output": said, "trajectory": [said[:2], said[2:4]]} if case["case_pos"] % 5 == 0 else said


_OUTPUTS = """outputs as (select c_custkey as case_pos, c_name as case_name, case when c_custkey % 7 <> 0 then lower(c_mktsegment) end as output,
  case when c_custkey % 7 <> 0 and c_custkey % 5 = 0 then left(lower(c_mktsegment), 2) || ',' || substr(lower(c_mktsegment), 3, 2) end as trajectory,
  case when c_custkey % 7 = 0 then 'no answer for ' || c_name end as error from customer)"""


@register("select * from outputs", _OUTPUTS)
def task_outputs(spark, sf_dir):
    out = experiments.run_task(_cases(spark, sf_dir), _task)
    return out.select("case_pos", "case_name", "output", F.array_join("trajectory", ",").alias("trajectory"), "error")


@register(
    "select c_custkey as case_pos, e.pos as evaluator_pos, e.name as evaluator from customer cross join (values (0, 'contains'), (1, 'prefix'), (2, 'equals')) as e(pos, name)"
)
def evaluator_grid(spark, sf_dir):
    names = spark.createDataFrame([(0, "contains"), (1, "prefix"), (2, "equals")], "evaluator_pos int, evaluator string")
    return experiments.grid(_cases(spark, sf_dir).select("case_pos"), names)


def _evaluators():
    rule = lambda ok: lambda rows: rows.select("case_pos", F.lit(0).alias("row_pos"), ok.cast("double").alias("score"), ok.alias("test_pass"), F.when(~ok, "no").alias("reason"), F.lit(None).cast("string").alias("label"))

    def partly(rows):
        known = F.col("output") != "building"
        return rows.select("case_pos", F.explode(F.array(F.lit(0), F.lit(1))).alias("row_pos"), (F.length("output") % 3 / 2).alias("score"), known.alias("test_pass"), F.lit("").alias("reason"),
                           F.when(F.col("output") == "machinery", reports.NOT_APPLICABLE).alias("label"))

    return [
        experiments.Evaluator("contains", rule(scoring.contains(F.col("output"), F.lit("u"))), "deterministic"),
        experiments.Evaluator("prefix", rule(scoring.starts_with(F.col("output"), F.lit("m"))), "deterministic"),
        experiments.Evaluator("partly", partly, "judge", "drop_na"),
    ]


@register(
    """select 0 as evaluator_pos, 'contains' as evaluator, case_pos, (error is null and contains(output, 'u'))::int::double as score, error is null and contains(output, 'u') as test_pass,
    case when error is not null then 'An error occurred: ' || error when contains(output, 'u') then '' else 'no' end as reason, true as applicable from outputs
    union all select 1, 'prefix', case_pos, (error is null and starts_with(output, 'm'))::int::double, error is null and starts_with(output, 'm'),
    case when error is not null then 'An error occurred: ' || error when starts_with(output, 'm') then '' else 'no' end, true from outputs
    union all select 2, 'partly', case_pos, case when error is not null or output = 'machinery' then 0.0 else (length(output) % 3) / 2 end::double, error is null and output <> 'building',
    case when error is not null then 'An error occurred: ' || error else '' end, error is not null or output <> 'machinery' from outputs""", _OUTPUTS,
)
def experiment_report(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    segment = F.lower("input")
    failed = F.col("case_pos") % 7 == 0
    outputs = cases.select("case_pos", F.when(~failed, segment).alias("output"), F.when(failed, F.concat(F.lit("no answer for "), "case_name")).alias("error"))
    report = experiments.run_experiment(cases, outputs, _evaluators())
    return report.select("evaluator_pos", "evaluator", "case_pos", "score", "test_pass", "reason", "applicable")


@register(
    """select c_custkey as case_pos, e.pos as evaluator_pos, 'Evaluator error: bad ' || e.pos as reason, 0.0::double as score, false as test_pass, true as applicable
    from customer cross join (values (0), (1)) as e(pos) where c_custkey % 4 = e.pos"""
)
def evaluator_error_rows(spark, sf_dir):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "evaluator_pos int, evaluator string")
    cells = experiments.grid(_cases(spark, sf_dir).select("case_pos"), names)
    errors = cells.where(F.col("case_pos") % 4 == F.col("evaluator_pos")).select("evaluator_pos", "case_pos", F.concat(F.lit("bad "), F.col("evaluator_pos").cast("string")).alias("error"))
    return experiments.evaluator_errors(cells, errors)


@register(
    """select c_name as case_name, case when c_custkey % 2 = 0 then 'run' else 'case' end as k, c_mktsegment as segment, case when c_custkey % 2 = 0 then '3' end as turns from customer"""
)
def run_metadata(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_name").alias("case_name"), F.create_map(F.lit("k"), F.lit("case"), F.lit("segment"), "c_mktsegment").alias("metadata"))
    runs = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("case_name"), F.create_map(F.lit("k"), F.lit("run"), F.lit("turns"), F.lit("3")).alias("run_metadata"))
    m = experiments.run_metadata(rows, runs)
    return m.select("case_name", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("k", "segment", "turns")))


@register(
    """select o_orderkey, case when o_orderstatus = 'F' then null else o_orderstatus end as actual, case when o_orderstatus = 'F' then 0.0 when o_orderpriority = '1-URGENT' then 0.0 when o_orderstatus = 'O' then 1.0 else 0.0 end::double as score,
    case when o_orderpriority = '1-URGENT' then 'Evaluator error: no state is expected' when o_orderstatus = 'F' then 'the state was not recorded' when o_orderstatus = 'O' then 'the state is as expected' else 'the state differs' end as reason from orders"""
)
def state_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kept = F.filter(F.array(F.struct(F.lit("other").alias("name"), F.lit("x").alias("state")), F.struct(F.when(F.col("o_orderstatus") == "F", "gone").otherwise("status").alias("name"), F.col("o_orderstatus").alias("state"))), lambda x: x["name"].isNotNull())
    s = o.select("o_orderkey", experiments.state_of(kept, "status").alias("actual"), F.when(F.col("o_orderpriority") != "1-URGENT", "O").alias("expected"))
    v = s.withColumn("v", experiments.state_equals(F.col("actual"), F.col("expected")))
    return v.select("o_orderkey", "actual", "v.score", "v.reason")


@register(
    """select t.session, t.trace_id, (has and known)::int::double as score, case when not known then 'no trajectory provided' when has then 'purchase was called' else 'purchase was not called' end as reason
    from (select session, trace_id, bool_or(tool = 'purchase') as has, min(pos) % 3 <> 0 as known from calls group by all) t""", A.CALLS_SQL,
)
def tool_call_verdicts(spark, sf_dir):
    g = A.calls(spark, sf_dir).groupBy("session", "trace_id").agg(F.collect_list("tool").alias("steps"), F.min("pos").alias("first"))
    v = g.withColumn("v", experiments.tool_called(F.when(F.col("first") % 3 != 0, F.col("steps")), "purchase"))
    return v.select("session", "trace_id", "v.score", "v.reason")


@register("select n_name as node, case when n_regionkey < 3 then 'rubric ' || r_name end as rubric, case when n_regionkey >= 3 then 'no rubric for ' || n_name end as error from nation join region on n_regionkey = r_regionkey")
def interaction_rubrics(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.join(r, n.n_regionkey == r.r_regionkey).where("n_regionkey < 3").select(F.col("n_name").alias("node"), F.concat(F.lit("rubric "), "r_name").alias("rubric"))
    return experiments.rubrics(n.select(F.col("n_name").alias("node")), known)


# --- judges and prompts ------------------------------------------------------------------------------------------------

#: Labels and scores by evaluator as the judges' definitions state them, and the bound to pass (fixed values).
_SCALES = """scales(evaluator, labels, scores, bound) as (values
('helpfulness', ['Not helpful at all', 'Very unhelpful', 'Somewhat unhelpful', 'Neutral/Mixed', 'Somewhat helpful', 'Very helpful', 'Above and beyond'], [0, 0.167, 0.333, 0.5, 0.667, 0.833, 1]::double[], 0.5),
('faithfulness', ['Not At All', 'Not Generally', 'Neutral/Mixed', 'Generally Yes', 'Completely Yes'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.5),
('coherence', ['Not At All', 'Not Generally', 'Neutral/Mixed', 'Generally Yes', 'Completely Yes'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.5),
('conciseness', ['Not Concise', 'Partially Concise', 'Perfectly Concise'], [0, 0.5, 1]::double[], 0.5),
('response_relevance', ['Not At All', 'Not Generally', 'Neutral/Mixed', 'Generally Yes', 'Completely Yes'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.5),
('correctness', ['Incorrect', 'Partially Correct', 'Perfectly Correct'], [0, 0.5, 1]::double[], 1),
('correctness_reference', ['INCORRECT', 'CORRECT'], [0, 1]::double[], 1), ('refusal', ['No', 'Yes'], [0, 1]::double[], 1),
('stereotyping', ['Stereotyping', 'Not Stereotyping'], [0, 1]::double[], 1), ('instruction_following', ['No', 'Yes'], [0, 1]::double[], 1),
('goal_success', ['No', 'Yes'], [0, 1]::double[], 1), ('goal_success_assertion', ['FAILURE', 'SUCCESS'], [0, 1]::double[], 1),
('tool_selection', ['No', 'Yes'], [0, 1]::double[], 1), ('tool_parameters', ['No', 'Yes'], [0, 1]::double[], 1), ('skill_selection', ['No', 'Yes'], [0, 1]::double[], 1),
('skill_instructions', ['Not At All', 'Not Generally', 'Neutral/Mixed', 'Generally Yes', 'Completely Yes'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.75),
('failure_communication', ['Failure', 'Poor', 'Acceptable', 'Good', 'Excellent'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.5),
('recovery_strategy', ['Failure', 'Poor', 'Acceptable', 'Good', 'Excellent'], [0, 0.25, 0.5, 0.75, 1]::double[], 0.5))"""
_SCALED = [n for n in judging.SCALES if n != "harmfulness"]


@register(
    """select o_orderkey, evaluator, case when o_orderkey % 8 < len(labels) then scores[o_orderkey % 8 + 1] else 0 end::double as score,
    o_orderkey % 8 < len(labels) and scores[o_orderkey % 8 + 1] >= bound as test_pass from orders cross join scales""", _SCALES,
)
def judge_scales(spark, sf_dir):
    """Every judge with a scale over every order; the label is the one at the order's place, some orders have none."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    out = None
    for name in _SCALED:
        labels = sorted(judging.SCALES[name].labels, key=judging.SCALES[name].labels.get)
        at = (F.col("o_orderkey") % 8 + 1).cast("int")
        label = F.try_element_at(F.array(*map(F.lit, labels)), at)
        rows = judging.scored(o.withColumn("label", label), name).select("o_orderkey", F.lit(name).alias("evaluator"), "score", "test_pass")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    """select event_id, least(1.0, greatest(0.0, value / 100))::double as score, least(1.0, greatest(0.0, value / 100)) >= 0.5 as test_pass from events"""
)
def judge_partial_completion(spark, sf_dir):
    return judging.scored(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("score")), "partial_completion").drop("label")


@register("select event_id, value / 100 as score, event_id % 2 = 0 as test_pass from events")
def judge_own_verdict(spark, sf_dir):
    return judging.scored(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("score"), (F.col("event_id") % 2 == 0).alias("test_pass")), "output")


@register(
    """select c_custkey as session_id, s.name, case when c_custkey % 3 = 0 or s.name is null then 'not_applicable' end as label, case when c_custkey % 3 = 0 then false when s.name is null then true end as test_pass,
    case when c_custkey % 3 = 0 then 'no trajectory to judge' when s.name is null then 'no skill was invoked' end as reason from customer left join (values ('pdf', 1), ('csv', 1), ('pdf', 2)) as s(name, k) on c_custkey % 4 = s.k"""
)
def skill_choice_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    known = spark.createDataFrame([("pdf", 1), ("csv", 1), ("pdf", 2)], "name string, k int")
    invoked = c.join(F.broadcast(known), F.col("session_id") % 4 == F.col("k")).select("session_id", "name")
    rows = judging.skill_rows(c.withColumn("has_trajectory", F.col("session_id") % 3 != 0), invoked)
    return rows.select("session_id", "name", "label", "test_pass", "reason")


@register(
    """select o_orderkey, case when n = 0 or o_orderstatus = 'F' then 0 else (least(n, 2) + 0.5 * greatest(least(n - 2, 2), 0)) / n end::double as score,
    n = 0 or o_orderstatus = 'F' or (least(n, 2) + 0.5 * greatest(least(n - 2, 2), 0)) / n >= 0.75 as test_pass from (select *, o_orderkey % 7 as n from orders)"""
)
def skill_step_scores(spark, sf_dir):
    every = F.array(*map(F.lit, ("covered", "covered", "partial", "partial", "skipped", "skipped")))
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("loaded").alias("status"), F.lit("body").alias("body"), F.slice(every, F.lit(1), (F.col("o_orderkey") % 7).cast("int")).alias("steps"))
    return judging.skill_steps(rows).select("o_orderkey", "score", "test_pass")


@register("select event_id, 'Available tools: [\"' || event_type || '\"]' || chr(10) || 'Tool call: ' || event_type || '(' || props || ')' || chr(10) || 'Result: ' || case when event_id % 2 = 0 then cast(user_id as varchar) else '' end as prompt from events")
def tool_prompts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.array("event_type")).alias("available_tools"), F.col("event_type").alias("tool_name"), F.col("props").alias("tool_arguments"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("tool_result"))
    return e.select("event_id", judging.tool_prompt().alias("prompt"))


@register(
    """select conv_id, turn, text as user_text, 'Previous turns:' || chr(10) || (select string_agg(case when b.role = 'user' then 'User: ' when b.role = 'assistant' then 'Assistant: ' else 'Action: ' end || b.text, chr(10) order by b.turn)
    from conversations b where b.conv_id = a.conv_id and b.turn <= a.turn) || chr(10) || 'Target turn:' || chr(10) || 'Assistant: ok' as prompt from conversations a"""
)
def trace_prompts(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    m = A.messages(spark, sf_dir).withColumn("session_history", F.collect_list(F.struct(F.col("role").alias("event"), "text")).over(w)).withColumn("agent_response", F.lit("ok"))
    return m.select("conv_id", "turn", F.col("text").alias("user_text"), judging.trace_prompt().alias("prompt"))


@register(
    """select c_custkey, case when c_custkey % 2 = 0 then '# Attacker goal' || chr(10) || c_mktsegment || chr(10) || chr(10) else '' end || '# Conversation' || chr(10) || c_name || case when c_custkey % 3 = 0 then chr(10) || chr(10) || '# Tool calls' || chr(10) || 'refund' else '' end as prompt from customer"""
)
def attack_prompts(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_mktsegment")).alias("objective"), F.lit("").alias("success_criteria"), F.col("c_name").alias("conversation"), F.when(k % 3 == 0, "refund").alias("tool_calls"))
    return c.select("c_custkey", judging.attack_prompt().alias("prompt"))


@register(
    """select p_partkey, (case when p_partkey % 2 = 0 then 1 else 0 end) + 1 + (case when p_partkey % 3 = 0 then 1 else 0 end) as parts, case when p_partkey % 2 = 0 then 'image' else 'text' end as first_kind,
    case when p_partkey % 3 = 0 then '<ExpectedOutput>' || p_type || '</ExpectedOutput>' else '<Instruction>describe</Instruction>' || chr(10) || '<Output>' || p_name || '</Output>' end as last_value from part"""
)
def multimodal_prompts(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, F.array("p_brand")).alias("images"), F.lit("describe").alias("instruction"), F.col("p_name").alias("actual_output"), F.when(k % 3 == 0, F.col("p_type")).alias("expected_output"))
    parts = p.withColumn("x", judging.multimodal_prompt())
    return parts.select("p_partkey", F.size("x").alias("parts"), F.col("x")[0]["kind"].alias("first_kind"), F.element_at("x", -1)["value"].alias("last_value"))


@register(
    """with x as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation)
    select a.n_regionkey, a.i, string_agg(b.n_name, ',' order by b.i) as near from x a join x b on a.n_regionkey = b.n_regionkey and b.i between a.i - 1 and a.i + 1 group by a.n_regionkey, a.i"""
)
def interaction_neighbours(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("all"))
    rows = n.select("n_regionkey", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1)).alias("i"))
    return rows.select("n_regionkey", F.col("i").cast("long").alias("i"), F.array_join(judging.neighbours(F.col("all"), F.col("i")), ",").alias("near"))


@register("select p_partkey, p_name || chr(10) || 'steps' as body, case when p_partkey % 2 = 0 then 'name: ' || p_brand else '' end as head from part")
def skill_bodies(spark, sf_dir):
    fenced = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("---\nname: "), "p_brand", F.lit("\n---\n"))).otherwise("")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(fenced, "p_name", F.lit("\nsteps")).alias("raw"))
    return p.select("p_partkey", judging.strip_frontmatter(F.col("raw")).alias("body"), judging.frontmatter_fields(F.col("raw")).alias("head"))


@register("select conv_id, string_agg(text, ' ' order by turn) filter (where role <> 'system') as text from conversations group by conv_id having count(*) filter (where role <> 'system') > 0")
def message_texts(spark, sf_dir):
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") != "system", F.col("text")).alias("text")))), lambda x: F.struct(x["text"].alias("text")))
    return A.messages(spark, sf_dir).groupBy("conv_id").agg(blocks.alias("blocks"), F.bool_or(F.col("role") != "system").alias("any")).where("any").select("conv_id", judging.message_text(F.col("blocks")).alias("text"))


@register("select doc_id, length(text) <= 1000 as whole, case when length(text) <= 1000 then text else left(text, 500) || '<cut>' || right(text, 500) end as text from documents")
def cut_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.length("text") <= 1000).alias("whole"), scoring.cut_middle(F.col("text"), 1000, "<cut>").alias("text"))


# --- diagnosis -------------------------------------------------------------------------------------------------------


def _spans(spark, sf_dir):
    """Calls as spans; a call's parent is the call before it in its trace."""
    c = A.calls(spark, sf_dir)
    before = F.lag("event_id").over(Window.partitionBy("session", "trace_id").orderBy("pos"))
    text = F.to_json(F.struct(F.col("event_id").alias("id"), "tool", "props"))
    return c.select("session", F.col("pos").cast("long").alias("pos"), "trace_id", F.col("event_id").cast("string").alias("span_id"), before.cast("string").alias("parent_span_id"), text.alias("text"))


def _detector(prompts):
    """Finds the spans of failed calls in a prompt by their text: a stand-in for a model with a known answer."""
    ids = F.regexp_extract_all("prompt", F.lit(r'\{"id":(\d+),"tool":"error"'), 1)
    item = lambda i: F.concat(F.lit('{"location":"'), i, F.lit('","category":["tool_error"],"confidence":["high"],"evidence":["call failed"]}'))
    body = F.concat(F.lit('```json\n{"errors":['), F.array_join(F.transform(ids, item), ","), F.lit("]}\n```"))
    return prompts.withColumn("response", body)


def _analyst(prompts):
    """Gives one root cause for each failing span that the prompt's list of failures names."""
    ids = F.regexp_extract_all("prompt", F.lit(r'"span_id":"(\d+)"'), 1)
    item = lambda i: F.concat(F.lit('{"failure_span_id":"'), i, F.lit('","location":"tool","fix_recommendation":{"fix_type":"tool","recommendation":" check the tool "}}'))
    return prompts.withColumn("response", F.concat(F.lit('{"root_causes":['), F.array_join(F.transform(ids, item), ","), F.lit("]}")))


@register("select session, cast(event_id as varchar) as span_id, 'tool_error' as category, 0.9::double as confidence, 'call failed' as evidence from calls where failed", A.CALLS_SQL)
def detected_failures(spark, sf_dir):
    """Sessions too long for one prompt are looked through chunk by chunk; the chunks' overlap finds some failures twice."""
    return diagnosis.detect_failures(_spans(spark, sf_dir), _detector, max_tokens=600)


@register(
    """select session, cast(count(*) filter (where failed) as int) as n_failures, count(*) filter (where failed) as n_causes, case when bool_or(failed) then 'check the tool' else '' end as recommendations from calls group by session""",
    A.CALLS_SQL,
)
def diagnosed_sessions(spark, sf_dir):
    d = diagnosis.diagnose(_spans(spark, sf_dir), _detector, _analyst, _analyst)
    n = F.when(F.col("root_causes").isNull(), 0).otherwise(F.size("root_causes")).cast("long")
    return d.select("session", "n_failures", n.alias("n_causes"), F.array_join("recommendations", ";").alias("recommendations"))


@register(
    """with t as (select doc_id, length(text) as n, case when length(text) = 0 then 0 else greatest(1, length(text) // 3) end as whole, greatest(1, (length(text) // 2) // 3) as part from documents)
    select doc_id, case when whole <= 650 then 'direct' when part <= 650 then 'pruned' when doc_id % 9 > 5 then 'chunked' else 'none' end as tier from t"""
)
def rca_tiers(spark, sf_dir):
    text = F.col("text")
    half = F.left(text, F.floor(F.length(text) / 2).cast("int"))
    whole, part = scoring.token_estimate(text), F.greatest(F.lit(1), scoring.token_estimate(half))
    return table(spark, sf_dir, "documents").select("doc_id", diagnosis.rca_tier(whole, part, F.col("doc_id") % 9, 1000).alias("tier"))


@register(
    """with r as (select session, trace_id, event_id, failed, (row_number() over (partition by session, trace_id order by pos) - 1) // greatest(5, count(*) over (partition by session) // 3) as w from calls),
    known as (select session, event_id from calls where failed and event_id % 2 = 0), own as (select distinct r.session, trace_id, w, r.event_id from r join known k on r.session = k.session and r.event_id = k.event_id),
    bare as (select distinct session, trace_id, w from r where (session, trace_id, w) not in (select (session, trace_id, w) from own))
    select session, trace_id, cast(w as int) as rca_window, cast(event_id as varchar) as span_id from (select * from own union all select b.session, trace_id, w, event_id from bare b join known k on b.session = k.session)""", A.CALLS_SQL,
)
def rca_window_failures(spark, sf_dir):
    s = _spans(spark, sf_dir)
    windows = detection.index_windows(s, "trace_id", ["pos"])
    failures = A.calls(spark, sf_dir).where("failed and event_id % 2 = 0").select("session", F.col("event_id").cast("string").alias("span_id"))
    return diagnosis.window_failures(windows, failures)


@register(
    """select doc_id as session, 0 as item, 's' || doc_id as failure_span_id, 'quality ' || quality as causality, 'prompt' as fix_type, 'fix ' || toxic as fix_recommendation from labels where doc_id % 5 <> 0"""
)
def root_cause_rows(spark, sf_dir):
    t = lambda c: F.col(c).cast("string")
    fix = F.struct(F.lit("prompt").alias("fix_type"), F.concat(F.lit("fix "), t("toxic")).alias("recommendation"))
    one = F.struct(F.concat(F.lit("s"), t("doc_id")).alias("failure_span_id"), F.concat(F.lit("quality "), t("quality")).alias("failure_causality"), fix.alias("fix_recommendation"))
    body = F.to_json(F.struct(F.array(one).alias("root_causes")))
    answers = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session"), F.when(F.col("doc_id") % 5 == 0, F.lit("no json")).otherwise(body).alias("response"))
    return diagnosis.root_cause_items(answers).select("session", "item", "failure_span_id", "causality", "fix_type", "fix_recommendation")


@register(
    """select event_id, event_type in ('click', 'purchase') as exceeded from events"""
)
def context_errors(spark, sf_dir):
    said = F.when(F.col("event_type") == "click", "Input is Too Long for the model").when(F.col("event_type") == "purchase", "context_length exceeded").when(F.col("event_type") == "view", "access denied")
    return table(spark, sf_dir, "events").select("event_id", diagnosis.context_exceeded(said).alias("exceeded"))


@register(
    """select session, '[' || string_agg('{"id":' || event_id || ',"tool":"' || tool || '","props":' || to_json(props)::varchar || '}', ',' || chr(10) order by pos) || ']' as body, count(*) as n_spans from calls group by session""", A.CALLS_SQL,
)
def session_texts(spark, sf_dir):
    return diagnosis.session_json(_spans(spark, sf_dir)).select("session", "body", "n_spans")


# --- attacks ---------------------------------------------------------------------------------------------------------

_ATTEMPTS = """tries as (select session, trace_id, row_number() over (partition by session, trace_id order by pos) as attempt, duration from calls)"""


def _attempts(spark, sf_dir):
    return A.calls(spark, sf_dir).select("session", "trace_id", F.row_number().over(Window.partitionBy("session", "trace_id").orderBy("pos")).alias("attempt"), "duration")


def _loop_sql(score: str, stop: float, budget: int) -> str:
    return f"""with s as (select session, trace_id, attempt, {score} as score from tries where attempt <= {budget}),
    f as (select session, trace_id, min(attempt) filter (where score >= {stop}) as hit_at from s group by all)
    select s.session, s.trace_id, count(*) as attempts, max(score) as best, max(score) >= {stop} as hit from s join f on s.session = f.session and s.trace_id = f.trace_id and (hit_at is null or attempt <= hit_at) group by all"""


@register(_loop_sql("((greatest(1, least(10, floor(duration / 10))) - 1) / 9)::double", 0.8, 6), A.CALLS_SQL, _ATTEMPTS)
def attack_pair(spark, sf_dir):
    return reports.attempts_used(_attempts(spark, sf_dir), ["session", "trace_id"], reports.pair_score(F.floor(F.col("duration") / 10)), 0.8, 6)


@register(_loop_sql("case cast(floor(duration) as int) % 5 when 2 then 0.5 when 3 then 1.0 else 0.0 end::double", 0.7, 3), A.CALLS_SQL, _ATTEMPTS)
def attack_likert(spark, sf_dir):
    return reports.attempts_used(_attempts(spark, sf_dir), ["session", "trace_id"], reports.likert_score(F.floor("duration") % 5), 0.7, 3)


@register(_loop_sql("case when cast(floor(duration) as int) % 7 = 0 then 0 else greatest(0, least(1, duration / 200 - 0.2)) end::double", 0.5, 5), A.CALLS_SQL, _ATTEMPTS)
def attack_sequential(spark, sf_dir):
    score = F.when(F.floor("duration") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("duration") / 200 - 0.2)
    return reports.attempts_used(_attempts(spark, sf_dir), ["session", "trace_id"], reports.clamped(score), 0.5, 5)


@register(_loop_sql("greatest(0, least(1, duration / 100))::double", 0.7, 10), A.CALLS_SQL, _ATTEMPTS)
def attack_goat(spark, sf_dir):
    return reports.attempts_used(_attempts(spark, sf_dir), ["session", "trace_id"], reports.clamped(F.col("duration") / 100), 0.7, 10)


@register("select session, trace_id, attempt, (row_number() over (partition by session order by trace_id, attempt) - 1) as place from tries", A.CALLS_SQL, _ATTEMPTS)
def attack_traces(spark, sf_dir):
    a = _attempts(spark, sf_dir).select("session", F.col("trace_id").alias("attempt"), F.col("attempt").alias("turn"))
    return reports.kept_trace(a, ["session"]).select("session", F.col("attempt").alias("trace_id"), F.col("turn").alias("attempt"), "place")


@register(
    """with t as (select conv_id, row_number() over (partition by conv_id order by turn) as turn, length(text) % 5 = 0 as goal from conversations),
    g as (select conv_id, max(turn) as n, min(turn) filter (where goal) as done from t group by conv_id)
    select conv_id, case when done <= 4 then done else least(n, 4) end as turns, case when done <= 4 then 'goal_completed' when n >= 4 then 'max_turns' else 'open' end as reason from g"""
)
def actor_stops(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = A.messages(spark, sf_dir).select("conv_id", F.row_number().over(w).alias("turn"), (F.length("text") % 5 == 0).alias("goal"))
    return reports.actor_stop(t, ["conv_id"], 4)


@register(
    """with c as (select *, max(case when failed then pos end) over (partition by session, trace_id) as back from calls)
    select session, trace_id, coalesce(string_agg(event_id, ',' order by pos) filter (where not failed and (back is null or pos > back)), '') as kept,
    coalesce(string_agg(event_id, ',' order by pos) filter (where not failed and pos < back), '') as pruned from c group by session, trace_id""", A.CALLS_SQL,
)
def attack_restores(spark, sf_dir):
    """Failed calls put the conversation back to its beginning."""
    c = A.calls(spark, sf_dir)
    turns = c.select("session", "trace_id", F.col("pos").alias("turn"), F.when(F.col("failed"), "restore").otherwise("say").alias("event"), F.col("event_id").cast("string").alias("text"), F.lit(0).alias("to"))
    r = sessions.attempts_kept(turns, ("session", "trace_id"))
    return r.select("session", "trace_id", F.array_join("kept", ",").alias("kept"), F.array_join("pruned", ",").alias("pruned"))


@register(
    """select count(*) as total, count(*) filter (where not passed) as breached, round(100.0 * count(*) filter (where not passed) / count(*), 1)::double as percent, count(distinct base) as cases, count(distinct strategy) as strategies,
    cast(sum((pos % 5) // 2) as bigint) as blocked, 'FAIL' as verdict from results""", A.ATTACKS_SQL,
    """results as (select case_name, bool_and(test_pass) as passed, arg_min(strategy, pos) as strategy, min(pos) as pos, arg_min(base, pos) as base from attacks group by case_name)""",
)
def breach_totals(spark, sf_dir):
    r = reports.attack_results(A.attacks(spark, sf_dir)).withColumn("pruned_turns", F.col("pos") % 5)
    return reports.breach_totals(reports.with_base_case(r))


@register("select case_name, case when n > 1 then case_name else base end as base_case from (select *, count(*) over (partition by base, strategy) as n from (select distinct case_name, base, strategy from attacks))", A.ATTACKS_SQL)
def unique_base_cases(spark, sf_dir):
    r = reports.attack_results(A.attacks(spark, sf_dir))
    return reports.with_base_case(r).select("case_name", "base_case")


@register("select case_name, evaluator_pos, case when applicable then printf('%.2f', score) else 'n/a' end as shown from report", A.JUDGED_SQL,
          """report as (select case_name, row_pos % 5 as evaluator_pos, avg(score) as score, not bool_and(coalesce(label = 'not_applicable', false) and test_pass) as applicable from judged group by case_name, row_pos % 5)""")
def shown_scores(spark, sf_dir):
    from tracelake.plans.registry import report_rows

    r = report_rows(spark, sf_dir)
    return r.select("case_name", "evaluator_pos", reports.shown_score(F.col("score"), F.col("applicable")).alias("shown"))


# --- generated cases ---------------------------------------------------------------------------------------------------


@register(
    """select n_name as target, r.c as risk_category, case r.c when 'guideline_bypass' then 'high' when 'harmful_content' then 'critical' end as severity, case when r.c = 'other' then 'unknown risk category other' end as error, k as case_no
    from nation cross join (values ('guideline_bypass'), ('harmful_content'), ('other')) as r(c) cross join range(0, 3) as t(k) where r.c <> 'other' or k = 0"""
)
def adversarial_cases(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("target"), F.explode(F.array(*map(F.lit, ("guideline_bypass", "harmful_content", "other")))).alias("risk_category"))
    return generation.adversarial_cases(wanted, 3).select("target", "risk_category", "severity", "error", F.col("case_no").cast("long").alias("case_no"))


@register(
    """select n_nationkey, case n_nationkey % 3 when 0 then 'harmful_content,harmful_content' when 1 then 'guideline_bypass,system_prompt_leak,harmful_content,data_exfiltration,excessive_agency' else 'excessive_agency' end as categories,
    case when n_nationkey % 2 = 0 then 'tools' else 'system_prompt,tools' end as missing from nation"""
)
def inferred_categories(spark, sf_dir):
    k = F.col("n_nationkey")
    names = F.when(k % 3 == 0, F.array(F.lit("harmful_content"), F.lit("x"), F.lit("harmful_content"))).when(k % 3 == 1, F.array(F.lit("y"))).otherwise(F.array(F.lit("excessive_agency")))
    target = F.when(k % 2 == 0, F.create_map(F.lit("system_prompt"), F.lit("p"))).otherwise(F.create_map(F.lit("name"), F.lit("n")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(generation.valid_categories(names), ",").alias("categories"), F.array_join(generation.missing_keys(target), ",").alias("missing"))


@register(
    """with q as (select n_nationkey, n_name, greatest(0, least(5, 101 - 5 * (row_number() over (order by n_nationkey) - 1))) as quota from nation)
    select n_name as topic, place, case when place < quota * 0.3 then 'easy' when place > quota * 0.8 then 'hard' else 'medium' end as difficulty from q, range(0, 5) as t(place) where place < quota"""
)
def planned_cases(spark, sf_dir):
    topics = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic_pos"), F.col("n_name").alias("topic"))
    return generation.planned_cases(topics, 101).select("topic", F.col("place").cast("long").alias("place"), "difficulty")


@register("select n_regionkey, n_name from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as n from nation) where n <= n_regionkey")
def truncated_cases(spark, sf_dir):
    return generation.truncated(table(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey"], F.col("n_regionkey")).select("n_regionkey", "n_name")


@register("select row_number() over (order by new, pos) - 1 as case_pos, name, segment from (select 0 as new, c_custkey as pos, c_name as name, c_mktsegment as segment from customer union all select 1, n_nationkey, n_name, null from nation)")
def extended_cases(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_pos"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("case_pos"), F.col("n_name").alias("name"))
    return generation.extended(old, new)


@register("select event_id, case when event_id % 3 = 0 then '{\"result\":\"No response\"}' when event_id % 3 = 1 then props_compact else '{\"result\":' || to_json(event_type)::varchar || '}' end as result from (select *, replace(props, ' ', '') as props_compact from events)")
def simulated_results(spark, sf_dir):
    k = F.col("event_id")
    said = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", generation.simulated_result(said).alias("result"))


@register(
    """with n as (select user_id as session, case when event_type in ('view', 'click') then 'pages' else event_type end as state, event_id, row_number() over (partition by user_id, case when event_type in ('view', 'click') then 'pages' else event_type end order by ts desc, event_id desc) as n, ts from events)
    select session, state, '[' || string_agg(event_id, ',' order by ts, event_id) || ']' as calls, count(*) as n from n where n <= 20 group by session, state"""
)
def tool_memories(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.when(F.col("event_type").isin("view", "click"), "pages").otherwise("").alias("shared"), F.col("event_type").alias("tool"), "ts", "event_id", F.col("event_id").cast("string").alias("body"))
    return generation.tool_memory(e)


@register("select conv_id, turn, turn % 4 as score from conversations where turn % 4 > 0 union all select conv_id, turn, null from conversations where turn % 4 = 0")
def goal_scores(spark, sf_dir):
    said = F.when(F.col("turn") % 4 == 0, F.lit("cannot tell")).otherwise(F.concat(F.lit("Score: "), (F.col("turn") % 4).cast("string"), F.lit(". Good.")))
    return A.messages(spark, sf_dir).select("conv_id", "turn", generation.goal_score(said).cast("long").alias("score"))


@register(
    """select conv_id, turn, (select coalesce(sum(length(b.role) + 1 + length(b.text) + 1), 0) from conversations b where b.conv_id = a.conv_id and b.turn < a.turn) + length(role) as chars from conversations a"""
)
def judge_memories(spark, sf_dir):
    m = A.messages(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("prompt"), F.col("text").alias("answer"))
    j = sessions.judge_conversations(m, ("conv_id",), "turn")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    # the first has an empty line in front of its prompt
    return j.withColumn("first", first).select("conv_id", "turn", (F.length("conversation") - F.col("first").cast("int")).cast("long").alias("chars"))


@register("select conv_id, string_agg(text, '' order by turn) as response from conversations group by conv_id")
def joined_answers(spark, sf_dir):
    return sessions.joined_deltas(A.messages(spark, sf_dir).select("conv_id", F.col("turn").alias("at"), F.col("text").alias("delta")), ("conv_id",))


@register("select event_id, user_id % 3 as run_id, case when event_id % 2 = 0 then 'own' else 'run ' || user_id % 3 end as session, 'prod' as env from events")
def stamped_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("run_id"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("session.id"), F.lit("own"))).alias("attributes"))
    runs = spark.createDataFrame([(i, {"session.id": f"run {i}", "env": "prod"}) for i in range(3)], "run_id long, baggage map<string,string>")
    s = sessions.stamped(e, runs)
    return s.select("event_id", "run_id", F.col("attributes")["session.id"].alias("session"), F.col("attributes")["env"].alias("env"))
