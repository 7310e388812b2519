"""Queries over the driver's tables, one per operator of the trace analytics engine, with DuckDB SQL for each.

The SQL is phrased independently of the operators: joins and minima where these use folds and windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import detection, expansion, experiments, hierarchy, history, reports
from tracelake.plans import adapters as A
from tracelake.runtime import table
from tracelake.sources import variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            parts = list(ctes)
            text = sql.strip()
            if text.lower().startswith("with "):
                recursive = text[5:].lstrip().lower().startswith("recursive ")
                body = text[5:].lstrip()
                body = body[10:] if recursive else body
                text = ("with recursive " if recursive else "with ") + ", ".join([*parts, body]) if parts else text
            elif parts:
                text = "with " + ", ".join(parts) + " " + text
            ORACLES[query.__name__] = text
        return query

    return add


# --- trajectories ----------------------------------------------------------------------------------------------------

EXPECTED = ("view", "click", "purchase")


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.calls(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "tool")))
    return c.groupBy("session", "trace_id").agg(F.transform(ordered, lambda x: x["tool"]).alias("actual")).withColumn("expected", F.array(*map(F.lit, EXPECTED)))


_STEPS = """steps as (select session, trace_id, tool, row_number() over (partition by session, trace_id order by pos) as i from calls)"""


@register(
    "select session, trace_id, cast(count(case when (i = 1 and tool = 'view') or (i = 2 and tool = 'click') or (i = 3 and tool = 'purchase') then 1 end) as double) / 3 as score from steps group by session, trace_id",
    A.CALLS_SQL, _STEPS,
)
def traj_exact(spark, sf_dir):
    t = _trajectories(spark, sf_dir)
    return t.select("session", "trace_id", scoring.exact_match(F.col("actual"), F.col("expected")).alias("score"))


@register(
    """with a as (select session, trace_id, min(case when tool = 'view' then i end) as p1 from steps group by all),
    b as (select a.session, a.trace_id, p1, min(case when tool = 'click' and i > p1 then i end) as p2 from a join steps s on a.session = s.session and a.trace_id = s.trace_id group by all),
    c as (select b.session, b.trace_id, p1, p2, min(case when tool = 'purchase' and i > p2 then i end) as p3 from b join steps s on b.session = s.session and b.trace_id = s.trace_id group by all)
    select session, trace_id, cast((p1 is not null)::int + (p2 is not null)::int + (p3 is not null)::int as double) / 3 as score from c""",
    A.CALLS_SQL, _STEPS,
)
def traj_in_order(spark, sf_dir):
    t = _trajectories(spark, sf_dir)
    return t.select("session", "trace_id", scoring.in_order_match(F.col("actual"), F.col("expected")).alias("score"))


@register("select session, trace_id, cast(count(distinct case when tool in ('view', 'click', 'purchase') then tool end) as double) / 3 as score from steps group by session, trace_id", A.CALLS_SQL, _STEPS)
def traj_any_order(spark, sf_dir):
    t = _trajectories(spark, sf_dir)
    return t.select("session", "trace_id", scoring.any_order_match(F.col("actual"), F.col("expected")).alias("score"))


@register("select session, trace_id, bool_or(tool = 'purchase') as test_pass from calls group by session, trace_id", A.CALLS_SQL)
def tool_called(spark, sf_dir):
    steps = A.calls(spark, sf_dir).groupBy("session", "trace_id").agg(F.collect_list("tool").alias("steps"))
    return steps.select("session", "trace_id", experiments.tool_called(F.col("steps"), "purchase")["test_pass"].alias("test_pass"))


# --- outputs ---------------------------------------------------------------------------------------------------------


@register("select a.conv_id, a.turn, a.text is not distinct from b.text as test_pass from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 2")
def output_equals(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    later = m.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("expected"))
    return m.join(later, ["conv_id", "turn"], "left").select("conv_id", "turn", scoring.equals(F.col("text"), F.col("expected")).alias("test_pass"))


@register("select conv_id, turn, contains(lower(coalesce(text, 'None')), 'the ') as test_pass from conversations")
def output_contains(spark, sf_dir):
    return A.messages(spark, sf_dir).select("conv_id", "turn", scoring.contains(F.col("text"), F.lit("The "), case_sensitive=False).alias("test_pass"))


@register("select conv_id, turn, starts_with(coalesce(text, 'None'), 'The') as test_pass from conversations")
def output_starts_with(spark, sf_dir):
    return A.messages(spark, sf_dir).select("conv_id", "turn", scoring.starts_with(F.col("text"), F.lit("The")).alias("test_pass"))


@register(
    """select session, first_tool as state, case when first_tool is null then false else first_tool = 'view' end as test_pass from
    (select session, arg_min(tool, pos) as first_tool from calls group by session)""", A.CALLS_SQL,
)
def state_equals(spark, sf_dir):
    states = F.array_sort(F.collect_list(F.struct("pos", F.lit("last").alias("name"), F.col("tool").alias("state"))))
    s = A.calls(spark, sf_dir).groupBy("session").agg(states.alias("states"))
    first = experiments.state_of(F.col("states"), "last")
    return s.select("session", first.alias("state"), experiments.state_equals(first, F.lit("view"))["test_pass"].alias("test_pass"))


# --- reports ---------------------------------------------------------------------------------------------------------

_GRID = "grid as (select distinct source as case_name from documents union all select 'no rows')"


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("case_name")).distinct().unionByName(spark.createDataFrame([("no rows",)], "case_name string"))


@register(
    """select g.case_name, coalesce(avg(score), 0.0) as score, coalesce(bool_and(test_pass), false) as test_pass,
    case when count(row_pos) = 0 then 'No evaluation outputs produced' else coalesce(string_agg(reason, ' | ' order by row_pos) filter (where coalesce(reason, '') <> ''), '') end as reason
    from grid g left join judged j on g.case_name = j.case_name group by g.case_name""", A.JUDGED_SQL, _GRID,
)
def agg_default(spark, sf_dir):
    return reports.aggregate_default(_grid(spark, sf_dir), A.judged(spark, sf_dir), ["case_name"])


@register(
    """with x as (select g.case_name, j.*, coalesce(j.label = 'not_applicable', false) as na from grid g left join (select case_name as cn, row_pos, score, test_pass, reason, label from judged) j on g.case_name = j.cn)
    select case_name, coalesce(avg(score) filter (where not na), 0.0) as score,
    case when count(row_pos) = 0 then true when count(row_pos) filter (where not na) > 0 then bool_and(test_pass) filter (where not na) else bool_and(test_pass) end as test_pass,
    case when count(row_pos) = 0 then 'not applicable' when count(row_pos) filter (where not na) > 0 then coalesce(string_agg(reason, ' | ' order by row_pos) filter (where not na and coalesce(reason, '') <> ''), '')
    else coalesce(string_agg(reason, ' | ' order by row_pos) filter (where coalesce(reason, '') <> ''), '') end as reason
    from x group by case_name""", A.JUDGED_SQL, _GRID,
)
def agg_drop_na(spark, sf_dir):
    return reports.aggregate_drop_na(_grid(spark, sf_dir), A.judged(spark, sf_dir), ["case_name"])


_REPORT = """report as (select case_name, row_pos % 5 as evaluator_pos, avg(score) as score, bool_and(test_pass) as test_pass,
  not bool_and(coalesce(label = 'not_applicable', false) and test_pass) as applicable from judged group by case_name, row_pos % 5)"""


def report_rows(spark, sf_dir):
    rows = A.judged(spark, sf_dir).withColumn("evaluator_pos", F.col("row_pos") % 5)
    keys = ["case_name", "evaluator_pos"]
    done = rows.groupBy(*keys).agg(F.avg("score").alias("score"), F.bool_and("test_pass").alias("test_pass"))
    return done.join(reports.applicable(rows, keys), keys)


@register("select case_name, evaluator_pos, applicable from report", A.JUDGED_SQL, _REPORT)
def applicability(spark, sf_dir):
    return report_rows(spark, sf_dir).select("case_name", "evaluator_pos", "applicable")


@register("select round(coalesce(avg(score) filter (where applicable), 0.0), 9) as overall_score, count(*) filter (where test_pass) as passed, count(*) as total from report", A.JUDGED_SQL, _REPORT)
def overall_score(spark, sf_dir):
    return reports.overall(report_rows(spark, sf_dir)).withColumn("overall_score", F.round("overall_score", 9))


@register(
    "select evaluator_pos, round(coalesce(avg(score) filter (where applicable), 0.0), 9) as overall_score, count(*) filter (where test_pass) as passed, count(*) as total, round(count(*) filter (where test_pass)::double / count(*), 9) as pass_rate from report group by evaluator_pos",
    A.JUDGED_SQL, _REPORT,
)
def report_by_evaluator(spark, sf_dir):
    r = reports.overall(report_rows(spark, sf_dir), ["evaluator_pos"])
    return r.withColumn("pass_rate", F.round(F.try_divide(F.col("passed").cast("double"), F.col("total")), 9)).withColumn("overall_score", F.round("overall_score", 9))


@register(
    """select round(coalesce(avg(score) filter (where applicable), 0.0), 9) as overall_score, count(*) filter (where test_pass) as passed, count(*) as total,
    case when coalesce(avg(score) filter (where applicable), 0.0) < 0.9 then 1 else 0 end as exit_code from report""", A.JUDGED_SQL, _REPORT,
)
def exit_rule(spark, sf_dir):
    return reports.exit_code(report_rows(spark, sf_dir), "threshold", 0.9).withColumn("overall_score", F.round("overall_score", 9))


@register(
    """select row_pos, score, test_pass, coalesce(reason, '') as reason, source from (
    select row_pos, score, test_pass, reason, 'a' as source from judged where row_pos % 2 = 0 union all select row_pos, 0.0, test_pass, '', 'b' from judged where row_pos % 2 = 1)""", A.JUDGED_SQL,
)
def flatten_reports(spark, sf_dir):
    j = A.judged(spark, sf_dir)
    a = j.where("row_pos % 2 = 0").select("row_pos", "score", "test_pass", "reason", F.lit("a").alias("source"))
    b = j.where("row_pos % 2 = 1").select("row_pos", "test_pass", F.lit("b").alias("source"))
    return reports.flatten([a, b])


@register(
    """select case_name, evaluator_pos, case when not applicable then 'N/A' when score = 1 then 'Good' when score = 0.5 then 'Fair' when score = 0 then 'Poor' when score >= 0.5 then 'YES' else 'NO' end as label from report""",
    A.JUDGED_SQL, _REPORT,
)
def score_labels(spark, sf_dir):
    mapping = spark.createDataFrame([(1.0, "Good"), (0.5, "Fair"), (0.0, "Poor")], "score double, label string")
    return reports.label_scores(report_rows(spark, sf_dir), mapping).select("case_name", "evaluator_pos", "label")


@register("select source as case_name, count(*) as n from documents group by source having count(*) > 1")
def duplicate_names(spark, sf_dir):
    return reports.duplicates(table(spark, sf_dir, "documents").select(F.col("source").alias("case_name")), "case_name")


@register("select case_name, bool_or(not test_pass) as diagnose from judged group by case_name", A.JUDGED_SQL)
def diagnosis_trigger(spark, sf_dir):
    return detection.needs_diagnosis(A.judged(spark, sf_dir), ["case_name"])


# --- adversarial runs ------------------------------------------------------------------------------------------------

_RESULTS = """results as (select case_name, coalesce(max(score), 0.0) as score, bool_and(test_pass) as passed, string_agg('[' || evaluator || '] ' || reason, ' | ' order by pos) as reason,
  arg_min(risk_category, pos) as risk_category, arg_min(strategy, pos) as strategy, min(pos) as pos, arg_min(base, pos) as base from attacks group by case_name)"""


@register("select case_name, score, passed, reason, risk_category, strategy, pos from results", A.ATTACKS_SQL, _RESULTS)
def attack_results(spark, sf_dir):
    return reports.attack_results(A.attacks(spark, sf_dir))


@register("select risk_category, count(*) as n, round(avg(score), 9) as avg_score, round(avg(passed::int), 9) as pass_rate from results group by risk_category", A.ATTACKS_SQL, _RESULTS)
def by_risk(spark, sf_dir):
    s = reports.grouped_summary(reports.attack_results(A.attacks(spark, sf_dir)), "risk_category")
    return s.withColumns({c: F.round(c, 9) for c in ("avg_score", "pass_rate")})


@register("select strategy, count(*) as n, round(avg(score), 9) as avg_score, round(avg(passed::int), 9) as pass_rate from results group by strategy", A.ATTACKS_SQL, _RESULTS)
def by_strategy(spark, sf_dir):
    s = reports.grouped_summary(reports.attack_results(A.attacks(spark, sf_dir)), "strategy")
    return s.withColumns({c: F.round(c, 9) for c in ("avg_score", "pass_rate")})


@register("select case_name, score, pos from results where not passed", A.ATTACKS_SQL, _RESULTS)
def failed_cases(spark, sf_dir):
    return reports.failed_cases(reports.attack_results(A.attacks(spark, sf_dir))).select("case_name", "score", "pos")


@register("select case_name, base as base_case from results", A.ATTACKS_SQL, _RESULTS)
def base_case_names(spark, sf_dir):
    r = reports.attack_results(A.attacks(spark, sf_dir))
    return r.select("case_name", reports.base_case(F.col("case_name"), F.col("strategy")).alias("base_case"))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@register(
    "with cells as (select base as base_case, " + ", ".join(f"arg_max(case when strategy = '{s}' then score end, pos) filter (where strategy = '{s}') as \"{s}\"" for s in SEGMENTS)
    + ", bool_or(not passed) as breach from results group by base) select *, greatest(" + ", ".join(f'coalesce("{s}", 0.0)' for s in SEGMENTS) + ") as worst from cells", A.ATTACKS_SQL, _RESULTS,
)
def attack_matrix(spark, sf_dir):
    r = reports.attack_results(A.attacks(spark, sf_dir))
    return reports.attack_matrix(r.withColumn("base_case", reports.base_case(F.col("case_name"), F.col("strategy"))), SEGMENTS)


@register(
    """with t as (select session, trace_id, pos as attempt, round(least(1.0, duration / 30), 3) as score from calls),
    u as (select *, (select max(score) from t p where p.session = t.session and p.trace_id = t.trace_id and p.attempt < t.attempt) as before from t)
    select session, trace_id, attempt, score, greatest(coalesce(before, -1), score) as best from u where coalesce(before, -1) < 0.8""", A.CALLS_SQL,
)
def pair_best_score(spark, sf_dir):
    c = A.calls(spark, sf_dir).select("session", "trace_id", F.col("pos").alias("attempt"), F.round(F.least(F.lit(1.0), F.col("duration") / 30), 3).alias("score"))
    return reports.running_best(c, ["session", "trace_id"], 0.8)


# --- expansion -------------------------------------------------------------------------------------------------------

EFFECTS = [("timeout", 0), ("network_error", 1), ("slow", 2)]


@register(
    """select c_name || '|' || e.name as case_name, e.name as effect_name, e.pos as effect_pos from customer
    cross join (values ('baseline', -1), ('timeout', 0), ('network_error', 1), ('slow', 2)) as e(name, pos)"""
)
def chaos_expand(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_name").alias("case_name"))
    return expansion.chaos_cases(cases, spark.createDataFrame(EFFECTS, "effect_name string, effect_pos int")).select("case_name", "effect_name", "effect_pos")


@register("select c_name || '__' || s.r_name as case_name, s.r_name as strategy from customer cross join region s")
def strategy_cross(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_name").alias("case_name"))
    return expansion.strategy_cases(cases, table(spark, sf_dir, "region").select(F.col("r_name").alias("strategy")))


@register(
    """select event_id, case event_type when 'view' then 'Tool call timed out' when 'click' then 'Network unreachable' when 'purchase' then 'Tool execution failed' when 'signup' then 'Tool input validation failed' end as message from events"""
)
def chaos_pre_effects(spark, sf_dir):
    names = {"view": "timeout", "click": "network_error", "purchase": "execution_error", "signup": "validation_error"}
    effect = F.lit(None).cast("string")
    for tool, name in names.items():
        effect = F.when(F.col("event_type") == tool, name).otherwise(effect)
    return table(spark, sf_dir, "events").select("event_id", expansion.pre_effect(effect).alias("message"))


@register("select p_partkey, left(p_name, 10) as name, left(p_brand, 10) as brand, left(p_type, 10) as type from part")
def chaos_truncate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    cut = expansion.truncate_fields(F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("type"), "p_type"))
    return p.select("p_partkey", cut.alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["brand"].alias("brand"), F.col("m")["type"].alias("type"))


def _fields(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("m"))


_FIELDS = """fields as (select p_partkey, unnest(['name', 'brand', 'type']) as k, unnest([p_name, p_brand, p_type]) as v, unnest([1, 2, 3]) as place from part),
drawn as (select *, row_number() over (partition by p_partkey order by md5('7:' || k)) <= 2 as hit from fields)"""


@register("select p_partkey, '{' || string_agg(to_json(k)::varchar || ':' || to_json(v)::varchar, ',' order by place) || '}' as value from drawn where not hit group by p_partkey", _FIELDS)
def chaos_remove_fields(spark, sf_dir):
    return _fields(spark, sf_dir).select("p_partkey", F.to_json(expansion.remove_fields(F.col("m"), 0.5, 7)).alias("value"))


@register(
    """select p_partkey, string_agg(k || '=' || case when hit then ['null', '99999', '""', 'true', '[]', '"CORRUPTED_DATA"'][(instr('0123456789abcdef', left(md5('7:' || k || ':v'), 1)) - 1) % 6 + 1] else to_json(v)::varchar end, ';' order by place) as value
    from drawn group by p_partkey""", _FIELDS,
)
def chaos_corrupt_values(spark, sf_dir):
    spoilt = F.map_entries(expansion.corrupt_values(F.col("m"), 0.5, 7))
    return _fields(spark, sf_dir).select("p_partkey", F.array_join(F.transform(spoilt, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("value"))


@register(
    """with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders)
    select o_orderkey, case when i < n * 0.3 then 'easy' when i > n * 0.8 then 'hard' else 'medium' end as difficulty from r"""
)
def difficulty_quota(spark, sf_dir):
    return expansion.difficulty(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority").select("o_orderkey", "difficulty")


@register(
    "select conv_id, turn, " + " or ".join(f"contains(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in expansion.REFUSAL_MARKERS) + " as refused from conversations"
)
def refusal_prefilter(spark, sf_dir):
    return A.messages(spark, sf_dir).select("conv_id", "turn", expansion.looks_refused(F.col("text")).alias("refused"))


# --- extraction ------------------------------------------------------------------------------------------------------


@register("select a.conv_id, a.turn, count(b.turn) as history_size, cast(sum(length(b.text)) as bigint) as history_chars from conversations a join conversations b on a.conv_id = b.conv_id and b.turn <= a.turn group by a.conv_id, a.turn")
def turn_history_size(spark, sf_dir):
    return history.turn_history(A.messages(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "history_size", "history_chars")


@register("select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by conv_id")
def last_turn(spark, sf_dir):
    return history.last_turn(A.messages(spark, sf_dir), "conv_id", ["turn"])


@register(
    """select a.session, a.trace_id, a.pos, count(b.pos) as prior from calls a left join calls b on a.session = b.session and a.trace_id = b.trace_id
    and (greatest(b."end", b."start") < a."start" or (greatest(b."end", b."start") = a."start" and b.pos < a.pos)) group by a.session, a.trace_id, a.pos""", A.CALLS_SQL,
)
def prior_executions(spark, sf_dir):
    return history.prior_executions(A.calls(spark, sf_dir), ["session", "trace_id"])


@register("select session, tool, count(*) as call_count, count(*) filter (where not failed) as success_count, count(*) filter (where failed) as error_count, round(sum(duration), 6) as total_time from calls group by session, tool", A.CALLS_SQL)
def tools_used_metrics(spark, sf_dir):
    return history.tool_metrics(A.calls(spark, sf_dir), ["session", "tool"]).withColumn("total_time", F.round("total_time", 6))


@register(
    """select c.session, c.props, c.pos, min(r.pos) as result_pos from calls c left join calls r on c.session = r.session and c.props = r.props and r.tool in ('purchase', 'error') and r.pos > c.pos
    where c.tool = 'click' group by c.session, c.props, c.pos""", A.CALLS_SQL,
)
def call_result_first(spark, sf_dir):
    c = A.calls(spark, sf_dir).select("session", "props", F.col("pos").cast("long"), "tool")
    return history.first_later_result(c.where("tool = 'click'").drop("tool"), c.where("tool in ('purchase', 'error')").drop("tool"), ["session", "props"])


@register(
    """select c.session, c.props, min(c.pos) as call_pos, coalesce(arg_max(r.tool, r.pos), '') as result from calls c left join calls r on c.session = r.session and c.props = r.props and r.tool in ('purchase', 'error')
    where c.tool = 'click' group by c.session, c.props""", A.CALLS_SQL,
)
def call_result_last(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    return history.last_result(c.where("tool = 'click'"), c.where("tool in ('purchase', 'error')"), ["session", "props"], "tool")


@register(
    """with n as (select c.session, c.pos, min(x.pos) as nxt from calls c left join calls x on c.session = x.session and x.tool in ('click', 'view') and x.pos > c.pos where c.tool in ('click', 'view') group by c.session, c.pos)
    select n.session, n.pos, min(r.pos) as result_pos from n left join calls r on n.session = r.session and r.tool = 'purchase' and r.pos > n.pos and (n.nxt is null or r.pos < n.nxt) group by n.session, n.pos""",
    A.CALLS_SQL,
)
def asof_result(spark, sf_dir):
    return history.bounded_result(A.calls(spark, sf_dir), ["session"], F.col("tool").isin("click", "view"), F.col("tool") == "purchase")


@register(
    """with h as (select session, pos, tool as source, lead(tool) over (partition by session order by pos) as target from calls), nodes as (select distinct session, tool as node from calls)
    select n.session, n.node, coalesce(string_agg(h.source, ',' order by h.pos), '') as dependencies from nodes n left join h on n.session = h.session and h.target = n.node group by n.session, n.node""",
    A.CALLS_SQL,
)
def handoff_dependencies(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    hand = history.handoffs(c.select("session", "pos", F.col("tool").alias("node")))
    return history.incoming(c.select("session", F.col("tool").alias("node")).distinct(), hand)


@register(
    """with t as (select session, pos, case when tool = 'signup' then props end as tools from calls) select a.session, a.pos, (select arg_max(b.tools, b.pos) from t b where b.session = a.session and b.pos <= a.pos and b.tools is not null) as tools from t a""",
    A.CALLS_SQL,
)
def carry_forward_tools(spark, sf_dir):
    c = A.calls(spark, sf_dir).select("session", "pos", F.when(F.col("tool") == "signup", F.col("props")).alias("tools"))
    return history.carry_forward(c, ["session"], ["pos"], "tools")


@register("with r as (select session, tool, event_id, row_number() over (partition by session, tool order by ts desc, event_id desc) as recency from calls) select * from r where recency <= 20", A.CALLS_SQL)
def recent_calls(spark, sf_dir):
    return history.recent(A.calls(spark, sf_dir), ["session", "tool"], ["ts", "event_id"]).select("session", "tool", "event_id", "recency")


@register("select conv_id, coalesce(string_agg(upper(role) || ': ' || text, chr(10) || chr(10) order by turn) filter (where trim(coalesce(text, '')) <> ''), '') as conversation from conversations group by conv_id")
def format_conversation(spark, sf_dir):
    return history.conversation(A.messages(spark, sf_dir), "conv_id", "turn")


# --- hierarchy -------------------------------------------------------------------------------------------------------


@register(
    """with r as (select *, row_number() over (partition by trace_id order by case when parent_span_id is null and has_content then 0 when parent_span_id is null then 1 else 2 end, "start", span_pos) as n from tree)
    select trace_id, span_id from r where n = 1""", A.TREE_SQL,
)
def root_span(spark, sf_dir):
    return hierarchy.root_span(A.span_tree(spark, sf_dir)).select("trace_id", "span_id")


@register(
    """with recursive up as (select t.trace_id, t.span_id, t.parent_span_id as at, 0 as depth from tree t where t.has_content
    union all select up.trace_id, up.span_id, p.parent_span_id, depth + 1 from up join tree p on p.trace_id = up.trace_id and p.span_id = up.at where not p.has_content),
    best as (select up.trace_id, up.span_id, max(p.span_id) as bridged_parent from up left join tree p on p.trace_id = up.trace_id and p.span_id = up.at and p.has_content group by all)
    select * from best""", A.TREE_SQL,
)
def bridge_parents(spark, sf_dir):
    return hierarchy.bridge_parents(A.span_tree(spark, sf_dir), F.col("has_content"))


@register(
    """with recursive up as (select t.trace_id, t.span_id, t.parent_span_id as at from tree t where t.span_type = 'execute_tool'
    union all select up.trace_id, up.span_id, p.parent_span_id from up join tree p on p.trace_id = up.trace_id and p.span_id = up.at where p.span_type <> 'invoke_agent'),
    near as (select up.trace_id, up.span_id, max(p.span_id) as agent from up left join tree p on p.trace_id = up.trace_id and p.span_id = up.at and p.span_type = 'invoke_agent' group by all),
    ranked as (select *, row_number() over (partition by trace_id order by case when parent_span_id is null and has_content then 0 when parent_span_id is null then 1 else 2 end, "start", span_pos) as n from tree where span_type = 'invoke_agent')
    select near.trace_id, near.span_id, coalesce(agent, r.span_id) as owner from near left join ranked r on r.trace_id = near.trace_id and r.n = 1""", A.TREE_SQL,
)
def tool_owner(spark, sf_dir):
    return hierarchy.tool_owner(A.span_tree(spark, sf_dir))


@register(
    """with recursive bad as (select trace_id, span_id, parent_span_id from tree where not has_content),
    up as (select trace_id, span_id, parent_span_id from bad union select t.trace_id, t.span_id, t.parent_span_id from up join tree t on t.trace_id = up.trace_id and t.span_id = up.parent_span_id),
    down as (select b.trace_id, b.span_id as seed, t.span_id, t.span_pos, 1 as depth from bad b join tree t on t.trace_id = b.trace_id and t.parent_span_id = b.span_id
      union all select d.trace_id, d.seed, t.span_id, t.span_pos, d.depth + 1 from down d join tree t on t.trace_id = d.trace_id and t.parent_span_id = d.span_id),
    few as (select *, row_number() over (partition by trace_id, seed order by depth, span_pos) as n from down)
    select trace_id, span_id from up union select trace_id, span_id from few where n <= 10""", A.TREE_SQL,
)
def failure_paths(spark, sf_dir):
    t = A.span_tree(spark, sf_dir)
    return hierarchy.failure_paths(t, t.where("not has_content"))


# --- detection -------------------------------------------------------------------------------------------------------


@register("select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 3) end as tokens, case when length(text) = 0 then 0 else greatest(1, length(text) // 3) end > 650 as exceeds from documents")
def token_estimate(spark, sf_dir):
    n = scoring.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), scoring.exceeds_context(n, 1000).alias("exceeds"))


@register(
    """with recursive d as (select source, doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 3) end::bigint as n, row_number() over (partition by source order by doc_id) as i from documents),
    f as (select source, 0::bigint as i, null::bigint as doc_id, 0::bigint as chunk, 0::bigint as slot, []::bigint[] as ids, []::bigint[] as sizes, 0::bigint as fresh, []::bigint[] as again, 0::bigint as next from d group by source
    union all select source, i, doc_id, chunk, slot, case when big then [] else list_append(kept, doc_id) end, case when big then [] else list_append(kept_n, n) end, case when big then 0 else fresh + 1 end, case when big or slot > len(kept) or fresh > 0 then [] else kept end,
      case when big then chunk + 1 else chunk end from (
      select source, i, doc_id, n, big, fresh, kept, kept_n, chunk, case when big then 0 else len(kept) end as slot from (
        select *, case when big then [] when full_ then list_slice(ids, len(ids) - keep + 1, len(ids)) else ids end as kept, case when big then [] when full_ then list_slice(sizes, len(sizes) - keep + 1, len(sizes)) else sizes end as kept_n,
          case when big or full_ then 0 else old_fresh end as fresh, case when (big or full_) and old_fresh > 0 then next + 1 else next end as chunk from (
          select f.source, d.i, d.doc_id, d.n, f.ids, f.sizes, f.fresh as old_fresh, f.next, d.n >= 10000 as big, len(f.ids) > 0 and list_sum(f.sizes) + d.n > 10000 as full_,
            (select coalesce(max(k), 0) from range(0, 6) as t(k) where k <= len(f.ids) and (k = 0 or (list_sum(list_slice(f.sizes, len(f.sizes) - k + 1, len(f.sizes))) <= 5000 and list_sum(list_slice(f.sizes, len(f.sizes) - k + 1, len(f.sizes))) + d.n <= 10000))) as keep
          from f join d on d.source = f.source and d.i = f.i + 1))))
    select source as session, cast(chunk as int) as chunk, cast(slot as int) as slot, doc_id as pos from f where doc_id is not null
    union all select source, cast(chunk as int), cast(unnest(range(0, len(again))) as int), unnest(again) from f where len(again) > 0"""
)
def token_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", scoring.token_estimate(F.col("text")).alias("tokens"))
    return detection.token_chunks(d, "source", "doc_id", "tokens", max_tokens=20_000)


_FAILURES = """failures as (select doc_id // 7 % 60 as span_id, case when toxic = 1 then 'toxic' else 'quality' end as category, doc_id // 1000 as chunk, doc_id as pos,
  case doc_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'unsure' end as level, 'doc ' || doc_id as evidence from labels),
  numbered as (select *, case level when 'low' then 0.5 when 'medium' then 0.75 when 'high' then 0.9 else 0.0 end::double as confidence from failures)"""


def _failures(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "unsure"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(
        (F.floor(F.col("doc_id") / 7) % 60).alias("span_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("quality").alias("category"), F.floor(F.col("doc_id") / 1000).alias("chunk"),
        F.col("doc_id").alias("pos"), scoring.confidence(level).alias("confidence"), F.concat(F.lit("doc "), "doc_id").alias("evidence"),
    )


@register(
    """with r as (select *, row_number() over (partition by span_id, category order by confidence desc, chunk, pos) as n, min(chunk * 1000000000 + pos) over (partition by span_id, category) as seen from numbered)
    select span_id, category, confidence, evidence, seen // 1000000000 as first_chunk, seen % 1000000000 as first_pos from r where n = 1""", _FAILURES,
)
def merge_failures(spark, sf_dir):
    return detection.merge_failures(_failures(spark, sf_dir))


@register("select span_id, category, pos, confidence from numbered where confidence >= 0.75", _FAILURES)
def threshold_failures(spark, sf_dir):
    return detection.over_threshold(_failures(spark, sf_dir), F.lit("medium")).select("span_id", "category", "pos", "confidence")


@register(
    """with r as (select session, trace_id, pos, row_number() over (partition by session, trace_id order by pos) - 1 as place, count(*) over (partition by session) as n from calls)
    select session, trace_id, pos, cast(place as bigint) as place, cast(place // greatest(5, n // 3) as int) as rca_window from r""", A.CALLS_SQL,
)
def rca_windows(spark, sf_dir):
    return detection.index_windows(A.calls(spark, sf_dir), "trace_id", ["pos"]).select("session", "trace_id", "pos", F.col("place").cast("long").alias("place"), "rca_window")


@register(
    """with w as (select p_brand, trim(p_type) as t, min(p_partkey) as first from part where trim(p_type) <> '' group by all) select p_brand, string_agg(t, ';' order by first) as recommendations from w group by p_brand"""
)
def recommendations(spark, sf_dir):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: x["p_type"])
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(detection.recommendations(texts), ";").alias("recommendations"))


@register("select session, trace_id, min(pos) as first_pos, count(*) as n_spans from (select session, case when tool = 'error' then 'unknown' else trace_id end as trace_id, pos from calls) group by session, trace_id", A.CALLS_SQL)
def group_spans(spark, sf_dir):
    c = A.calls(spark, sf_dir).withColumn("trace_id", F.when(F.col("tool") != "error", F.col("trace_id")))
    return detection.group_spans(c)


# --- schema on read --------------------------------------------------------------------------------------------------


@register("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_args(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", variants.get(variants.parsed(F.col("props")), "$.k", "long").alias("k"))


@register("select event_id, epoch_us(ts) as from_ns, epoch_us(ts) // 1000000 * 1000000 as from_seconds from events")
def parse_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ns = (F.col("us") * 1000).cast("string")
    seconds = F.floor(F.col("us") / 1_000_000).cast("double")
    return e.select("event_id", F.unix_micros(scoring.parse_time(ns)).alias("from_ns"), F.unix_micros(scoring.parse_time(F.format_string("%.1f", seconds))).alias("from_seconds"))


@register(
    """with tagged as (select *, case when event_type = 'signup' then case when event_id % 2 = 0 then 'a' else 'b' end end as tag from events)
    select event_id from tagged where user_id in (select user_id from tagged where tag = 'a') and (tag is null or tag = 'a')"""
)
def session_filter(spark, sf_dir):
    from tracelake.sources.spans import filter_session

    e = table(spark, sf_dir, "events").withColumn("tag", F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")))
    return filter_session(e, "user_id", "tag", "a").select("event_id")
