"""Known answers and odd inputs of the analytics operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import detection, expansion, hierarchy, history, reports


def one(spark, actual, expected, score):
    df = spark.createDataFrame([(actual, expected)], "a array<string>, e array<string>")
    return df.select(score(F.col("a"), F.col("e")).alias("s")).first().s


def test_trajectory_scores(spark):
    exact, in_order, any_order = scoring.exact_match, scoring.in_order_match, scoring.any_order_match
    assert one(spark, ["s1", "s2", "wrong"], ["s1", "s2", "s3"], exact) == pytest.approx(2 / 3)
    assert one(spark, ["s2", "s1", "s3", "s4"], ["s1", "s2", "s3"], exact) == pytest.approx(1 / 3)
    assert one(spark, ["s2", "s1", "s3"], ["s1", "s2", "s3"], in_order) == pytest.approx(1 / 3)
    assert one(spark, ["a"], [], in_order) == one(spark, ["a"], [], any_order) == 1.0
    assert one(spark, ["a"], ["a", "a"], any_order) == 0.5
    assert one(spark, [None], [None, "x"], exact) == 0.5
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, ["a"], [], exact)


def test_text_scores(spark):
    df = spark.createDataFrame([(None, None)], "a string, e string")
    r = df.select(scoring.equals(F.col("a"), F.col("e")).alias("eq"), scoring.contains(F.col("a"), F.lit("None")).alias("c"), scoring.starts_with(F.col("a"), F.lit("no"), False).alias("s")).first()
    assert (r.eq, r.c, r.s) == (True, True, True)


@pytest.mark.parametrize("scores, labels, passes, overall", [
    ([0.0, 1.0], [None, "judged"], [False, True], 0.5), ([0.0, 1.0], ["not_applicable", "judged"], [True, True], 1.0), ([0.0, 1.0], ["not_applicable", "judged"], [False, True], 0.5),
])
def test_overall_score(spark, scores, labels, passes, overall):
    rows = spark.createDataFrame(list(zip(range(2), scores, labels, passes)), "case_pos int, score double, label string, test_pass boolean")
    report = rows.join(reports.applicable(rows, ["case_pos"]), "case_pos")
    assert reports.overall(report).first().overall_score == overall


def test_aggregators_without_rows(spark):
    grid = spark.createDataFrame([("a",)], "case_name string")
    none = spark.createDataFrame([], "case_name string, row_pos int, score double, test_pass boolean, reason string, label string")
    assert tuple(reports.aggregate_default(grid, none, ["case_name"]).first()) == ("a", 0.0, False, "No evaluation outputs produced")
    assert tuple(reports.aggregate_drop_na(grid, none, ["case_name"]).first()) == ("a", 0.0, True, "not applicable")
    assert tuple(reports.overall(none.withColumn("applicable", F.lit(True))).first()) == (0.0, 0, 0)


def test_ownership(spark):
    spans = [
        ("t", "1", None, 1, "invoke_agent", True, 10), ("t", "2", "1", 2, "invoke_agent", True, 11), ("t", "3", "2", 3, "execute_tool", True, 12), ("t", "4", "9", 4, "execute_tool", True, 13),
        ("t", "5", "1", 5, "inference", True, 14), ("t", "6", "5", 6, "execute_tool", True, 15), ("u", "1", None, 1, "execute_tool", True, 1), ("c", "1", "2", 1, "execute_tool", True, 1), ("c", "2", "1", 2, "inference", True, 1),
    ]
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, span_pos long, span_type string, has_content boolean, start long")
    got = {(r.trace_id, r.span_id): r.owner for r in hierarchy.tool_owner(df).collect()}
    assert got == {("t", "3"): "2", ("t", "4"): "1", ("t", "6"): "1", ("u", "1"): None, ("c", "1"): None}
    kept = {(r.trace_id, r.span_id) for r in hierarchy.failure_paths(df, df.where("trace_id = 't' and span_id = '5'")).collect()}
    assert kept == {("t", "5"), ("t", "1"), ("t", "6")}


def test_failure_paths_reach_the_root_of_deep_trees(spark):
    """A chain of 150 levels, one with an orphaned top, and a cycle."""
    rows = [("deep", str(i), str(i - 1) if i else None, i) for i in range(150)] + [("deep", "aside", "3", 150)]
    rows += [("orphan", str(i), str(i - 1), i) for i in range(1, 90)] + [("cycle", str(i), str((i + 1) % 5), i) for i in range(5)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, span_pos long")
    failing = df.where("(trace_id, span_id) in (('deep', '149'), ('orphan', '89'), ('cycle', '2'))")
    kept = sorted((r.trace_id, r.span_id) for r in hierarchy.failure_paths(df, failing).collect())
    assert kept == sorted([("deep", str(i)) for i in range(150)] + [("orphan", str(i)) for i in range(1, 90)] + [("cycle", str(i)) for i in range(5)])


def test_prior_executions_break_ties_by_place(spark):
    calls = spark.createDataFrame([("s", 1, 0, 5), ("s", 2, 5, 5), ("s", 3, 5, 9), ("s", 4, 4, 2)], "k string, pos long, start long, end long")
    got = {r.pos: r.prior for r in history.prior_executions(calls, ["k"]).collect()}
    assert got == {1: 0, 2: 2, 3: 3, 4: 0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=30), st.integers(2, 20))
def test_chunks_hold_everything_in_order(sizes, limit):
    chunks = detection.plan_chunks(sizes, limit)
    assert sorted({i for c in chunks for i in c}) == list(range(len(sizes)))
    for c in chunks:
        assert c == list(range(c[0], c[-1] + 1))
        assert sum(sizes[i] for i in c) <= limit or len(c) == 1
    assert all(len([i for i in b if i <= a[-1]]) <= 5 for a, b in zip(chunks, chunks[1:]))


def test_token_estimate(spark):
    df = spark.createDataFrame([("x" * 1000,), ("",), ("a",), (None,)], "t string")
    assert [r.n for r in df.select(scoring.token_estimate(F.col("t")).alias("n")).collect()] == [333, 0, 1, 0]


def test_responses_are_parsed(spark):
    good = '```json\n{"errors": [{"location": "s1", "category": ["a"], "confidence": ["low"], "evidence": ["e"]}, {"location": "s2", "category": ["a", "b"], "confidence": ["low"], "evidence": ["e"]}]}\n```'
    df = spark.createDataFrame([(good,), ("not json",), (None,)], "raw string")
    assert [[x.location for x in r.e] for r in df.select(detection.parse_response(F.col("raw")).alias("e")).collect()] == [["s1"], [], []]


def test_effects_are_repeatable(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"},), ({},)], "m map<string,string>")
    kept = [r.m for r in df.select(expansion.remove_fields(F.col("m"), 0.0, 1).alias("m")).collect()]
    assert len(kept[0]) == 2 and kept[1] == {}
    spoiled = [r.m for r in df.select(expansion.corrupt_values(F.col("m"), 0.5, 1).alias("m")).collect()]
    assert sum(spoiled[0][k] != f'"{v}"' for k, v in {"a": "1", "b": "2", "c": "3"}.items()) == 2
    assert [r.m for r in df.select(expansion.corrupt_values(F.col("m"), 0.5, 1).alias("m")).collect()] == spoiled


def test_running_best_stops_at_the_first_hit(spark):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate([0.1, 0.5, 0.3, 0.9, 0.2])], "c string, attempt int, score double")
    assert [(r.attempt, r.best) for r in reports.running_best(df, ["c"], 0.8).orderBy("attempt").collect()] == [(0, 0.1), (1, 0.5), (2, 0.5), (3, 0.9)]
