"""Experiments: the grid of cases and evaluators, tasks run over cases, their reports, and metadata of runs."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators import reports
from tracelake.runtime import broadcast_if_small, ship_package

#: What a task gave for a case.
OUTPUTS = "case_pos long, case_name string, session_id string, input string, output string, trajectory array<string>, error string"
#: What evaluators give, any number of rows a case.
JUDGED = "case_pos long, row_pos int, score double, test_pass boolean, reason string, label string"


@dataclass(frozen=True)
class Evaluator:
    """A named function from task outputs to judged rows (see ``JUDGED``), with its rule of aggregation: ``default``,
    ``drop_na``, or a function of (grid, rows, keys) of the shape of ``reports.aggregate_default``. ``needs_session`` says
    that it reads trajectories of a session."""

    name: str
    judge: Callable[[DataFrame], DataFrame]
    kind: str = "custom"
    aggregator: str | Callable[[DataFrame, DataFrame, Sequence[str]], DataFrame] = "default"
    needs_session: bool = False


AGGREGATORS = {"default": reports.aggregate_default, "drop_na": reports.aggregate_drop_na}


def check_names(evaluators: Sequence[Evaluator]) -> None:
    names = [e.name for e in evaluators]
    if again := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"evaluator names repeat: {', '.join(again)}")


def grid(cases: DataFrame, evaluators: DataFrame) -> DataFrame:
    """Every case with each of the (few) evaluators, evaluators outermost: evaluator_pos, evaluator, and the cases' columns."""
    return cases.crossJoin(broadcast_if_small(evaluators)).orderBy("evaluator_pos", "case_pos")


def eval_task(before: Callable[[dict], Any] | None = None, after: Callable[[dict, Any], Any] | None = None):
    """A decorator for tasks: ``before`` sees the case, a callable answer is called with the case's input, what is no
    text or dict becomes text, and ``after`` may replace the answer."""

    def wrap(task: Callable[[dict], Any]) -> Callable[[dict], Any]:
        def run(case: dict) -> Any:
            if before is not None:
                before(case)
            answer = task(case) if inspect.signature(task).parameters else task()
            if callable(answer):
                answer = answer(case.get("input"))
            if answer is not None and not isinstance(answer, str | dict):
                answer = str(answer)
            return answer if after is None else after(case, answer)

        return run

    return wrap


def run_task(cases: DataFrame, task: Callable[[dict], Any]) -> DataFrame:
    """``OUTPUTS`` of a task over cases (case_pos, case_name, session_id, input). A task gives a text, or a dict of
    output, trajectory and input; an exception is that case's error and touches no other. Cases are independent, so they
    run where they lie, in batches."""
    ship_package(cases.sparkSession)

    def one(case: dict) -> tuple:
        given, output, steps, error = case["input"], None, None, None
        try:
            answer = task(case)
            if isinstance(answer, dict):
                given = answer.get("input", given)
                output, steps = answer.get("output"), answer.get("trajectory")
            else:
                output = answer
            output = output if output is None or isinstance(output, str) else json.dumps(output, sort_keys=True)
        except Exception as e:  # noqa: BLE001  a case's failure is its result
            error = str(e)
        return case["case_pos"], case["case_name"], case["session_id"], given, output, None if steps is None else [str(s) for s in steps], error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(c) for c in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUTS.split(", ")])

    return cases.select("case_pos", "case_name", "session_id", "input").mapInPandas(run, OUTPUTS)


def task_errors(cells: DataFrame, outputs: DataFrame) -> DataFrame:
    """One failing row for each evaluator of a case whose task failed."""
    failed = outputs.where("error is not null").select("case_pos", "error")
    return cells.join(failed, "case_pos").select(
        "evaluator_pos", "case_pos", F.lit(0.0).alias("score"), F.lit(False).alias("test_pass"), F.concat(F.lit("An error occurred: "), "error").alias("reason"), F.lit(True).alias("applicable"))


def evaluator_errors(cells: DataFrame, errors: DataFrame) -> DataFrame:
    """One failing row for each (evaluator_pos, case_pos) whose evaluator failed with ``error``; it counts in means."""
    return cells.join(errors, ["evaluator_pos", "case_pos"]).select(
        "evaluator_pos", "case_pos", F.lit(0.0).alias("score"), F.lit(False).alias("test_pass"), F.concat(F.lit("Evaluator error: "), "error").alias("reason"), F.lit(True).alias("applicable"))


def run_experiment(cases: DataFrame, outputs: DataFrame, evaluators: Sequence[Evaluator]) -> DataFrame:
    """The report, evaluator by evaluator and case by case: evaluator_pos, evaluator, evaluator_type, case_pos, case_name,
    score, test_pass, reason, applicable. Cases whose task failed are not judged."""
    check_names(evaluators)
    spark = cases.sparkSession
    names = spark.createDataFrame([(i, e.name, e.kind) for i, e in enumerate(evaluators)], "evaluator_pos int, evaluator string, evaluator_type string")
    cells = grid(cases.select("case_pos", "case_name"), names)
    good = outputs.where("error is null")
    report = task_errors(cells, outputs)
    for i, e in enumerate(evaluators):
        rows = e.judge(good)
        own = good.select(F.lit(i).alias("evaluator_pos"), "case_pos")
        merge = AGGREGATORS.get(e.aggregator, e.aggregator) if isinstance(e.aggregator, str) else e.aggregator
        done = merge(own, rows.withColumn("evaluator_pos", F.lit(i)), ["evaluator_pos", "case_pos"])
        counts = reports.applicable(rows, ["case_pos"])
        done = done.join(counts, "case_pos", "left").withColumn("applicable", F.coalesce("applicable", F.lit(True)))
        report = report.unionByName(done.select("evaluator_pos", "case_pos", "score", "test_pass", "reason", "applicable"))
    return cells.join(report, ["evaluator_pos", "case_pos"]).select(
        "evaluator_pos", "evaluator", "evaluator_type", "case_pos", "case_name", "score", "test_pass", "reason", "applicable").orderBy("evaluator_pos", "case_pos")


def with_cache(cases: DataFrame, cache: Any, task: Callable[[dict], Any]) -> DataFrame:
    """Outputs of all cases: those that the cache holds, and the others run now and saved."""
    check_unique(cases, "case_name")
    known = cache.load()
    todo = cases if known is None else cases.join(known.select("case_name"), "case_name", "left_anti")
    cache.save(run_task(todo, task))
    return cache.load().join(cases.select("case_name"), "case_name", "left_semi")


def check_unique(rows: DataFrame, name: str) -> None:
    if again := [r[0] for r in reports.duplicates(rows, name).orderBy(name).limit(10).collect()]:
        raise ValueError(f"names repeat: {', '.join(map(str, again))}")


# --- metadata and lookups ----------------------------------------------------------------------------------------------


def merged(left: Column, right: Column) -> Column:
    """Two maps in one; the right one wins where both have a key. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    l, r = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(r, k)), r)


def run_metadata(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Report rows with the metadata of their case's run merged into their own. runs: case_name, run_metadata."""
    return rows.join(runs, "case_name", "left").withColumn("metadata", merged(F.col("metadata"), F.col("run_metadata"))).drop("run_metadata")


def state_of(states: Column, name: str) -> Column:
    """The state of the first entry of that name, or null."""
    return F.try_element_at(F.filter(states, lambda x: x["name"] == name), F.lit(1))["state"]


def state_equals(actual: Column, expected: Column) -> Column:
    """(score, test_pass, reason) of a state against what is expected; a missing state fails, a missing expectation is an
    error."""
    same = actual.eqNullSafe(expected)
    ok = F.coalesce(actual.isNotNull() & expected.isNotNull() & same, F.lit(False))
    reason = F.when(expected.isNull(), "Evaluator error: no state is expected").when(actual.isNull(), "the state was not recorded").when(ok, "the state is as expected").otherwise("the state differs")
    return F.struct(ok.cast("double").alias("score"), ok.alias("test_pass"), reason.alias("reason"))


def tool_called(trajectory: Column, tool: str) -> Column:
    """(score, test_pass, reason) of whether a tool is among a trajectory's steps; a missing trajectory fails."""
    hit = F.coalesce(F.array_contains(trajectory, tool), F.lit(False))
    reason = F.when(trajectory.isNull(), "no trajectory provided").when(hit, f"{tool} was called").otherwise(f"{tool} was not called")
    return F.struct(hit.cast("double").alias("score"), hit.alias("test_pass"), reason.alias("reason"))


def rubrics(interactions: DataFrame, known: DataFrame) -> DataFrame:
    """Interactions with their node's rubric; ``error`` names a node that has none. known: node, rubric."""
    out = interactions.join(known, "node", "left")
    return out.withColumn("error", F.when(F.col("rubric").isNull(), F.concat(F.lit("no rubric for "), "node")))
