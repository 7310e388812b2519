"""Command line: ``python -m tracelake.plans.cli COMMAND ...``. Exit codes: 0 fine, 1 a failing verdict, 2 wrong use, 3 an
error. A path of ``-`` is standard input or output."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scoring
from tracelake.operators import diagnosis, experiments, generation, judging, reports
from tracelake.operators.experiments import Evaluator
from tracelake.plans import registry
from tracelake.runtime import local_session
from tracelake.sources import remote, store

#: Short names of evaluators (fixed values), and the judge that each stands for.
SHORT_NAMES = {
    "coherence": "coherence", "conciseness": "conciseness", "correctness": "correctness", "equals": "equals", "faithfulness": "faithfulness", "goal-success-rate": "goal_success",
    "harmfulness": "harmfulness", "helpfulness": "helpfulness", "instruction-following": "instruction_following", "refusal": "refusal", "response-relevance": "response_relevance",
    "skill-instruction-following": "skill_instructions", "skill-selection-accuracy": "skill_selection", "stereotyping": "stereotyping",
    "tool-parameter-accuracy": "tool_parameters", "tool-selection-accuracy": "tool_selection",
}


class Misuse(ValueError):
    """Wrong use of a command: exit code 2."""


def read_text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def show_text(path: str, text: str) -> None:
    if path == "-":
        print(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def deterministic(name: str, rule: Any) -> Evaluator:
    """An evaluator of one row a case from a column of whether it passes."""
    row = lambda rows: rows.select("case_pos", F.lit(0).alias("row_pos"), rule().cast("double").alias("score"), rule().alias("test_pass"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("label"))
    return Evaluator(name, row, "deterministic")


def evaluator_of(spec: str, expected: str | None = None) -> Evaluator:
    """An evaluator by short name, ``contains:TEXT``, ``equals`` or ``module:attribute``."""
    if spec == "equals":
        return deterministic("equals", lambda: scoring.equals(F.col("output"), F.lit(expected)))
    if spec.startswith("contains:"):
        return deterministic(spec, lambda: scoring.contains(F.col("output"), F.lit(spec.removeprefix("contains:"))))
    if spec in SHORT_NAMES:
        scale = judging.SCALES[SHORT_NAMES[spec]]

        def judge(rows: DataFrame) -> DataFrame:
            labelled = rows.select("case_pos", F.lit(0).alias("row_pos"), F.get_json_object("output", "$.label").alias("label"))
            return judging.scored(labelled, SHORT_NAMES[spec]).select("case_pos", "row_pos", "score", "test_pass", "reason", "label")

        return Evaluator(spec, judge, "judge", needs_session=scale.level in ("trace", "tool", "session"))
    found = remote.resolve(spec)
    found = found() if isinstance(found, type) else found
    if not isinstance(found, Evaluator):
        raise Misuse(f"{spec} is no evaluator")
    return found


def check_evaluators(evaluators: list[Evaluator], has_sessions: bool, expected: str | None) -> None:
    """Combinations that can never pass are wrong use: judges of sessions over plain tasks, and an equality with nothing."""
    if not has_sessions and (names := sorted(e.name for e in evaluators if e.needs_session)):
        raise Misuse(f"{', '.join(names)}: these judge sessions, and a plain task has none")
    if expected is None and any(e.name == "equals" for e in evaluators):
        raise Misuse("equals needs an expected output")


def run_command(spark: SparkSession, given: argparse.Namespace) -> int:
    """Runs a task over an experiment's cases, or over one case from the arguments, and judges the answers."""
    task = remote.resolve(given.task)
    if given.experiment:
        cases = store.read_cases(spark, given.experiment).withColumn("case_pos", F.col("case_pos").cast("long")).withColumnRenamed("name", "case_name")
    else:
        cases = spark.createDataFrame([(0, "case", "s", read_text("-") if given.input == "-" else given.input)], "case_pos long, case_name string, session_id string, input string")
    specs = given.evaluator or (["equals"] if given.expected_output is not None else [])
    if not specs:
        raise Misuse("name an evaluator, or an expected output")
    evaluators = [evaluator_of(s, given.expected_output) for s in specs]
    if not given.experiment:
        check_evaluators(evaluators, given.agent, given.expected_output)
    outputs = experiments.run_task(cases, task).cache()
    report = experiments.run_experiment(cases, outputs, evaluators).cache()
    shown = report.withColumn("score", reports.shown_score(F.col("score"), F.col("applicable")))
    shown.select("evaluator", "case_name", "score", "test_pass", "reason").show(50, truncate=60)
    if given.output:
        store.write_report_file(report, given.output)
    return print_verdict(report, given.fail_on, given.threshold)


def print_verdict(report: DataFrame, fail_on: str, threshold: float) -> int:
    verdict = reports.exit_code(report, fail_on, threshold).first()
    print(f"overall {verdict.overall_score:.2f}, {verdict.passed} of {verdict.total} passed")
    return verdict.exit_code


def diagnose_command(spark: SparkSession, given: argparse.Namespace) -> int:
    """Failures and root causes of a table of spans; detector and analyst are ``module:attribute``."""
    spans = spark.read.json(given.spans)
    detector = remote.resolve(given.detector) if given.detector else None
    if given.only == "causes":
        if not given.failures:
            raise Misuse("root causes alone need --failures")
        failures = spark.read.json(given.failures)
    else:
        if detector is None:
            raise Misuse("name a detector")
        failures = diagnosis.detect_failures(spans, detector, given.level)
    if given.only == "failures":
        out = failures.orderBy("session", "span_id", "category")
    else:
        analyst = remote.resolve(given.analyst)
        causes = diagnosis.analyze_root_cause(spans, failures, analyst, remote.resolve(given.merger) if given.merger else analyst)
        out = diagnosis.diagnosed(spans.select("session").distinct(), failures, causes).orderBy("session")
    show_text(given.output, "\n".join(r[0] for r in out.select(F.to_json(F.struct(*out.columns))).limit(given.rows).collect()))
    return 0


def generate_command(spark: SparkSession, given: argparse.Namespace) -> int:
    """A plan of cases to be written: a row per case with its topic and difficulty."""
    topics = spark.createDataFrame(list(enumerate(json.loads(read_text(given.topics)))), "topic_pos int, topic string")
    rows = generation.planned_cases(topics, given.cases).orderBy("topic_pos", "place").select("topic", "place", "difficulty").toJSON().collect()
    show_text(given.output, "\n".join(rows))
    return 0


def fetch_command(spark: SparkSession, given: argparse.Namespace) -> int:
    """A session's records from a trace service, as JSON lines."""
    options = dict(o.split("=", 1) for o in given.option)
    records = remote.fetch(spark, given.session, given.since, client=given.client, **options).orderBy("pos").select(F.to_json("record")).collect()
    if not records:
        print(f"no session {given.session}", file=sys.stderr)
        return 3
    show_text(given.output, "\n".join(r[0] for r in records))
    return 0


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracelake")
    sub = parser.add_subparsers(dest="command", required=True)
    query = sub.add_parser("query", help="run a registered query over a data folder")
    query.add_argument("query")
    query.add_argument("folder")
    query.add_argument("--rows", type=int, default=20)
    sub.add_parser("list", help="names of the registered queries")
    run = sub.add_parser("run", help="run a task over cases and judge its answers")
    run.add_argument("experiment", nargs="?")
    run.add_argument("--task", required=True)
    run.add_argument("--agent", action="store_true", help="the task gives sessions")
    run.add_argument("--input", default="")
    run.add_argument("--expected-output")
    run.add_argument("--evaluator", action="append")
    run.add_argument("--output")
    check = sub.add_parser("validate", help="count cases and evaluators of an experiment file")
    check.add_argument("path")
    report = sub.add_parser("report", help="print a report and judge it")
    report.add_argument("path")
    for p in (run, report):
        p.add_argument("--fail-on", choices=["none", "any", "threshold"], default="any")
        p.add_argument("--threshold", type=float, default=0.5)
    diagnose = sub.add_parser("diagnose", help="find failures and their root causes in spans")
    diagnose.add_argument("spans")
    diagnose.add_argument("--only", choices=["failures", "causes"])
    diagnose.add_argument("--failures")
    for name in ("detector", "analyst", "merger"):
        diagnose.add_argument(f"--{name}")
    diagnose.add_argument("--level", choices=["low", "medium", "high"], default="low")
    diagnose.add_argument("--rows", type=int, default=1000)
    generate = sub.add_parser("generate", help="plan cases over topics")
    generate.add_argument("topics")
    generate.add_argument("--cases", type=int, default=10)
    fetch = sub.add_parser("fetch", help="read a session from a trace service")
    fetch.add_argument("session")
    fetch.add_argument("--client", default="tracelake.sources.remote:DumpClient")
    fetch.add_argument("--since")
    fetch.add_argument("--option", action="append", default=[])
    for p in (diagnose, generate, fetch):
        p.add_argument("--output", default="-")
    return parser


def main(args: list[str] | None = None) -> int:
    from tracelake.plans import more, runs, traces  # noqa: F401  all fill the registry

    try:
        given = build_parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if given.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    commands = {"run": run_command, "diagnose": diagnose_command, "generate": generate_command, "fetch": fetch_command}
    try:
        spark = local_session()
        if given.command in commands:
            return commands[given.command](spark, given)
        if given.command == "query":
            if given.query not in registry.QUERIES:
                raise Misuse(f"no query named {given.query}")
            registry.QUERIES[given.query](spark, given.folder).show(given.rows, truncate=80)
            return 0
        if given.command == "validate":
            print(f"{store.read_cases(spark, given.path).count()} cases, {len(store.read_evaluators(spark, given.path))} evaluators")
            return 0
        rows = store.read_report(spark, given.path)
        rows.withColumn("score", reports.shown_score(F.col("score"), F.col("applicable"))).show(50, truncate=60)
        return print_verdict(rows, given.fail_on, given.threshold)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  the last resort of a command line
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
