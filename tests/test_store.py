"""Files, caches, sources and the command line."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tracelake.plans import cli
from tracelake.sources import remote, store


@pytest.fixture
def experiment(tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"cases": [{"name": "a", "input": "q", "expected_trajectory": ["x"]}, {"name": "b", "session_id": "s", "metadata": {"k": "v"}}], "evaluators": [{"type": "contains", "model_id": "m"}]}))
    return str(path)


def test_experiments(spark, experiment):
    rows = store.read_cases(spark, experiment).orderBy("case_pos").collect()
    assert [r.name for r in rows] == ["a", "b"] and rows[0].expected_trajectory == ["x"] and rows[1].session_id == "s" and len(rows[0].session_id) == 64 and rows[1].metadata == {"k": "v"}
    assert store.read_evaluators(spark, experiment) == [{"type": "contains", "model": "m"}]
    with pytest.raises(ValueError):
        store.read_cases(spark, "x.yaml")
    assert cli.main(["validate", experiment]) == 0


def test_reports_and_exit_codes(spark, tmp_path):
    path = str(tmp_path / "r.json")
    store.write_report(spark.createDataFrame([("e", "a", 1.0, True, "", True), ("e", "b", 0.0, False, "no", True)], store.REPORT), path)
    assert store.read_report(spark, path).count() == 2
    assert [cli.main(["report", path, "--fail-on", rule]) for rule in ("none", "any", "threshold")] == [0, 1, 0]
    assert cli.main(["report", path, "--fail-on", "threshold", "--threshold", "0.9"]) == 1
    assert cli.main(["report", "x.yaml"]) == 2 and cli.main(["nothing"]) == 2 and cli.main(["list"]) == 0 and cli.main(["query", "no_such", "x"]) == 2
    assert store.metric_records(store.read_report(spark, path)).count() == 2 + 1 + 2 + 1


def test_cache(spark, tmp_path):
    cache = store.ResultCache(spark, str(tmp_path / "cache"), "name")
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    assert cache.missing(cases).count() == 2 and cache.one("a") is None
    cache.save(cases.where("name = 'a'"))
    assert [r.name for r in cache.missing(cases).collect()] == ["b"]
    cache.save(spark.createDataFrame([("a", 7)], "name string, x int"))
    assert [tuple(r) for r in cache.one("a").collect()] == [("a", 7)] and cache.load().count() == 1


def test_session_dumps(spark, tmp_path):
    path = tmp_path / "dump.jsonl"
    path.write_text("".join(json.dumps({"session_id": s, "n": i}) + "\n" for i, s in enumerate(["a", "a", "é1", "a", "c"])))
    df = store.read_sessions(spark, str(path))
    assert df.count() == 5 and df.where("session_id = 'a'").count() == 3 and df.where("session_id = 'é1'").count() == 1
    found = store.lookup(spark.createDataFrame([("a",), ("z",)], "session_id string"), df.groupBy("session_id").agg(F.count("*").alias("n")))
    assert {(r.session_id, r.found) for r in found.collect()} == {("a", True), ("z", False)}


def test_experiment_and_report_files(spark, tmp_path):
    path = str(tmp_path / "e.json")
    cases = spark.createDataFrame([(0, "a", "s", "in", "out", None, ["x"], {"k": "v"}), (1, "b", "t", None, None, None, None, None)], "case_pos int, " + store.CASES)
    store.write_experiment(cases, [{"type": "equals", "model": "m"}], path)
    back = store.read_cases(spark, path).orderBy("case_pos").collect()
    assert [(r.name, r.session_id, r.expected_trajectory, r.metadata) for r in back] == [("a", "s", ["x"], {"k": "v"}), ("b", "t", None, None)]
    assert store.read_evaluators(spark, path) == [{"type": "equals", "model": "m"}]
    report = str(tmp_path / "r.json")
    store.write_report_file(spark.createDataFrame([("e", "b", 0.0, False, "no", True), ("e", "a", 1.0, True, "", True)], store.REPORT), report)
    assert [json.loads(x)["case_name"] for x in open(report)] == ["a", "b"] and store.read_report(spark, report).count() == 2
    metrics = str(tmp_path / "m.json")
    store.write_metrics(store.read_report(spark, report), metrics)
    lines = spark.read.json(metrics)
    assert lines.count() == 2 + 1 + 2 + 1 and lines.select("_aws.CloudWatchMetrics").first()[0][0].Namespace == "evaluations"


def test_fetch_from_a_service(spark, tmp_path):
    for session, n in (("s1", 3), ("s2", 1)):
        folder = tmp_path / session
        folder.mkdir()
        for page in range(n):
            (folder / f"{page}.json").write_text(json.dumps([{"id": session, "time": f"2024-01-0{page + 1}", "n": page * 2 + i} for i in range(2)]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ask = lambda session, **more: [json.loads(r[0])["n"] for r in remote.fetch(spark, session, folder=f"file://{tmp_path}", page_size="2", **more).orderBy("pos").select(F.to_json("record")).collect()]
    assert ask("s1") == [0, 1, 2, 3, 4, 5] and ask("s2") == [0, 1] and ask("s3") == []
    assert ask("s1", limit="3") == [0, 1, 2]
    out = str(tmp_path / "out.jsonl")
    assert cli.main(["fetch", "s2", "--option", f"folder=file://{tmp_path}", "--output", out]) == 0 and len(open(out).read().splitlines()) == 2
    assert cli.main(["fetch", "s9", "--option", f"folder=file://{tmp_path}"]) == 3


def test_retries_wait_and_give_up():
    calls, waits = [], []

    class ThrottlingException(Exception):
        pass

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ThrottlingException("slow down")
        return "done"

    assert remote.with_retries(flaky, sleep=waits.append) == "done" and waits == [0.5, 1.0, 2.0]
    with pytest.raises(ThrottlingException):
        remote.with_retries(lambda: (_ for _ in ()).throw(ThrottlingException()), attempts=3, sleep=waits.append)
    with pytest.raises(KeyError):
        remote.with_retries(lambda: {}["x"], sleep=waits.append)
    error = Exception("x")
    error.response = {"Error": {"Code": "TooManyRequestsException"}}
    assert remote.is_throttled(error) and not remote.is_throttled(ValueError("x"))


def test_commands(spark, tmp_path, capsys, experiment):
    task = "tests.tasks:echo"
    assert cli.main(["run", "--task", task, "--input", "hello", "--expected-output", "hello"]) == 0
    assert cli.main(["run", "--task", task, "--input", "hello", "--evaluator", "contains:bye"]) == 1
    assert cli.main(["run", "--task", task, "--input", "hello"]) == 2
    assert cli.main(["run", "--task", task, "--input", "hello", "--evaluator", "helpfulness"]) == 2
    assert cli.main(["run", "--task", task, "--input", "hello", "--evaluator", "tests.tasks:SHORT"]) == 0
    assert cli.main(["run", "--task", "tests.tasks:fails", "--input", "x", "--evaluator", "contains:x"]) == 1
    report = str(tmp_path / "r.json")
    assert cli.main(["run", experiment, "--task", task, "--evaluator", "contains:q", "--fail-on", "none", "--output", report]) == 0
    assert [json.loads(x)["test_pass"] for x in open(report)] == [True, False]
    topics = tmp_path / "topics.json"
    topics.write_text('["a", "b"]')
    plan = str(tmp_path / "plan.jsonl")
    assert cli.main(["generate", str(topics), "--cases", "3", "--output", plan]) == 0
    assert [json.loads(x)["topic"] for x in open(plan)] == ["a", "a", "b"]
    spans_ = tmp_path / "spans.json"
    spans_.write_text("\n".join(json.dumps({"session": "s", "pos": i, "trace_id": "t", "span_id": str(i), "parent_span_id": None if not i else "0", "text": '{"tool":"error"}' if i == 1 else "{}"}) for i in range(4)))
    out = str(tmp_path / "d.jsonl")
    assert cli.main(["diagnose", str(spans_), "--detector", "tests.tasks:detector", "--only", "failures", "--output", out]) == 0
    assert [json.loads(x)["category"] for x in open(out)] == ["bad"]
    assert cli.main(["diagnose", str(spans_), "--detector", "tests.tasks:detector", "--analyst", "tests.tasks:analyst", "--output", out]) == 0
    assert json.loads(open(out).read())["recommendations"] == ["mend it"]
    assert cli.main(["diagnose", str(spans_), "--only", "causes"]) == 2


def test_images(spark):
    b = base64.b64encode(b"png!").decode()
    df = spark.createDataFrame([(b,), (f"data:image/png;base64,{b}",), ("http://x/y.png",)], "s string")
    assert [None if r.b is None else bytes(r.b) for r in df.select(store.image_bytes(F.col("s")).alias("b")).collect()] == [b"png!", b"png!", None]
