"""Histories, skills, judges and streams on small inputs."""

import json

from pyspark.sql import functions as F

from tracelake.operators import extraction, judging
from tracelake.streaming import sessions

SPAN = "session_id string, trace_seq int, trace_id string, span_id string, span_pos long, span_type string, user_prompt string, agent_response string, tool_name string, tool_arguments string, tool_result string, tool_error string, tool_definitions string, owner string"


def spans(spark):
    rows = [
        ("s", 0, "t0", "a", 0, "invoke_agent", "hi", "hello", None, None, None, None, "[1]", None), ("s", 0, "t0", "x", 1, "execute_tool", None, None, "skill", '{"name": "pdf_tools"}', "body", None, None, "a"),
        ("s", 1, "t1", "b", 2, "invoke_agent", "more", "done", None, None, None, None, None, None), ("s", 1, "t1", "y", 3, "execute_tool", None, None, "bash", json.dumps({"command": "sh -c 'cd x && cat skills/pdf-tools/SKILL.md'"}), "body and more", None, None, "b"),
        ("s", 1, "t1", "z", 4, "execute_tool", None, None, "skill", '{"name": "other"}', None, "no such skill", None, "b"), ("u", 0, "t9", "q", 0, "inference", None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SPAN)


def test_levels(spark):
    df = spans(spark)
    got = {r.span_id: [(x.event, x.text) for x in r.session_history] for r in extraction.trace_inputs(df).collect()}
    assert got["a"] == [("user", "hi"), ("tool", "skill")]
    assert got["b"] == [("user", "hi"), ("tool", "skill"), ("assistant", "hello"), ("user", "more"), ("tool", "bash"), ("tool", "skill")]
    level = {r.session_id: r for r in extraction.session_inputs(df).collect()}
    assert len(level["s"].contexts) == 2 and level["u"].error == "no agent span"
    prompts = extraction.trace_inputs(df).select("span_id", extraction.user_prompt(F.col("session_history")).alias("p")).collect()
    assert {(r.span_id, r.p) for r in prompts} == {("a", ""), ("b", "")}


def test_skills(spark):
    events = extraction.skill_events(spans(spark).where("span_type = 'execute_tool'"))
    assert [(r.name, r.status, r.position) for r in events.orderBy("position").collect()] == [("pdf_tools", "loaded", 0), ("pdf-tools", "loaded", 1), ("other", "failed", 2)]
    folded = {r.canonical_name: r for r in extraction.invoked_skills(events).collect()}
    assert folded["pdf-tools"].body == "body and more" and folded["pdf-tools"].status == "loaded" and folded["other"].error == "no such skill"
    verdicts = [extraction.skill_invoked(events, spans(spark).where("session_id = 's'"), n).first() for n in ("pdf_tools", "other", "third")]
    assert [v.test_pass for v in verdicts] == [True, False, False] and "1 attempts" in verdicts[1].reason
    prompts = spark.createDataFrame([("s", 0, "<available_skills></available_skills>"), ("s", 1, "x <available_skills>\n<skill><name>a&amp;b</name><description> d </description></skill></available_skills>")], "session_id string, pos int, text string")
    assert [tuple(r) for r in extraction.available_skills(prompts).collect()] == [("s", 0, "a&b", "d")]
    assert extraction.advertised(prompts).first().advertised


def test_shell_reads(spark):
    cases = [("cat skills/a/SKILL.md", "a"), ("bash -lc 'sed -n 1,20p /x/b/SKILL.md'", "b"), ("sed -i s/x/y/ c/SKILL.md", None), ("echo hi > d/SKILL.md", None), ("ls e/SKILL.md", None), ("cat x.txt > f/SKILL.md", None), (None, None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    assert [r.s for r in df.select(extraction.skill_read(F.col("c")).alias("s")).collect()] == [s for _, s in cases]


def test_tools_used(spark):
    use = lambda i: {"toolUse": {"name": f"n{i}", "toolUseId": str(i), "input": {"q": i}}}
    result = lambda i, text, status: {"toolResult": {"toolUseId": str(i), "status": status, "content": [{"text": text}]}}
    rows = [("s", 0, "user", [result(1, "early", "success")]), ("s", 1, "assistant", [{"text": "go"}, use(1), use(2), use(3)]), ("s", 2, "user", [result(1, "one", "success"), result(2, "two", "error")]), ("s", 3, "user", [result(1, "late", "error")])]
    df = spark.createDataFrame([(a, b, c, json.dumps(d)) for a, b, c, d in rows], "session_id string, msg_pos int, role string, content string")
    assert {r.name: (r.tool_result, r.is_error) for r in extraction.tools_used(df).collect()} == {"n1": ("one", False), "n2": ("two", True), "n3": (None, None)}


def test_judges(spark):
    rows = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "prompt string")
    judge = judging.TableJudge(spark.createDataFrame([("p1", "Very helpful"), ("p2", "odd")], "prompt string, label string"))
    got = {r.prompt: r for r in judging.evaluate(rows, "helpfulness", judge).collect()}
    assert (got["p1"].score, got["p1"].test_pass) == (0.833, True) and got["p2"].reason.endswith("odd") and got["p3"].score == 0.0
    direct = judging.scored(spark.createDataFrame([(0.1,), (0.3,), (None,), (float("nan"),), (7.0,)], "score double"), "attack_success").collect()
    assert [(r.score, r.test_pass) for r in direct] == [(0.1, True), (0.3, False), (0.0, True), (0.0, True), (1.0, False)]
    for scale in judging.SCALES.values():
        assert set(scale.labels.values()) <= {0.0, 0.167, 0.25, 0.333, 0.5, 0.667, 0.75, 0.833, 1.0}


def test_prompts(spark):
    df = spark.createDataFrame([("q", "a", None, "must")], "input string, actual_output string, expected_output string, expected_assertion string")
    assert df.select(judging.case_prompt().alias("p")).first().p == "<Input>q</Input>\n<Output>a</Output>\n<ExpectedAssertion>must</ExpectedAssertion>"
    df = spark.createDataFrame([(["covered", "partial", "skipped", "covered"], ["a", "b", "c"], "---\nx: 1\n---\nrest")], "s array<string>, e array<string>, b string")
    r = df.select(judging.step_coverage(F.col("s")).alias("c"), judging.neighbours(F.col("e"), F.lit(0)).alias("n0"), judging.neighbours(F.col("e"), F.lit(1)).alias("n1"), judging.strip_frontmatter(F.col("b")).alias("b")).first()
    assert (r.c, r.n0, r.n1, r.b) == (0.625, ["a", "b"], ["a", "b", "c"], "rest")


def test_streams(spark, tmp_path):
    rows = [(i, 1 + i % 2, f"2024-01-01 0{i // 4}:0{i % 4}:00", t, False, 1.0) for i, t in enumerate(["view", "view", "click", "click", "purchase", "view", "view", "click"])]
    df = spark.createDataFrame(rows, "event_id long, session long, t string, tool string, failed boolean, duration double").withColumn("ts", F.to_timestamp("t"))
    batch = {(r.session, r.n_calls, round(r.score, 3)) for r in sessions.session_scores(df, ["view", "click"]).collect()}
    assert batch == {(1, 2, 1.0), (2, 2, 1.0), (1, 2, 0.5), (2, 2, 1.0)}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = sessions.recent_per_key(stream, keep=2).writeStream.outputMode("update").format("memory").queryName("recent_calls_test").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert all(r.n <= 2 for r in spark.sql("select * from recent_calls_test").collect())
    assert sessions.windowed_metrics(df).count() == 5


def test_case_prompts_hold_whole_texts(spark):
    from tracelake.plans import more
    from tracelake.runtime import table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").where("text is not null").collect()}
    prompts = {r.doc_id: r.prompt for r in more.case_prompts(spark, sf).collect()}
    assert max(map(len, texts.values())) > 1000 and all(f"<Output>{t}</Output>" in prompts[i] for i, t in texts.items())
