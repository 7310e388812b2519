"""Effects at any depth, attack conversations, skills, long traces and growing span tables."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import detection, diagnosis, expansion, experiments, extraction, generation, hierarchy, judging, skills
from tracelake.sources import producers, variants
from tracelake.streaming import sessions


def test_effects_reach_nested_values():
    value = {"name": "a long name", "info": {"note": "another long one", "n": 3, "deep": {"x": "abcdefghijklm"}}, "list": ["stays as it is, whole"]}
    cut = expansion.effect_on(value, "truncate_fields", 5)
    assert cut == {"name": "a lon", "info": {"note": "anoth", "n": 3, "deep": {"x": "abcde"}}, "list": ["stays as it is, whole"]}
    for ratio, n in ((0.0, 2), (0.5, 1), (1.0, 0)):
        assert len(expansion.effect_on(value, "remove_fields", ratio, 1)) == n
    spoilt = expansion.effect_on(value, "corrupt_values", 0.3, 1)
    assert list(spoilt) == list(value) and sum(spoilt[k] != value[k] for k in value) >= 1
    assert all(expansion.effect_on({"k": g}, "corrupt_values", 1.0, s)["k"] != g for g in (None, 99999, "", True, [], "CORRUPTED_DATA") for s in range(8))
    assert expansion.effect_on([1], "truncate_fields", 1) == [1] and expansion.effect_on({}, "remove_fields", 1) == {}
    assert expansion.effect_on_block("plain text", "truncate_fields", 5) == "plain" and expansion.effect_on_block("plain text", "remove_fields", 1) == "plain text"
    assert expansion.effect_on_block("[1, 2]", "truncate_fields", 1) == "[1, 2]" and expansion.effect_on_block(None, "truncate_fields", 1) is None


def test_sixteen_refusal_markers(spark):
    assert len(expansion.REFUSAL_MARKERS) == 16
    df = spark.createDataFrame([(f"Well, {m.upper()} do",) for m in expansion.REFUSAL_MARKERS] + [("Sure.",), (None,)], "t string")
    assert [r[0] for r in df.select(expansion.looks_refused(F.col("t"))).collect()] == [True] * 16 + [False] * 2


def test_long_chains_keep_all_ancestors(spark):
    n = 300
    chain = spark.createDataFrame([("t", str(i), str(i - 1) if i else None, i, i == 0) for i in range(n)] + [("t", "x", "y", n, False), ("t", "y", "x", n + 1, False)], "trace_id string, span_id string, parent_span_id string, span_pos int, root boolean")
    kept = hierarchy.failure_paths(chain, spark.createDataFrame([("t", str(n - 1)), ("t", "x")], "trace_id string, span_id string"))
    assert {r.span_id for r in kept.collect()} == {*map(str, range(n)), "x", "y"}
    found = {r.span_id: r.ancestor for r in hierarchy.nearest_ancestor(chain, F.col("root")).collect()}
    assert found[str(n - 1)] == "0" and found["0"] is None and found["x"] is None


def test_wide_trees_keep_the_first_below(spark):
    rows = [("t", "r", None, 0)] + [("t", f"a{i}", "r", 1 + i) for i in range(7)] + [("t", f"b{i}", f"a{i % 7}", 100 + i) for i in range(30)]
    tree = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, span_pos int")
    kept = hierarchy.failure_paths(tree, spark.createDataFrame([("t", "r")], "trace_id string, span_id string"))
    assert {r.span_id for r in kept.collect()} == {"r", *(f"a{i}" for i in range(7)), "b0", "b1", "b2"}


def test_chunks_stream_through_partitions(spark):
    sizes = [30, 10, 10, 50, 200, 5, 5, 5, 90, 1, 1, 99, 100]
    spans = spark.createDataFrame([(s, i, n) for s in ("a", "b", None) for i, n in enumerate(sizes)], "s string, i long, n long").repartition(3)
    got = {}
    for r in detection.token_chunks(spans, "s", "i", "n", max_tokens=200).collect():
        got.setdefault((r.session, r.chunk), []).append((r.slot, r.pos))
    want = detection.plan_chunks(sizes, 100)
    for s in ("a", "b", None):
        assert [[p for _, p in sorted(got[s, c])] for c in range(len(want))] == want
    assert all(sum(sizes[i] for i in c) <= 100 or len(c) == 1 for c in want) and {i for c in want for i in c} == set(range(len(sizes)))


def test_tasks_fail_alone(spark):
    cases = spark.createDataFrame([(0, "a", "s", "1"), (1, "b", "s", "x"), (2, "c", "s", None)], "case_pos long, case_name string, session_id string, input string")
    task = experiments.eval_task(after=lambda c, x: {"output": x, "trajectory": ["t"]} if x == "2" else x)(lambda c: int(c["input"]) + 1)
    got = {r.case_name: r for r in experiments.run_task(cases, task).collect()}
    assert got["a"].output == "2" and got["a"].trajectory == ["t"] and got["a"].error is None
    assert "invalid literal" in got["b"].error and got["c"].error
    with pytest.raises(ValueError):
        experiments.check_names([experiments.Evaluator("a", None), experiments.Evaluator("a", None)])
    with pytest.raises(ValueError):
        experiments.check_unique(cases.unionByName(cases), "case_name")


def test_cached_results_are_not_run_again(spark, tmp_path):
    from tracelake.sources.store import ResultCache

    cases = spark.createDataFrame([(i, f"c{i}", "s", str(i)) for i in range(4)], "case_pos long, case_name string, session_id string, input string")
    cache = ResultCache(spark, str(tmp_path / "cache"))
    assert {r.output for r in experiments.with_cache(cases.where("case_pos < 2"), cache, lambda c: "first " + c["input"]).collect()} == {"first 0", "first 1"}
    assert {r.output for r in experiments.with_cache(cases, cache, lambda c: "second " + c["input"]).collect()} == {"first 0", "first 1", "second 2", "second 3"}


def test_attacks_with_custom_targets(spark):
    def attack(case, target):
        rows = []
        for turn in range(3):
            state = target.snapshot()
            answer = target.invoke(f"{case['case_name']}{turn}")
            refused = answer.startswith("no")
            if refused:
                target.restore(state)
            rows.append({"turn": turn, "answer": answer, "refused": refused, "kept": len(target.messages)})
        return rows

    make = lambda: generation.Conversation(lambda m: "no" if m[-1].endswith("1") else f"ok {len(m)}")
    cases = spark.createDataFrame([("a",), ("b",)], "case_name string")
    out = generation.run_attacks(cases, ["case_name"], attack, make, "case_name string, turn int, answer string, refused boolean, kept int")
    assert sorted((r.case_name, r.turn, r.answer, r.kept) for r in out.collect()) == [(c, t, a, k) for c in "ab" for t, a, k in ((0, "ok 1", 2), (1, "no", 2), (2, "ok 3", 4))]
    s = generation.STRATEGIES.get("pair")
    assert generation.Strategy.from_dict(s.to_dict()) == s and s.stop == 0.8
    with pytest.raises(KeyError):
        generation.STRATEGIES.get("nothing")
    with pytest.raises(ValueError):
        generation.STRATEGIES.add("pair")(s)


def test_registered_tools_and_effects(spark):
    @generation.simulated_tool("search", {"q": "string"}, shared="web")
    def search(q):
        """Finds pages."""

    assert generation.TOOLS.get("search").description == "Finds pages." and generation.TOOLS.get("search").shared == "web"
    generation.EFFECTS.add("upper")(lambda v: {k: str(x).upper() for k, x in v.items()})
    df = spark.createDataFrame([('{"a":"x"}',), ("text",), (None,)], "t string")
    assert [r[0] for r in df.select(generation.apply_registered(F.col("t"), "upper")).collect()] == ['{"a":"X"}', "text", None]


def test_templates_have_versions():
    known = [("refusal", "basic", 1, "newer"), ("refusal", "reference", 0, "other")]
    assert judging.template("refusal", known=known) == "newer" and judging.template("refusal", 0, known=known) == judging.template("refusal")
    assert judging.template("refusal", mode="reference", known=known) == "other"
    for bad in (("refusal", 9), ("nothing", None)):
        with pytest.raises(KeyError):
            judging.template(*bad)


def test_skill_results_are_read():
    read = skills.read_result
    assert read(json.dumps({"content": [{"text": "# steps"}]})) == (False, "# steps", None)
    assert read(json.dumps({"content": "Launching skill: pdf"})) == (False, None, None)
    assert read(json.dumps({"content": "Skill 'x' not found"})) == (True, None, "Skill 'x' not found")
    assert read(json.dumps({"content": "Skill 'x' loaded\nreal body"})) == (False, "Skill 'x' loaded\nreal body", None)
    assert read(json.dumps({"status": "error", "content": "denied"})) == (True, None, "denied")
    assert read(json.dumps({"response": {"error": "no such file"}})) == (True, None, "no such file")
    assert read(json.dumps({"exit_code": 141, "output": "body"})) == (False, "body", None) and read(json.dumps({"exit_code": 2, "output": "x"}))[0]
    assert read(json.dumps({"content": json.dumps({"instructions": "inner"})})) == (False, "inner", None)
    assert read(None) == (None, None, None)


def test_skill_calls_without_ids_and_injected_texts(spark):
    items = [
        {"role": "assistant", "content": [{"name": "load_skill", "args": {"skill_name": "a"}}, {"name": "load_skill", "args": {"skill_name": "b"}}]},
        {"type": "tool_response", "content": "body a"}, {"type": "tool_response", "content": "body b"},
        {"role": "assistant", "content": [{"name": "load_skill", "args": {"skill_name": "c"}}]}, {"role": "assistant", "content": [{"name": "other", "args": {}}]}, {"type": "tool_response", "content": "not c"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "Skill", "input": {"skill": "pdf_tools"}}, {"type": "tool_use", "id": "2", "name": "Skill", "input": {"skill": "csv"}}]}},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": "Launching skill: pdf_tools"}, {"type": "tool_result", "tool_use_id": "2", "content": "Launching skill: csv"}]},
        {"role": "user", "content": "Base directory for this skill: /s/csv\ncsv text"}, {"role": "user", "content": "Base directory for this skill: /s/pdf-tools\npdf text"},
        {"type": "item.completed", "item": {"type": "command_execution", "command": "bash -lc 'cat x/SKILL.md'", "aggregated_output": "---\nname: named\n---\nsteps", "exit_code": 0}},
    ]
    df = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(items)], "session_id string, msg_pos long, item string")
    got = sorted((r.position, r.name, r.status, r.body) for r in skills.list_events(df).collect())
    assert got == sorted([
        (0, "a", "loaded", "body a"), (0, "b", "loaded", "body b"), (3, "c", "attempted", None), (6, "pdf_tools", "loaded", "Base directory for this skill: /s/pdf-tools\npdf text"),
        (6, "csv", "loaded", "Base directory for this skill: /s/csv\ncsv text"), (10, "named", "loaded", "---\nname: named\n---\nsteps")])


def test_shell_reads(spark):
    reads = {
        "cat a/SKILL.md": "a", "sudo FOO=1 time head -3 b/SKILL.md": "b", "bash -lc 'cd x; tail c/SKILL.md'": "c", 'Get-Content "d d/SKILL.md"': "d d", "cat x > e/SKILL.md": None, "sed -i s/a/b/ f/SKILL.md": None,
        "sed -n 1p g/SKILL.md": "g", "more h/SKILL.md": None, "cat data.csv; ls i/SKILL.md": None, "cat ./SKILL.md": None, "nohup /usr/bin/cat j/SKILL.md": "j", "cat k/SKILL.md | head": "k", "": None}
    df = spark.createDataFrame([(k,) for k in reads], "c string")
    assert {r.c: r.s for r in df.select("c", extraction.skill_read(F.col("c")).alias("s")).collect()} == reads


def test_variants(spark):
    df = spark.createDataFrame([('{"a":1}',), ("[1]",), ('"x"',), ("3",), ("true",), ("null",), ("plain",)], "t string")
    kinds = [r[0] for r in df.select(variants.kind(variants.parsed(F.col("t")))).collect()]
    assert kinds[:3] == ["object", "array", "string"] and kinds[4:] == ["boolean", "void", "string"]
    assert [r[0] for r in df.select(producers.tool_literal(F.when(F.col("t") == "plain", "{'a': (1, 2)}").otherwise(F.col("t")))).collect()] == ['{"a":1}', "[1]", '"x"', "3", "true", "null", '{"a":[1,2]}']


def test_spans_in_a_growing_table(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    schema = "session_id string, span_id string"
    for batch in ([("a", "1"), ("b", "2")], [("a", "3")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        sessions.span_log(spark.readStream.schema(schema).json(source), table, checkpoint).awaitTermination(60)
    assert sorted(r.span_id for r in sessions.session_spans(spark, table, "a").collect()) == ["1", "3"]


def test_diagnosis_tiers(spark):
    """A short session is analysed whole, a long one by its failing path, a longer path window by window."""
    def spans(session, n, size, parent):
        return [(session, i, "t", f"{session}{i}", parent(session, i), json.dumps({"id": f"{session}{i}", "tool": "error" if i == n - 1 else "x", "pad": "p" * size})) for i in range(n)]

    flat = lambda s, i: None
    chain = lambda s, i: f"{s}{i - 1}" if i else None
    rows = spans("a", 4, 5, flat) + spans("b", 40, 60, flat) + spans("c", 40, 60, chain)
    df = spark.createDataFrame(rows, "session string, pos long, trace_id string, span_id string, parent_span_id string, text string")
    seen = []

    def detector(prompts):
        ids = F.regexp_extract_all("prompt", F.lit(r'\{"id": "(\w+)", "tool": "error"'), 1)
        items = F.transform(ids, lambda i: F.concat(F.lit('{"location":"'), i, F.lit('","category":["c"],"confidence":["low"],"evidence":["e"]}')))
        return prompts.withColumn("response", F.concat(F.lit('{"errors":['), F.array_join(items, ","), F.lit("]}")))

    def analyst(prompts):
        seen.append(sorted(r[0] for r in prompts.select("session").collect()))
        return prompts.withColumn("response", F.lit('{"root_causes":[{"failure_span_id":"f","fix_recommendation":{"fix_type":"t","recommendation":"r"}}]}'))

    def merger(prompts):
        return prompts.withColumn("response", F.concat(F.lit('{"root_causes":[{"failure_span_id":"merged ' ), F.size(F.split("prompt", "\n")).cast("string"), F.lit('"}]}')))

    out = {r.session: r for r in diagnosis.diagnose(df, detector, analyst, merger, max_tokens=1000).collect()}
    assert all(r.n_failures == 1 for r in out.values())
    assert out["a"].root_causes[0].failure_span_id == "f" and out["b"].root_causes[0].failure_span_id == "f" and out["c"].root_causes[0].failure_span_id == "merged 4"
    assert ["c", "c", "c", "c"] in seen and ["a", "b"] in seen and out["a"].recommendations == ["r"]
