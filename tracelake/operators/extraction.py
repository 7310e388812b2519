"""Evaluation inputs at three levels from normalized spans, and tool calls and skills from message histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import hierarchy, history

# --- levels ----------------------------------------------------------------------------------------------------------


def history_events(spans: DataFrame) -> DataFrame:
    """User text, tool calls and answer of every turn in order: session_id, trace_seq, event_seq, owner, event, text.

    ``spans`` are normalized, with trace_seq and, for tools, the owner's span id in ``owner``.
    """
    agents = spans.where("span_type = 'invoke_agent'")
    pick = lambda df, event, text, rank, owner: df.select(
        "session_id", "trace_seq", F.col(owner).alias("owner"), F.lit(event).alias("event"), F.col(text).alias("text"), F.lit(rank).alias("rank"), "span_pos", F.col("span_id").alias("event_span"))
    rows = pick(agents, "user", "user_prompt", 0, "span_id").unionByName(pick(spans.where("span_type = 'execute_tool'"), "tool", "tool_name", 1, "owner")).unionByName(pick(agents, "assistant", "agent_response", 2, "span_id"))
    w = Window.partitionBy("session_id").orderBy("trace_seq", "rank", "span_pos")
    return rows.withColumn("event_seq", F.row_number().over(w)).drop("rank")


def trace_inputs(spans: DataFrame) -> DataFrame:
    """One row per agent span: the events of earlier traces, then this turn's user text and the tools it owns."""
    events = history_events(spans)
    entry = F.struct("event_seq", "event", "text")
    past = events.groupBy("session_id", "trace_seq").agg(F.array_sort(F.collect_list(entry)).alias("own"))
    w = Window.partitionBy("session_id").orderBy("trace_seq").rowsBetween(Window.unboundedPreceding, -1)
    past = past.withColumn("before", F.flatten(F.collect_list("own").over(w))).drop("own")
    now = events.where("event <> 'assistant'").groupBy("session_id", "trace_seq", "owner").agg(F.array_sort(F.collect_list(entry)).alias("now"))
    agents = spans.where("span_type = 'invoke_agent'").select("session_id", "trace_seq", "trace_id", F.col("span_id").alias("owner"), "agent_response", "span_pos")
    out = agents.join(now, ["session_id", "trace_seq", "owner"], "left").join(past, ["session_id", "trace_seq"], "left")
    return out.select("session_id", "trace_id", F.col("owner").alias("span_id"), F.concat("before", F.coalesce("now", F.array().cast("array<struct<event_seq:int,event:string,text:string>>"))).alias("session_history"), "agent_response", "span_pos")


def trace_summaries(spans: DataFrame) -> DataFrame:
    """One row per trace: prompt, response and tools of its root agent, the number of its agents and tool spans, and the
    number of history entries that it leaves: a message for a prompt and for an answer, one list for all tool calls.
    ``spans`` have trace_seq, has_content, start, and available_tools (an array) besides the usual columns."""
    agents = spans.where("span_type = 'invoke_agent'").withColumn("trace_id", F.concat_ws("/", "session_id", "trace_seq"))
    roots = hierarchy.root_span(agents).select("session_id", "trace_seq", F.col("user_prompt").alias("root_prompt"), F.col("agent_response").alias("root_response"), F.col("available_tools").alias("root_tools"))
    is_tool = F.col("span_type") == "execute_tool"
    counts = spans.groupBy("session_id", "trace_seq").agg(F.count_if(is_tool).alias("n_tools"), F.count_if(F.col("span_type") == "invoke_agent").alias("n_agents"))
    out = counts.join(roots, ["session_id", "trace_seq"], "left")
    said = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int")
    return out.withColumns({"entries": said("root_prompt") + (F.col("n_tools") > 0).cast("int") + said("root_response"), "has_prompt": said("root_prompt")})


def tool_inputs(spans: DataFrame) -> DataFrame:
    """One row per tool span: how many history entries it sees (those of earlier traces, then the root agent's prompt of
    its own), how many calls of its own trace ended before it began, and its tools. Those are the last that a root agent
    had so far; where a trace has several agents, those of the span's owner, or none.

    History is given by its length and by ``history_before``, the number of entries of earlier traces, so that no row
    carries the session; ``tool_histories`` spells it out for rows that reach a judge. Columns besides those of
    ``trace_summaries``: span_pos, start, end, owner.
    """
    t = trace_summaries(spans)
    w = Window.partitionBy("session_id").orderBy("trace_seq")
    known = F.last(F.when(F.size("root_tools") > 0, F.col("root_tools")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("entries").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumns({"known_tools": known, "history_before": before}).select("session_id", "trace_seq", "n_agents", "has_prompt", "known_tools", "history_before")
    tools = spans.where("span_type = 'execute_tool'")
    timed = tools.withColumn("pos", F.row_number().over(Window.partitionBy("session_id", "trace_seq").orderBy("span_pos")))
    prior = history.prior_executions(timed, ["session_id", "trace_seq"])
    rows = timed.join(prior, ["session_id", "trace_seq", "pos"]).join(t, ["session_id", "trace_seq"])
    owners = spans.where("span_type = 'invoke_agent'").select("session_id", "trace_seq", F.col("span_id").alias("owner"), F.col("available_tools").alias("own_tools"))
    rows = rows.drop("available_tools").join(owners, ["session_id", "trace_seq", "owner"], "left")
    none = F.array().cast("array<string>")
    several = F.col("owner").isNotNull() & (F.col("n_agents") > 1)
    own = F.coalesce(F.when(F.size("own_tools") > 0, F.col("own_tools")), none)
    position = F.row_number().over(Window.partitionBy("session_id").orderBy("trace_seq", "span_pos")) - 1
    return rows.withColumns({
        "available_tools": F.when(several, own).otherwise(F.coalesce("known_tools", none)), "position": position,
        "history_size": F.col("history_before") + F.col("has_prompt") + (F.col("prior") > 0).cast("int")})


def tool_histories(inputs: DataFrame, spans: DataFrame) -> DataFrame:
    """``inputs`` (rows of ``tool_inputs``, few enough to be judged) with ``session_history``: the entries of earlier traces
    and the own prompt, as (trace_seq, rank, event, texts)."""
    t = trace_summaries(spans)
    calls = spans.where("span_type = 'execute_tool'").groupBy("session_id", "trace_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("span_pos", "tool_name"))), lambda x: x["tool_name"]).alias("calls"))
    told = t.join(calls, ["session_id", "trace_seq"], "left")
    entry = lambda rank, event, texts, there: F.when(there, F.struct("trace_seq", F.lit(rank).alias("rank"), F.lit(event).alias("event"), texts.alias("texts")))
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = F.array_compact(F.array(
        entry(0, "user", F.array("root_prompt"), said("root_prompt")), entry(1, "tools", F.col("calls"), F.col("n_tools") > 0), entry(2, "assistant", F.array("root_response"), said("root_response"))))
    events = told.select("session_id", F.explode(rows).alias("e"))
    wanted = inputs.select("session_id", "span_id", "trace_seq").join(events, "session_id")
    seen = wanted.where((F.col("e.trace_seq") < F.col("trace_seq")) | ((F.col("e.trace_seq") == F.col("trace_seq")) & (F.col("e.rank") == 0)))
    listed = seen.groupBy("session_id", "span_id").agg(F.array_sort(F.collect_list("e")).alias("session_history"))
    return inputs.join(listed, ["session_id", "span_id"], "left")


def session_inputs(spans: DataFrame) -> DataFrame:
    """One row per session: a context per agent span with all tool calls of its trace; ``error`` without agent spans."""
    tools = spans.where("span_type = 'execute_tool'").groupBy("session_id", "trace_seq").agg(F.array_sort(F.collect_list(F.struct("span_pos", "tool_name", "tool_arguments", "tool_result", "tool_error"))).alias("tools"))
    agents = spans.where("span_type = 'invoke_agent'").join(tools, ["session_id", "trace_seq"], "left")
    context = F.struct("trace_seq", "span_pos", "user_prompt", "agent_response", "tools")
    found = agents.groupBy("session_id").agg(F.array_sort(F.collect_list(context)).alias("contexts"))
    return spans.select("session_id").distinct().join(found, "session_id", "left").withColumn("error", F.when(F.col("contexts").isNull(), "no agent span"))


def user_prompt(history: Column) -> Column:
    """The last entry's text if it is a message, else nothing: a turn that used tools has no prompt at its end."""
    last = F.try_element_at(history, F.lit(-1))
    return F.when(last["event"] != "tool", last["text"]).otherwise("")


# --- message histories -------------------------------------------------------------------------------------------------

BLOCKS = "array<struct<text:string,toolUse:struct<name:string,toolUseId:string,input:variant>,toolResult:struct<toolUseId:string,status:string,content:array<struct<text:string>>>>>"


def message_blocks(messages: DataFrame) -> DataFrame:
    """(session_id, msg_pos, block_pos, role, block) of messages whose content is a JSON list of blocks."""
    return messages.select("session_id", "msg_pos", "role", F.posexplode(F.from_json("content", BLOCKS)).alias("block_pos", "block"))


def tools_used(messages: DataFrame) -> DataFrame:
    """Each tool call with the first later result of its id: name, input, result text, is_error; a miss is null."""
    b = message_blocks(messages)
    calls = b.where("role = 'assistant' and block.toolUse is not null").select("session_id", "msg_pos", "block_pos", F.col("block.toolUse.name").alias("name"), F.col("block.toolUse.toolUseId").alias("call_id"), F.to_json("block.toolUse.input").alias("input"))
    results = b.where("role = 'user' and block.toolResult is not null").select(
        "session_id", F.col("msg_pos").alias("at"), F.col("block_pos").alias("at_block"), F.col("block.toolResult.toolUseId").alias("call_id"), F.col("block.toolResult.status").alias("status"),
        F.try_element_at(F.filter("block.toolResult.content", lambda c: c["text"].isNotNull()), F.lit(1))["text"].alias("tool_result"))
    joined = calls.join(results, ["session_id", "call_id"], "left").withColumn("later", F.col("at") > F.col("msg_pos"))
    first = F.min(F.when(F.col("later"), F.struct("at", "at_block", "tool_result", "status"))).alias("r")
    out = joined.groupBy("session_id", "msg_pos", "block_pos", "name", "call_id", "input").agg(first)
    return out.select("session_id", "msg_pos", "block_pos", "name", "call_id", "input", F.col("r.tool_result").alias("tool_result"), (F.col("r.status") == "error").alias("is_error"))


# --- skills ----------------------------------------------------------------------------------------------------------

#: Catalogues of skills in prompts, the paths of skill files, and how shells are wrapped (formats, fixed values).
SKILL_BLOCK = r"(?si)<available_skills>(.*?)</available_skills>"
SKILL_ITEM = r"(?si)<skill>(.*?)</skill>"
SKILL_MARKDOWN = r"(?sim)^### Available skills\s*$\n(.*?)(?=^###\s|\z)"
SKILL_MARKDOWN_ITEM = r"(?m)^\s*-\s+[^:\n]+:\s*.*?\s*$"
SKILL_PATH_TEXT = r"""(?i)"([^"\n]*SKILL\.md)"|'([^'\n]*SKILL\.md)'|([^\s"'=;|<>]*SKILL\.md)"""
SHELL_WRAPPER = r"""(?s)^\s*(?:\S*/)?(?:ba|da|k|z)?sh\s+(?:-\w+\s+)*(['"])(.*)\1\s*$"""
SHELL_SEPARATOR = r"\|\||&&|[;|\n]"
SHELL_PREFIX = r"(?i)^(?:(?:sudo|env|command|time|nohup|\S+=\S*)\s+)+"
SED_IN_PLACE = r"(?:^|\s)(?:-i\S*|--in-place\b)"
READ_VERBS = ("cat", "sed", "head", "tail", "bat", "less", "type", "get-content")


def canonical(name: Column) -> Column:
    """The form in which skill names are compared: lower case, hyphens, the last part of a path."""
    return F.translate(F.lower(F.trim(F.element_at(F.split(name, "/"), -1))), "_ ", "--")


def _unescaped(text: Column) -> Column:
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def catalogue_items(text: Column) -> Column:
    """(name, description) of the skills that a prompt lists, as an array: those of a marked-up block, whatever it holds,
    else those of a Markdown section. Entries without a name are left out; file locators go from descriptions."""
    block = F.regexp_extract(text, SKILL_BLOCK, 1)
    field = lambda x, n: F.trim(F.regexp_extract(x, f"(?si)<{n}>(.*?)</{n}>", 1))
    item = lambda name, said: F.struct(name.alias("name"), said.alias("description"))
    marked = F.filter(F.regexp_extract_all(block, F.lit(SKILL_ITEM), 1), lambda x: x.rlike("(?si)<name>.*?</name>"))
    marked = F.transform(marked, lambda x: item(_unescaped(field(x, "name")), _unescaped(field(x, "description"))))
    lines = F.regexp_extract_all(F.regexp_extract(text, SKILL_MARKDOWN, 1), F.lit(SKILL_MARKDOWN_ITEM), 0)
    part = lambda x, i: F.trim(F.regexp_extract(x, r"(?s)^\s*-\s+([^:\n]+):\s*(.*?)\s*$", i))
    plain = F.transform(lines, lambda x: item(part(x, 1), F.trim(F.regexp_replace(part(x, 2), r"(?i)\s+\(file:\s*.+?\)\s*$", ""))))
    return F.filter(F.when(text.rlike(SKILL_BLOCK), marked).otherwise(plain), lambda x: x["name"] != "")


def available_skills(prompts: DataFrame) -> DataFrame:
    """(session_id, pos, name, description) of the first system prompt that lists any. prompts: session_id, pos, text."""
    found = prompts.withColumn("items", catalogue_items(F.col("text"))).where("size(items) > 0")
    first = found.groupBy("session_id").agg(F.min_by("items", "pos").alias("items"))
    return first.select("session_id", F.posexplode("items").alias("pos", "x")).select("session_id", "pos", "x.name", "x.description")


def advertised(prompts: DataFrame) -> DataFrame:
    """Whether any prompt holds a catalogue at all, empty or not, in either form."""
    there = F.col("text").rlike(SKILL_BLOCK) | F.col("text").rlike(SKILL_MARKDOWN)
    return prompts.groupBy("session_id").agg(F.coalesce(F.bool_or(there), F.lit(False)).alias("advertised"))


def skill_path(text: Column) -> Column:
    """The first path of a skill file in a text, in quotes or not; null without one."""
    group = lambda i: F.nullif(F.regexp_extract(text, SKILL_PATH_TEXT, i), F.lit(""))
    return F.coalesce(group(1), group(2), group(3))


def shell_read(command: Column) -> Column:
    """The path of the skill file that a shell command reads, or null. A wrapper's inner command counts, command by
    command; what only is written to, edited in place, or named by another command is not read."""
    inner = F.when(command.rlike(SHELL_WRAPPER), F.regexp_extract(command, SHELL_WRAPPER, 2)).otherwise(command)
    heads = F.transform(F.split(inner, SHELL_SEPARATOR), lambda p: F.regexp_replace(F.ltrim(F.element_at(F.split(p, ">"), 1)), SHELL_PREFIX, ""))
    verb = lambda h: F.lower(F.element_at(F.split(F.element_at(F.split(h, r"\s+"), 1), "/"), -1))
    reads = F.filter(heads, lambda h: verb(h).isin(*READ_VERBS) & ~((verb(h) == "sed") & h.rlike(SED_IN_PLACE)))
    paths = F.filter(F.transform(reads, lambda h: skill_path(F.regexp_replace(h, r"^\S+", ""))), lambda p: p.isNotNull())
    return F.try_element_at(paths, F.lit(1))


def skill_read(command: Column) -> Column:
    """The name of the skill whose file a shell command reads: the file's directory, or null."""
    parent = F.try_element_at(F.split(F.translate(shell_read(command), "\\", "/"), "/"), F.lit(-2))
    return F.when(~parent.isin("", ".", ".."), parent)


def skill_events(tool_spans: DataFrame, skill_tools: tuple[str, ...] = ("skill", "load_skill", "skills")) -> DataFrame:
    """Loads of skills among a session's tool spans: a call of a skill tool, loaded or failed, or a read of its file.
    ``position`` counts all tool spans of the session."""
    w = Window.partitionBy("session_id").orderBy("trace_seq", "span_pos")
    args = lambda k: F.get_json_object("tool_arguments", f"$.{k}")
    reserved = F.lower("tool_name").isin(*skill_tools)
    asked = F.coalesce(args("skill"), args("skill_name"), args("name"))
    read = skill_read(F.coalesce(args("command"), args("cmd"), F.concat(F.lit("cat "), F.coalesce(args("path"), args("file_path")))))
    failed = F.col("tool_error").isNotNull() | F.coalesce(F.col("tool_result").rlike(r"(?i)^(?:error|unknown skill|skill .* not found)"), F.lit(False))
    numbered = tool_spans.withColumn("position", F.row_number().over(w) - 1)
    out = numbered.withColumn("skill_name", F.when(reserved, asked).when(~failed, read)).where("skill_name is not null")
    return out.select("session_id", F.col("skill_name").alias("name"), F.when(reserved & failed, "failed").otherwise("loaded").alias("status"), F.when(~failed, F.col("tool_result")).alias("body"),
                      F.when(failed, F.coalesce("tool_error", "tool_result")).alias("error"), "position")


def invoked_skills(events: DataFrame) -> DataFrame:
    """One row per canonical name in the order of first attempts: success beats failure, and a fuller body replaces the
    kept one only if it contains it."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", "status", "body", "error")))
    g = events.groupBy("session_id", canonical(F.col("name")).alias("canonical_name")).agg(ordered.alias("e"), F.min("position").alias("first_position"))
    loaded = F.filter("e", lambda x: x["status"] == "loaded")
    body = F.aggregate(loaded, F.lit(None).cast("string"), lambda kept, x: F.when(kept.isNull() | (F.contains(x["body"], kept) & (F.length(x["body"]) > F.length(kept))), x["body"]).otherwise(kept))
    ok = F.size(loaded) > 0
    return g.select("session_id", F.when(ok, loaded[0]["name"]).otherwise(F.col("e")[0]["name"]).alias("name"), "canonical_name", F.when(ok, "loaded").otherwise(F.col("e")[0]["status"]).alias("status"),
                    body.alias("body"), F.when(~ok, F.element_at("e", -1)["error"]).alias("error"), "first_position")


def skill_invoked(events: DataFrame, sessions: DataFrame, skill: str) -> DataFrame:
    """Whether a session loaded exactly this skill, with the reason."""
    mine = F.col("name") == skill
    g = events.groupBy("session_id").agg(F.bool_or(mine & (F.col("status") == "loaded")).alias("hit"), F.count_if(mine).alias("tries"), F.min_by("error", F.when(mine, F.col("position"))).alias("error"), F.count("*").alias("n"))
    out = sessions.select("session_id").distinct().join(g, "session_id", "left")
    reason = F.when(F.col("n").isNull(), "no skill was invoked").when(F.col("hit"), F.lit(f"skill '{skill}' was invoked")).when(F.col("tries") > 0, F.format_string(f"skill '{skill}' failed in %d attempts: %s", "tries", F.coalesce("error", F.lit("unknown")))).otherwise(f"skill '{skill}' was not among those invoked")
    return out.select("session_id", F.coalesce("hit", F.lit(False)).cast("double").alias("score"), F.coalesce("hit", F.lit(False)).alias("test_pass"), reason.alias("reason"))
