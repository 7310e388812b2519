"""Skill loads in message histories: blocks of any harness, their calls and results, and the loads they tell of.

Messages are JSON texts (session_id, msg_pos, item). Blocks, calls and result pairs are expressions, windows and joins
by session; only the interpretation of a result, which nests to any depth, runs in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.extraction import catalogue_items, shell_read

#: Tools that load skills, and the argument that names one (fixed values).
SKILL_TOOLS = {"skills": "skill_name", "Skill": "skill", "load_skill": "skill_name", "activate_skill": "name", "invoke_skill": "name"}
#: Tools that read files, run commands, and list skills (fixed values).
READ_TOOLS = ("read", "read_file", "file_read", "filesystem_read", "read_text_file")
SHELL_TOOLS = ("bash", "shell", "terminal", "command", "execute_command", "exec_command", "run_command")
DISCOVERY_TOOLS = ("list_skills", "search_skills")
#: Block types that stand alone as messages; keys and types that name a block's harness (fixed values).
ALONE = ("tool_response", "function_response", "function_call", "function_call_output")
BLOCK_TYPES = ("tool_use", "tool_result", "text", "command_execution", "function_call", "function_call_output")
TAGS = ("toolUse", "functionCall", "function_call", "content_type", "tool_name", "kind")
#: Statuses of failures, and exit codes that leave usable output (fixed values).
FAILED = ("error", "errored", "fail", "failed", "failure", "cancelled", "canceled")
FINE_EXITS = (None, 0, "0", 141, "141")
#: Where a result's text stands, in this order (fixed values).
TEXT_KEYS = ("instructions", "llmContent", "content", "output", "aggregated_output", "text", "response", "result")
#: Lines that tell of a load, and of a refused one; the preamble of a command's output (formats, fixed values).
ACKNOWLEDGED = re.compile(
    r"""(?:(?:launching|loading|activating|loaded|activated)\s+skill|skill\s+(?:'[^']*'|"[^"]*"|[\w.-]+)?[ \t]*(?:activated|loaded|launched))\b(?:[ \t]*[:.]?[^\n]*)?""",
    re.I,
)
REFUSED = re.compile(
    r"""(?:error\s*:\s*skill_name\s+is\s+required|skill\s+(?:'[^']*'|"[^"]*"|[\w.-]+)\s+(?:was\s+|is\s+)?not\s+found|(?:unknown|unrecognized)\s+skill\b|no\s+such\s+skill\b)[ \t]*[:.]?[^\n]*""",
    re.I,
)
PREAMBLE = re.compile(r"\A((?:[A-Za-z][A-Za-z ]*:.*\n|Process exited with code\s+-?\d+\n)*?)Output:\n(.*)\Z", re.S)
EXIT_LINE = re.compile(r"^Process exited with code\s+(-?\d+)\s*$", re.M)
BASE_DIRECTORY = r"(?i)^\s*Base directory for this skill:\s*(\S+)"


# --- blocks ----------------------------------------------------------------------------------------------------------


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _object(**fields: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))))


def blocks(messages: DataFrame) -> DataFrame:
    """(session_id, msg_pos, block_pos, role, block): the content blocks of plain messages, of wrapped ones, of event
    streams and of parts; a text counts as a text block. What is no object is left out."""
    m = messages.select("session_id", "msg_pos", F.try_parse_json("item").alias("v")).where(_is(F.col("v"), "OBJECT"))
    v = F.col("v")
    inner = _get(v, "$.message", "variant")
    m = m.withColumn("message", F.when(_is(inner, "OBJECT"), inner).otherwise(v))
    message, item = F.col("message"), _get(v, "$.item", "variant")
    content = F.coalesce(_get(message, "$.content", "variant"), _get(message, "$.parts", "variant"))
    alone = _get(v, "$.type").isin(*ALONE) | F.startswith(_get(v, "$.kind"), F.lit("InvokeSkill"))
    event = (_get(v, "$.type") == "item.completed") & _is(item, "OBJECT")
    shaped = _get(message, "$.type").isin(*BLOCK_TYPES) | F.startswith(_get(message, "$.kind"), F.lit("InvokeSkill"))
    for key in ("toolUse", "toolResult", "tool_name"):
        shaped = F.coalesce(shaped, F.lit(False)) | _get(message, f"$.{key}", "variant").isNotNull()
    shaped = shaped | (_get(message, "$.name", "variant").isNotNull() & _get(message, "$.args", "variant").isNotNull())
    listed = F.filter(_get(content, "$", "array<variant>"), lambda b: _is(b, "OBJECT"))
    found = (
        F.when(event, F.array(item)).when(alone, F.array(v)).when(_is(content, "ARRAY"), listed).when(_is(content, "OBJECT"), F.array(content))
        .when(_is(content, "STRING"), F.array(_object(type=F.lit("text"), text=_get(content, "$")))).when(shaped, F.array(message))
    )
    role = F.when(~F.coalesce(event | alone, F.lit(False)), F.coalesce(_get(message, "$.role"), _get(v, "$.role")))
    return m.select("session_id", "msg_pos", role.alias("role"), F.posexplode(found).alias("block_pos", "block"))


def _call(call_id: Column, name: Column, arguments: Column, fits: Column) -> Column:
    usable = F.coalesce(fits, F.lit(False)) & _is(name, "STRING") & _is(arguments, "OBJECT")
    return F.when(usable, F.struct(call_id.alias("call_id"), _get(name, "$").alias("name"), arguments.alias("arguments")))


def tool_call(b: Column) -> Column:
    """The call of a block, or null: the first shape that fits with a name and an object of arguments. A shape without a
    harness's mark counts only on blocks that have none."""
    get = lambda p: _get(b, p, "variant")
    text = lambda *paths: F.coalesce(*(_get(b, p) for p in paths))
    kind = _get(b, "$.type")
    wrapped = F.when(_is(get("$.functionCall"), "OBJECT"), get("$.functionCall")).otherwise(get("$.function_call"))
    decoded = F.try_parse_json(_get(b, "$.arguments"))
    tagged = F.lit(False)
    for key in TAGS:
        tagged = tagged | get(f"$.{key}").isNotNull()
    tagged = tagged | F.coalesce(kind.isin("tool_use", "function_call"), F.lit(False))
    coded = F.when(_is(get("$.arguments"), "OBJECT"), get("$.arguments")).when(_is(decoded, "OBJECT"), decoded).otherwise(F.parse_json(F.lit("{}")))
    return F.coalesce(
        _call(_get(b, "$.toolUse.toolUseId"), get("$.toolUse.name"), get("$.toolUse.input"), _is(get("$.toolUse"), "OBJECT")),
        _call(_get(wrapped, "$.id"), _get(wrapped, "$.name", "variant"), _get(wrapped, "$.args", "variant"), _is(wrapped, "OBJECT")),
        _call(text("$.tool_call_id"), get("$.name"), get("$.arguments"), _get(b, "$.content_type") == "tool_use"),
        _call(text("$.id", "$.tool_use_id"), get("$.name"), get("$.input"), kind == "tool_use"),
        _call(text("$.call_id", "$.id"), get("$.name"), coded, kind == "function_call"),
        _call(text("$.id"), get("$.tool_name"), get("$.parameters"), _get(b, "$.tool_name") != ""),
        _call(text("$.id"), get("$.name"), get("$.args"), ~tagged),
        _call(text("$.tool_call_id", "$.id"), F.parse_json(F.lit('"invoke_skill"')), _object(name=_get(b, "$.name")), _get(b, "$.kind") == "InvokeSkillAction"),
    )


def tool_result(b: Column) -> Column:
    """(call_id, payload) of a block that carries a result, or null; the payload is JSON text."""
    get = lambda p: _get(b, p, "variant")
    text = lambda *paths: F.coalesce(*(_get(b, p) for p in paths))
    kind = _get(b, "$.type")
    wrapped = F.when(_is(get("$.functionResponse"), "OBJECT"), get("$.functionResponse")).otherwise(get("$.function_response"))
    made = lambda fits, call_id, payload: F.when(F.coalesce(fits, F.lit(False)), F.struct(call_id.alias("call_id"), F.to_json(payload).alias("payload")))
    return F.coalesce(
        made(_is(get("$.toolResult"), "OBJECT"), _get(b, "$.toolResult.toolUseId"), get("$.toolResult")),
        made(_is(wrapped, "OBJECT"), _get(wrapped, "$.id"), wrapped),
        made(_get(b, "$.content_type") == "tool_result", text("$.tool_call_id"), b),
        made(kind == "tool_result", text("$.tool_use_id", "$.id"), b),
        made(kind == "function_call_output", text("$.call_id", "$.id"), _object(coded=_get(b, "$.output"), output=F.to_json(get("$.output")))),
        made(kind.isin("tool_response", "function_response"), text("$.tool_use_id", "$.id"), b),
        made(_get(b, "$.kind") == "InvokeSkillObservation", text("$.tool_call_id", "$.id"), b),
    )


# --- results ---------------------------------------------------------------------------------------------------------


def content_text(value: Any) -> str:
    """The text of a result: itself, the lines of a list, or the first of the known fields that has any."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(content_text, value) if t)
    if isinstance(value, dict):
        return next((t for k in TEXT_KEYS if k in value and (t := content_text(value[k]))), "")
    return ""


def result_failed(value: Any) -> bool:
    if not isinstance(value, dict):
        return False
    if str(value.get("status", "")).casefold() in FAILED or value.get("is_error") is True or value.get("error") not in (None, "", False) or value.get("exit_code") not in FINE_EXITS:
        return True
    return any(result_failed(value[k]) for k in ("response", "result") if isinstance(value.get(k), dict))


def _error_of(value: Any) -> str | None:
    if not isinstance(value, dict):
        return None
    own = value.get("error")
    if isinstance(own, str) and own.strip():
        return own.strip()
    return next((e for k in ("response", "result") if k in value and (e := _error_of(value[k])) is not None), None)


def _body_of(value: Any) -> str | None:
    text = "" if result_failed(value) else content_text(value).strip()
    if not text or ACKNOWLEDGED.fullmatch(text) or REFUSED.fullmatch(text):
        return None
    if text[0] in "{[":  # structured results are sometimes encoded once more
        try:
            inner = json.loads(text)
        except ValueError:
            return text
        return text if inner == value else _body_of(inner)
    return text


def read_result(payload: str | None) -> tuple[bool | None, str | None, str | None]:
    """(refused, body, error) of a result's payload; a command's preamble gives its exit code and is cut off."""
    if payload is None:
        return None, None, None
    value = json.loads(payload)
    if isinstance(value, dict) and "output" in value and set(value) <= {"coded", "output"}:
        coded = value.get("coded")
        if (m := PREAMBLE.match(coded or "")) is not None:
            code = EXIT_LINE.search(m[1])
            value = {"output": m[2], **({"exit_code": int(code[1])} if code else {})}
        else:
            value = {"output": json.loads(value["output"]) if coded is None else coded}
    text = content_text(value).strip()
    refused = result_failed(value) or REFUSED.fullmatch(text) is not None
    return refused, _body_of(value), (_error_of(value) or text or None) if refused else None


def interpreted(payload: Column | str) -> Column:
    """``read_result`` over a column, in Arrow batches."""

    @F.pandas_udf("refused boolean, body string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_result(p) for p in texts], columns=["refused", "body", "error"]).astype(object)

    return run(payload)


# --- events ----------------------------------------------------------------------------------------------------------


def frontmatter_name(body: Column) -> Column:
    """The name in a skill file's front matter, or null."""
    head = F.regexp_extract(body, r"(?s)\A---\s*\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(head, r"""(?m)^name:\s*["']?([^"'\n]+?)["']?\s*$""", 1)), F.lit(""))


def directory_name(path: Column) -> Column:
    """The directory of a skill file, or null where it names none."""
    parent = F.try_element_at(F.split(F.translate(path, "\\", "/"), "/"), F.lit(-2))
    return F.when(~parent.isin("", ".", ".."), parent)


def canonical(name: Column) -> Column:
    """Lower case, with hyphens for underscores."""
    return F.translate(F.lower(name), "_", "-")


def _first_after(session: str, fits: Column, value: Column) -> Column:
    w = Window.partitionBy(session).orderBy("msg_pos").rangeBetween(1, Window.unboundedFollowing)
    return F.first(F.when(fits, value), ignorenulls=True).over(w)


def paired_calls(messages: DataFrame) -> DataFrame:
    """Calls with their results: session_id, msg_pos, block_pos, call_id, name, arguments, and matched, refused, body,
    error. A call with an id takes the last result of that id, wherever it stands. One without takes the first result
    without an id in the messages after it and before the message of the next call."""
    b = blocks(messages)
    b = b.withColumns({"call": tool_call(F.col("block")), "result": tool_result(F.col("block"))})
    b = b.withColumns({"is_call": F.col("call").isNotNull(), "loose": F.col("result").isNotNull() & F.col("result.call_id").isNull()})
    b = b.withColumn("next_call", _first_after("session_id", F.col("is_call"), F.col("msg_pos")))
    # the messages with such results, numbered: the nth such call of a message takes the nth of them that follows
    first = F.min(F.when(F.col("loose"), F.struct("block_pos", "result.payload")))
    numbers = Window.partitionBy("session_id").orderBy("at")
    loose = b.where("loose").groupBy("session_id", F.col("msg_pos").alias("at")).agg(first.alias("x")).select(
        "session_id", "at", F.row_number().over(numbers).alias("nth"), F.col("x.payload").alias("later"))
    starts = b.withColumn("lead", F.row_number().over(Window.partitionBy("session_id", "msg_pos").orderBy(~F.col("loose"), "block_pos")) == 1)
    upto = Window.partitionBy("session_id").orderBy("msg_pos").rangeBetween(Window.unboundedPreceding, 0)
    counted = starts.withColumn("passed", F.sum((F.col("loose") & F.col("lead")).cast("int")).over(upto))
    bare = F.col("call.call_id").isNull()
    mine = F.sum(bare.cast("int")).over(Window.partitionBy("session_id", "msg_pos").orderBy("block_pos"))
    calls = counted.where("is_call").withColumn("nth", F.when(bare, F.col("passed") + mine)).join(loose, ["session_id", "nth"], "left")
    later = F.when(F.col("next_call").isNull() | (F.col("at") < F.col("next_call")), F.col("later"))
    calls = calls.select("session_id", "msg_pos", "block_pos", "call.call_id", "call.name", "call.arguments", later.alias("later"))
    keyed = b.where("result.call_id is not null").groupBy("session_id", F.col("result.call_id").alias("call_id")).agg(
        F.max_by("result.payload", F.struct("msg_pos", "block_pos")).alias("keyed"))
    joined = calls.join(keyed, ["session_id", "call_id"], "left").withColumn("payload", F.coalesce("keyed", "later"))
    read = joined.withColumn("r", interpreted("payload"))
    return read.select("session_id", "msg_pos", "block_pos", "call_id", "name", "arguments", F.col("payload").isNotNull().alias("matched"), "r.refused", "r.body", "r.error")


def injected_bodies(messages: DataFrame) -> DataFrame:
    """(session_id, at, directory, text) of user messages that carry a skill's text under its directory's name."""
    b = blocks(messages).where("role is null or role = 'user'")
    text = _get(F.col("block"), "$.text")
    found = b.select("session_id", F.col("msg_pos").alias("at"), F.col("block_pos").alias("at_block"), text.alias("text"))
    path = F.regexp_extract("text", BASE_DIRECTORY, 1)
    return found.where(path != "").withColumn("directory", F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1))


def list_events(messages: DataFrame) -> DataFrame:
    """Loads of skills in message histories: session_id, position, name, status (attempted, loaded or failed), body,
    error, call_id."""
    calls = paired_calls(messages)
    argument = lambda k: _get(F.col("arguments"), f"$.{k}")
    asked = F.lit(None).cast("string")
    for tool, key in SKILL_TOOLS.items():
        asked = F.when(F.col("name") == tool, argument(key)).otherwise(asked)
    asked = F.when(F.endswith(F.lower("name"), F.lit("_load_skill")) & ~F.col("name").isin(*SKILL_TOOLS), argument("skill_name")).otherwise(asked)
    path = F.coalesce(argument("path"), argument("file_path"), argument("filePath"), argument("absolute_path"))
    tool = F.lower("name")
    read = F.when(tool.isin(*READ_TOOLS) & path.rlike(r"(?i)SKILL\.md$"), path).when(tool.isin(*SHELL_TOOLS), shell_read(F.coalesce(argument("command"), argument("cmd"))))
    marked = calls.withColumns({"asked": F.nullif(asked, F.lit("")), "read": read})
    # texts that were injected after a launch: by directory, else the only one there is
    launched = marked.where("name = 'Skill' and asked is not null and body is null and not coalesce(refused, false)").select("session_id", "msg_pos", "block_pos", "asked")
    texts = launched.join(injected_bodies(messages), "session_id").where("at > msg_pos")
    same = canonical(F.col("directory")) == canonical(F.col("asked"))
    order = F.struct("at", "at_block")
    texts = texts.groupBy("session_id", "msg_pos", "block_pos").agg(F.min_by("text", F.when(same, order)).alias("named"), F.min_by("text", order).alias("only"), F.count("*").alias("n"))
    injected = texts.select("session_id", "msg_pos", "block_pos", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("injected"))
    m = marked.join(injected, ["session_id", "msg_pos", "block_pos"], "left").withColumn("whole", F.coalesce("body", "injected"))
    refused = F.coalesce("refused", F.lit(False))
    status = F.when(refused, "failed").when(~F.col("matched") & F.col("whole").isNull(), "attempted").otherwise("loaded")
    loads = m.where("asked is not null").select(
        "session_id", F.col("msg_pos").alias("position"), "block_pos", F.col("asked").alias("name"), status.alias("status"),
        F.when(~refused, F.col("whole")).alias("body"), F.when(refused, F.col("error")).alias("error"), "call_id")
    # a read counts if it gave the file's text, and that or its directory names the skill
    reads = m.where(F.col("asked").isNull() & F.col("read").isNotNull() & ~refused & F.col("body").isNotNull())
    reads = reads.select(
        "session_id", F.col("msg_pos").alias("position"), "block_pos", F.coalesce(frontmatter_name(F.col("body")), directory_name(F.col("read"))).alias("name"),
        F.lit("loaded").alias("status"), "body", F.lit(None).cast("string").alias("error"), "call_id")
    b = blocks(messages).where(_get(F.col("block"), "$.type") == "command_execution")
    runs = b.withColumn("r", interpreted(F.to_json("block"))).withColumn("read", shell_read(_get(F.col("block"), "$.command")))
    runs = runs.where("read is not null and r.body is not null").select(
        "session_id", F.col("msg_pos").alias("position"), "block_pos", F.coalesce(frontmatter_name(F.col("r.body")), directory_name(F.col("read"))).alias("name"),
        F.lit("loaded").alias("status"), F.col("r.body").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("call_id"))
    return loads.unionByName(reads.where("name is not null")).unionByName(runs.where("name is not null"))


def listed_skills(messages: DataFrame) -> DataFrame:
    """(session_id, pos, name, description) of the first catalogue in a message history: one of a system message before
    one in the result of a tool that lists skills, which is told by its name or by the id of its call."""
    b = blocks(messages).withColumns({"call": tool_call(F.col("block")), "result": tool_result(F.col("block"))})
    lists: Callable[[Column], Column] = lambda name: F.lower(name).rlike("^(?:.*_)?(?:" + "|".join(DISCOVERY_TOOLS) + ")$")
    asked = b.where(lists(F.col("call.name")) & F.col("call.call_id").isNotNull()).select("session_id", F.col("call.call_id").alias("call_id")).distinct().withColumn("listed", F.lit(True))
    answers = b.where("result is not null").withColumn("call_id", F.col("result.call_id")).join(asked, ["session_id", "call_id"], "left")
    named = F.coalesce(lists(F.coalesce(_get(F.col("block"), "$.name"), _get(F.col("block"), "$.tool_name"), _get(F.col("block"), "$.functionResponse.name"), _get(F.col("block"), "$.function_response.name"))), F.lit(False))
    answers = answers.where(F.coalesce("listed", F.lit(False)) | named).select("session_id", F.lit(1).alias("tier"), "msg_pos", "block_pos", interpreted("result.payload")["body"].alias("text"))
    system = b.where("lower(role) in ('system', 'developer')").select("session_id", F.lit(0).alias("tier"), "msg_pos", "block_pos", _get(F.col("block"), "$.text").alias("text"))
    found = system.unionByName(answers).withColumn("items", catalogue_items(F.col("text"))).where("size(items) > 0")
    first = found.groupBy("session_id").agg(F.min_by("items", F.struct("tier", "msg_pos", "block_pos")).alias("items"))
    return first.select("session_id", F.posexplode("items").alias("pos", "x")).select("session_id", "pos", "x.name", "x.description")

