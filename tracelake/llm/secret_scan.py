"""Secret scanning: three pattern kinds, and values in credential contexts judged by guess cost.

The guess cost of a value is the cheapest way to write it as a chain of segments, found by dynamic programming over
its end points: words of a ranked list (by rank), dates, repeats, keyboard walks, sequences, and brute force. A value
that even the cheapest chain makes expensive to guess is random enough to be a live credential.

The list of words is a parameter: by default a short list of common passwords, in the registered query and the pipeline
also the letter-only entries of public tokenizer vocabularies, whose order is that of their frequency (see
``ranked_words``).

Kinds, in the order used where two spans start together: ``assign``, ``access``, ``hex`` (patterns, see
``base_spans``) and ``guess`` (the value after a credential word, whose guess cost is at least the threshold).

Nulls and empty texts have no spans. Rows are judged one by one, so repeated rows get equal results; spans that start
together come in the order of kinds. An empty table gives an empty result; other input columns are ignored, whatever
their names. Values are costed as a whole, however long, in time linear in their length; memory is bounded by a batch of
texts and the longest one.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import column, map_rows
from tracelake.runtime import ship_package

#: Patterns of the base kinds (fixed values); letters of the first match in either case, of ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")

#: Credential words before a separator and a value, wider than ``ASSIGN``; the value may hold any printable sign.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|client[_\x20-]?secret|auth|bearer|credential|pin)s?["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([\x21\x23-\x26\x28-\x7E]{4,})""",
    re.I | re.A,
)
#: Decimal logarithm of the guesses from which a value counts as unguessable.
DEFAULT_THRESHOLD = 10.0
#: Longest word looked up, longest unit of a repeat, and most places back at which a walk, sequence or repeat may start
#: besides its very beginning. They bound the segments that are tried at each end, not the value.
LONGEST, UNIT, BACK = 24, 64, 16

#: Common password words, most common first; the place in the list is the guess rank (fixed values).
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou princess sunshine shadow "
    "football baseball superman trustno1 hello freedom whatever secret test guest root user pass changeme default "
    "example demo sample token key love money summer winter spring autumn company server system access private public"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT_KEYS = {frozenset((a, b)) for row in KEY_ROWS for a, b in zip(row, row[1:])} | {
    frozenset((upper[i], lower[j])) for upper, lower in zip(KEY_ROWS[:-1], KEY_ROWS[1:]) for i in range(len(upper)) for j in (i - 1, i) if 0 <= j < len(lower)
}
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def ranked_words(*paths: str) -> dict[str, int]:
    """Ranks of words: the common passwords, then the entries of vocabulary files (a base64 token and its rank a line, the
    most frequent first) that are three letters or more, with or without a space in front. A word has its least rank."""
    found = dict(RANK)
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                word = base64.b64decode(token).decode("utf-8", "ignore").strip(" ").lower()
                if len(word) >= 3 and word.isalpha():
                    found[word] = min(found.get(word, 1 << 30), len(COMMON) + int(rank))
    return found


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33


def date_cost(text: str) -> float | None:
    """Guesses for a year, a month of a year or a day of it among 120 years; None for other texts."""
    if not DATE.fullmatch(text):
        return None
    digits = sum(c.isdigit() for c in text)
    return math.log10(120 * (1 if digits == 4 else 12 if digits == 6 else 365))


def _step(a: str, b: str) -> int:
    step = ord(b) - ord(a)
    return step if abs(step) == 1 else 0


def _starts(first: int, last: int) -> list[int]:
    """Starts to try: the beginning of a run, and the last few places at which the segment is long enough."""
    return [first, *range(max(first + 1, last - BACK), last + 1)] if first <= last else []


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """Decimal logarithm of the guesses for a value under the cheapest segmentation; 0 for an empty one."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + math.log10(_alphabet(c)))
    chain = math.log10(2)  # each further segment also costs the guess that there is one
    best, before = [0.0], [0.0]  # ``before``: what a segment that starts there begins with
    cheapest_brute = 0.0
    walk = steps = 0  # starts of the keyboard walk and of the sequence that end here
    alike = [0] * (min(UNIT, n // 2) + 1)  # for each unit, how many signs in a row equal those a unit before
    for end in range(1, n + 1):
        low_end = low[end - 1]
        total = brute[end] + cheapest_brute
        if end > 1:
            a = low[end - 2]
            walk = walk if frozenset((a, low_end)) in NEXT_KEYS else end - 1
            step = _step(a, low_end)
            steps = end - 1 if not step else steps if end > 2 and _step(low[end - 3], a) == step else end - 2
        for start in range(max(0, end - LONGEST), end - 2):
            for shown, extra in ((low, 0.0), (plain, 0.3)):
                if (rank := ranks.get(shown[start:end])) is not None:
                    case = 0.0 if value[start:end] == low[start:end] else 0.6
                    total = min(total, before[start] + math.log10(rank + 1) + extra + case)
        for start in _starts(walk, end - 4):
            total = min(total, before[start] + math.log10(47 * 4 * (end - start)))
        for start in _starts(steps, end - 3):
            total = min(total, before[start] + math.log10(40 * (end - start)))
        if low_end.isdigit():
            for start in range(max(0, end - 10), end - 3):
                if value[start].isdigit() and (cost := date_cost(value[start:end])) is not None:
                    total = min(total, before[start] + cost)
        for unit in range(1, min(len(alike) - 1, end - 1) + 1):
            if low[end - 1 - unit] != low_end:
                alike[unit] = 0
                continue
            alike[unit] += 1
            most = alike[unit] // unit + 1
            for times in {*range(2, min(most, BACK) + 1), most}:
                if times > 1 and times * unit >= 3:
                    start = end - times * unit
                    total = min(total, before[start] + brute[start + unit] - brute[start] + math.log10(times))
        best.append(total)
        before.append(total + chain)
        cheapest_brute = min(cheapest_brute, before[end] - brute[end])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern kinds, in code points, leftmost and without overlap within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def guess_spans(text: str, threshold: float = DEFAULT_THRESHOLD, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str, float]]:
    """(start, end, ``guess``, cost) of context values at or above the threshold; the span is the value."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)]}>")
        if value and (cost := guess_cost(value, ranks)) >= threshold:
            out.append((m.start(1), m.start(1) + len(value), KINDS[3], cost))
    return out


def all_spans(text: str, threshold: float = DEFAULT_THRESHOLD, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    found = base_spans(text) + [x[:3] for x in guess_spans(text, threshold, ranks)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[REDACTED]") -> str:
    """The text with every span replaced by a mark; overlapping spans are replaced once."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


#: Any match of a kind holds one of these; a text without them is passed over at once.
_MAYBE = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[:=]|\x20is\x20")

SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = DEFAULT_THRESHOLD, ranks: dict[str, int] = RANK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, and ``spans`` as an array of (start, end, kind). One pass, no shuffle; the
    ranked words are broadcast, at most a vocabulary's worth."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = [
                [{"start": s, "end": e, "kind": k} for s, e, k in all_spans(t, threshold, shared.value)] if t and _MAYBE.search(t) else []
                for t in column(batch, "text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars", threshold: float = DEFAULT_THRESHOLD, ranks: dict[str, int] = RANK) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by a mark and ``length`` (if there is such a column) set anew.

    A text without secrets, a null among them, keeps its row as it is.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            was = batch.column(i).to_pylist()
            now = [redact(t, all_spans(t, threshold, shared.value)) if t and _MAYBE.search(t) else t for t in was]
            columns = list(batch.columns)
            columns[i] = pa.array(now, batch.schema.field(i).type)
            if length is not None and (j := batch.schema.get_field_index(length)) >= 0:
                kept = batch.column(j).to_pylist()
                columns[j] = pa.array([len(b) if b != a else n for a, b, n in zip(was, now, kept)], batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, run)


def digests(spans: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans' list, and the list of all spans, from ``scan``'s rows."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        count(KINDS[3]),
    )


