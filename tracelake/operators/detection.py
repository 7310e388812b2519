"""The deterministic shell of failure detection: chunks under a token budget, merging, thresholds and windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.scoring import confidence
from tracelake.runtime import ship_package


class ChunkFold:
    """Spans packed in order below ``limit`` tokens, a span at a time; a call gives the chunks that it closes, as lists of
    (span, tokens). A span of ``limit`` or more is a chunk of its own. A chunk after a full one starts with the last few
    spans of that one, as many as leave ``least_new`` of the room, and the next span, free."""

    def __init__(self, limit: int, overlap: int = 5, least_new: float = 0.5) -> None:
        self.limit, self.overlap, self.room = limit, overlap, int(limit * (1 - least_new))
        self.now: list[tuple[int, int]] = []
        self.total = self.fresh = 0  # ``fresh``: spans of ``now`` that are not overlap

    def close(self) -> list[list[tuple[int, int]]]:
        done = [self.now] if self.fresh else []
        self.now, self.total, self.fresh = [], 0, 0
        return done

    def add(self, span: int, n: int) -> list[list[tuple[int, int]]]:
        if n >= self.limit:
            return [*self.close(), [(span, n)]]
        done: list[list[tuple[int, int]]] = []
        if self.now and self.total + n > self.limit:
            kept = self.now[-self.overlap :] if self.overlap else []
            done = self.close()
            total, start = sum(x for _, x in kept), 0
            while start < len(kept) and (total > self.room or total + n > self.limit):
                total, start = total - kept[start][1], start + 1
            self.now, self.total = kept[start:], total
        self.now.append((span, n))
        self.total, self.fresh = self.total + n, self.fresh + 1
        return done


def plan_chunks(sizes: Sequence[int], limit: int, overlap: int = 5, least_new: float = 0.5) -> list[list[int]]:
    """Indices per chunk of a list of sizes."""
    fold = ChunkFold(limit, overlap, least_new)
    return [[i for i, _ in chunk] for chunk in [c for i, n in enumerate(sizes) for c in fold.add(i, n)] + fold.close()]


def token_chunks(spans: DataFrame, session: str, pos: str, tokens: str, max_tokens: int, overhead: int = 0, share: float = 0.5, overlap: int = 5) -> DataFrame:
    """(session, chunk, slot, pos): a session's spans in chunks. Order decides, so a session is one run of sorted rows of
    a partition; they stream through the fold, which holds one chunk, whatever the session's length."""
    ship_package(spans.sparkSession)
    limit = int(max_tokens * share) - overhead

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, last, n_chunks, open_ = ChunkFold(limit, overlap), None, 0, False
        for pdf in batches:
            out: list[tuple] = []

            def take(chunks: list[list[tuple[int, int]]], key) -> None:
                nonlocal n_chunks
                for chunk in chunks:
                    out.extend((key, n_chunks, s, p) for s, (p, _) in enumerate(chunk))
                    n_chunks += 1

            for key, p, n in pdf.itertuples(index=False):
                if not open_ or key != last:
                    take(fold.close(), last)
                    last, n_chunks, open_ = key, 0, True
                take(fold.add(int(p), int(n)), key)
            yield pd.DataFrame(out, columns=["session", "chunk", "slot", "pos"])
        rest = fold.close()
        yield pd.DataFrame([(last, n_chunks, s, p) for chunk in rest for s, (p, _) in enumerate(chunk)], columns=["session", "chunk", "slot", "pos"])

    narrow = spans.select(F.col(session).alias("session"), F.col(pos).cast("long").alias("pos"), F.col(tokens).cast("long").alias("tokens"))
    kind = narrow.schema["session"].dataType.simpleString()
    return narrow.repartition("session").sortWithinPartitions("session", "pos").mapInPandas(run, f"session {kind}, chunk int, slot int, pos long")


def merge_failures(rows: DataFrame) -> DataFrame:
    """One row per span and category: the highest confidence with its evidence, the first of equals. Columns: chunk,
    pos, span_id, category, confidence (number), evidence."""
    first = F.struct(F.col("confidence"), -F.col("chunk"), -F.col("pos"))
    return rows.groupBy("span_id", "category").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", first).alias("evidence"), F.min(F.struct("chunk", "pos")).alias("seen")).select(
        "span_id", "category", "confidence", "evidence", F.col("seen.chunk").alias("first_chunk"), F.col("seen.pos").alias("first_pos")
    )


def over_threshold(failures: DataFrame, level: Column) -> DataFrame:
    return failures.where(F.col("confidence") >= confidence(level))


def parse_response(raw: Column) -> Column:
    """Failures in a detector's answer, as an array of (span_id, category, confidence, evidence) lists: code fences are
    stripped, malformed answers are empty, and items whose lists differ in length are left out."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.coalesce(F.nullif(fenced, F.lit("")), raw)
    kind = "struct<errors:array<struct<location:string,category:array<string>,confidence:array<string>,evidence:array<string>>>>"
    errors = F.from_json(body, kind)["errors"]
    even = lambda x: (F.size(x["category"]) == F.size(x["confidence"])) & (F.size(x["category"]) == F.size(x["evidence"]))
    return F.coalesce(F.filter(errors, even), F.array().cast("array<struct<location:string,category:array<string>,confidence:array<string>,evidence:array<string>>>"))


def index_windows(spans: DataFrame, trace: str, order: Sequence[str], least: int = 5, parts: int = 3) -> DataFrame:
    """Spans in tumbling windows of a third of the session's spans (``least`` at least), by place within the trace."""
    place = F.row_number().over(Window.partitionBy("session", trace).orderBy(*order)) - 1
    total = F.count("*").over(Window.partitionBy("session"))
    size = F.greatest(F.lit(least), F.floor(total / parts))
    return spans.withColumn("place", place).withColumn("rca_window", F.floor(F.col("place") / size).cast("int"))


def recommendations(texts: Column) -> Column:
    """Distinct non-empty trimmed texts in their first order."""
    return F.array_distinct(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x != ""))


def group_spans(spans: DataFrame) -> DataFrame:
    """Spans per trace in first-seen order; spans without a trace share one named ``unknown``."""
    return spans.groupBy("session", F.coalesce("trace_id", F.lit("unknown")).alias("trace_id")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_spans"))


def needs_diagnosis(rows: DataFrame, keys: Sequence[str], trigger: str = "on_failure") -> DataFrame:
    failed = F.lit(True) if trigger == "always" else F.bool_or(~F.col("test_pass"))
    return rows.groupBy(*keys).agg(failed.alias("diagnose"))


