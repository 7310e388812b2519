"""Packing by optimal length buckets.

The global histogram of lengths is one aggregation. Dynamic programming over it places ``n_buckets`` boundaries so
that padding every row to its bucket's boundary wastes the fewest tokens. Inside a bucket, rows form batches whose
padded size stays within the token budget.

The histogram that reaches the driver is exact: a bin for each length that occurs. Texts of D different lengths have at
least D (D - 1) / 2 tokens between them, so D stays below the square root of twice the number of tokens: 200,000 would
need 20 billion tokens in texts of ever new lengths. It travels as Arrow columns of 16 bytes a bin.

Batches are numbered without a global sort: a bucket's rows are dealt over slices by the number that each row got when
the lengths were written (as many slices as its count asks for, so that a bucket with a third of all rows is still many
tasks, also where these rows are equal), and each slice forms its batches from its rows in order of length. Every slice
but for its last batch fills the batches; no row is dropped.

A row longer than the budget forms a batch of its own. Null and empty texts have length 0 and share the first bucket.
Repeated rows are packed each on their own; rows of equal length come in order of their id, null first. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.runtime import Scratch

N_BUCKETS = 12
TOKEN_BUDGET = 16_384
SLICE_ROWS = 20_000


def words(text: str = "text") -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def length_histogram(rows: DataFrame, length: str = "n_tokens") -> list[tuple[int, int]]:
    """(length, rows) of every length that occurs, ascending."""
    got = rows.groupBy(F.col(length).alias("n")).agg(F.count("*").alias("rows")).toArrow()
    n, count = got.column("n").to_numpy(), got.column("rows").to_numpy()
    order = np.argsort(n)
    return list(zip(n[order].tolist(), count[order].tolist()))


def optimal_boundaries(histogram: list[tuple[int, int]], n_buckets: int = N_BUCKETS) -> list[int]:
    """Boundaries (ascending, the last is the longest length) that minimise padding over the histogram.

    cost(i, j): bins i..j padded to the top of bin j. best[k][j]: least padding of the first j bins in k buckets. The
    cost meets the quadrangle inequality, so the best split moves with j and each layer is found by divide and conquer.
    """
    if not histogram:
        return []
    top, count = np.array(histogram, np.int64).T
    rows = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(top * count)])
    n = len(histogram)
    n_buckets = min(n_buckets, n)
    never = 1 << 62
    best = np.concatenate([[0], np.full(n, never)])
    cuts: list[np.ndarray] = []
    for _k in range(n_buckets):
        now, cut = np.full(n + 1, never), np.zeros(n + 1, np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + (rows[j] - rows[i]) * top[j - 1] - (tokens[j] - tokens[i])
            at = int(np.argmin(total))
            now[j], cut[j] = min(int(total[at]), never), i[at]
            stack += [(lo, j - 1, left, int(i[at])), (j + 1, hi, int(i[at]), right)]
        cuts.append(cut)
        best = now
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(top[j - 1]))
        j = int(cut[j])
        if j == 0:
            break
    return sorted(out)


def pack(rows: DataFrame, key: str = "doc_id", length: str = "n_tokens", n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, length, bucket, boundary, batch_id, slot, padding), one row per row of ``rows``.

    ``batch_id`` is unique over all buckets: bucket, slice and number within the slice. ``slot`` counts from 0. Keys,
    lengths and the rows' numbers are written first, so that the rows are read once and their numbers stay as they are.
    """
    numbered = rows.select(F.col(key).alias("doc_id"), F.col(length).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("nth"))
    narrow = Scratch(rows.sparkSession, "packing").keep(numbered, "lengths")
    histogram = length_histogram(narrow)
    boundaries = optimal_boundaries(histogram, n_buckets)
    if not boundaries:
        boundaries = [0]
    counts = [sum(r for t, r in histogram if low < t <= high) for low, high in zip([-1, *boundaries], boundaries)]
    n = F.col("n_tokens")
    case = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    bucket = F.lit(0)
    for b in boundaries[:-1]:
        bucket = bucket + (n > b).cast("int")
    slices = [max(1, -(-c // slice_rows)) for c in counts]
    room = [max(1, budget // max(1, b)) for b in boundaries]
    dealt = narrow.withColumn("bucket", bucket).withColumn("boundary", case([int(b) for b in boundaries]).cast("long"))
    dealt = dealt.withColumn("room", case(room)).withColumn("slice", F.pmod(F.xxhash64("nth"), case(slices)).cast("int"))
    order = Window.partitionBy("bucket", "slice").orderBy("n_tokens", "doc_id", "nth")
    placed = dealt.withColumn("place", F.row_number().over(order) - 1)
    return placed.select(
        "doc_id", "n_tokens", "bucket", "boundary",
        F.format_string("%d-%d-%d", "bucket", "slice", F.floor(F.col("place") / F.col("room")).cast("int")).alias("batch_id"),
        (F.col("place") % F.col("room")).cast("int").alias("slot"), (F.col("boundary") - n).alias("padding"),
    )


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """Documents packed by their number of words."""
    return pack(docs.select(F.col(key).cast("long").alias("doc_id"), words(text).alias("n_tokens")), **settings)
