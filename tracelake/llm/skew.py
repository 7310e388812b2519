"""Joins with a side that has hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of all rows; so at most ``1 / HOT_SHARE`` keys are.
HOT_SHARE = 1e-3
HOT_LEAST = 64
_MARK = "__hot_key"


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``left`` joined (``inner`` or ``left``) with ``right``, which has one row per key, without one task for a hot key.

    The hot keys of ``left`` number at most 1,000, whatever the input, as each has over a thousandth of its rows; the
    right rows of these are broadcast, and all other keys take the shuffle. ``counts`` (keys, n) and ``total`` spare
    counting where they are known; keys that ``counts`` lacks count as rare. ``left`` is read more than once.
    """
    total = left.count() if total is None else total
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > max(HOT_LEAST, int(total * HOT_SHARE))).select(*keys, F.lit(True).alias(_MARK)))
    marked = left.join(hot, keys, "left")
    few = F.broadcast(right.join(hot.drop(_MARK), keys, "left_semi"))
    return marked.where(F.col(_MARK)).drop(_MARK).join(few, keys, how).unionByName(marked.where(F.col(_MARK).isNull()).drop(_MARK).join(right, keys, how))
