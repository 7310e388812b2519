"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import rank_mod
from tracelake.runtime import Scratch


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int, bytes_per_label: int, text: str = "text", key: str = "doc_id", held_out: int = 2) -> list[tuple[bytes, int]]:
    """A bounded sample of training rows: per label the ``rows_per_label`` identifiers with the smallest hash, and of
    these, in that order, the texts that fit into ``bytes_per_label`` bytes together.

    Rows whose fold (``crc32`` of the identifier modulo 4) is ``held_out`` are left out before anything else. Of an
    identifier that repeats, the smallest label and the smallest text count.
    """
    known = (
        labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (rank_mod("doc_id") != held_out))
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    order = F.xxhash64("doc_id")
    # The sample is bounded by rows_per_label, so its identifiers may be broadcast; each limit is a top-k by hash.
    picked = known.where("label = 0").orderBy(order, "doc_id").limit(rows_per_label).unionByName(
        known.where("label = 1").orderBy(order, "doc_id").limit(rows_per_label)
    )
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    found = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    scratch = Scratch(docs.sparkSession, "sample")
    kept = scratch.keep(found, "texts")
    sizes = kept.select("doc_id", "label", F.octet_length("text").alias("n"), order.alias("h")).collect()  # two times rows_per_label at most
    room, wanted = {0: bytes_per_label, 1: bytes_per_label}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= room[r["label"]]:
            room[r["label"]] -= r["n"]
            wanted.append((r["doc_id"],))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(wanted, "doc_id long"))
    got = kept.join(chosen, "doc_id", "left_semi").collect()  # at most two times bytes_per_label bytes
    scratch.drop(kept)
    return [(bytes(r["text"]), int(r["label"])) for r in sorted(got, key=lambda r: r["doc_id"])]


def label_share(labels: DataFrame, label: str, held_out: int = 2) -> float | None:
    """Share of label 1 among all labelled rows outside the held-out fold; None without any."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (rank_mod("doc_id") != held_out))
    return known.agg(F.avg(F.col(label).cast("double"))).first()[0]
