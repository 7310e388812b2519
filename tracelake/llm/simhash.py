"""SimHash near-duplicates: fingerprints that differ in few bits, found by pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Two fingerprints that differ
in at most ``radius`` bits agree wholly in at least ``blocks - radius`` of ``blocks`` blocks, so for one of the choices
of that many blocks they share a key made of these blocks' bits. The number of blocks is chosen by the number of
distinct fingerprints, so that the key is long enough to keep unrelated ones apart; every choice finds every pair.

1. One pass makes the fingerprints; equal ones are one class from here on, so exact copies cost one row per task.
2. Each class has one row per key. Keys that only one class has fall away. The rest are dealt by key, sorted, and
   compared in arrays, verifying the Hamming distance. A key with more than ``TILE`` classes is split into tiles: its
   classes are dealt over parts, and each pair of parts is its own group, so that no task holds the whole of it.
3. A group sends only what joins its classes (a spanning forest found by union-find), never all its pairs.
4. Components of the classes come from star contractions (see ``components``).

Texts without words have fingerprint zero and link like any other. Nulls count as empty texts. A null identifier
takes part in linking but is never the smallest of a component unless the component has no other. Repeated rows have
equal fingerprints, and of ids that repeat the smallest counts once. An empty table gives an empty result. Other
columns are ignored. Texts are never split: a task holds a batch of texts and the hashes of the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import column, texts
from tracelake.llm.components import connected_components
from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch, input_bytes, parts_for, ship_package

BITS = 64
RADIUS = 4
TILE = 1024
SEED = 42


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each run of ``k`` words joined by spaces (fewer words: all of them), in order, repeats included."""
    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, SEED)]
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])]


def fingerprint(text: bytes, k: int = 4) -> int:
    hashes = shingle_hashes(text, k)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) per row of ``docs``, the fingerprint as a signed 64-bit integer."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, k) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def scheme(n: int, radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """(number, bit positions) of each key. The fewest blocks whose keys are long enough that ``n`` random fingerprints
    meet in less than one pair per key and fingerprint."""
    for blocks in range(radius + 1, 2 * radius + 2):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        keys = [[b for i in chosen for b in range(edges[i], edges[i + 1])] for chosen in combinations(range(blocks), blocks - radius)]
        if min(map(len, keys)) >= np.log2(max(2, n)) + 1:
            break
    return list(enumerate(keys))


def _mask(bits: list[int]) -> int:
    """The bits' mask as a signed 64-bit integer; bit 0 is the lowest."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def keyed(classes: DataFrame, keys: list[tuple[int, list[int]]]) -> DataFrame:
    """(k, part, fp): a row for each key of each fingerprint, ``part`` being the fingerprint's bits in the key."""
    rows = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("part")) for i, bits in keys))
    return classes.select("fp", F.explode(rows).alias("x")).select("x.k", "x.part", "fp")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius  # of signed numbers it would count the absolute value


def group_forest(fps: np.ndarray, left: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join what is within the radius in a group. ``left`` marks the part that pairs are wanted with: all
    pairs if it is all, else pairs between the parts only."""
    n = len(fps)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    whole = bool(left.all())
    for i in range(n):
        if whole:
            hits = i + 1 + np.flatnonzero(_near(fps[i + 1 :], fps[i], radius))
        elif left[i]:
            hits = np.flatnonzero(_near(fps, fps[i], radius) & ~left)
        else:
            continue
        for j in hits.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def _small_groups(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs in sorted rows whose groups are small, by comparing rows at each distance."""
    a, b = [], []
    gap = 1
    while True:
        same = np.flatnonzero(group[gap:] == group[:-gap]) if gap < len(group) else np.zeros(0, np.int64)
        if not len(same):
            break
        near = same[_near(fps[same], fps[same + gap], radius)]
        a.append(fps[near])
        b.append(fps[near + gap])
        gap += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, n: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that join every component."""
    spark = classes.sparkSession
    n = classes.count() if n is None else n
    keys = scheme(n, radius)
    parts = parts_for(input_bytes(classes) * len(keys) * 3, 32 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = keyed(classes, keys)
    crowded = rows.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    met = skew_join(rows, crowded, ["k", "part"], counts=crowded, total=n * len(keys))
    split = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), split).cast("int")
    # a class of a large group goes to every pair of parts that holds its own part; small groups have one part
    spread = met.select("k", "part", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), split - 1)).alias("other"))
    spread = spread.select(
        F.xxhash64("k", "part", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp", (F.col("own") <= F.col("other")).alias("left")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(grp: np.ndarray, fps: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(grp)))
            small = np.repeat(sizes <= 16, sizes)
            whole = np.repeat(np.logical_and.reduceat(left, first) if len(first) else np.zeros(0, bool), sizes)
            easy = small & whole
            a, b = _small_groups(grp[easy], fps[easy], radius)
            pairs = []
            for f, s in zip(first.tolist(), sizes.tolist()):
                if not easy[f]:
                    pairs += group_forest(fps[f : f + s], left[f : f + s], radius)
            more = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, more[:, 0]])), pa.array(np.concatenate([b, more[:, 1]]))], ["a", "b"])

        for batch in batches:
            held.append((column(batch, "grp").to_numpy(), column(batch, "fp").to_numpy(), column(batch, "left").to_numpy(zero_copy_only=False)))
            if not batch.num_rows or held[-1][0][0] == held[-1][0][-1] == held[0][0][0]:
                continue  # still one group: at most two tiles' rows are held
            grp, fps, left = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(grp, grp[-1]))  # the last group may go on in the next batch
            if cut:
                yield done(grp[:cut], fps[:cut], left[:cut])
            held = [(grp[cut:], fps[cut:], left[cut:])]
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    dealt = spread.repartition(parts, "grp").sortWithinPartitions("grp", "fp")
    return scratch.keep(dealt.mapInArrow(compare, "a long, b long"), "links")


def components(marked: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of ``marked`` (with ``fp`` and ``doc_id``) and their component's ``root`` and smallest id."""
    classes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = connected_components(links(classes.select("fp"), scratch, radius, tile=tile), scratch)
    joined = scratch.keep(classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(skew_join(joined.select("fp", "root", "n"), least, ["root"]), "named")
    return skew_join(marked, named.drop("n"), ["fp"], counts=named.select("fp", "n"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = RADIUS, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, k, text, key), "fingerprints")
    return components(marked, scratch, radius, tile).select("doc_id", "fp", "component_id")


def shown(rows: DataFrame) -> DataFrame:
    """Fingerprints as 16 lower-case hex digits."""
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
