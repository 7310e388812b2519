"""Near copies by similarity: SimHash fingerprints whose blocks make candidates, and the exact Jaccard similarity of
shingle sets.

A text is the set of its shingles' hashes; equal sets are one class. As in operator 2, a fingerprint bit is 1 if it is
set in over half of the hashes, and fingerprints that agree in a block of bits are compared by their differing bits. Two
sets of similarity 0.8 differ in 15% of all bits (19% if one has 4 shingles and the other one more), nearly 10 of 64, so
64 bits would not do: a fingerprint has several slices of ``SLICE`` bits from independent hashes. In each slice two
classes are candidates if they agree in a block of ``BLOCK`` bits and differ in at most ``limit`` bits of the slice. The
chance that no slice finds a pair follows from these numbers (``missed``); there are as many slices as bring it to
``MISSED`` or less for the worst pair at the similarity, of whatever sizes. Closer pairs are missed less still.

1. Each slice is a group: its classes' bits are packed a batch a row, so that a fingerprint is shuffled once. Where
   there are more than ``GROUP_CLASSES`` classes, a slice's first bits deal it over groups of about that size, and
   there are more slices, so that the chance of a miss stays the same. A class of a group is compared with those that
   share a block; what earlier links join already is passed over in large blocks.
2. Components of these ties are sets of candidates, nothing more. The texts of candidates are read again.
3. Within a set of candidates the shingle sets are compared exactly; pairs of at least the similarity are linked, and
   pairs that earlier links join already are passed over. Sets of more than a tile are dealt over pairs of tiles.
4. Components of the links come from star contractions; of each the row with the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, comb, log, log2, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import U64, column, mix, row_key, splitmix, texts
from tracelake.llm.components import connected_components
from tracelake.llm.simhash import TILE, shingle_hashes
from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch, input_bytes, parts_for, ship_package

SIMILARITY = 0.8
#: Bits of a slice and of a block.
SLICE, BLOCK = 256, 12
WORDS = SLICE // 64
#: Greatest chance that a pair at the similarity is no candidate.
MISSED = 5e-7
#: Classes in a group of a slice.
GROUP_CLASSES = 1 << 20
#: Blocks shared by at most this many classes are compared row by row, by at most that many in a square.
FEW, SQUARE = 16, 512
#: Most shingles in a tile, besides its number of classes.
TILE_SHINGLES = 4_000_000


class Scheme(NamedTuple):
    """``slices`` of a fingerprint, the first ``route`` bits of each that deal it over groups, its number of ``blocks``,
    the ``limit`` of differing bits, and the ``least`` size of a set that a different one can be similar to."""

    slices: int
    route: int
    blocks: int
    limit: int
    least: int


def _halves(n: int) -> np.ndarray:
    return np.array([comb(n, i) for i in range(n + 1)]) / 2.0**n


def bit_share(a: int, b: int, both: int) -> float:
    """The chance that a bit differs between sets of ``a`` and ``b`` shingles that share ``both``."""
    one, other = (np.array([_halves(n - both)[2 * (k + np.arange(n - both + 1)) > n].sum() for k in range(both + 1)]) for n in (a, b))
    return float((_halves(both) * (one * (1 - other) + other * (1 - one))).sum())


@cache
def worst_share(similarity: float) -> float:
    """The largest chance that a bit differs between sets of the similarity: of large sets by the angle between them, of
    small ones, whose halves tie, counted."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    for a in range(1, 40 + int(2 / max(1 - similarity, 0.01))):
        for b in range(a, int(a / similarity + 1e-9) + 1):
            both = ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if both <= a and both < b:
                share = max(share, bit_share(a, b, both))
    return share


def missed(share: float, route: int, limit: int) -> float:
    """The chance that a slice does not make candidates of two classes whose bits differ with the chance ``share``."""

    def differ(n: int) -> np.ndarray:
        return np.array([comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(n + 1)])

    blocks = (SLICE - route) // BLOCK
    block = differ(BLOCK)
    apart = np.append(0, block[1:])  # of blocks that do not agree
    some = none = differ(SLICE - route - blocks * BLOCK)
    for _ in range(blocks):
        some, none = np.convolve(some, block), np.convolve(none, apart)
    return 1 - (1 - share) ** route * float((some - none)[: limit + 1].sum())


@cache
def scheme(n: int, similarity: float = SIMILARITY, group: int = GROUP_CLASSES) -> Scheme:
    """The scheme for ``n`` classes; pairs at the similarity are missed with the chance ``MISSED`` at most for every n."""
    share = worst_share(similarity)
    route = max(0, ceil(log2(max(1, n) / group)))
    limit = round(share * SLICE + 1.6 * sqrt(SLICE * share * (1 - share)))
    slices = ceil(log(MISSED) / log(missed(share, route, limit)))
    return Scheme(slices, route, (SLICE - route) // BLOCK, limit, ceil(similarity / max(1 - similarity, 1e-12) - 1e-9))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, k), U64))


def fingerprint(shingles: np.ndarray, slices: int) -> bytes:
    """``slices`` times ``SLICE`` bits; each word of 64 comes from a hash of its own of the shingles."""
    salts, counts = splitmix(slices * WORDS, 97), np.zeros(slices * SLICE, np.int64)
    for at in range(0, len(shingles), 255):  # bounded memory for long texts, and counts that fit a byte
        hashes = mix(shingles[at : at + 255, None] ^ salts)
        counts += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).tobytes()


def _groups(grp: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(grp)).tolist() if len(grp) else [0]
    yield from zip(cuts, cuts[1:])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole groups from rows sorted by ``grp``; the last group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        grp = column(batch, "grp").to_numpy()
        cut = int(np.searchsorted(grp, grp[-1]))
        if cut or column(held[0], "grp")[0].as_py() != grp[-1]:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _forest(sets: list[np.ndarray], ids: np.ndarray, left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join all pairs of at least the similarity; in split groups only pairs across the parts are seen."""
    n, whole = len(sets), bool(left.all())
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    own, label, out = np.zeros(len(values), bool), np.arange(n), []
    for i in range(n):
        if not whole and not left[i]:
            continue
        open_ = (label != label[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) * (1 - 1e-9))
        if whole:
            open_[: i + 1] = False
        else:
            open_ &= ~left
        if not open_.any():
            continue
        mine = at[starts[i] : starts[i] + size[i]]
        own[mine] = True
        both = np.add.reduceat(own[at], starts, dtype=np.int64)
        own[mine] = False
        for j in np.flatnonzero(open_ & (both / (size + size[i] - both) >= similarity)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _bits(words: np.ndarray, at: int, n: int) -> np.ndarray:
    """``n`` bits, from the bit ``at`` on, of rows of 64-bit words."""
    w, s = divmod(at, 64)
    x = words[:, w] >> U64(s)
    if s + n > 64:
        x = x | words[:, w + 1] << U64(64 - s)
    return x & U64((1 << n) - 1)


class _Ties:
    """Union-find over the rows of a group; ``a`` and ``b`` collect the ties that joined something."""

    def __init__(self, words: np.ndarray, limit: int) -> None:
        self.words = [np.ascontiguousarray(words[:, w]) for w in range(WORDS)]
        self.limit = limit
        self.parent = np.arange(len(words))
        self.a: list[np.ndarray] = [self.parent[:0]]
        self.b: list[np.ndarray] = [self.parent[:0]]

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while (root != (up := self.parent[root])).any():
            root = up
        self.parent[at] = root
        return root

    def near(self, i: np.ndarray, j: np.ndarray) -> None:
        """Tie the pairs of rows that differ in at most the limit."""
        bits = 0
        for w, own in enumerate(self.words):
            bits = bits + np.bitwise_count(own[i] ^ own[j]).astype(np.int16)
            if w % 2:
                kept = bits <= self.limit
                i, j, bits = i[kept], j[kept], bits[kept]
        while len(i):
            i, j = self.roots(i), self.roots(j)
            open_ = i != j
            i, j = np.minimum(i, j)[open_], np.maximum(i, j)[open_]
            self.parent[j] = i  # of several the last counts; the others take the next round
            joined = np.unique(j)
            self.a.append(joined)
            self.b.append(self.parent[joined])

    def cross(self, rows: np.ndarray, others: np.ndarray) -> None:
        """Tie what is near between rows and others."""
        step = max(1, 1_000_000 // len(others))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            most = sum(np.bitwise_count(own[some][:, None] ^ own[others]) for own in self.words[:-1])
            i, j = np.divmod(np.flatnonzero(most <= self.limit), len(others))
            i, j = some[i], others[j]
            apart = i < j if rows is others else i != j
            if apart.any():
                self.near(i[apart], j[apart])

    def block(self, key: np.ndarray) -> None:
        """Tie the near ones of rows with equal keys."""
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        few = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        rows, own = order[few], key[few]
        for gap in range(1, FEW):
            same = np.flatnonzero(own[gap:] == own[:-gap])
            if not len(same):
                break
            self.near(rows[same], rows[same + gap])
        for f, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            rows = order[f : f + n]
            if n <= SQUARE:
                self.cross(rows, rows)
                continue
            for at in range(0, n, n // 16):  # most of a large block are copies of few texts, or strangers
                if (self.roots(rows) == self.roots(rows[:1])).all():
                    break
                self.near(np.full(n, rows[at]), rows)
            names, at = np.unique(self.roots(rows), return_inverse=True)
            most = np.bincount(at).argmax()
            if len(names) > 1:
                self.cross(rows[at != most], rows)


def candidate_ties(classes: DataFrame, plan: Scheme) -> DataFrame:
    """(a, b): ties between classes (cls, fp) whose components hold every two classes that some slice makes candidates;
    an empty ``fp`` has none."""
    spark = classes.sparkSession
    slices, route, blocks, limit, _ = plan

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = column(batch, "fp").to_pylist()
            cls = column(batch, "cls").to_numpy()[np.array([len(x) > 0 for x in fps], bool)]
            words = np.frombuffer(b"".join(fps), U64).reshape(len(cls), slices, WORDS)
            grp, ids, bits = [], [], []
            for s in range(slices):
                to = _bits(words[:, s], 0, route)
                for part in np.unique(to).tolist():
                    grp.append(s << 32 | part)
                    ids.append(cls[to == part].tobytes())
                    bits.append(words[to == part, s].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.binary())], ["grp", "ids", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _streamed(batches):
            for a, b in _groups(t.column("grp").to_numpy()):
                part = t.slice(a, b - a)
                cls = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int64)
                words = np.frombuffer(b"".join(part.column("bits").to_pylist()), U64).reshape(-1, WORDS)
                ties = _Ties(words, limit)
                for n in range(blocks):
                    ties.block(_bits(words, route + n * BLOCK, BLOCK).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(cls[np.concatenate(x)]) for x in (ties.a, ties.b)], ["a", "b"])

    parts = parts_for(input_bytes(classes) * 2, 32 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = classes.select("cls", "fp").mapInArrow(rows, "grp long, ids binary, bits binary").repartition(parts, "grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(compare, "a long, b long")


def similar_links(sets: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): links that join all pairs of classes of at least the similarity. ``sets`` has cls, shingles (the sorted
    set's bytes), n (its size) and root, the component of candidates."""
    spark = sets.sparkSession
    parts_of = F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("n") / F.lit(TILE_SHINGLES))).cast("int")
    shape = sets.groupBy("root").agg(parts_of.alias("split"), F.count("*").alias("n"))
    met = skew_join(sets, shape.where("split > 1").select("root", "split"), ["root"], "left", counts=shape.select("root", "n"))
    small = met.where("split is null").select(F.col("root").alias("grp"), "cls", "shingles", F.lit(True).alias("left"))
    # large components: each class goes to every pair of parts that holds its own part, and pairs of parts are groups
    spread = met.where("split is not null").select(
        "root", "cls", "shingles", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("split")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("other"))
    spread = spread.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "cls", "shingles", (F.col("own") <= F.col("other")).alias("left"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _streamed(batches):
            grp, cls, left = (t.column(c).to_numpy() for c in ("grp", "cls", "left"))
            bits = t.column("shingles").to_pylist()
            pairs = [x for a, b in _groups(grp) for x in _forest([np.frombuffer(s, U64) for s in bits[a:b]], cls[a:b], left[a:b], similarity)]
            found = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    parts = parts_for(input_bytes(sets), 32 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = small.unionByName(spread).repartition(parts, "grp").sortWithinPartitions("grp")
    return scratch.keep(dealt.mapInArrow(verify, "a long, b long"), "links")


def keep_one_similar(docs: DataFrame, k: int = 5, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each group of texts whose ``k``-word shingles have at least the similarity: that with the
    smallest id (null last), of equals the one whose row has the smaller hash, of rows that repeat wholly any one.
    All columns stay, whatever their names. Texts without words are one group; nulls count as empty texts; an empty
    table stays empty. Rows and classes are told apart by 128 bits."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "similar")
    plan = scheme(docs.count(), similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps = [], []
            for t in texts(batch):
                own = shingle_set(t, k)
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(fingerprint(own, plan.slices) if len(own) >= plan.least else b"")
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "r1", "r2")), pa.array(sets, pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "r1", "r2", "same", "fp"])

    def read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [shingle_set(t, k) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([column(part, "root"), column(part, "cls"), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["root", "cls", "n", "shingles"])

    id_of = F.col(key).cast("long")
    rows = docs.select(id_of.alias("doc_id"), *row_key(id_of, F.col(text)), F.col(text).alias("text"))
    marked = scratch.keep(rows.mapInArrow(run, "doc_id long, r1 long, r2 long, same binary, fp binary"), "fingerprints")
    equal = marked.groupBy("same").agg(F.first("fp").alias("fp"), F.min(F.struct("r1", "r2")).alias("row"), F.count("*").alias("n"))
    # the number given to a class is written here, so that it stays the same whatever is computed anew
    classes = scratch.keep(equal.select(F.monotonically_increasing_id().alias("cls"), "same", "fp", "row.r1", "row.r2", "n"), "classes")
    near = connected_components(candidate_ties(classes, plan), scratch).join(classes.select(F.col("cls").alias("node"), "r1", "r2"), "node")
    again = rows.select("r1", "r2", "text").dropDuplicates(["r1", "r2"]).join(near.select("r1", "r2", "root", F.col("node").alias("cls")), ["r1", "r2"])
    sets = scratch.keep(again.select("root", "cls", "text").mapInArrow(read_again, "root long, cls long, n long, shingles binary"), "sets")
    roots = connected_components(similar_links(sets, scratch, similarity, tile), scratch)
    scratch.drop(sets)
    of = scratch.keep(classes.select("same", "cls", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("same", F.coalesce("root", "cls").alias("root"), "n"), "roots")
    joined = skew_join(marked.select("doc_id", "r1", "r2", "same"), of.drop("n"), ["same"], counts=of.select("same", "n"))
    first = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("x"))
    # the columns of docs travel in one struct, so that no name of theirs can clash with the key's
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), *row_key(id_of, F.col(text)))
    return packed.dropDuplicates(["r1", "r2"]).join(first.select("x.r1", "x.r2"), ["r1", "r2"], "left_semi").select("kept.*")
