"""Substring dedup over a De Bruijn graph of word windows.

A node is a run of ``WINDOW - 1`` words, an edge the ``WINDOW`` words of two nodes that follow one another. A word goes
if an edge over it also occurs earlier (smaller document id, or earlier in the same document).

1. Cut. Every document's nodes are dealt by minimizer, the smallest hash among the ``ANCHOR``-word runs inside the
   node. Nodes that follow one another and share it travel as one piece, with the node before and the node after, so
   that all edges into and out of a node meet in the one place that owns the node. Equal pieces of one run of documents
   are settled on the spot, word by word, and only the first travels: a passage that a third of all documents hold
   sends one piece per run.
2. Meet. Where a minimizer's pieces meet, a node's degrees are the numbers of distinct edges into and out of it. Of an
   edge that occurs more than once, the first occurrence by (document, place) is the source; repeated edges that follow
   one another in their source, over a node that does not branch, are compacted into path pieces. Later occurrences
   become runs that name their path piece and their source coordinates.
3. Compact. Path pieces that meet at a node that does not branch are glued along the source's coordinates, and a join
   brings each run its path; runs that follow one another on one path are one span.
4. Verify. Spans meet documents in a join on the row, both as the repeat and as its source. Each side sends the SHA-256
   of its words; they must agree. Should hashes ever have brought together what differs, the whole is done again with
   other hashes, so results do not rest on them.
5. The same pass over the documents cuts the words out.

Documents are rows; a row's identity is 128 bits of its id and text, so rows that repeat wholly get the same result
and neither of two rows with one id is earlier than the other at the same place. Null ids come before all others.
Nulls and empty texts have no words. An empty table gives an empty result. Other columns are ignored, whatever their
names. Texts are never split: a task holds ``RUN_BYTES`` of text plus the longest text, about fifteen times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import U64, WORD_SPACE, Tokens, column, equal_words, mix, pieces, row_key, spread, texts
from tracelake.runtime import Scratch, input_bytes, parts_for, ship_package

WINDOW = 20
ANCHOR = 6
RUN_BYTES = 2_000_000
LONGEST_PIECE = 16_000
#: Hash functions to try; already the second is needed with a chance of less than one in a million runs.
HASHES = 8
NULL_ID = -(1 << 63)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
BLOBS = "bucket int, blob binary"
#: What meeting pieces give: spans that need no source (kind 0), runs of later edges (1) and path pieces (2).
FOUND = "kind byte, r1 long, r2 long, start long, n long, s1 long, s2 long, s_start long, piece long"
HOME, RUN, PATH = 0, 1, 2
CHECKS = "array<struct<s1:long,s2:long,s_start:long,n:long,digest:binary>>"
_CHECK = pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("s_start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Pieces:
    """Runs of nodes that share a minimizer: ``first`` node and ``count`` of nodes owned, whether a node ``before`` and
    one ``after`` travel along, and whether a node may occur twice in the piece (``loops``)."""

    def __init__(self, tokens: Tokens, window: int, anchor: int, seed: int) -> None:
        self.nodes = tokens.shingles(window - 1, seed)
        n, size = len(self.nodes), np.diff(tokens.first)
        doc = tokens.doc[:n]
        valid = tokens.full(window - 1) & (size[doc] >= window)
        anchors, width = tokens.shingles(anchor, seed), window - anchor
        least = _sliding_min(anchors, width)[:n] if n else np.zeros(0, U64)
        start = valid.copy()
        start[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(start)
        stop = np.flatnonzero(valid & np.append(~valid[1:] | start[1:], True)[:n]) + 1
        if len(first) and (stop - first).max() > LONGEST_PIECE:  # a text that repeats a few words over and over
            part, step = spread(np.zeros(len(first), np.int64), -(-(stop - first) // LONGEST_PIECE))
            first, stop = first[part] + step * LONGEST_PIECE, stop[part]
            stop = np.minimum(stop, first + LONGEST_PIECE)
        self.first, self.count, self.doc = first, stop - first, doc[first]
        self.place = first - tokens.first[self.doc]
        self.before = self.place > 0
        self.after = self.place + self.count <= size[self.doc] - window + 1
        self.minimizer = mix(least[first])
        twice = np.zeros(len(anchors) + 1, np.int64)
        for gap in range(1, min(width, len(anchors) - 1) + 1):
            twice[np.flatnonzero(anchors[gap:] == anchors[:-gap]) + 1] = 1
        twice = np.cumsum(twice)
        self.loops = twice[np.minimum(stop + width - 1, len(anchors))] > twice[first]

    @property
    def from_node(self) -> np.ndarray:
        return self.first - self.before

    @property
    def n_nodes(self) -> np.ndarray:
        return self.count + self.before + self.after

    @property
    def n_edges(self) -> np.ndarray:
        """Edges out of owned nodes; each edge of a document is in exactly one piece."""
        return self.count - 1 + self.after


def _heads(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For sorted rows whose groups start where ``same`` is false: the place in the order of each row's first one."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order


def _starts(*broken: np.ndarray) -> np.ndarray:
    """Where runs start: at the first row, and wherever any of the conditions between a row and the one before holds."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce(broken)))


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", len(kinds), 4)
    out, at = [], 4 + 4 * len(kinds)
    for kind, n in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


#: Of a blob: row keys and ids of its documents; per piece the minimizer's high half, the document's place in that
#: list, the first owned node's place, the number of owned nodes, and flags; per node 32 and 16 bits of its hash.
KINDS = ["<i8", "<i8", "<i8", "<u4", "<u4", "<u4", "<u2", "u1", "<u4", "<u2"]
BEFORE, AFTER, LOOPS = 1, 2, 4
#: Of a blob of settled spans: row keys, first edge, number of edges.
SETTLED = ["<i8", "<i8", "<u4", "<u4"]


def _settled(tokens: Tokens, p: Pieces, ids: np.ndarray, window: int) -> np.ndarray:
    """Pieces that stand, word by word, in an earlier place of the same run of documents."""
    last = p.from_node + p.n_nodes - 1
    with np.errstate(over="ignore"):
        whole = mix(p.nodes[p.from_node] ^ mix(p.nodes[last] + (p.n_nodes * 4 + 2 * p.before + p.after).astype(U64)))
    owner = ids[p.doc]
    order = np.lexsort((p.place, owner, whole))
    same = np.append(False, whole[order][1:] == whole[order][:-1])
    head = order[_heads(order, same)]
    later = (owner[order] > owner[head]) | ((owner[order] == owner[head]) & (p.place[order] > p.place[head]))
    at, head = order[later], head[later]
    at = at[equal_words(tokens, p.from_node[at], tokens, p.from_node[head], p.n_nodes[at] + window - 2)]
    out = np.zeros(len(p.first), bool)
    out[at] = True
    return out


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, members) in order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(bucket[order[a]]), order[a:b]


def cut_run(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, buckets: int, window: int, anchor: int, seed: int) -> list[tuple[int, bytes]]:
    """(bucket, blob) of a run of documents. A negative bucket marks spans that are found already; any partition may
    pass them on."""
    tokens = Tokens(data, offsets, WORD_SPACE)
    p = Pieces(tokens, window, anchor, seed)
    if not len(p.first):
        return []
    r1, r2, ids = (column(part, c).to_numpy() for c in ("r1", "r2", "id"))
    done = _settled(tokens, p, ids, window)
    blobs = []
    at = np.flatnonzero(done & (p.n_edges > 0))
    if len(at):
        at = at[np.lexsort((p.place[at], p.doc[at]))]
        new = _starts(p.doc[at][1:] != p.doc[at][:-1], p.place[at][1:] != (p.place + p.n_edges)[at][:-1])
        doc, n = p.doc[at][new], np.add.reduceat(p.n_edges[at], new)
        blobs.append((-1 - int(p.minimizer[0] % U64(buckets)), _pack([r1[doc].astype("<i8"), r2[doc].astype("<i8"), p.place[at][new].astype("<u4"), n.astype("<u4")])))
    at = np.flatnonzero(~done)
    for bucket, members in _by_bucket((p.minimizer[at] % U64(buckets)).astype(np.int64)):
        own = at[members]
        named, local = np.unique(p.doc[own], return_inverse=True)
        _, node = spread(p.from_node[own], p.n_nodes[own])
        h = p.nodes[node]
        flags = p.before[own] * BEFORE + p.after[own] * AFTER + p.loops[own] * LOOPS
        blobs.append((bucket, _pack([
            r1[named].astype("<i8"), r2[named].astype("<i8"), ids[named].astype("<i8"), (p.minimizer[own] >> U64(32)).astype("<u4"), local.astype("<u4"),
            p.place[own].astype("<u4"), p.count[own].astype("<u2"), flags.astype("u1"), (h >> U64(32)).astype("<u4"), (h & U64(0xFFFF)).astype("<u2"),
        ])))
    return blobs


def _degree(node: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Of ``n`` nodes: how many distinct others stand beside each."""
    order = np.lexsort((other, node))
    node, other = node[order], other[order]
    new = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))[: len(node)]
    return np.bincount(node[new], minlength=n)


def compare(blobs: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """What ``FOUND`` holds of runs and of path pieces, a row for each column, from all pieces of some minimizers."""
    lists = [_unpack(b, KINDS) for b in blobs]
    shift = np.cumsum([0, *(len(x[0]) for x in lists)])
    r1, r2, ids, minimizer, local, place, count, flags, high, low = (np.concatenate(x) for x in zip(*lists))
    doc = local.astype(np.int64) + np.repeat(shift[:-1], [len(x[4]) for x in lists])
    del lists
    count, place = count.astype(np.int64), place.astype(np.int64)
    before, after = flags & BEFORE, (flags & AFTER) // AFTER
    sent = count + before + after
    begin = np.cumsum(sent) - sent + before  # of the first owned node
    _, back, often = np.unique(minimizer, return_inverse=True, return_counts=True)
    at = np.flatnonzero((often[back] > 1) | (flags & LOOPS > 0))  # the others' minimizers are theirs alone: no node repeats
    of, node = spread(begin[at], count[at])
    of = at[of]
    hashes = (high.astype(U64) << U64(32)) | (low.astype(U64) << U64(16))
    own = hashes[node] | (minimizer[of] & 0xFFFF).astype(U64)
    spot = place[of] + node - begin[of]
    owner, at_doc = ids[doc[of]], doc[of]
    has_next = (node - begin[of] < count[of] - 1) | (after[of] > 0)
    has_last = (node > begin[of]) | (before[of] > 0)
    # nodes and their degrees
    nodes, number = np.unique(own, return_inverse=True)
    leaving, entering = np.flatnonzero(has_next), np.flatnonzero(has_last)
    following = hashes[node[leaving] + 1]
    single = (_degree(number[leaving], following, len(nodes)) <= 1) & (_degree(number[entering], hashes[node[entering] - 1], len(nodes)) <= 1)
    # edges: (node, next node), their sources, and whether an occurrence comes later than its source
    number, owner, spot, at_doc = number[leaving], owner[leaving], spot[leaving], at_doc[leaving]
    order = np.lexsort((spot, owner, following, number))
    number, owner, spot, at_doc, following = (x[order] for x in (number, owner, spot, at_doc, following))
    same = np.append(False, (number[1:] == number[:-1]) & (following[1:] == following[:-1]))[: len(number)]
    head = _heads(order, same)
    later = (owner > owner[head]) | ((owner == owner[head]) & (spot > spot[head]))
    # path pieces: sources of repeated edges, in their documents' order
    source = np.zeros(len(order), bool)
    source[head[later]] = True
    src = np.flatnonzero(source)
    src = src[np.lexsort((spot[src], at_doc[src]))]
    open_ = single[number[src]]
    new = _starts(at_doc[src][1:] != at_doc[src][:-1], spot[src][1:] != spot[src][:-1] + 1, ~open_[1:]) if len(src) else src
    size = np.diff(np.append(new, len(src)))
    piece = np.zeros(len(order), np.int64)
    piece[src] = np.repeat(spot[src][new], size)
    s = src[new]
    zero = np.zeros(len(s), np.int64)
    paths = np.stack([zero + PATH, zero, zero, zero, size, r1[at_doc[s]], r2[at_doc[s]], spot[s], open_[new].astype(np.int64)])
    # runs of later edges; in a loop the place just before bears witness, so that a loop is one run
    run = np.flatnonzero(later)
    witness, of_piece = head[run], piece[head[run]]
    loop = same[run] & (at_doc[run] == at_doc[run - 1]) & (spot[run] - spot[run - 1] <= window)
    witness, of_piece = np.where(loop, run - 1, witness), np.where(loop, -1, of_piece)
    order = np.lexsort((spot[run], at_doc[run]))
    run, witness, of_piece = run[order], witness[order], of_piece[order]
    if not len(run):
        return np.zeros((9, 0), np.int64), paths
    new = _starts(
        at_doc[run][1:] != at_doc[run][:-1], spot[run][1:] != spot[run][:-1] + 1, at_doc[witness][1:] != at_doc[witness][:-1],
        spot[witness][1:] != spot[witness][:-1] + 1, of_piece[1:] != of_piece[:-1],
    )
    size = np.diff(np.append(new, len(run)))
    a, b = run[new], witness[new]
    zero = np.zeros(len(a), np.int64)
    return np.stack([zero + RUN, r1[at_doc[a]], r2[at_doc[a]], spot[a], size, r1[at_doc[b]], r2[at_doc[b]], spot[b], of_piece[new]]), paths


def _rows(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    for i in range(0, found.shape[1], 50_000):
        part = found[:, i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int8)), *(pa.array(x) for x in part[1:])], names)


def repeated_edges(docs: DataFrame, scratch: Scratch, window: int, anchor: int, seed: int) -> DataFrame:
    """``FOUND`` over all of ``docs`` (see ``keyed``). Pieces travel as blobs, one per task's run and bucket."""
    spark = docs.sparkSession
    buckets = parts_for(input_bytes(docs), 4 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, limit=RUN_BYTES):
                blobs = cut_run(part, data, offsets, buckets, window, anchor, seed)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            for bucket, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "blob").to_pylist()):
                if bucket < 0:
                    r1, r2, start, n = _unpack(blob, SETTLED)
                    zero = np.zeros(len(r1), np.int64)
                    yield from _rows(np.stack([zero + HOME, r1, r2, start.astype(np.int64), n.astype(np.int64), zero, zero, zero, zero]))
                else:
                    blobs.append(blob)
        if blobs:
            for found in compare(blobs, window):
                yield from _rows(found)

    bucket = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    return scratch.keep(docs.select("r1", "r2", "id", "text").mapInArrow(cut, BLOBS).repartition(buckets, bucket).mapInArrow(meet, FOUND), "edges")


def compacted_spans(found: DataFrame) -> DataFrame:
    """(r1, r2, start, n, s1, s2, s_start): the longest runs that follow one path of their source without a branch."""
    by_source = Window.partitionBy("s1", "s2").orderBy("s_start")
    glued = (F.col("piece") == 1) & (F.lag(F.col("s_start") + F.col("n")).over(by_source) == F.col("s_start"))
    pieces = found.where(F.col("kind") == PATH).distinct().withColumn("glued", F.coalesce(glued, F.lit(False)))
    path = F.last(F.when(~F.col("glued"), F.col("s_start")), ignorenulls=True).over(by_source)
    paths = pieces.select("s1", "s2", F.col("s_start").alias("piece"), path.alias("path"))
    runs = found.where(F.col("kind") == RUN).drop("kind").distinct().join(paths, ["s1", "s2", "piece"], "left")
    runs = runs.select("r1", "r2", "start", "n", "s1", "s2", "s_start", F.coalesce("path", F.lit(-1)).alias("path"), (F.col("start") - F.col("s_start")).alias("shift"))
    walk = ["r1", "r2", "s1", "s2", "path", "shift"]
    along = Window.partitionBy(*walk).orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("n")).over(along) < F.col("start"), F.lit(True))
    marked = runs.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along))
    spans = marked.groupBy(*walk, "span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("s_start").alias("s_start"))
    return spans.select("r1", "r2", "start", "n", "s1", "s2", "s_start")


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, id, r1, r2, text): the id with null in front of all others, and the row's key."""
    key_col: Column = F.col(key).cast("long")
    return docs.select(key_col.alias("doc_id"), F.coalesce(key_col, F.lit(NULL_ID)).alias("id"), *row_key(key_col, F.col(text)), F.col(text).alias("text"))


def removed_words(spans: list[tuple[int, int]], n: int, window: int) -> np.ndarray:
    """Which of ``n`` words some span's edges cover."""
    edge = np.zeros(n + 1, np.int64)
    at = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 0] + at[:, 1] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(text: bytes, spans: list[dict] | None, sources: list[dict] | None, window: int) -> tuple[bytes, int, int, list[dict]]:
    """Kept words, number of words, number removed, and the digests that both sides of a repeat must share."""
    words = text.split()
    if not spans and not sources:
        return b" ".join(words), len(words), 0, []
    seen = lambda start, n: hashlib.sha256(b" ".join(words[start : start + n + window - 1])).digest()
    checks = [{"s1": x["s1"], "s2": x["s2"], "s_start": x["s_start"], "n": x["n"], "digest": seen(x["start"], x["n"])} for x in spans or () if x["s1"] is not None]
    checks += [{**x, "digest": seen(x["s_start"], x["n"])} for x in sources or ()]
    gone = removed_words([(x["start"], x["n"]) for x in spans or ()], len(words), window)
    return b" ".join(compress(words, (~gone).tolist())), len(words), int(gone.sum()), checks


def _deduped(docs: DataFrame, window: int, anchor: int, shown: Callable[[bytes], str], name: str) -> DataFrame:
    """(doc_id, n_words, n_removed, ``name``): what ``shown`` makes of each row's kept words."""
    spark = docs.sparkSession
    ship_package(spark)
    own = keyed(docs)
    parts = parts_for(input_bytes(docs) * 2, 64 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [{"s1": a, "s2": b} for a, b in zip(column(batch, "r1").to_pylist(), column(batch, "r2").to_pylist())]
            rows = [
                _cut(t, spans, [{**k, **x} for x in sources or ()], window)
                for t, k, spans, sources in zip(texts(batch), key, column(batch, "spans").to_pylist(), column(batch, "sources").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"), pa.array([n for _, n, _, _ in rows], pa.int64()), pa.array([r for _, _, r, _ in rows], pa.int64()),
                    pa.array([shown(k) for k, _, _, _ in rows], pa.string()), pa.array([c for _, _, _, c in rows], pa.list_(_CHECK)),
                ],
                ["doc_id", "n_words", "n_removed", name, "checks"],
            )

    for seed in range(HASHES):
        scratch = Scratch(spark, "substring")
        found = repeated_edges(own, scratch, window, anchor, seed)
        spans = scratch.keep(compacted_spans(found), "spans")
        home = found.where(F.col("kind") == HOME).select("r1", "r2", F.struct("start", "n", *(F.lit(None).cast("long").alias(c) for c in ("s1", "s2", "s_start"))).alias("x"))
        repeats = spans.select("r1", "r2", F.struct("start", "n", "s1", "s2", "s_start").alias("x")).unionByName(home)
        repeats = repeats.groupBy("r1", "r2").agg(F.collect_set("x").alias("spans"))
        sources = spans.select("s1", "s2", F.struct("s_start", "n").alias("x")).groupBy("s1", "s2").agg(F.collect_set("x").alias("sources"))
        met = own.repartition(parts, "r1", "r2").join(repeats, ["r1", "r2"], "left").join(sources.withColumnsRenamed({"s1": "r1", "s2": "r2"}), ["r1", "r2"], "left")
        kept = scratch.keep(met.select("doc_id", "r1", "r2", "text", "spans", "sources").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string, checks {CHECKS}"), "kept")
        sides = kept.select(F.explode("checks").alias("x")).select("x.*").groupBy("s1", "s2", "s_start", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
        if sides.where("a <> b").isEmpty():
            scratch.drop(found)
            scratch.drop(spans)
            return kept.drop("checks")
        # two different runs of words had one hash: once more with others
    raise RuntimeError("repeats and their sources differ under all hash functions")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, n_words, n_removed): texts without their repeated words, kept words joined by one space."""
    return _deduped(docs, window, anchor, bytes.decode, "text").select("doc_id", "text", "n_words", "n_removed")


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``."""
    return _deduped(docs, window, anchor, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256").select("doc_id", "n_words", "n_removed", "kept_sha256")
