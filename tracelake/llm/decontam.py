"""Benchmark decontamination: a prefix-filtered containment join of item windows against documents.

Both sides are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII signs. A window is ``WINDOW``
consecutive words of an item, or the whole of a shorter item. To contain a window, a document must contain all of
its ``SHINGLE``-word shingles, so one is enough to look for: the window's rarest, which is its prefix. Rarity is the
shingle's count over all documents.

1. Every document's shingles that occur in the benchmark are counted (partial counts per task, then a sum).
2. Each window keeps its rarest shingle and the shingle's offset in it (the positional bound).
3. Document shingles are looked up among the prefixes by hash; offset and length bounds give the one place where the
   window can lie, and there the words themselves are compared byte by byte. Hashes only make candidates.

The benchmark's windows go to the executors as sorted arrays while they take at most ``BROADCAST_BYTES``, which are
summed first. A larger benchmark takes the other way, with the same result: documents and prefixes meet in a shuffle
join on the prefix shingle, and candidates meet the texts of their documents in a join on the row.

Null or empty texts have no words and are never contaminated; items without words have no windows. Items are told
apart by ``item_id``, whose repeats count once; a null ``item_id`` is listed as ``null``. Repeated documents are
judged each on their own, whether their ids are null, repeated or neither, and columns other than id and text are
ignored (``drop_contaminated`` keeps all, under any names). Texts are never split: a task's memory is bounded by 2 MB
of text plus the longest text, times the size of its arrays. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, WORD_LETTERS, Tokens, column, equal_words, map_rows, pieces, row_key, spread, text_arrays
from tracelake.runtime import Scratch, ship_package

WINDOW = 10
SHINGLE = 5
BROADCAST_BYTES = 64 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
WINDOWS = "item_id string, win binary, size int, shingles array<long>"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    return Tokens(LOWER[data], offsets, WORD_LETTERS)


def _shingles(tokens: Tokens, k: int) -> np.ndarray:
    return tokens.shingles(k).view(np.int64)


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct (item_id, window): the window's words joined by one space, their number, and its shingles' hashes in
    order. Items shorter than a shingle have one shingle, all their words."""
    ship_package(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                tokens = _tokens(data, offsets)
                by_size = {k: _shingles(tokens, k) for k in range(1, SHINGLE + 1)}
                rows: list[tuple] = []
                for i, item in enumerate(column(part, "item_id").to_pylist()):
                    a, b = int(tokens.first[i]), int(tokens.first[i + 1])
                    size = min(window, b - a)
                    k = min(SHINGLE, size)
                    if size:
                        rows += [(item, tokens.text(at, size), size, by_size[k][at : at + size - k + 1]) for at in range(a, b - size + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64())))],
                        ["item_id", "win", "size", "shingles"],
                    )

    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, WINDOWS).distinct()


def _window_bytes(windows: DataFrame) -> int:
    """What the windows take on the driver and in a broadcast, by a sum over all of them."""
    each = F.octet_length("item_id") + 2 * F.octet_length("win") + 16 * F.size("shingles") + F.lit(200)
    return int(windows.agg(F.sum(each.cast("long"))).first()[0] or 0)


class WindowIndex:
    """Windows by prefix shingle, as sorted arrays."""

    def __init__(self, rows: list[tuple[str, bytes, int, list[int]]], counts: dict[int, int]) -> None:
        self.items = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.items)}
        owners: dict[bytes, set[int]] = {}
        prefix: dict[bytes, tuple[int, int]] = {}
        for item, win, _, shingles in rows:
            owners.setdefault(win, set()).add(number[item])
            if win not in prefix:
                offset = min(range(len(shingles)), key=lambda j: (counts.get(shingles[j], 0), shingles[j], j))
                prefix[win] = shingles[offset], offset
        order = sorted(owners, key=lambda w: (prefix[w][0], w))
        self.key = np.array([prefix[w][0] for w in order], np.int64)
        self.offset = np.array([prefix[w][1] for w in order], np.int64)
        data, offsets = text_arrays(pa.array(order, pa.binary()))
        self.words = Tokens(data, offsets, WORD_LETTERS)
        self.size = np.diff(self.words.first)
        self.k = np.minimum(self.size, SHINGLE)
        self.owners = [np.array(sorted(owners[w]), np.int64) for w in order]
        self.sizes = sorted({int(k) for k in self.k})

    def find(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence, in all documents of ``tokens``."""
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.sizes:
            own = np.flatnonzero(self.k == k)
            keys, shingles = self.key[own], _shingles(tokens, k)
            low = np.searchsorted(keys, shingles, "left")
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == shingles)
            row, place = spread(low[at], np.searchsorted(keys, shingles[at], "right") - low[at])
            w = own[place]
            start = at[row] - self.offset[w]  # positional bound: the only place where this window can begin
            end = start + self.size[w]
            ok = np.flatnonzero((start >= 0) & (end <= len(tokens.doc)))
            ok = ok[tokens.doc[start[ok]] == tokens.doc[end[ok] - 1]]  # length bound, within one document
            start, w = start[ok], w[ok]
            same = equal_words(tokens, start, self.words, self.words.first[w], self.size[w])
            starts.append(start[same])
            windows.append(w[same])
        return np.concatenate(starts), np.concatenate(windows)


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _hit_words(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def shingle_counts(docs: DataFrame, wanted: np.ndarray, text: str = "text") -> DataFrame:
    """(shingle, n): how often each wanted shingle occurs over all documents; each task sends its sums only."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(np.unique(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch):
                tokens = _tokens(data, offsets)
                for k in range(1, SHINGLE + 1):
                    found = _shingles(tokens, k)[tokens.full(k)]
                    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    total += np.bincount(at[keys[at] == found], minlength=len(keys))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(total[used])], ["shingle", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, windows: DataFrame, text: str = "text") -> WindowIndex:
    """The broadcast form of windows that take at most ``BROADCAST_BYTES``."""
    rows = [(r["item_id"], bytes(r["win"]), r["size"], list(r["shingles"])) for r in windows.collect()]
    wanted = np.array(sorted({s for r in rows for s in r[3]}), np.int64)
    counts = {r["shingle"]: r["n"] for r in shingle_counts(docs, wanted, text).collect()} if len(wanted) else {}
    return WindowIndex(rows, counts)


def match_by_broadcast(docs: DataFrame, index: WindowIndex, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        nothing = _digest([])
        for batch in batches:
            for part, data, offsets in pieces(batch):
                tokens = _tokens(data, offsets)
                start, window = own.find(tokens)
                hit = _hit_words(len(tokens.doc), start, own.size[window])
                n = np.diff(tokens.first)
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[tokens.first[1:]] - total[tokens.first[:-1]]
                items: dict[int, set[str]] = {}
                for d, w in zip(tokens.doc[start].tolist(), window.tolist()):
                    items.setdefault(d, set()).update(own.items[i] for i in own.owners[w])
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"), pa.array(n.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                        pa.array([len(items.get(d, ())) for d in range(len(n))], pa.int64()),
                        pa.array([_digest(sorted(items[d])) if d in items else nothing for d in range(len(n))]), pa.array(n_hit > 0),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return _rows(docs, text, key).mapInArrow(run, SCHEMA)


def verified_by_shuffle(docs: DataFrame, windows: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(r1, r2, n_hit, wins): the rows that hold windows of a benchmark of any size, each once however often it repeats;
    ``row_key`` of id and text tells them apart. Nothing of the benchmark is broadcast or collected.

    Shingle rarity, prefixes and candidates are all joins on the shingle; candidates then meet the text of their row,
    where words are compared.
    """
    rows = _rows(docs, text, key)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, limit=200_000):
                tokens, keys = _tokens(data, offsets), [column(part, c) for c in ("r1", "r2")]
                for k in range(1, SHINGLE + 1):
                    found = _shingles(tokens, k)
                    ok = np.flatnonzero(tokens.full(k))
                    of = tokens.doc[ok]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(pa.array(of)) for c in keys), pa.array(found[ok]), pa.array(ok - tokens.first[of]), pa.array(np.full(len(ok), k, np.int32))],
                        ["r1", "r2", "shingle", "at", "k"],
                    )

    named = rows.select(*row_key("doc_id", "text"), "doc_id", "text")
    grams = named.mapInArrow(spans, "r1 long, r2 long, shingle long, at long, k int")
    wins = windows.select("win", "size", "shingles").distinct()
    by_shingle = wins.select("win", "size", F.posexplode("shingles").alias("offset", "shingle"), F.least(F.lit(SHINGLE), "size").alias("k"))
    # left semi keeps the documents' grams that any window has; only those are counted and kept
    kept = scratch.keep(grams.join(by_shingle.select("shingle", "k").distinct(), ["shingle", "k"], "left_semi"), "grams")
    counts = kept.groupBy("shingle", "k").agg(F.count("*").alias("n"))
    prefix = by_shingle.join(counts, ["shingle", "k"], "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "k", "size")).alias("p")
    ).select("win", "p.shingle", "p.k", "p.offset", "p.size")
    start = (F.col("at") - F.col("offset")).alias("start")
    candidates = kept.join(prefix, ["shingle", "k"]).select("r1", "r2", F.struct(start, "size", "win").alias("c")).where("c.start >= 0")
    listed = candidates.groupBy("r1", "r2").agg(F.collect_set("c").alias("found"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one row at a time: its candidates and its words
                part = batch.slice(i, 1)
                data, offsets = text_arrays(column(part, "text"))
                tokens, found = _tokens(data, offsets), column(part, "found").flatten()
                start, size = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "size"))
                inside = np.flatnonzero(start + size <= len(tokens.doc))
                start, size, wins_of = start[inside], size[inside], found.field("win").take(pa.array(inside))
                own = Tokens(*text_arrays(wins_of), WORD_LETTERS)
                same = equal_words(tokens, start, own, own.first[:-1], size)
                n_hit = int(_hit_words(len(tokens.doc), start[same], size[same]).sum())
                if n_hit:
                    hit = pa.array([sorted(set(wins_of.filter(pa.array(same)).to_pylist()))], pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([column(part, "r1"), column(part, "r2"), pa.array([n_hit], pa.int64()), hit], ["r1", "r2", "n_hit", "wins"])

    texts = named.dropDuplicates(["r1", "r2"]).join(listed, ["r1", "r2"])
    return scratch.keep(texts.select("r1", "r2", "text", "found").mapInArrow(verify, "r1 long, r2 long, n_hit long, wins array<binary>"), "hits")


def match_by_shuffle(docs: DataFrame, windows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``match_by_broadcast`` for a benchmark of any size."""
    scratch = Scratch(docs.sparkSession, "decontam")
    hits = verified_by_shuffle(docs, windows, scratch, text, key)
    items_of = hits.select("r1", "r2", F.explode("wins").alias("win")).join(windows.select("win", "item_id").distinct(), "win").groupBy("r1", "r2").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch):
                n = np.diff(_tokens(data, offsets).first).astype(np.int64)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "r1"), column(part, "r2"), pa.array(n)], ["doc_id", "r1", "r2", "n_words"])

    base = _rows(docs, text, key).select("doc_id", *row_key("doc_id", "text"), "text").mapInArrow(sizes, "doc_id long, r1 long, r2 long, n_words long")
    out = base.join(hits.select("r1", "r2", "n_hit").join(items_of, ["r1", "r2"]), ["r1", "r2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", most: int = BROADCAST_BYTES) -> DataFrame:
    """Hit words and items per document; the way is chosen by the summed bytes of the windows."""
    ship_package(docs.sparkSession)
    windows = Scratch(docs.sparkSession, "windows").keep(item_windows(items), "windows")
    if _window_bytes(windows) <= most:
        return match_by_broadcast(docs, build_index(docs, windows, text), text, key)
    return match_by_shuffle(docs, windows, text, key)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", most: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that hold any window of an item; all columns kept."""
    spark = docs.sparkSession
    ship_package(spark)
    windows = Scratch(spark, "windows").keep(item_windows(items), "windows")
    if _window_bytes(windows) <= most:
        shared = spark.sparkContext.broadcast(build_index(docs, windows, text))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                for part, data, offsets in pieces(batch, text):
                    tokens = _tokens(data, offsets)
                    start, _ = own.find(tokens)
                    clean = np.ones(part.num_rows, bool)
                    clean[tokens.doc[start]] = False
                    yield part.filter(pa.array(clean))

        return map_rows(docs, run)
    dirty = verified_by_shuffle(docs, windows, Scratch(spark, "decontam"), text, key).select("r1", "r2")
    own = row_key(F.col(key).cast("long"), F.col(text))
    # the columns of docs travel in one struct, so that no name of theirs can clash with the key's
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), *own)
    return packed.join(dirty, ["r1", "r2"], "left_anti").select("kept.*")
