"""Array kernels shared by the corpus operators: Arrow text access, word boundaries and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that separate words: space, and tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values made by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        x = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _join(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
    """Hashes of pairs of hashes; each pair goes through the finaliser, so nothing of their order or kind adds up."""
    with np.errstate(over="ignore"):
        return mix((a ^ (b * U64(0xD6E8FEB86659FD93))) + U64(tag))


#: Words of up to this many bytes are hashed in arrays, eight bytes at a time; longer ones one by one.
LANES = 64
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

WORD_SPACE = np.ones(256, bool)
WORD_SPACE[list(SPACES)] = False
#: Bytes of words made of letters and digits: lower-case ASCII, and all bytes of non-ASCII signs.
WORD_LETTERS = np.zeros(256, bool)
WORD_LETTERS[0x30:0x3A] = WORD_LETTERS[0x61:0x7B] = WORD_LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Tokens:
    """Word boundaries of a run of documents.

    ``starts``/``ends`` are byte offsets into ``data``, ``doc`` the document index of each word and ``first`` the
    index of each document's first word (one longer than the number of documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> None:
        n = len(data)
        inside = is_word[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        left = np.empty(n, bool)
        right = np.empty(n, bool)
        if n:
            left[0], right[-1] = True, True
            np.logical_or(~inside[:-1], edge[1:n], out=left[1:])
            np.logical_or(~inside[1:], edge[1:n], out=right[:-1])
        self.data = data
        self.starts = np.flatnonzero(inside & left)
        self.ends = np.flatnonzero(inside & right) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._runs: dict[tuple[int, int], np.ndarray] = {}

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Every eight bytes pass the finaliser together with the state before, so
        no pattern of bytes collides by construction; words of up to eight bytes of one length never collide."""
        if (1, seed) not in self._runs:
            size = self.ends - self.starts
            h = mix(size.astype(U64) + splitmix(1, 1000 + seed))
            lanes = np.lib.stride_tricks.sliding_window_view(np.append(self.data, np.zeros(8, np.uint8)), 8)
            at, step = np.flatnonzero(size <= LANES), 0
            while len(at):
                part = np.ascontiguousarray(lanes[self.starts[at] + step]).view("<u8")[:, 0]
                h[at] = mix(h[at] ^ (part & _LANE_MASK[np.minimum(size[at] - step, 8)]))
                step += 8
                at = at[size[at] > step]
            for i in np.flatnonzero(size > LANES).tolist():
                h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), seed)
            self._runs[1, seed] = h
        return self._runs[1, seed]

    def _run(self, k: int, seed: int) -> np.ndarray:
        """Hashes of the runs of ``k`` words, a power of two, that start at each word."""
        if k == 1:
            return self.word_hashes(seed)
        if (k, seed) not in self._runs:
            half = self._run(k // 2, seed)
            self._runs[k, seed] = _join(half[: max(0, len(half) - k // 2)], half[k // 2 :], k)
        return self._runs[k, seed]

    def shingles(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of the ``k`` words that start at each word; only those at ``full(k)`` are meant. A run is the pair of
        the two runs, as long as a power of two, that begin and end it."""
        p = 1 << k.bit_length() - 1
        run = self._run(p, seed)
        return run if p == k else _join(run[: max(0, len(run) - (k - p))], run[k - p :], -k & 0xFFFF)

    def text(self, first: int, size: int) -> bytes:
        """The words of a run, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist()))

    def full(self, k: int) -> np.ndarray:
        """Whether the ``k`` words that start at a word are all of its document."""
        n = max(0, len(self.starts) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : k - 1 + n]


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every member of ranges given by their first place and their number of places."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def equal_words(a: Tokens, first: np.ndarray, b: Tokens, second: np.ndarray, size: np.ndarray, step: int = 1_000_000) -> np.ndarray:
    """Whether the ``size`` words of ``a`` from ``first`` are, byte by byte, those of ``b`` from ``second``. Rows are
    compared in turn so that about ``step`` words' arrays are held."""
    out = np.ones(len(first), bool)
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + step, step), "right")
    for lo, hi in zip([0, *cuts[1:-1].tolist()], [*cuts[1:-1].tolist(), len(first)]):
        row, i = spread(first[lo:hi], size[lo:hi])
        j = i - first[lo:hi][row] + second[lo:hi][row]
        length = a.ends[i] - a.starts[i]
        good = length == b.ends[j] - b.starts[j]
        word, at = spread(a.starts[i[good]], length[good])
        other = at - a.starts[i[good]][word] + b.starts[j[good]][word]
        good[np.flatnonzero(good)[word[a.data[at] != b.data[other]]]] = False
        out[lo:hi][row[~good]] = False
    return out


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs.mapInArrow(run)`` with the columns of ``docs``, also where names hold dots, which ``mapInArrow`` would take
    for fields of structs."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(renamed, plain.schema).toDF(*names)


def row_key(*columns: Column) -> list[Column]:
    """Two columns, ``r1`` and ``r2``, that tell rows apart by the given columns: 128 bits, as 64 would make two of ten
    billion rows equal."""
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("second"), *columns).alias("r2")]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text each (one row at least), so that arrays stay small.

    A text is never split: memory is bounded by ``limit`` plus the longest text.
    """
    data, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row's text; null counts as empty."""
    data, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
    raw = data.tobytes()
    at = offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rank_mod(name: str = "doc_id", mod: int = 4):
    """``crc32`` of an identifier's decimal text, modulo ``mod``: the fold of a labelled row. Null counts as empty."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
