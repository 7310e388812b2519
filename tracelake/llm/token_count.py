"""Exact token counts by byte-pair merging with a heap and a linked list.

Each pre-token starts as its byte symbols in a doubly linked list. The adjacent pairs that the merge table knows
wait in a heap by (rank, place); the best one is popped, checked for staleness, and merged, which makes at most two
new neighbours. The count is the number of initial symbols minus the number of merges: no identifiers are made.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each on their own. An empty table gives
an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import column
from tracelake.runtime import ship_package

#: The byte-level pre-tokenizer's published pattern (fixed value), with letters, the most common case, tried first:
#: no other alternative can begin where that one matches.
BYTE_LEVEL_PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the
    rest take code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in own}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(own))
    return shown


class _Counts(dict):
    """Counts of pre-tokens seen before, in two generations of bounded size: when the young one is full it becomes
    the old one, and entries still in use move back on their next lookup."""

    def __init__(self, count: Callable[[bytes], int], most: int) -> None:
        super().__init__()
        self.count, self.most, self.old = count, most, {}

    def __missing__(self, word: str) -> int:
        n = self.old.pop(word, None)
        if n is None:
            n = self.count(word.encode())
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


class HeapBPE:
    """Counts tokens under a byte-level BPE vocabulary file."""

    def __init__(self, path: str, cache_size: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        symbol = {shown: bytes([b]) for b, shown in byte_alphabet().items()}
        as_bytes = lambda s: b"".join(symbol[c] for c in s)
        number = {bytes([b]): b for b in range(256)}
        self.rank: dict[int, int] = {}  # of a pair of symbol numbers
        self.made: list[int] = []  # the symbol that the merge of a rank makes
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.made.append(number.setdefault(a + b, len(number)))
            self.rank.setdefault(number[a] << 20 | number[b], i)
        self.split = regex.compile(BYTE_LEVEL_PATTERN).findall
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cache = _Counts(self.merges, cache_size)

    def merges(self, word: bytes) -> int:
        """Number of symbols left of one pre-token."""
        n = left = len(word)
        rank = self.rank.get
        symbol = list(word)  # a byte is its own symbol; -1 marks one merged into its left neighbour
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two has been merged since
            whole = symbol[i] = self.made[r]
            symbol[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank(whole << 20 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbol[h] << 20 | whole)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return left

    def _plain(self, text: str) -> int:
        return sum(map(self.cache.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        """Tokens of a text; added tokens inside it count as one each, as the library's default has it."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


_LOADED: dict[str, HeapBPE] = {}


def load(path: str) -> HeapBPE:
    """The counter of a vocabulary; a worker process keeps it, with its bounded cache, from task to task."""
    if path not in _LOADED:
        _LOADED[path] = HeapBPE(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, UTF-8 length, token count, and whether the count exceeds ``limit``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can open. One pass, no shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            counts = [bpe.count(t) if t else 0 for t in column(batch, "text").to_pylist()]
            n_bytes = column(batch, "n_bytes")
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), n_bytes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(run, SCHEMA)
