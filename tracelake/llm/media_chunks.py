"""Media columns: payloads cut by content, chunks stored once, and ordered chunk lists that rebuild the media.

A payload becomes a WAV file of 8-bit mono samples. A rolling gear hash over the file's bytes cuts it into chunks
where the hash's top bits are zero, with a least and a largest chunk size, so that equal passages give equal chunks
wherever they lie. A chunk is known by its SHA-256.

1. One pass lists every payload's chunk digests (its recipe); only these narrow rows are written.
2. An aggregation on the digest finds those that occur more than once; a recipe that occurs often is counted once per
   task by the partial aggregation.
3. A second pass writes the media table: a chunk that no other chunk may equal stays in its payload's row, compressed;
   the others leave a reference, and their bytes go to the chunk store, which a Spark aggregation on the digest makes
   unique. Which chunks may have an equal is told by a Bloom filter sized by the number of shared chunks (at most
   ``FILTER_BITS``): it never misses a shared chunk, and one that it wrongly lists is merely stored beside the shared
   ones. Beyond that size more chunks take the store's way, with the same result.
4. Reading back joins references with the store on the digest and puts the chunks of each distinct recipe in order;
   every chunk and every rebuilt file is checked against its digest. Recipes are rebuilt once, however many rows share
   them, and the narrow results are joined back to the rows.

Null and empty texts give the smallest payload (one pad unit of spaces). Repeated rows get equal values. An empty
table gives an empty result. Other columns are ignored, whatever their names. Texts are never split: a task holds a
batch of texts and, of the longest one, the payload, its hashes (eight times its size) and its chunks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import U64, column, splitmix, texts
from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch, ship_package

PAD = 192
SAMPLE_RATE = 8000
HEADER_BYTES = 44
LEAST_CHUNK = 1024
MEAN_BITS = 12
LARGEST_CHUNK = 16 * 1024
#: Most bits of the filter; one of 2^28 is 32 MB and tells 27 million shared chunks apart.
FILTER_BITS = 1 << 28
FILTER_HASHES = 4
GEAR = splitmix(256, 41)
RESULT = "recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    """The text followed by spaces up to a positive multiple of ``PAD`` bytes."""
    size = max(PAD, -(-len(text) // PAD) * PAD)
    return text.ljust(size, b" ")


def to_wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file with the payload as unsigned 8-bit mono samples."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> bytes:
    """The samples of a file that ``to_wav`` made; the header is checked."""
    riff, _, wave, fmt, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER_BYTES])
    if (riff, wave, fmt, data, code, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER_BYTES : HEADER_BYTES + n]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear[byte], so the sum over the last 64 bytes of gear << age. Doubling
    the window six times gives it for all places at once."""
    h = GEAR[data]
    with np.errstate(over="ignore"):
        for k in range(6):
            step = 1 << k
            if len(h) > step:
                h[step:] += h[:-step] << U64(step)  # the right side is a new array before it is added
    return h


def cuts(hashes: np.ndarray) -> list[int]:
    """Chunk ends of one file, from its gear hashes: at the first candidate from ``LEAST_CHUNK`` bytes on, or at
    ``LARGEST_CHUNK``."""
    n = len(hashes)
    candidate = (np.flatnonzero(hashes >> U64(64 - MEAN_BITS) == 0) + 1).tolist()
    ends, start, i = [], 0, 0
    while n - start > LEAST_CHUNK:
        while i < len(candidate) and candidate[i] < start + LEAST_CHUNK:
            i += 1
        end = min(candidate[i] if i < len(candidate) else n, start + LARGEST_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(gear_hashes(np.frombuffer(media, np.uint8)))
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def recipe_of(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).digest()


def feature(payload: bytes) -> str:
    """What the samples look like: mean, deviation, zero-line crossings and the mean level of four quarters."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n = len(x)
    quarters = [int(x[n * q // 4 : n * (q + 1) // 4].sum()) * 1000 // max(1, n * (q + 1) // 4 - n * q // 4) for q in range(4)]
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero(np.diff((x * n > total).astype(np.int8))))
    return f"mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};cross={crossings};quarters={','.join(map(str, quarters))}"


class DigestFilter:
    """A Bloom filter over SHA-256 digests; its places are read off the digest itself."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(digests: list[bytes], size: int) -> np.ndarray:
        words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :FILTER_HASHES]
        return (words % U64(size)).astype(np.int64)

    def holds(self, digests: list[bytes]) -> np.ndarray:
        at = self.places(digests, len(self.bits) * 8)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def filter_size(n_shared: int) -> int:
    """Bits for a number of digests: about one wrong answer in a hundred, and at most ``FILTER_BITS``."""
    return min(FILTER_BITS, 1 << max(16, (10 * n_shared).bit_length()))


def shared_filter(shared: DataFrame, size: int) -> DigestFilter:
    """The filter over the digests of ``shared``, made by an aggregation: tasks send the words of 64 bits that they set,
    and Spark joins equal words' bits. At most ``size`` / 64 words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(DigestFilter.places(column(batch, "digest").to_pylist(), size))
                word, first = np.unique(at >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(U64(1), (at & 63).astype(U64)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    total = np.zeros(size // 64, np.uint64)
    found = shared.select("digest").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    total[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return DigestFilter(total.view(np.uint8))


def store(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", filter_bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, media, chunk store): rows map a key to its recipe; media hold a recipe's own chunks and references."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch)
            lists = [[hashlib.sha256(c).digest() for c in chunks(to_wav(padded(t)))] for t in raw]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array([recipe_of(x) for x in lists], pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "recipe", "digests"],
            )

    rows = scratch.keep(source.mapInArrow(list_chunks, "doc_id long, n_bytes long, recipe binary, digests array<binary>"), "recipes")
    shared = rows.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.keep(shared.select("digest"), "shared")
    told = spark.sparkContext.broadcast(shared_filter(shared, filter_bits or filter_size(shared.count())))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_repeat, pack = told.value, zstandard.ZstdCompressor(level=3).compress
        sent: set[bytes] = set()  # digests of chunks and of recipes that this task has written, bounded
        for batch in batches:
            for t in texts(batch):
                parts = chunks(to_wav(padded(t)))
                digests = [hashlib.sha256(c).digest() for c in parts]
                recipe = recipe_of(digests)
                if recipe in sent:
                    continue  # an equal payload has been written by this task
                elsewhere = may_repeat.holds(digests)
                inline = b"".join(c for c, e in zip(parts, elsewhere) if not e)
                yield _media([[recipe, digests, [0 if e else len(c) for c, e in zip(parts, elsewhere)], pack(inline)]])
                new = [(d, c) for d, c, e in zip(digests, parts, elsewhere) if e and d not in sent]
                if new:
                    yield _store(new, pack)
                if len(sent) > 50_000:
                    sent.clear()  # bounded memory; a chunk sent twice is made unique by the store
                sent.update([recipe, *(d for d, _ in new)])

    return rows, *_split(scratch, source.select("text").mapInArrow(write, MEDIA))


MEDIA = "recipe binary, digests array<binary>, inline_sizes array<long>, data binary"
_MEDIA = pa.schema([("recipe", pa.binary()), ("digests", pa.list_(pa.binary())), ("inline_sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def _media(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _MEDIA)], schema=_MEDIA)


def _store(new: list[tuple[bytes, bytes]], pack) -> pa.RecordBatch:
    """Chunk rows travel in the media rows' shape, with the digest in the recipe's place and no list."""
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in new], pa.binary()), pa.nulls(len(new), _MEDIA[1].type), pa.nulls(len(new), _MEDIA[2].type), pa.array([pack(c) for _, c in new], pa.binary())],
        schema=_MEDIA,
    )


def _split(scratch: Scratch, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = scratch.keep(written, "media")
    media = both.where("digests is not null")
    parts = both.where("digests is null").select(F.col("recipe").alias("digest"), F.col("data").alias("chunk"))
    return media, scratch.keep(parts.groupBy("digest").agg(F.first("chunk").alias("chunk")), "chunks")


def _described(recipe: bytes, parts: list[bytes], digests: list[bytes]) -> tuple:
    if [hashlib.sha256(c).digest() for c in parts] != list(digests):
        raise ValueError("a chunk does not match its digest")
    media = b"".join(parts)
    payload = from_wav(media)
    return recipe, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)


_RESULT = pa.schema(
    [("recipe", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def read_back(media: DataFrame, store: DataFrame) -> DataFrame:
    """One row per distinct recipe (see ``RESULT``), rebuilt from the stored bytes and verified."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                inline, at, fetched, parts = unpack(r["data"]), 0, {}, []
                for c in r.get("fetched") or ():
                    fetched[c["digest"]] = c["chunk"]
                for d, n in zip(r["digests"], r["inline_sizes"]):
                    if n:
                        parts.append(inline[at : at + n])
                        at += n
                    else:
                        parts.append(unpack(fetched[d]))
                out.append(_described(r["recipe"], parts, r["digests"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)

    whole = media.where(~F.exists("inline_sizes", lambda n: n == 0)).mapInArrow(rebuild, RESULT)
    # rows with references: one per recipe, as several tasks may have written the same payload
    apart = media.where(F.exists("inline_sizes", lambda n: n == 0)).groupBy("recipe").agg(F.first(F.struct("digests", "inline_sizes", "data")).alias("m"))
    apart = apart.select("recipe", "m.*")
    refers = media.where(F.exists("inline_sizes", lambda n: n == 0)).select("recipe", F.explode(F.arrays_zip("digests", "inline_sizes")).alias("x"))
    wanted = refers.where("x.inline_sizes = 0").select("recipe", F.col("x.digests").alias("digest")).distinct()
    # a chunk of at most LARGEST_CHUNK bytes: those of the frequent digests are broadcast (see skew_join)
    fetched = skew_join(wanted, store, ["digest"]).groupBy("recipe").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    return whole.unionByName(apart.join(fetched, "recipe").mapInArrow(rebuild, RESULT))


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """One row per row of ``docs`` with what the rebuilt media show."""
    scratch = Scratch(docs.sparkSession, "media")
    rows, media, parts = store(docs, scratch, text, key, filter_bits)
    found = scratch.keep(read_back(media, parts), "described").dropDuplicates(["recipe"])
    # a payload that very many rows share is one row of what is found, and stays out of the shuffle
    return skew_join(rows.select("doc_id", "n_bytes", "recipe"), found, ["recipe"]).drop("recipe")
