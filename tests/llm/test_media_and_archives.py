import hashlib
import random
import zlib

import numpy as np
import pytest

from tracelake.llm import arc_warc, media_chunks
from tracelake.runtime import Scratch, table

SF = "/root/testdata/sf0.001"


def media_by_force(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
    media = media_chunks.to_wav(payload)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), media_chunks.feature(payload)


@pytest.mark.parametrize("filter_bits", [1 << 20, 64])
def test_round_trip_of_odd_texts(odd, filter_bits):
    """Also with a filter so small that every chunk takes the store's way."""
    got = media_chunks.round_trip(odd, filter_bits=filter_bits).collect()
    key = lambda x: (x[0] is None, x)
    want = sorted(((r.doc_id, *media_by_force(r.text)) for r in odd.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
    assert sorted(map(tuple, got), key=lambda x: (x[0] is None, x[0] or 0, x[1:])) == want
    _ = key


def test_round_trip_of_whole_table(spark):
    docs = table(spark, SF, "documents")
    assert {r.doc_id: tuple(r[1:]) for r in media_chunks.round_trip(docs).collect()} == {r.doc_id: media_by_force(r.text) for r in docs.collect()}


def test_round_trip_of_nothing(none):
    assert media_chunks.round_trip(none).collect() == []


def test_gear_hash_rolls():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    h, want = 0, []
    for x in data.tolist():
        h = ((h << 1) + int(media_chunks.GEAR[x])) & ((1 << 64) - 1)
        want.append(h)
    assert media_chunks.gear_hashes(data).tolist() == want


def test_chunks_survive_a_shift():
    body = random.Random(2).randbytes(100_000)
    a, b = media_chunks.chunks(body), media_chunks.chunks(b"some bytes in front" + body)
    assert b"".join(a) == body and all(len(c) <= media_chunks.LARGEST_CHUNK for c in a)
    assert len(set(a) & set(b)) >= len(a) - 3
    assert all(len(c) >= media_chunks.LEAST_CHUNK for c in a[:-1])


def test_filter_holds_what_is_shared(spark):
    r = random.Random(9)
    digests = [r.randbytes(32) for _ in range(3000)]
    size = media_chunks.filter_size(2000)
    found = media_chunks.shared_filter(spark.createDataFrame([(bytearray(d),) for d in digests[:2000]], "digest binary").repartition(6), size)
    assert found.holds(digests[:2000]).all() and found.holds(digests[2000:]).mean() < 0.05
    assert media_chunks.filter_size(10**12) == media_chunks.FILTER_BITS


def test_shared_chunks_are_stored_once(spark):
    body = " ".join(str(random.Random(3).random()) for _ in range(1))
    r = random.Random(4)
    passage = " ".join(f"w{r.randrange(9999)}" for _ in range(8000))
    docs = spark.createDataFrame([(i, f"{body} {i} {passage} {i}") for i in range(20)], "doc_id long, text string").repartition(4)
    _, media, store = media_chunks.store(docs, Scratch(spark, "test"))
    stored = sum(len(x.data) for x in media.collect()) + sum(len(x.chunk) for x in store.collect())
    assert stored < 20 * len(passage) / 4


def pages_by_force(rows):
    kept = {}
    for key, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 1000 and key is not None:
            kept[p] = max(kept.get(p, key), key)
    out = []
    for key, _, html in rows:
        p = (html or "").encode()
        to = kept.get(p) if len(p) >= 1000 else None
        other = to is not None and to != key
        out.append((key, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", to if other else None))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1:4]))


PAGES = [
    (1, "http://a.example/x y", "<p>" + "q" * 1500), (2, "http://b.example/", "<p>" + "q" * 1500), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
    (7, "http://é.example/", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n" * 60), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000),
    (None, "u", "x" * 1000), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (12, "u", "é\n\x00\r\n" * 400), (12, "u", "é\n\x00\r\n" * 400), (13, "u", "\n\n\n"),
]


@pytest.mark.parametrize("version", [1, 2, None])
def test_pages_through_archives(spark, version, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = Scratch(spark, "test").path("warc")
    arc_warc.convert(arc_warc.pages_to_arc(pages, version), path)
    got = sorted(map(tuple, arc_warc.read_warc(spark, path).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:4]))
    assert got == pages_by_force(PAGES)


def test_many_repeated_digests_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(arc_warc, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([*PAGES, *((100 + i, "u", "x" * 3000) for i in range(90))], "page_id long, url string, html string")
    got = sorted(map(tuple, arc_warc.archive_pages(pages).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:4]))
    assert got == pages_by_force([tuple(r) for r in pages.collect()])


def test_whole_table_and_nothing(spark):
    pages = table(spark, SF, "pages")
    got = sorted(map(tuple, arc_warc.archive_pages(pages).collect()))
    assert got == pages_by_force([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert arc_warc.archive_pages(pages.limit(0)).collect() == []


def test_arc_versions_are_parsed():
    for version in (1, 2):
        data = arc_warc.arc_version_block(version) + b"".join(arc_warc.arc_record(version, k, u, (h or "").encode()) for k, u, h in PAGES)
        records = list(arc_warc.parse_arc(data))
        assert len(records) == len(PAGES) and all(r["version"] == version for r in records)
        assert records[0]["URL"] == b"http://a.example/x%20y" and (version == 1 or records[0]["Result-code"] == b"200")
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc(data[:-40]))
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc(b"http://x 0 0 0 0\n"))


def test_warc_files_are_plain_gzip_members(spark):
    import gzip
    import glob

    path = Scratch(spark, "test").path("warc")
    arc_warc.convert(arc_warc.pages_to_arc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)), path)
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(path.removeprefix("file://") + "/part-*"))
    every = [h for h, _ in arc_warc.parse_warc(data)]
    heads = [h for h in every if h["warc-type"] != "warcinfo"]
    assert every[0]["warc-type"] == "warcinfo" and len(every) > len(heads)
    named = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    for h in revisits:
        of = named[h["warc-refers-to"]]
        assert of["warc-payload-digest"] == h["warc-payload-digest"] and of["warc-target-uri"] == h["warc-refers-to-target-uri"] and of["warc-date"] == h["warc-refers-to-date"]
    assert revisits and len(heads) == len(PAGES) and len({h["warc-record-id"] for h in heads}) >= len(PAGES) - 2
    assert all(h["warc-date"] == "2024-01-01T00:00:00Z" for h in heads)
