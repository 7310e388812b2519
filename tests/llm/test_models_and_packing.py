import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import packing, quality, toxicity
from tracelake.llm.labels import labelled_sample
from tracelake.runtime import table

SF = "/root/testdata/sf0.001"

HELD = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
DATA = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, threshold, least", [(toxicity, "toxic", 0.3, 0.95), (quality, "quality", 0.7, 0.95)])
def test_held_out_accuracy(spark, module, label, threshold, least):
    """On the largest of the three test tables: the smaller ones have a few dozen toxic rows, in four languages."""
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    got = {r.doc_id: r for r in module.score(docs, module.train(docs, labels), threshold).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == HELD(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for i, r in got.items())
    held = [(got[r.doc_id], r[label]) for r in labels.collect() if HELD(r.doc_id)]
    ones, zeros = ([g.score for g, y in held if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc >= least, auc


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_inputs(spark, odd, none, module, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = module.train(docs, labels)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 0)}) == 1 and module.score(none, model).collect() == []
    for some in (labels.limit(0), labels.where(f"{label} = 1"), labels.selectExpr("doc_id", f"cast(null as int) as {label}")):
        scores = {r.score for r in module.score(odd, module.train(docs, some)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    for module in (toxicity, quality):
        a, b = (sorted((r.doc_id, r.score) for r in module.score(docs, module.train(docs, x)).collect()) for x in (labels, flipped))
        assert a == b


def test_toxic_rows_go_and_clean_ones_stay(spark, odd):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.train(docs, labels)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, model, 0.3).collect() if r.predicted == 0}
    assert toxicity.keep_clean(odd, model).columns == odd.columns


def padding_by_force(lengths, n_buckets):
    tops = sorted(set(lengths))
    best = None
    for k in range(1, min(n_buckets, len(tops)) + 1):
        for inner in itertools.combinations(tops[:-1], k - 1):
            bounds = [*inner, tops[-1]]
            cost = sum(min(b for b in bounds if b >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(1, 5))
def test_boundaries_are_optimal(lengths, n_buckets):
    histogram = [(x, lengths.count(x)) for x in sorted(set(lengths))]
    bounds = packing.optimal_boundaries(histogram, n_buckets)
    assert len(bounds) <= n_buckets and bounds[-1] == max(lengths)
    assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == padding_by_force(lengths, n_buckets)


def check_packed(rows, lengths, budget):
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    batches = {}
    for r in rows:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches.setdefault(r.batch_id, []).append(r)
    for members in batches.values():
        assert len({(r.bucket, r.boundary) for r in members}) == 1 and sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) * members[0].boundary <= budget or len(members) == 1


def test_packing(spark, odd, none):
    r = random.Random(1)
    lengths = [int(r.lognormvariate(5, 1.5)) for _ in range(3000)] + [7] * 1500 + [50_000, 60_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    rows = packing.pack(df, slice_rows=400).collect()
    assert sorted(x.doc_id for x in rows) == list(range(len(lengths)))
    check_packed(rows, lengths, packing.TOKEN_BUDGET)
    n_batches = len({x.batch_id for x in rows})
    least = sum(-(-sum(x.boundary for x in rows if x.bucket == b) // packing.TOKEN_BUDGET) for b in {x.bucket for x in rows})
    assert n_batches <= least * 2 + len(lengths) // 400 + 14
    want = [len((x.text or "").encode().split()) for x in odd.collect()]
    check_packed(packing.pack_documents(odd).collect(), want, packing.TOKEN_BUDGET)
    assert packing.pack_documents(none).collect() == []


def test_long_lengths_are_packed_optimally(spark):
    """The least padding over lengths far above a few thousand words, by the plain dynamic program over all of them."""
    r = random.Random(8)
    lengths = [4000 + 37 * i for i in range(300)] + [r.randrange(5000, 200_000) for _ in range(150)] + [9000] * 400
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    tops = sorted(set(lengths))
    assert packing.length_histogram(df) == [(n, lengths.count(n)) for n in tops]
    rows = packing.pack(df).collect()
    check_packed(rows, lengths, packing.TOKEN_BUDGET)
    rows_to, tokens_to = np.cumsum([0] + [lengths.count(n) for n in tops]), np.cumsum([0] + [n * lengths.count(n) for n in tops])
    best = [0] + [10**18] * len(tops)
    for _ in range(packing.N_BUCKETS):
        best = [0] + [min(best[j], min(best[i] + int((rows_to[j] - rows_to[i]) * tops[j - 1] - (tokens_to[j] - tokens_to[i])) for i in range(j))) for j in range(1, len(tops) + 1)]
    assert sum(x.padding for x in rows) == best[-1]


def test_equal_rows_are_dealt_over_slices(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(7 as long) as n_tokens").repartition(3)
    rows = packing.pack(df, slice_rows=100).collect()
    check_packed(rows, [7] * 3000, packing.TOKEN_BUDGET)
    slices = [int(x.batch_id.split("-")[1]) for x in rows]
    assert len(set(slices)) == 30 and max(slices.count(k) for k in set(slices)) < 200


def test_samples_are_bounded_by_rows_and_bytes(spark):
    rows = [(i, "x" * (1 + i % 50)) for i in range(400)] + [(400, None), (None, "y" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(401)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = labelled_sample(docs, known, "toxic", 50, 700)
    for y in (0, 1):
        part = [t for t, k in got if k == y]
        assert 0 < len(part) <= 50 and 600 < sum(map(len, part)) <= 700
    free = sorted(i for i in range(400) if not HELD(i))
    whole = labelled_sample(docs, known, "toxic", 10_000, 10**9)
    assert [t.decode() for t, _ in whole] == [rows[i][1] for i in free] and [y for _, y in whole] == [i % 2 for i in free]


def word_list(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def test_toxicity_scores_by_force(spark, odd):
    """Features and sums of the fitted model, spelled out word by word for every row of the table and the odd texts."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.at.tolist(), np.float32(model.weights).tolist()))
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def word(w):
        if len(w) > 64:
            return xxhash.xxh3_64_intdigest(w, 0)
        h = mix(len(w) + mix((1000 + 0x9E3779B97F4A7C15) & mask) & mask)
        for i in range(0, len(w), 8):
            h = mix(h ^ int.from_bytes(w[i : i + 8], "little"))
        return h

    def score(text):
        hashes = [word(w) for w in word_list(text)]
        found = set(hashes) | {mix((a * 3 + b * 5 + gap) & mask) for gap in (1, 2, 3) for a, b in zip(hashes, hashes[gap:])}
        total = sum(weight.get(f, 0.0) for f in {h >> 64 - toxicity.BITS for h in found})
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * total + model.offset))))

    assert weight
    for df in (docs.limit(80), odd):
        rows = df.select("doc_id", "text").collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 5)) for r in toxicity.score(df, model).collect())
        want = sorted((-1 if i is None else i, round(score(t), 5)) for i, t in rows)
        assert all(a == b and abs(x - y) <= 2e-5 for (a, x), (b, y) in zip(got, want, strict=True))


def test_ftrl_by_force():
    """The proximal update, coordinate by coordinate, in plain arithmetic."""
    r = random.Random(2)
    rows = [(sorted(r.sample(range(30), 6)), r.randrange(2)) for _ in range(60)]
    model = toxicity.FTRL(l1=0.3)
    z, n, z0, n0 = [0.0] * 30, [0.0] * 30, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for at, y in rows:
        model.learn(np.array(at), y)
        w0 = -z0 / ((model.beta + math.sqrt(n0)) / model.alpha)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-(w0 + sum(w.values())))) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * w[i]
            n[i] += g * g
        z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / model.alpha * w0
        n0 += g * g
    at, got, _ = model.sparse()
    assert at.tolist() == [i for i in range(30) if abs(z[i]) > model.l1]
    assert np.allclose(got, [weight(i) for i in at.tolist()], atol=1e-4)


def test_quality_scores_by_force(spark, odd):
    """Sizes under both dictionaries, block by block with a compressor made anew for each, and the logistic of their
    normalised difference."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    assert 0 < len(model.good) <= quality.DICT_BYTES and 0 < len(model.bad) <= quality.DICT_BYTES

    def size(text, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=quality.LEVEL)
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK))

    rows = [(r.doc_id, r.text) for r in docs.limit(40).select("doc_id", "text").collect()] + [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        a, b = (size(raw, c) for c in (model.good, model.bad))
        value = 2 * (b - a) / (a + b) if raw else 0.0
        want.append((i, 1 / (1 + math.exp(-max(-40.0, min(40.0, model.weights[0] * value + model.weights[1]))))))
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(want, key=key), strict=True))
