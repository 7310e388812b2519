import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tracelake.llm import similarity, simhash, substring_dedup
from tracelake.llm.common import mix, splitmix
from tracelake.llm.components import connected_components
from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch, table

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed_by_force(docs, window=20):
    key = lambda i: -(1 << 63) if i is None else i
    first, out = {}, []
    lists = [(key(i), WORD.findall(t or "")) for i, t in docs]
    for i, w in lists:
        for p in range(len(w) - window + 1):
            run = tuple(w[p : p + window])
            first[run] = min(first.get(run, (i, p)), (i, p))
    for (i, w), (doc, _) in zip(lists, docs):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def components_by_force(docs, k=4):
    prints = []
    for _, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        runs = [" ".join(w[p : p + k]) for p in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return Counter((doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(docs))


def words(seed, n, size=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_substring_dedup_of_odd_texts(odd):
    assert Counter(map(tuple, substring_dedup.digests(odd).collect())) == removed_by_force(pairs(odd))


def test_substring_dedup_returns_texts(odd):
    rows = substring_dedup.dedup(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows) == removed_by_force(pairs(odd))


def test_substring_dedup_of_whole_table(spark):
    docs = table(spark, SF, "documents")
    assert Counter(map(tuple, substring_dedup.digests(docs).collect())) == removed_by_force(pairs(docs))


def test_substring_dedup_of_nothing(none):
    assert substring_dedup.digests(none).collect() == []


def test_substring_dedup_of_few_words(spark):
    """Texts over two words: loops, branches and overlaps everywhere."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["a", "b"]) if r.random() < 0.1 else "a" for _ in range(r.randrange(150)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, substring_dedup.digests(docs).collect())) == removed_by_force(rows)


def test_long_pieces_are_split(monkeypatch, spark):
    monkeypatch.setattr(substring_dedup, "LONGEST_PIECE", 16)
    rows = [(1, "la " * 200), (2, "la " * 90 + "b " + "la " * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup.digests(docs).collect())) == removed_by_force(rows)


def test_words_that_weak_hashes_confuse(spark):
    bits = [i.bit_count() % 2 for i in range(512)]
    one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    line = " ".join(f"k{i}" for i in range(10))
    rows = [(1, f"{line} {one} {line}"), (2, f"{line} {other} {line}"), (3, f"{line} {one} {line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, substring_dedup.digests(docs).collect())) == removed_by_force(rows)


def test_paths_are_compacted_and_name_their_sources(spark):
    """Two passages share their middle: the path branches there, and each span lies on one path of one source."""
    a, b, middle = words(31, 60), words(32, 60), words(33, 60)
    rows = [(1, f"{a} {middle} {b}"), (2, f"x {a} {middle} {b} y"), (3, f"z {middle} z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "test")
    found = substring_dedup.repeated_edges(substring_dedup.keyed(docs), scratch, 20, 6, 0)
    spans = substring_dedup.compacted_spans(found).collect()
    got = sorted((r.start, r.n, r.s_start) for r in spans)
    assert len(spans) <= 6 and sum(n for _, n, _ in got) == (180 - 19) + (60 - 19)
    assert {r.n for r in spans if r.start - r.s_start == 1 - 60} == {41}


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup_of_loops_and_long_texts(spark, parts):
    loop = " ".join(["a b c"] * 3000)
    rows = [(1, loop), (2, "x " + loop), (3, "q " * 25), (4, words(34, 30_000)), (5, words(34, 30_000) + " end"), (None, loop)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert Counter(map(tuple, substring_dedup.digests(docs).collect())) == removed_by_force(rows)


def test_simhash_of_odd_texts(odd):
    assert Counter(map(tuple, simhash.shown(simhash.near_duplicates(odd)).collect())) == components_by_force(pairs(odd))


def test_simhash_of_whole_table(spark):
    docs = table(spark, SF, "documents")
    assert Counter(map(tuple, simhash.shown(simhash.near_duplicates(docs)).collect())) == components_by_force(pairs(docs))


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).collect() == []


def test_large_groups_are_tiled(spark):
    """Fingerprints near one centre: tiles of 8 give the components that all pairs give."""
    r = np.random.default_rng(5)
    centre = [int(x) for x in r.integers(0, 1 << 62, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for c in centre for _ in range(120)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark, "test")
    edges = [(e.a, e.b) for e in simhash.links(df, scratch, tile=8).collect()]
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= 4 for a, b in edges)

    def roots(links):
        parent = {x: x for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {x: root(x) for x in signed}

    force = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a & mask) ^ (b & mask)).bit_count() <= 4]
    want = roots(force)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(roots(edges)) == groups(want)
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(force, "a long, b long"), scratch).collect()}
    assert groups({x: found.get(x, x) for x in signed}) == groups(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = {x.node: x.root for x in connected_components(edges, Scratch(spark, "test")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_every_pair_shares_a_key():
    r = random.Random(9)
    for n in (10, 10_000, 10_000_000, 10**11):
        keys = simhash.scheme(n)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(all((x >> b & 1) == (y >> b & 1) for b in bits) for _, bits in keys)


def test_keep_one(odd, none):
    keep = similarity.keep_one_similar
    kept = keep(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    ids = {i for i, _ in rows}
    assert len(rows) == len(set(rows)) and {0, 5, 10, 21} <= ids and not ids & {1, 2, 6, 12, 20, None}
    assert keep(none).collect() == []


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("tile", [1024, 8])
def test_similar_texts_go_and_others_stay(spark, tile):
    """Copies with a changed word here and there: those well above the threshold go, those well below it stay."""
    r = random.Random(11)
    rows = []
    for base in range(30):
        own = [f"w{r.randrange(3000)}" for _ in range(300)]
        for changes in (0, 0, 2, 4, 30, 60):
            copy = list(own)
            for at in r.sample(range(300), changes):
                copy[at] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    kept = {x.doc_id for x in similarity.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    for i, t in rows:
        near = max([jaccard(t, u) for j, u in rows[i // 6 * 6 : i]], default=0)
        assert (i in kept) or near >= 0.7, (i, near)
        assert (i not in kept) or near <= 0.9, (i, near)


def test_hubs_and_hot_keys_leave_the_result_as_it_is(spark):
    """A star of 3,000 leaves, a chain, and a clique: components are those of union-find, whatever the hubs."""
    edges = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(5000, 5060)] + [(a, b) for a in range(6000, 6020) for b in range(6000, a)] + [(7000 + i, 7500) for i in range(200)]
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark, "test")).collect()}
    want = {n: (0 if n <= 3000 else 5000 if n < 5100 else 6000 if n < 6100 else 7000) for e in edges for n in e}
    assert found == want
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (3, 1), (None, 5)], "k long, i long")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (4, "four")], "k long, name string")
    for how in ("inner", "left"):
        got = skew_join(left, right, ["k"], how).select("k", "i", "name").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, left.join(right, ["k"], how).select("k", "i", "name").collect()))


def kept_ids(spark, rows):
    return {x.doc_id for x in similarity.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_similarity_is_exact_at_the_threshold(spark):
    """Pairs at and just above 0.8 all go, pairs just below it all stay; texts of 8 words and of hundreds."""
    r = random.Random(17)
    rows, gone = [], set()
    for pair in range(400):
        n = (8, 10, 24, 104, 404)[pair % 5]
        own = [f"w{r.randrange(10**9)}" for _ in range(n)]
        shingles = n - 4
        # cut from the front: of s shingles s - c stay, which is the similarity; 0.8 and the next one below
        cut = shingles // 5 + (pair // 5) % 2
        if n == 8:  # 4 of 5 shingles, and 4 of 6
            other, own = own, own + [f"x{r.randrange(10**9)}" for _ in range(1 + (pair // 5) % 2)]
        else:
            other = own[cut:]
        rows += [(2 * pair, " ".join(own)), (2 * pair + 1, " ".join(other))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            gone.add(2 * pair + 1)
    assert 150 < len(gone) < 250
    assert kept_ids(spark, rows) == {i for i, _ in rows} - gone


def test_candidates_chain_but_only_similar_texts_are_joined(spark):
    """Windows that slide over one long text are all candidates of their neighbours, none at 0.8."""
    r = random.Random(19)
    long = [f"w{r.randrange(10**9)}" for _ in range(3000)]
    rows = [(i, " ".join(long[at : at + 104])) for i, at in enumerate(range(0, 2800, 14))]
    assert max(jaccard(a[1], b[1]) for a, b in zip(rows, rows[1:])) < 0.8
    assert kept_ids(spark, rows) == {i for i, _ in rows}


def test_decisions_follow_the_similarity_and_not_the_size(spark):
    """Pairs around 0.8 are decided by their exact similarity, alone and among thousands of other texts."""
    r = random.Random(23)
    rows = []
    for pair in range(150):
        own = [f"w{r.randrange(10**9)}" for _ in range(204)]
        cut = 34 + pair % 13
        rows += [(2 * pair, " ".join(own)), (2 * pair + 1, " ".join(own[cut:]))]
    others = [(1000 + i, " ".join(f"x{r.randrange(10**9)}" for _ in range(20))) for i in range(3000)]
    want = {i for i, t in rows if i % 2 == 0 or jaccard(t, rows[i - 1][1]) < 0.8}
    assert kept_ids(spark, rows) == want
    assert kept_ids(spark, rows + others) == want | {i for i, _ in others}


def test_candidates_come_from_simhash_blocks(spark, monkeypatch):
    """The bits of each class are set where over half of its shingles' hashes have them, whatever the text's length."""
    seen = {}
    ties = similarity.candidate_ties

    def spy(classes, plan):
        seen["plan"], seen["fps"] = plan, {r.fp for r in classes.collect()}
        return ties(classes, plan)

    monkeypatch.setattr(similarity, "candidate_ties", spy)
    rows = [(i, words(100 + i, n, 10**6)) for i, n in enumerate((8, 9, 30, 259, 260, 700))] + [(10, "too short to be near another"), (11, None)]
    assert kept_ids(spark, rows) == {i for i, _ in rows}
    want = {b""}
    for _, text in rows[:6]:
        w = text.encode().split()
        hashes = np.array(sorted({xxhash.xxh64_intdigest(b" ".join(w[p : p + 5]), 42) for p in range(len(w) - 4)}), np.uint64)
        each = [int(x) for x in splitmix(seen["plan"].slices * 4, 97)]
        value = b""
        for salt in each:
            mixed = mix(hashes ^ np.uint64(salt))
            value += np.packbits(np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=int) * 2 > len(hashes)).tobytes()
        want.add(value)
    assert seen["fps"] == want


@pytest.mark.parametrize("group", [1 << 20, 300])
def test_pairs_at_the_similarity_are_candidates(spark, group):
    """Pairs of sets at 0.8, of 4 shingles and more, all meet, also where slices are dealt over groups; strangers do not."""
    r, plan = np.random.default_rng(29), similarity.scheme(3000, 0.8, group)
    assert (plan.route > 0) == (group < 3000)
    rows = []
    for pair in range(1500):
        n = (5, 10, 15, 25, 100)[pair % 5]
        own = r.integers(0, 1 << 63, n).astype(np.uint64)
        rows += [(2 * pair, similarity.fingerprint(own, plan.slices)), (2 * pair + 1, similarity.fingerprint(own[: n * 4 // 5], plan.slices))]
    classes = spark.createDataFrame([*rows, (9999, b"")], "cls long, fp binary").repartition(3)
    found = {(min(e), max(e)) for e in similarity.candidate_ties(classes, plan).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(1500)}


def test_chance_of_a_miss_is_alike_at_every_size():
    for n in (1, 10**4, 10**7, 10**10):
        plan = similarity.scheme(n)
        assert similarity.missed(similarity.worst_share(0.8), plan.route, plan.limit) ** plan.slices <= similarity.MISSED
        assert n >> plan.route <= similarity.GROUP_CLASSES
    assert similarity.bit_share(5, 4, 4) == similarity.worst_share(0.8) == 0.1875
    assert similarity.scheme(1).least == 4


def test_large_blocks_join_all_that_is_near():
    """A chain of small steps within one large block, a dense cluster and strangers: components are those of all pairs."""
    r = np.random.default_rng(31)
    words = r.integers(0, 1 << 63, (900, 4)).astype(np.uint64)
    for i in range(1, 300):  # each differs from the one before in up to 40 bits
        words[i] = words[i - 1]
        for b in r.integers(0, 256, 40).tolist():
            words[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    words[300:700] = words[300]
    words[300:700, 3] ^= np.arange(400, dtype=np.uint64)
    words = words[r.permutation(900)]
    ties = similarity._Ties(words, 58)
    ties.block(np.zeros(900, np.uint16))
    apart = np.bitwise_count(words[:, None] ^ words).sum(axis=2) <= 58
    name = np.arange(900)
    while ((new := np.where(apart, name, 900).min(axis=1)) != name).any():
        name = new
    roots = ties.roots(np.arange(900))
    assert len(set(zip(roots.tolist(), name.tolist()))) == len(set(roots.tolist())) == len(set(name.tolist())) < 220
    assert all(apart[a, b] or name[a] == name[b] for a, b in zip(np.concatenate(ties.a), np.concatenate(ties.b)))
