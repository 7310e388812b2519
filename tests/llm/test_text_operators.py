import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import decontam, queries, secret_scan, token_count
from tracelake.llm.common import WORD_LETTERS, Tokens
from tracelake.runtime import Scratch, table

SF = "/root/testdata/sf0.001"

PATH = queries.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def test_counts_of_odd_texts(odd):
    rows = token_count.count_tokens(odd, PATH).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_counts_of_whole_table(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: len(LIBRARY.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, PATH).collect()} == want


def test_counts_of_nothing(none):
    assert token_count.count_tokens(none, PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*map(chr, range(0x250)), "<|endoftext|>", " ", "\n", "'s", "\u2009", "\u3000", "東", "🙂", "\u0301"]), max_size=40).map("".join))
def test_counts_like_the_library(text):
    assert token_count.load(PATH).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def base_by_force(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


SECRETS = [
    "password=hunter2xyz and token: 'abc'", "API_KEY = AbCd1234+/ef", "apikey:=x", "secret : \"a1b2c3d4\"", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIASHORT",
    "deadbeef" * 4, "é" * 5 + "passwd=ünder123456", "TOKEN=aaaaaa token=bbbbbb", "ſecret=abcdefgh toKen=abcdefgh", "password is correct horse", "pwd: 8#kQz!vL2p", "", "   ",
]


def test_base_spans_by_force():
    r = random.Random(1)
    for _ in range(500):
        text = " ".join(r.choices(SECRETS, k=r.randrange(6)))
        assert [f"{k}:{s}:{e}" for s, e, k in secret_scan.base_spans(text)] == base_by_force(text)


def test_secret_digests(spark, odd, none):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(df)).collect()}
    for i, t in rows:
        base = base_by_force(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("guess")] == base
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
    assert "guess" in got[11].spans and "guess" not in got[10].spans
    assert secret_scan.scan(odd).count() == odd.count() and secret_scan.scan(none).count() == 0


def test_guess_cost_orders_values():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    for weak in ("password1", "P@ssw0rd", "aaaaaaaaaa", "qwertyuiop", "2024-01-31", "abcabcabcabc", "12345678"):
        assert cost(weak) < secret_scan.DEFAULT_THRESHOLD, weak
    for strong in ("k3J9xQ2mZp", "b7db7aa4a5fcc78305", "8#kQz!vL2p", "xkqzjvwpmtrbhd", "XKQZJVWPMT"):
        assert cost(strong) >= secret_scan.DEFAULT_THRESHOLD, strong
    words = queries.known_words()
    assert len(words) > 20_000 and words["password"] == 1
    for plain in ("information", "Entwicklung", "international", "monkey1999", "january2024"):
        assert cost(plain, words) < secret_scan.DEFAULT_THRESHOLD < cost(plain.translate(str.maketrans("aeiot", "xqzjk")), words) + 4, plain
    for strong in ("k3J9xQ2mZp", "xkqzjvwpmtrbhd"):
        assert cost(strong, words) >= secret_scan.DEFAULT_THRESHOLD, strong


def test_long_values_are_costed_as_a_whole():
    cost = secret_scan.guess_cost
    unit = "kx93qmzt"
    assert abs(cost(unit * 24) - cost(unit * 12) - math.log10(2)) < 1e-9
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    assert cost(long) > 10_000


def cost_by_force(value, ranks):
    """The cheapest of all ways to cut the value into segments, each priced by what it is."""
    low = value.lower()
    digit = lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33

    def price(a, b):
        part, shown, n = value[a:b], low[a:b], b - a
        brute = [math.log10(digit(c)) for c in part]
        costs = [sum(brute)]
        if n >= 3:
            for form, extra in ((shown, 0.0), (shown.translate(secret_scan.LEET), 0.3)):
                if form in ranks:
                    costs.append(math.log10(ranks[form] + 1) + extra + (0.6 if part != shown else 0.0))
        if n >= 4 and all(frozenset(x) in secret_scan.NEXT_KEYS for x in zip(shown, shown[1:])):
            costs.append(math.log10(188 * n))
        if n >= 3 and {ord(y) - ord(x) for x, y in zip(shown, shown[1:])} in ({1}, {-1}):
            costs.append(math.log10(40 * n))
        if n >= 4 and part[0].isdigit() and part[-1].isdigit() and secret_scan.date_cost(part) is not None:
            costs.append(secret_scan.date_cost(part))
        for unit in range(1, n // 2 + 1):
            if n >= 3 and n % unit == 0 and shown == shown[:unit] * (n // unit):
                costs.append(sum(brute[:unit]) + math.log10(n // unit))
        return min(costs)

    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[a] + price(a, end) + (math.log10(2) if a else 0.0) for a in range(end)))
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abqwert12@P-09", max_size=14))
def test_cost_is_that_of_the_cheapest_segmentation(value):
    ranks = {**secret_scan.RANK, "wert": 40, "tre": 9, "bat": 3}
    assert math.isclose(secret_scan.guess_cost(value, ranks), cost_by_force(value, ranks), abs_tol=1e-9)


@pytest.mark.parametrize("value", ["password2024password", "P@ssw0rd1999-12-31", "qwertyuiopabcabcabc", "abcdefg7654321", "aaaa1111bbbb"])
def test_cost_of_mixed_values(value):
    assert math.isclose(secret_scan.guess_cost(value), cost_by_force(value, secret_scan.RANK), abs_tol=1e-9)


def test_guess_spans_are_found_over_the_table(spark):
    """Every span of the registered query beside the base kinds: a context's value, priced by all segmentations."""
    words = queries.known_words()
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r.spans for r in queries.op5_secrets(spark, SF).collect()}
    for doc, text in docs:
        spans = [x.split(":") for x in got[doc].split(",") if x]
        want = []
        for m in secret_scan.CONTEXT.finditer(text or ""):
            value = m[1].rstrip(".,;:)]}>")
            if value and len(value) <= 40 and cost_by_force(value, words) >= secret_scan.DEFAULT_THRESHOLD:
                want.append((m.start(1), m.start(1) + len(value)))
        assert want == [(int(s), int(e)) for k, s, e in spans if k == "guess" and int(e) - int(s) <= 40]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=hunter2xyz b", "x", 23), (2, None, "y", 0), (3, "clean text", "z", 10)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.redact_documents(df).collect()}
    assert got[1].text == "a [REDACTED] b" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3] == df.where("doc_id = 3").first()
    assert secret_scan.all_spans(got[1].text) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits_by_force(docs, items):
    windows = {}
    for item, t in items:
        w = lower(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in docs:
        w, found = lower(t), set()
        hit = [False] * len(w)
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (run := tuple(w[p : p + n])) in windows:
                    found |= windows[run]
                    hit[p : p + n] = [True] * n
        out.append((-1 if doc is None else doc, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out)


def benchmark_rows(docs):
    texts = [t for _, t in docs if t]
    return [
        (0, texts[4]), (1, "one"), (2, None), (3, ""), (4, "la la la la la la la la la la la la"), (5, " ".join(texts[-1].split()[:12])), (5, "two words"), (None, "naïve café"), (10, "nothing of this is there at all in any document"),
        (11, "Two, WORDS!"),
    ]


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_odd_texts(spark, odd, most):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = benchmark_rows(docs)
    got = decontam.find_contamination(odd, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == hits_by_force(docs, items)


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_whole_table(spark, most):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = hits_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, decontam.find_contamination(docs, items, most=most).collect())) == want
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, items, most=most).collect()}
    assert kept == {r[0] for r in want if not r[5]}


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontamination_of_nothing(spark, odd, none, most):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(none, empty, most=most).collect() == []
    assert not any(r.contaminated for r in decontam.find_contamination(odd, empty, most=most).collect())


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_contaminated_rows_go_by_row_not_by_id(spark, most):
    """Null and repeated ids: only the rows that hold the passage go, both ways."""
    passage = " ".join(f"p{i}" for i in range(10))
    rows = [(1, "clean one"), (1, f"x {passage} y"), (2, passage), (3, "clean"), (3, "clean"), (None, f"{passage} z"), (None, "clean too"), (None, None), (4, f"a {passage}"), (4, f"a {passage}")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(7, passage)], "item_id long, text string"), most=most)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [0, 3, 4, 6, 7]


def twins():
    """Two words of 512 bytes over two letters, each the other with the letters exchanged, that polynomial hashes modulo
    powers of two cannot tell apart."""
    bits = [i.bit_count() % 2 for i in range(512)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_words_are_compared_and_not_only_hashed(spark, most):
    one, other = twins()
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {other} y")], "doc_id long, text string")
    got = decontam.find_contamination(docs, spark.createDataFrame([(7, one)], "item_id long, text string"), most=most)
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 1, 2: 0}


def test_containment_does_not_rest_on_hashes(monkeypatch):
    """With one hash for all shingles everything is a candidate, and the words decide."""
    monkeypatch.setattr(Tokens, "shingles", lambda self, k, seed=0: np.zeros(max(0, len(self.doc) - k + 1), np.uint64))
    index = decontam.WindowIndex([("1", b"a b c d e f", 6, [0, 0]), ("2", b"c d", 2, [0])], {})
    text = b"z a b c d e f g c d"
    start, window = index.find(Tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORD_LETTERS))
    assert sorted((int(s), index.words.text(int(index.words.first[w]), int(index.size[w]))) for s, w in zip(start, window)) == [(1, b"a b c d e f"), (3, b"c d"), (8, b"c d")]


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(3), "x")
    assert kept.count() == 3
    scratch.drop(kept)
