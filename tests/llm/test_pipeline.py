"""The corpus pipeline against a brute-force version of each stage, over a table of nulls, ties, odd and repeated rows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tracelake.llm import packing, queries, secret_scan, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, r1 long, r2 long, kept string, row string, same string, `a.b` string, `__hot_key` boolean"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "letter", "garden", "window", "summer", "bread", "music", "paper", "night"]) + str(r.randrange(900)) for _ in range(n))


def toxic(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["vile", "rotten", "hateful", "filth", "scum"]) + str(r.randrange(4)) for _ in range(n))


def table_rows():
    texts, r = [], random.Random(5)
    passage = prose(900, 10)
    for i in range(120):
        texts.append((i, prose(i, 60)))
    for i in range(120, 170):
        texts.append((i, toxic(i, 40)))
    texts += [(200 + i, prose(i, 60)) for i in range(10)]  # exact copies
    texts += [(220 + i, " ".join(prose(20 + i, 60).split()[:57])) for i in range(10)]  # near ones
    texts += [(240, f"{prose(801, 20)} {passage.upper()} {prose(802, 20)}"), (241, passage), (240, prose(803, 30)), (None, f"x {passage} y"), (None, prose(804, 30))]
    texts += [(250, f"{prose(805, 12)} password=hunter2xyz and {prose(806, 9)}"), (251, f"pwd: k3J9xQ2mZpT7 {prose(807, 12)}"), (252, "AKIA" + "B7" * 10)]
    texts += [(260, None), (261, ""), (262, "   "), (None, None), (263, "one"), (264, "one"), (265, "x" * 30_000), (266, prose(808, 9000)), (267, "naïve 東京 🙂")]
    texts += [(270, prose(809, 25))] * 3
    r.shuffle(texts)
    return [(i, t, "en", "s", None if t is None else len(t), 1, 2, "k", "w", "m", "d", True) for i, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(table_rows(), COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    known = [(i, 1, 0) for i in range(120)] + [(i, 0, 1) for i in range(120, 170)] + [(240, None, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    items = [(1, prose(900, 10)), (2, None), (3, ""), (1, prose(901, 14))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()


def one_of_each_group(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            whole = len(sets[i] | sets[j])
            if not whole or len(sets[i] & sets[j]) / whole >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def lower_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items):
    w = lower_words(text)
    windows = {tuple(i[p : p + 10]) for i in map(lower_words, items) if i for p in range(max(1, len(i) - 9))}
    return any(tuple(w[p : p + len(x)]) == x for x in windows for p in range(len(w) - len(x) + 1))


def test_stages_by_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    scores = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), 0.3).collect()
    want = Counter(r.doc_id for r in scores if not r.predicted)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert not any(120 <= (i or 0) < 170 for i in want) and all(i in want for i in range(120))

    rows = [tuple(r) for r in kept.collect()]
    kept = spark.createDataFrame(rows, docs.schema)
    near = stage["near_dedup"](spark, kept, folder)
    assert near.columns == docs.columns
    groups = one_of_each_group(rows)
    # of rows of one group that have the same smallest id any one may stay
    assert Counter(r.doc_id for r in near.collect()) == Counter(r[0] for r in groups)
    assert {tuple(r) for r in near.collect()} <= set(rows)

    rows = [tuple(r) for r in near.collect()]
    near = spark.createDataFrame(rows, docs.schema)
    clean = stage["decontamination"](spark, near, folder)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns
    assert Counter(map(tuple, clean.collect())) == Counter(r for r in rows if not contaminated(r[1], items))

    rows = [tuple(r) for r in clean.collect()]
    clean = spark.createDataFrame(rows, docs.schema)
    safe = stage["secrets"](spark, clean, folder)
    words = queries.known_words()
    want = []
    for r in rows:
        text = r[1] and secret_scan.redact(r[1], secret_scan.all_spans(r[1], ranks=words))
        want.append((r[0], text, *r[2:4], len(text) if text != r[1] else r[4], *r[5:]))
    assert safe.columns == docs.columns and Counter(map(tuple, safe.collect())) == Counter(want)
    assert not any("hunter2xyz" in (r[1] or "") or "k3J9xQ2mZpT7" in (r[1] or "") or "AKIAB7" in (r[1] or "") for r in want)

    packed = stage["packing"](spark, spark.createDataFrame(want, docs.schema), folder).collect()
    lengths = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in want]
    assert Counter(p.n_tokens for p in packed) == Counter(lengths) and Counter(p.doc_id for p in packed) == Counter(r[0] for r in want)
    batches = {}
    for p in packed:
        batches.setdefault(p.batch_id, []).append(p)
    assert all(len(b) * b[0].boundary <= packing.TOKEN_BUDGET or len(b) == 1 for b in batches.values())


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame([tuple(r) for r in stage(spark, docs, folder).collect()], docs.schema)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())


def test_run_over_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
