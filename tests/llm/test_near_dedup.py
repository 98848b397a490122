import random

import pytest

from fathomry.llm import near_dedup
from fathomry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """{doc_id: (n_shingles, least reachable doc_id)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split(" ")]
        w = [x for y in w for x in y.split() if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, rng, rate):
    return " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.random()) if rng.random() < rate else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 400))]
        rows += [edited(base, rng, rate) for rate in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [passage + " " + " ".join(f"q{rng.randrange(4000)}" for _ in range(150)) for _ in range(40)]
    rows += ["", " \n", "One two", "one TWO", "one two three", None, "Ünï ünï", "ünï ünï"]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("blocks", [None, (8, 2000)])
def test_matches_brute_force(spark, corpus, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(near_dedup, "KEY_BLOCK", blocks[0])
        monkeypatch.setattr(near_dedup, "SET_BLOCK", blocks[1])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in corpus], SCHEMA).repartition(4)
    got = near_dedup.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == brute(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_edges(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, a, None, None, None), (7, a, None, None, None), (5, b, None, None, None), (7, b, None, None, None), (None, a, None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fp string, node int")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.component_id, r.kept) for r in got} >= {(5, 5, True), (7, 5, False)}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.where("doc_id is not null").collect()] == [5]
    empty = docs.where("1 = 0")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one(empty).count() == 0


def test_pigeonhole(spark):
    """Every pair within the guaranteed distance shares a key."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    most = near_dedup.REACH
    for _ in range(50):
        a = rng.integers(0, 65536, near_dedup.K).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.K, most, replace=False)] ^= 1
        frame = pd.DataFrame({"rep": [1, 2], "sig": [a.tobytes(), b.tobytes()]})
        keys = pd.concat(near_dedup._keys(iter([frame])))
        assert set(keys.key[keys.rep == 1]) & set(keys.key[keys.rep == 2])


def near(text, k):
    """The text with its word k replaced."""
    w = text.split()
    w[k] = f"other{k}"
    return " ".join(w)


def test_texts_of_one_document_link_their_copies(spark):
    """Near copies of either text of a document, and of repeated rows, are one component; no row is lost or multiplied."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rows = [(10, a), (10, b), (20, near(a, 3)), (30, near(b, 5)), (30, near(b, 5)), (5, near(b, 70)), (40, a), (50, c), (60, near(c, 9)), (60, near(c, 9)), (60, near(c, 9))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, 50 if i in (50, 60) else 5) for i, _ in rows)


def test_recall_at_the_threshold(spark):
    """Made pairs just above similarity 0.75: no link is lost."""
    rng = random.Random(11)
    rows, pairs = [], 0
    for n in (40, 150, 400):
        for _ in range(300):
            base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            other, have = list(base), base
            while True:
                at = rng.randrange(n)
                other = [*have[:at], f"u{rng.randrange(10**6)}", *have[at + 1 :]]
                x, y = ({tuple(w[k : k + 5]) for k in range(n - 4)} for w in (base, other))
                if 100 * len(x & y) < 75 * len(x | y):
                    break
                have = other
            if have is not base:
                pairs += 1
                rows += [(2 * pairs, " ".join(base)), (2 * pairs + 1, " ".join(have))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert pairs > 800 and got.where("not kept").count() == pairs


def test_hub(spark):
    """A label at most nodes, itself linked further down."""
    links = [(k, 100) for k in range(101, 3000)] + [(100, 7), (7, 3), (5000, 2999), (6000, 4000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "node long, label long"), "hub").collect()}
    assert got == {k: 3 for k in [7, 100, *range(101, 3000), 5000]} | {6000: 4000}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(99, 40), (99, 50), (60, 50)], "node long, label long")
    got = {r.node: r.root for r in components(links, "chain").collect()}
    assert got == {k: 0 for k in [*range(1, 41), 50, 60, 99]}
    assert components(links.where("1 = 0"), "none").count() == 0
