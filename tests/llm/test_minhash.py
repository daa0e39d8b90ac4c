import random
import re
from collections import defaultdict

import numpy as np

from yieldloom.llm import minhash
from yieldloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(data, width, percent):
    """doc_id -> (set size, component), for distinct ids."""
    sets, parent = {}, {}
    for i, text, *_ in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((40, 90, 150)))] for _ in range(4)]
    data = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(words) if i % 7 else " ".join(words).upper() + "\t\n", "en", "s", 1))
    data += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n", "en", "s", 0), (n + 3, "two words", "en", "s", 0), (n + 4, "Two\x0bWORDS", "en", "s", 0), (n + 5, "two words É", "en", "s", 0), (n + 6, "two words é", "en", "s", 0), (n + 7, "z " * 700_000, "en", "s", 0)]
    return data


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)
    for width, percent, stars in ((3, 85, 3), (5, 80, 0)):
        monkeypatch.setattr(minhash, "STARS", stars)
        data = corpus(width, 150)
        want = brute(data, width, percent)
        got = minhash.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(3), width, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_nulls_and_stage(spark):
    text = " ".join(f"a{k}" for k in range(60))
    data = [(5, text, "en", "s", 1, 1), (5, text, "en", "s", 1, 2), (3, text + " end", "en", "s", 1, 3), (None, text, "en", "s", 1, 4), (9, None, None, None, None, 5)]
    docs = spark.createDataFrame(data, SCHEMA + ", gone_id long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (9, 9, True)], key=str)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.gone_id for r in kept.collect()) == [3, 4, 5]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    ladder = [(i, i + 1) for i in range(0, 40)]
    shuffled = rng.sample(range(1000, 1060), 60)
    edges = ladder + [(100, 101), (101, 100), (7, 7)] + list(zip(shuffled, shuffled[1:], strict=False)) + [(2000, 2000 + k) for k in range(1, 50)]
    edges += [(rng.randrange(3000, 3060), rng.randrange(3000, 3060)) for _ in range(50)]
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, a)
            want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert connected_components(spark.createDataFrame([(5, 3)], "src long, dst long").where("src > 0")).count() == 2


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:-40], np.arange(40, dtype=np.uint64) * np.uint64(2**57) + np.uint64(12345)])
    b.sort()
    shared = defaultdict(int)
    values = [(np.array([(s * minhash._odd[p]).min() for s in (a, b)]), np.array([(s * minhash._odd[p]).max() for s in (a, b)])) for p in range(minhash.PERMUTATIONS)]
    for low, high in values:
        shared["low"] += low[0] == low[1]
        shared["high"] += high[0] == high[1]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    for side in ("low", "high"):
        assert abs(shared[side] / minhash.PERMUTATIONS - true) < 0.15


def test_a_large_family_is_joined_by_its_hub(spark, monkeypatch):
    """Copies with up to three changed words of 150 are linked to the document in the middle, not to each
    other: one round joins them, and only what isn't linked is compared in blocks."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]

    def copy(edits):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(150)] = f"x{rng.randrange(10**7)}"
        return " ".join(words)

    data = [(i, copy(rng.choice((0, 1, 2, 3, 3))), "en", "s", 1) for i in range(1500)] + [(5000 + i, copy(9), "en", "s", 1) for i in range(30)]
    left = []

    def across(named, body, percent, own=minhash._across_labels):
        left.append(named.groupBy("label").agg({"vertex": "count"}).count())
        return own(named, body, percent)

    monkeypatch.setattr(minhash, "_across_labels", across)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {got[i] for i in range(1500)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(30))
    assert left == [1] or left[0] <= 31


def test_rows_that_share_an_id_are_one_document(spark):
    """Links of all rows of an id count, also where the smallest ids of two sets are the same."""
    texts = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcd"}
    cases = [
        ([(3, "a"), (5, "a"), (5, "b"), (7, "b")], {3: 3, 5: 3, 7: 3}),
        ([(3, "a"), (3, "b"), (4, "b"), (9, "c"), (9, "d"), (8, "d"), (9, "a")], {3: 3, 4: 3, 8: 3, 9: 3}),
        ([(1, "a"), (1, "b"), (1, "c"), (2, "d")], {1: 1, 2: 2}),
    ]
    for rows, want in cases:
        near = [(i, texts[t] + (" end" if k % 2 else ""), "en", "s", 1) for k, (i, t) in enumerate(rows)]
        got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(near, SCHEMA)).collect()]
        assert sorted(got) == sorted((i, want[i], want[i] == i) for i, _ in rows)
