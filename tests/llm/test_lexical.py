"""Search against plain scoring of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from yieldloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    fold = {k: k + 32 for k in range(65, 91)}
    return TERM.findall((text or "").translate(fold))


def plain(docs, items, top=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    pooled = {}
    for item, text in items:
        pooled.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, asked in pooled.items():
        scores = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, top=20):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, score int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(d, q, top).collect()), key=str)


def corpus(seed, n):
    """Documents of a few topics, with words that all share and passages that some repeat."""
    rng = np.random.default_rng(seed)
    topics = [[f"w{t}x{k}" for k in range(40)] for t in range(6)]
    shared = [f"the{k}" for k in range(12)]
    docs = []
    for i in range(n):
        own = topics[i % 6]
        words = rng.choice(own, 20 + i % 30).tolist() + rng.choice(shared, 15).tolist()
        docs.append((i, " ".join(words).title()))
    items = [(q, " ".join(rng.choice(topics[q % 6], 8).tolist() + rng.choice(shared, 4).tolist())) for q in range(12)]
    return docs, items


def test_shards_of_topical_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 300)
    docs, items = corpus(1, 900)
    assert run(spark, docs, items) == plain(docs, items)


def test_blocks_are_skipped(spark):
    """With the score needed known, most documents that have a term of an item are not scored."""
    docs, items = corpus(2, 3000)
    vocabulary, pooled = {}, {}
    for q, text in items:
        pooled[q] = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text))
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = lexical.vectors(table, {t.encode(): k for t, k in vocabulary.items()})
    df = lexical.frequencies(found)
    weights = np.array([lexical.weight(3000, df.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    total = found.agg({"n": "sum"}).first()[0]
    shards = lexical.index(found, pooled, len(vocabulary), 3000, total)
    best = lexical.ranked(shards, pooled, weights, {}, 20).groupBy("item").agg({"score": "min", "scored": "max"}).collect()
    needed = {r["item"]: r["min(score)"] for r in best}
    scored = {r["item"]: r["scored"] for r in lexical.ranked(shards, pooled, weights, needed, 20).collect()}
    held = [(i, set(terms(t))) for i, t in docs]
    matching = {q: sum(any(t in own for t in set(terms(text))) for _, own in held) for q, text in items}
    assert set(scored) == set(matching)
    assert all(scored[q] < 0.7 * matching[q] for q in matching), (scored, matching)


def test_blocks_hold_each_document_once():
    rng = np.random.default_rng(0)
    sketch = rng.standard_normal((2000, 8)).astype(np.float32)
    for rows in (np.arange(0, 2000, 2, dtype=np.int32), np.array([7], np.int32), np.arange(2000, dtype=np.int32)):
        ordered, begins = lexical.blocked(rows, sketch)
        assert sorted(ordered.tolist()) == rows.tolist()
        assert begins[0] == 0 and np.diff([*begins, len(rows)]).max() <= lexical.MOST


def test_odd_rows(spark):
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (2, "alpha, BETA!"), (3, None), (4, ""), (5, "... !!"), (None, "alpha beta"), (6, "Ärger ärger Äx"), (7, "alpha " * 200_000), (8, "gamma_delta gamma")]
    items = [(1, "alpha BETA beta"), (2, None), (3, "?!"), (4, "ärger Ärger"), (5, "nowhere"), (6, "gamma"), (6, "delta"), (None, "beta")]
    for top in (2, 20):
        assert run(spark, docs, items, top) == plain(docs, items, top)
    assert run(spark, docs[:0], items) == [] == run(spark, docs, items[:0])


@pytest.mark.parametrize("size", [64, 10_000])
def test_ties_and_item_blocks(spark, monkeypatch, size):
    """Hundreds of copies tie: the smallest ids stay. Items in several blocks give the same."""
    monkeypatch.setattr(lexical, "ITEM_BYTES", size)
    monkeypatch.setattr(lexical, "SHARD", 100)
    docs = [(k, "same words here") for k in range(400, 0, -1)] + [(1000, "same same"), (2000, "other")]
    items = [(k, t) for k, t in enumerate(("same words", "here", "other same", "nothing at all", "words of others"))]
    assert run(spark, docs, items) == plain(docs, items)
