"""The pipeline's stages, each held against plain Python on what its predecessor kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from test_exact_mixing import fold
from test_minhash import brute
from tokenizers import Tokenizer

import corpus_pipeline
from yieldloom.llm import language, mixing, packing
from yieldloom.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    """The given documents, copies in capitals, near copies, texts without letters, nulls and a repeated row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id < 6")
    upper = some.select(F.lit(10**6) + F.col("doc_id"), F.upper("text"), "lang", "source", "n_chars").toDF(*COLUMNS)
    near = docs.where("length(text) > 900").limit(20).select(F.lit(2 * 10**6) + F.col("doc_id"), F.concat("text", F.lit(" closing words")), "lang", "source", "n_chars").toDF(*COLUMNS)
    junk = spark.createDataFrame([(3 * 10**6, "123 456", "en", "src1", 7), (3 * 10**6 + 1, None, None, None, None), (3 * 10**6 + 2, "", "en", None, 0), (None, "words without an id " * 9, "en", None, 0)], docs.schema)
    return docs.unionByName(upper).unionByName(near).unionByName(junk).unionByName(some.limit(1))


def has_letter(text):
    return any(c.isalpha() for c in text or "")


def plain_slots(rows, block=16, alpha=0.7):
    """Slot of each row by earliest-deadline-first over the tempered weights, found by a scan of all sources."""
    counts = Counter(r.source for r in rows)
    whole = mixing.fine_weights(mixing.tempered(counts, alpha), {s: -(-k // block) for s, k in counts.items()})
    total, done = sum(whole.values()), Counter()
    names = sorted(whole, key=lambda s: (s is not None, s or ""))
    at = defaultdict(list)
    for slot in range(total):
        open_ = [s for s in names if done[s] * total // whole[s] <= slot and done[s] < whole[s]]
        best = min(open_, key=lambda s: (-(-(done[s] + 1) * total // whole[s]), names.index(s)))
        at[best].append(slot)
        done[best] += 1
    out = {}
    for s in names:
        own = sorted((r for r in rows if r.source == s), key=lambda r: ((r.doc_id or 0) % 4096, r.doc_id is not None, r.doc_id or 0))
        for i, r in enumerate(own):
            k = i // block
            out[r.doc_id] = k // whole[s] * total + at[s][k % whole[s]]
    return out


def test_stages_against_brute_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    docs = documents(spark)
    kept = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "pack":
            assert docs.columns == COLUMNS + (["mix_slot"] if name == "mix_sources" else [])
        rows = docs.collect()
        kept[name] = rows
        if name != "pack":
            docs = spark.createDataFrame(rows, docs.schema)

    def ids(name):
        return Counter(r.doc_id for r in kept[name])

    trees = language.learn(documents(spark))
    texts = [(r.text or "").encode() for r in kept["documents"]]
    _, posterior = trees.predict(texts)
    assert ids("language_id") == Counter(r.doc_id for r, p in zip(kept["documents"], posterior, strict=True) if has_letter(r.text) and p >= 0.5)

    best = {}
    for r in kept["language_id"]:
        key = fold(r.text)
        best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
    assert ids("exact_dedup") == Counter(None if i == -1 else i for i in best.values())

    known = [tuple(r) for r in kept["exact_dedup"] if r.doc_id is not None]
    component = brute(known, 5, 80)
    gone = {i for i, (_, c) in component.items() if c != i}
    assert len(gone) >= 15
    assert ids("near_dedup") == Counter(r.doc_id for r in kept["exact_dedup"] if r.doc_id not in gone)

    assert Counter(tuple(r)[:5] for r in kept["mix_sources"]) == Counter(map(tuple, kept["near_dedup"]))
    slots = plain_slots(kept["near_dedup"])
    assert all(slots[r.doc_id] == r.mix_slot for r in kept["mix_sources"])

    whole = Tokenizer.from_file(VOCABULARY)
    tokens = {r.doc_id: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in kept["mix_sources"]}
    places, spans = defaultdict(list), defaultdict(list)
    for p in kept["pack"]:
        own = tokens[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        places[p.sequence_id].append((p.offset, p.length))
        spans[p.doc_id].append((p.start, p.length))
    assert set(spans) == set(tokens)
    for of, full in ((spans, {i: len(t) for i, t in tokens.items()}), (places, None)):
        for key, pieces in of.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at
                at += length
            assert at == full[key] if full else at <= 2048


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)

    def pieces(df):
        return Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())

    got = pieces(corpus_pipeline.run(spark, SF))
    assert got == pieces(docs)
    assert {k[0] for k in got} <= {r["doc_id"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def shares_of_prefixes(pieces, sources, counts):
    """For each prefix of sequences with at least a tenth and at most a third of all documents: the largest deviation of a
    source's share of documents from its tempered weight. Documents count at their first piece."""
    weights = mixing.tempered(counts, 0.7)
    first = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        first.setdefault(p.doc_id, p.sequence_id)
    done, worst, order = Counter(), 0.0, sorted(first, key=first.get)
    for k, doc in enumerate(order, 1):
        done[sources[doc]] += 1
        if len(order) // 10 <= k <= len(order) // 3:
            worst = max(worst, *(abs(done[s] / k - w) for s, w in weights.items()))
    return worst


def test_packed_sequences_follow_the_mixture(spark):
    """What has been read of the packed sequences at any time holds the target weights; without the mixing stage it doesn't."""
    words = [f"word{k}" for k in range(300)]
    rows = [(i, " ".join(words[(i * 7 + j) % 300] for j in range(5 + i * 13 % 90)), "en", "big" if i < 2600 else "mid" if i < 3600 else "small", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sources = {r[0]: r[3] for r in rows}
    counts = Counter(sources.values())
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    packed = packing.pack_in_order(mixed, "mix_slot", VOCABULARY, range_docs=100).collect()
    assert shares_of_prefixes(packed, sources, counts) < 0.03
    whole = corpus_pipeline.pack_windows(spark, mixed, SF).collect()
    assert shares_of_prefixes(whole, sources, counts) < 0.1
    assert shares_of_prefixes(corpus_pipeline.pack_windows(spark, docs, SF).collect(), sources, counts) > 0.12
    # the same pieces of the same documents, each once
    def cut(found):
        return sum(p.length for p in found), {p.doc_id for p in found}

    assert cut(packed) == cut(whole) == cut(corpus_pipeline.pack_windows(spark, docs, SF).collect())
