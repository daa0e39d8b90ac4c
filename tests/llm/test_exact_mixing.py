import hashlib
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldloom.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_against_brute_force(spark):
    data = [(1, "Abc", "en", "a", 3), (2, "aBC", "en", "a", 3), (3, "É", "fr", "b", 1), (4, "é", "fr", "b", 1), (5, None, None, None, None), (6, "", "en", "a", 0), (7, "x" * 200_000, "en", "a", 1), (7, "x" * 200_000, "en", "a", 1), (None, "abc", "en", "a", 3)]
    docs = spark.createDataFrame(data, SCHEMA)
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[fold(t)].append(i)
    want = Counter()
    for i, t, *_ in data:
        ids = groups[fold(t)]
        keep = max((k for k in ids if k is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.duplicate_groups(docs).collect())) == want


def test_survivors_keep_all_columns_and_clashing_names(spark):
    data = [(i, f"t{i % 5}", "en", "s", i, i, -i) for i in range(60)]
    docs = spark.createDataFrame(data, SCHEMA + ", group_size long, content_key long")
    got = exact_dedup.deduplicate(docs).collect()
    assert sorted(map(tuple, got)) == data[55:]
    assert exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 99)), max_size=120), st.sampled_from([1, 200, 1 << 20]))
def test_grace_recursion_equals_one_table(rows, table_bytes):
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [f"text {t}" * 9], "n": [1]}) for t, i in rows]
    best, count = {}, Counter()
    for t, i in rows:
        best[t] = max(i, best.get(t, i))
        count[f"text {t}" * 9] += 1
    got = [r for b in exact_dedup.grace(batches, "text", "doc_id", "n", table_bytes) for r in b.to_pylist()]
    assert sorted((r["text"], r["doc_id"], r["n"]) for r in got) == sorted((f"text {t}" * 9, i, count[f"text {t}" * 9]) for t, i in best.items())
    assert xxhash.xxh3_64_intdigest(b"a", seed=1) != xxhash.xxh3_64_intdigest(b"a", seed=2)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=150), st.sampled_from([1, 600, 2000, 1 << 20]))
def test_combined_keeps_rows_and_meets_hot_texts_once(texts, most_bytes):
    rows = [x for t in texts for x in (t, 99)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [f"text {t}" * 9], "n": [1]}) for i, t in enumerate(rows)]
    got = [r for b in exact_dedup.combined(batches, "text", "doc_id", "n", most_bytes) for r in b.to_pylist()]
    count, best = Counter(), {}
    for r in got:
        count[r["text"]] += r["n"]
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert count == Counter(f"text {t}" * 9 for t in rows)
    assert best == {f"text {t}" * 9: i for i, t in enumerate(rows)}
    if most_bytes >= 2000 and len(set(texts)) < 12:
        assert sum(r["text"] == "text 99" * 9 for r in got) <= 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 40), min_size=1, max_size=8))
def test_cycle_deviates_by_less_than_one_block(weights):
    total, slots = sum(weights.values()), mixing.cycle(weights)
    order = {t: s for s, at in slots.items() for t in at}
    assert sorted(order) == list(range(total))
    done = Counter()
    for t in range(total):
        done[order[t]] += 1
        for s, w in weights.items():
            assert abs(done[s] * total - w * (t + 1)) < total
    for s, at in slots.items():
        for i, t in enumerate(at):
            assert i * total // weights[s] <= t < -(-(i + 1) * total // weights[s])


def test_schedule_and_mix(spark):
    data = [(i, "x", "en", "big" if i % 3 else "small", 1) for i in range(900)] + [(2000 + i, None, None, None, None) for i in range(100)] + [(None, "n", "en", "big", 1), (1, "x", "en", "big", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    weights = {"big": 0.5, "small": 0.3, None: 0.2}
    got = mixing.schedule(docs, weights, block=4).collect()
    assert len(got) == len(data)
    rank = defaultdict(list)
    for r in got:
        rank[r.source].append(r.source_rank)
        assert r.release <= r.slot < r.deadline
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in rank.values())
    blocks = defaultdict(set)
    for r in got:
        if r.in_mix:
            blocks[r.slot].add((r.source, r.block))
    horizon = max(blocks) + 1
    assert sorted(blocks) == list(range(horizon)) and all(len(b) == 1 for b in blocks.values())
    assert Counter(r.slot for r in got if r.in_mix) == {t: 4 for t in range(horizon)}
    done = Counter()
    for t in range(horizon):
        done[next(iter(blocks[t]))[0]] += 1
        assert all(abs(done[s] - w * (t + 1)) < 1 for s, w in weights.items())
    mixed = mixing.mix(docs, weights, block=4)
    assert mixed.columns == docs.columns
    kept = Counter(r.doc_id for r in mixed.collect())
    assert kept == Counter(r.doc_id for r in got if r.in_mix)
    assert mixing.schedule(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_sources_do_not_bound_the_mixture(spark):
    data = [(i, "x", "en", "big" if i % 3 else "mid", 1, -i) for i in range(3000)] + [(5000, "y", "en", "tiny", 1, 0), (5001, "z", "en", None, 1, 0)]
    docs = spark.createDataFrame(data, SCHEMA + ", slot int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = [tuple(r) for r in mixed.collect()]
    assert Counter(got) == Counter(data)
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs).collect()}
    assert [slot[r[0]] for r in got] == sorted(slot.values())
    # both large sources are spread: in the first half of the order each stands near its tempered weight
    first = Counter(r[3] for r in got[:1000])
    assert abs(first["mid"] / 1000 - 1000**0.7 / (1000**0.7 + 2000**0.7)) < 0.03


def test_no_drift_from_the_weights_before_rounding(spark):
    weights = {"a": 0.3333333, "b": 0.0004, "c": 0.6662667}
    blocks = {"a": 20_000, "b": 24, "c": 40_000}
    whole = mixing.fine_weights(weights, blocks)
    total, slots = sum(whole.values()), mixing.cycle(whole)
    for s, w in weights.items():
        for i in range(0, blocks[s], 7):
            at = i // whole[s] * total + slots[s][i % whole[s]]
            if at < 60_000:
                assert abs(i - w * at) < 2  # a block of Pfair's own, and less than one of rounding
    many = {"hot": 0.95} | {f"s{k}": 0.05 / 5000 for k in range(5000)}
    whole = mixing.fine_weights(many, {s: 100_000 if s == "hot" else 2 for s in many})
    assert abs(whole["hot"] / sum(whole.values()) - 0.95) < 1e-5
    assert mixing.fine_weights({"a": 0.5, "b": 0.5}, {"a": 9, "b": 9}) == {"a": 500, "b": 500}
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "if(id % 2 = 0, 'a', 'b') AS source", "1 AS n_chars")
    rows = mixing.schedule(docs, {"a": 0.50049, "b": 0.49951}, block=1).where("in_mix").orderBy("slot").collect()
    done = 0
    for t, r in enumerate(rows):
        assert r.slot == t
        done += r.source == "a"
        assert abs(done - 0.50049 * (t + 1)) < 2


def test_cycles_stay_bounded():
    """At 10^11 rows blocks have grown, so that the driver's cycle has a bound, also beside tiny sources."""
    for rows in (10**7, 10**9, 10**11):
        counts = {"hot": rows // 3, None: 1, "tiny": 5} | {f"s{k}": rows * (k + 1) // 84 for k in range(7)}
        block = mixing.block_size(sum(counts.values()))
        assert block == mixing.BLOCK or sum(counts.values()) // block <= mixing.MAX_BLOCKS
        whole = mixing.fine_weights(mixing.tempered(counts, 0.7), {s: -(-n // block) for s, n in counts.items()})
        assert sum(whole.values()) <= mixing.MAX_CYCLE
    assert mixing.block_size(1000) == 16 and mixing.block_size(16 * mixing.MAX_BLOCKS + 1) == 32


def test_clashing_names(spark):
    docs = spark.createDataFrame([(k, "x", "en", f"s{k % 2}", 1, k, k, k) for k in range(50)], SCHEMA + ", __r_source int, mix_slot int, of_source int")
    found = mixing.with_slots(docs)
    assert found.columns == [*docs.columns, "_mix_slot"] and mixing.slot_column(found.columns) == "_mix_slot"
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs).collect()}
    assert {r.doc_id: r._mix_slot for r in found.collect()} == slot
    assert mixing.mix(docs).count() == 50
