"""Ranked lexical search by per-term geometric blocking.

Items are ranked in blocks of at most ``ITEM_BYTES`` of text, so that a block's vocabulary has a bound. For one
block of items:

1. Each document becomes a vector over the items' terms (term, occurrences), in one pass over whole
   texts; document and term counts are taken over all documents.
2. Documents are dealt into shards of at most ``SHARD`` documents, as they lie. A shard's inverted index has a
   posting list for each term. Each list is clustered by document similarity: documents are projected to
   ``SKETCH`` dimensions, and a list's documents go to the nearest of some of their own number. A cluster,
   cut at ``MOST`` documents, is a block; its summary holds, coordinate by coordinate, the maximum over its
   documents, for the coordinates that some item asks for together with the list's term. Summaries are rounded up
   to multiples of ``1 << SHIFT``, never down. The index is written as a table, one row for each shard.
3. An item reads the lists of its terms, largest possible contribution first, until what the other
   terms can add at most falls below the score that a document needs. A block is skipped only if the item's
   product with its summary is below that score; documents of other blocks are scored in full, in 64-bit integers.
   The score needed is that of the 20th best so far in the shard, and from the start that of
   the 20th best of ``SEED_SHARDS`` shards, which are searched first.

Both bounds hold for each document they stand for, so the result is the exact one. Each shard gives its best
``top`` documents of each item; the best of those are the result.

Cases: a null or empty text, or one without terms, is no document and is never found; items without terms have no
rows; rows that share an item_id are one item, with the terms of all of them; equal scores go by doc_id, null
ids last, and repeated rows are ranked each; terms that no document has add nothing; an empty table
on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import materialize, slices, tidy, utf8

TOP = 20
SHARD = 4096
SKETCH = 48
MOST = 256
SHIFT = 4
SEED_SHARDS = 8
ITEM_BYTES = 1 << 18
#: Bytes of texts: ASCII other than letters and digits stands between terms, A-Z is lower-cased.
_FOLD = bytes(k + 32 if 65 <= k <= 90 else k if 48 <= k <= 57 or 97 <= k <= 122 or k > 127 else 32 for k in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in order."""
    return text.translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all its terms, repeats too), and as packed 32-bit integers the numbers of the terms of
    ``vocabulary`` that it has (in order) and how often; documents without terms are left out."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                rows, ids, times = [], [], []
                for k, text in enumerate(utf8(batch.column("text"))):
                    counts = Counter(terms(text))
                    if counts:
                        own = sorted((vocabulary[t], n) for t, n in counts.items() if t in vocabulary)
                        rows.append((k, sum(counts.values())))
                        ids.append(np.array([t for t, _ in own], np.int32).tobytes())
                        times.append(np.array([n for _, n in own], np.int32).tobytes())
                doc_id = batch.column("doc_id").take(pa.array([k for k, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array([n for _, n in rows], pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, terms binary, times binary")


def frequencies(found: DataFrame) -> dict[int, int]:
    """Documents by term of the vocabulary (which has a bound): summed within tasks before they are shuffled."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(np.frombuffer(x, np.int32).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    rows = found.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What each posting is worth, before the term's weight: ``lengths`` has the document's m."""
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 12 * lengths)


class Shard:
    """Documents with their impacts by (document, term), as rows of ``ids``, ``at`` (where a document's
    postings begin), ``term`` and ``impact``."""

    def __init__(self, ids: list, at: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.at, self.term, self.impact = ids, at, term, impact

    def matrix(self, width: int, kind=np.int32, values: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(self.ids), width), kind)
        out[np.repeat(np.arange(len(self.ids)), np.diff(self.at)), self.term] = self.impact if values is None else values
        return out

    def lists(self) -> Iterator[tuple[int, np.ndarray]]:
        """term, documents (by place) of each posting list."""
        of = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.at))
        order = np.argsort(self.term, kind="stable")
        begins = np.flatnonzero(np.diff(self.term[order], prepend=-1))
        for begin, end in zip(begins, [*begins[1:], len(order)], strict=True):
            yield int(self.term[order[begin]]), of[order[begin:end]]


def blocked(rows: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list's documents, block by block, and where blocks begin. Documents go to the nearest (by
    cosine of sketches) of some of their own number, spread evenly over the list; clusters are cut at ``MOST``."""
    centres = max(1, min(32, len(rows) // 48))
    if centres == 1 and len(rows) <= MOST:
        return rows, np.zeros(1, np.int32)
    chosen = rows[(np.arange(centres) * len(rows)) // centres]
    nearest = np.argmax(sketch[rows] @ sketch[chosen].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    begins = []
    for begin, end in _runs(nearest[order]):
        begins += range(begin, end, MOST)
    return rows[order], np.array(begins, np.int32)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    begins = np.flatnonzero(np.diff(values, prepend=-1))
    yield from zip(begins.tolist(), [*begins[1:].tolist(), len(values)], strict=True)


def _together(items: dict[int, Counter], width: int) -> list[np.ndarray]:
    """For each term the terms that some item asks for together with it."""
    near: list[set] = [set() for _ in range(width)]
    for asked in items.values():
        for t in asked:
            near[t].update(asked)
    return [np.array(sorted(s), np.int32) for s in near]


def index(found: DataFrame, items: dict[int, Counter], width: int, documents: int, total: int) -> DataFrame:
    """One row for each shard: its documents and postings, and for each list its documents by block, where blocks
    begin, and the blocks' summaries (32-bit and 16-bit integers, packed)."""
    schema = "ids array<long>, at binary, term binary, impact binary, list_terms binary, list_sizes binary, rows binary, list_blocks binary, begins binary, summaries binary"
    near = _together(items, width)
    projection = np.random.Generator(np.random.PCG64(20_261_201)).standard_normal((width, SKETCH)).astype(np.float32)

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x, np.int32) for x in batch.column("terms").to_pylist()]
        at = np.cumsum([0, *map(len, own)])
        term = np.concatenate(own)
        times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32)
        m = np.array([75 + 25 * n * documents // total for n in batch.column("n").to_pylist()], np.int64)
        shard = Shard(batch.column("doc_id").to_pylist(), at, term, impacts(times, np.repeat(m, np.diff(at))).astype(np.int32))
        upper = shard.matrix(width, np.uint16, -(-shard.impact >> SHIFT))
        sketch = np.zeros((len(own), SKETCH), np.float32)
        for k in range(len(own)):
            sketch[k] = np.sqrt(shard.impact[at[k] : at[k + 1]].astype(np.float32)) @ projection[own[k]]
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        parts: dict[str, list] = {c: [] for c in ("list_terms", "list_sizes", "rows", "list_blocks", "begins", "summaries")}
        for t, members in shard.lists():
            rows, begins = blocked(members, sketch)
            ends = [*begins[1:], len(rows)]
            near_t = near[t]
            if 2 * len(near_t) < width:
                columns = upper[rows[:, None], near_t]
                summary = np.maximum.reduceat(columns, begins, axis=0)
            else:
                summary = np.stack([upper[rows[a:b]].max(axis=0) for a, b in zip(begins, ends, strict=True)])[:, near_t]
            for name, value in zip(parts, (np.int32(t), np.int32(len(rows)), rows, np.int32(len(begins)), begins, summary), strict=True):
                parts[name].append(value.tobytes())
        packed = [shard.at.astype(np.int32).tobytes(), shard.term.tobytes(), shard.impact.tobytes(), *[b"".join(p) for p in parts.values()]]
        names = ["ids", "at", "term", "impact", *parts]
        return pa.RecordBatch.from_arrays([pa.array([shard.ids], pa.list_(pa.int64())), *[pa.array([x], pa.large_binary()).cast(pa.binary()) for x in packed]], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = SHARD - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == SHARD:
                    yield build(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
        if held:
            yield build(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return found.mapInArrow(tidy(run), schema)


def _best(scores: np.ndarray, rows: np.ndarray, ids: list, top: int) -> list[tuple[int, int]]:
    """(score, place) of the best ``top``: highest score first, then smallest id, null ids last."""
    if len(rows) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        keep = scores >= least
        scores, rows = scores[keep], rows[keep]
    order = sorted(zip(scores.tolist(), rows.tolist(), strict=True), key=lambda x: (-x[0], ids[x[1]] is None, ids[x[1]] or 0))
    return order[:top]


def ranked(shards: DataFrame, items: dict[int, Counter], weights: np.ndarray, needed: dict[int, int], top: int) -> DataFrame:
    """item (its number), doc_id, score, and how many documents of how many were scored: each shard's best ``top`` of
    each item, as far as their score reaches what is ``needed``."""
    near = _together(items, len(weights))
    asked = {i: (t := np.array(sorted(c), np.int64), weights[t] * np.array([c[k] for k in t.tolist()], np.int64)) for i, c in items.items()}

    def one(row: dict) -> pa.RecordBatch:
        def part(name, kind=np.int32):
            return np.frombuffer(row[name], kind)

        shard = Shard(row["ids"], part("at"), part("term"), part("impact"))
        exact = shard.matrix(len(weights))
        highest = exact.max(axis=0).astype(np.int64)
        lists, r, b, s = {}, 0, 0, 0
        rows, begins, summaries = part("rows"), part("begins"), part("summaries", np.uint16)
        for t, size, blocks in zip(part("list_terms").tolist(), part("list_sizes").tolist(), part("list_blocks").tolist(), strict=True):
            w = len(near[t])
            lists[t] = (rows[r : r + size], begins[b : b + blocks], summaries[s : s + blocks * w].reshape(blocks, w))
            r, b, s = r + size, b + blocks, s + blocks * w
        out: list[tuple[int, int | None, int, int]] = []
        for item, (own, w) in asked.items():
            least = max(1, needed.get(item, 1))
            seen = np.zeros(len(shard.ids), bool)
            scores, places = np.empty(0, np.int64), np.empty(0, np.int64)
            most = w * highest[own]
            order = np.argsort(-most, kind="stable")
            rest = np.cumsum(most[order][::-1])[::-1]
            for k, left in zip(order.tolist(), rest.tolist(), strict=True):
                # no document outside the lists read so far can have more than what is left
                if left < least or not most[k]:
                    break
                members, first, summary = lists[int(own[k])]
                bounds = (summary[:, np.searchsorted(near[int(own[k])], own)].astype(np.int64) << SHIFT) @ w
                if not (keep := bounds >= least).any():
                    continue
                sizes = np.diff(first, append=len(members))
                new = members[np.repeat(keep, sizes)]
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                found = exact[new[:, None], own].astype(np.int64) @ w
                good = found >= least
                scores, places = np.concatenate([scores, found[good]]), np.concatenate([places, new[good]])
                if len(scores) >= top:
                    least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
            out += [(item, shard.ids[p], v, int(seen.sum())) for v, p in _best(scores, places, shard.ids, top)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "doc_id", "score", "scored"])

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield one(batch.slice(k, 1).to_pylist()[0])

    return shards.mapInArrow(tidy(run), "item long, doc_id long, score long, scored long")


def _place() -> Window:
    return Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())


def _of_items(docs: DataFrame, texts: list[tuple[object, bytes]], item_type, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    pooled: dict[object, Counter] = {}
    for item, text in texts:
        pooled.setdefault(item, Counter()).update(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text))
    named = list(pooled)
    items = {k: pooled[item] for k, item in enumerate(named) if pooled[item]}
    found = materialize(vectors(docs, vocabulary))
    total = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, width = total["documents"], max(1, len(vocabulary))
    df = frequencies(found)
    weights = np.array([weight(documents, df.get(k, 0)) for k in range(width)], np.int64)
    held = materialize(index(found.where(F.length("terms") > 0), items, width, documents, max(1, total["terms"] or 0)))
    seeds = ranked(held.limit(SEED_SHARDS), items, weights, {}, top).withColumn("place", F.row_number().over(_place()))
    needed = {r["item"]: r["score"] for r in seeds.where(F.col("place") == top).select("item", "score").collect()}
    best = ranked(held, items, weights, needed, top).withColumn("rank", F.row_number().over(_place())).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(named)), f"of_item long, item_id {item_type}")
    return best.join(names, F.col("item") == F.col("of_item")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best ``top`` documents of ``docs`` (doc_id, text) for each of
    ``items`` (item_id, text), as far as their score is above 0. Items come to the driver block by block."""
    kind = items.schema["item_id"].dataType.simpleString()
    sized = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-max(1, size) // ITEM_BYTES)
    out = None
    for k in range(count):
        own = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect()
        part = _of_items(docs, [(r["item_id"], r["text"].encode()) for r in own], kind, top)
        out = part if out is None else out.unionByName(part)
    return out
