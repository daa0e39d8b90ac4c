"""Near-duplicate documents by min-max hashing.

A document's words are maximal runs of characters other than ASCII white space, A-Z lower-cased; its set
holds its distinct ``width``-word shingles as 64-bit hashes. Under each of ``PERMUTATIONS`` permutations
(multiplication by an odd number) both the smallest and the largest value are kept: two signature values
for one evaluation. ``BANDS`` bands of ``ROWS`` values each, half of smallest and half of largest values,
bring documents together: a pair at similarity 0.85 shares no band with probability (1-0.85^7)^32 = 4e-6.

Documents with equal sets are one vertex from the start. What shares a bucket of a band is compared on full
sets, but not pair by pair: in each of ``STARS`` rounds a document is compared with one hub and joins its
component if they are linked. Hubs are documents that share buckets with many others, at first the one
that shares most, which lies in the middle of a family of copies. Only buckets that still hold different
components then go on: their documents are dealt to tasks in pairs of blocks of at most ``BLOCK``, by
size, and the largest component of such a cluster is compared with the others, not with itself. So a
family of near copies takes work in proportion to its size, and the square is paid only for documents
that share buckets without a link. Tasks return ties of a spanning forest, never all pairs. Only a pair
that shares no bucket is missed.

Cases: null and empty texts and texts without words have an empty set and are linked with nothing; a
text of fewer words than ``width`` has its whole sequence as its one shingle; rows that share an id are
one document, with the links of all its rows; a null id is never linked; an empty table gives an empty
result; other columns are ignored (:func:`near_duplicates`) or carried (:func:`deduplicate`).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import bucket_ranks, fresh, materialize, slices, tidy, utf8
from yieldloom.llm.components import connected_components

ROWS, BANDS = 7, 32
PERMUTATIONS = ROWS * BANDS // 2
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Rounds in which a document is compared with one hub before blocks are compared.
STARS = 3
_PIECE = 1 << 20
_MOST_WORDS = 1 << 16


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
_odd = np.random.Generator(np.random.PCG64(20_260_101)).integers(0, 2**63, size=PERMUTATIONS + 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """Hashes of the words of a text, in order; A-Z lower-cased if ``fold``. Long texts are read piece by
    piece, cut between words."""
    text = text.lower() if fold else text
    parts, begin = [], 0
    while begin < len(text):
        end = len(text)
        if end - begin > _PIECE:
            cut = max(text.rfind(c, begin, begin + _PIECE) for c in (b" ", b"\n"))
            end = cut if cut > begin else end
        words = text[begin:end].split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        begin = end if end > begin else len(text)
        if end < len(text):
            begin = end + 1
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_sets(texts: Iterable[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        words = word_hashes(text)
        n = len(words)
        if n >= width:
            total = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                total += words[k : n - width + 1 + k] * _odd[PERMUTATIONS + k]
            out.append(np.unique(_mix(total)))
        elif n:
            whole = np.uint64(n)
            for k in range(n):
                whole = _mix(np.array([whole]) * _odd[PERMUTATIONS + 8] + words[k : k + 1])[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(words)
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (documents x BANDS) of non-empty sets, all permutations over all documents at once."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.zeros((2, BANDS // 2, len(sets)), np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)
    for p in range(PERMUTATIONS):
        values = flat * _odd[p]
        for side, reduce in enumerate((np.minimum, np.maximum)):
            band = keys[side, p // ROWS]
            band *= salt
            band += _mix(reduce.reduceat(values, starts))
    keys = _mix(keys.reshape(BANDS, len(sets)) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * _odd[PERMUTATIONS + 9])
    return keys.T.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), bands."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_shingles", T.LongType()).add("digest", T.BinaryType()).add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = shingle_sets(utf8(batch.column("text")), width)
                some = [k for k, s in enumerate(sets) if len(s)]
                keys = iter(band_keys([sets[k] for k in some]).tolist() if some else ())
                bands = [next(keys) if len(s) else None for s in sets]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets ``a`` (rows) and ``b`` (columns) have 100 * intersection >= percent * union."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (a, b)]
    flat = np.concatenate([*a, *b])
    of = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, of = np.unique(number[shared], return_inverse=True)[1], of[shared]
    common = np.zeros((len(a), len(b)), np.float32)
    most = int(number.max()) + 1 if len(number) else 0
    step = max(256, (1 << 23) // (len(a) + len(b)))
    order = np.argsort(number, kind="stable")
    number, of = number[order], of[order]
    for low in range(0, most, step):
        i, j = np.searchsorted(number, (low, low + step))
        part = np.zeros((len(a) + len(b), min(step, most - low)), np.float32)
        part[of[i:j], number[i:j] - low] = 1
        common += part[: len(a)] @ part[len(a) :].T
    common = np.rint(common).astype(np.int64)
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def _forest(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Ties of each id to the smallest that it reaches over ``links`` (symmetric)."""
    labels, top = ids.copy(), np.iinfo(np.int64).max
    while True:
        now = np.minimum(labels, np.where(links, labels[None, :], top).min(axis=1))
        if (now == labels).all():
            return [(int(i), int(k)) for i, k in zip(ids, labels, strict=True) if i != k]
        labels = now


def _confirm(percent: int):
    """Links within a block, or across the two blocks of a pair, as ties of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("vertex").to_pylist(), np.int64)
        second = np.array(table.column("second").to_pylist(), bool)
        sets = _unpacked(table.column("hashes").combine_chunks())
        edges: list[tuple[int, int]] = []
        if not second.any():
            edges = _forest(ids, linked(sets, sets, percent))
        elif not second.all():
            a, b = np.flatnonzero(~second), np.flatnonzero(second)
            links = np.zeros((len(ids), len(ids)), bool)
            links[np.ix_(a, b)] = linked([sets[k] for k in a], [sets[k] for k in b], percent)
            edges = _forest(ids, links | links.T)
        return pa.table({"src": pa.array([e[0] for e in edges], pa.int64()), "dst": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


#: Vertices below this number name no document.
_MADE_UP = -(1 << 62)


def _vertices(known: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``groups`` (one row for each set) with ``vertex``, a number of its own: the smallest id that has the set. Sets
    of one id are tied from the start: labels (id, component), None if each id has one set."""
    several = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    several = materialize(several)
    if not several.limit(1).count():
        return groups.withColumn("vertex", F.col("first_id")), None
    clash = groups.groupBy("first_id").agg(F.min("digest").alias("holder"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("first_id").alias("of_id"), "holder")
    marked = groups.join(clash, F.col("first_id") == F.col("of_id"), "left").drop("of_id")
    others = marked.where("holder is not null and digest <> holder").select("digest").withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(1024)))
    numbered = bucket_ranks(others, [], "digest", "bucket", "place").select(F.col("digest").alias("of_digest"), (F.lit(_MADE_UP - 1) - F.col("place")).alias("made_up"))
    groups = marked.join(numbered, F.col("digest") == F.col("of_digest"), "left").withColumn("vertex", F.coalesce("made_up", "first_id")).drop("holder", "of_digest", "made_up")
    groups = materialize(groups)
    rows = known.join(several, "doc_id", "left_semi").select("doc_id", F.col("digest").alias("of_digest"))
    ends = rows.join(groups.select("digest", "vertex"), F.col("of_digest") == F.col("digest")).select("doc_id", "vertex")
    hubs = ends.groupBy(F.col("doc_id").alias("of_id")).agg(F.max("vertex").alias("hub"))
    return groups, _merged(ends.join(hubs, F.col("doc_id") == F.col("of_id")).select(F.col("vertex").alias("src"), F.col("hub").alias("dst")), None)


def _bodies(docs: DataFrame, vertices: DataFrame, width: int) -> DataFrame:
    """vertex, hashes (its sorted set, packed) of ``vertices`` (vertex, and first_id and digest of a document with the set)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = [s.tobytes() for s in shingle_sets(utf8(batch.column("text")), width)]
                # other rows of the id may have other sets
                own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("vertex").filter(own), pa.array(sets, pa.binary()).filter(own)], ["vertex", "hashes"])

    # neither side has a size bound, so neither is broadcast
    found = docs.join(vertices.hint("merge"), F.col("doc_id") == F.col("first_id")).select("vertex", "digest", "text")
    return found.mapInArrow(tidy(run), "vertex long, hashes binary")


def _named(member: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``member`` with ``label``: the component that its vertex belongs to so far."""
    if labels is None:
        return member.withColumn("label", F.col("vertex"))
    joined = member.join(labels, F.col("vertex") == F.col("id"), "left")
    return joined.select("vertex", "n", "weight", "band", F.coalesce("component", "vertex").alias("label"))


def _alike_in_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _stars(named: DataFrame, turn: int, percent: int) -> DataFrame:
    """vertex, hub: for each vertex the one hub with which it shares most bands. A bucket's hub is at first its
    vertex with most ``weight``, which lies in the middle of a family of copies; later one is drawn by a
    hash, with odds in proportion to the weight. Only hubs of other labels count."""
    drawn = F.log((F.pmod(F.xxhash64("vertex", F.lit(turn)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))) / F.col("weight")
    order = F.struct(F.col("weight") if turn == 0 else drawn, -F.col("vertex"))
    hub = F.max_by(F.struct("vertex", "n", "label"), order)
    hubs = named.groupBy(F.col("band").alias("of_band")).agg(hub.alias("hub"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    ties = named.join(hubs, F.col("band") == F.col("of_band")).where("label <> hub.label").select("vertex", "n", F.col("hub.vertex").alias("hub"), F.col("hub.n").alias("hub_n"))
    ties = ties.where(_alike_in_size("n", "hub_n", percent)).groupBy("vertex", "hub").agg(F.count(F.lit(1)).alias("shared"))
    return ties.groupBy("vertex").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))


def _linked_stars(ties: DataFrame, body: DataFrame, percent: int) -> DataFrame:
    """The ties (src, dst) whose full sets are linked. A hub may have any share of the ties: it is the
    hot key of a join that Spark splits, and its set goes to each part once."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2)), _unpacked(batch.column(3)), strict=True)
            found = []
            for vertex, hub, a, b in rows:
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    found.append((vertex, hub))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["src", "dst"])

    near = ties.withColumnRenamed("vertex", "src").join(body.hint("merge"), F.col("src") == F.col("vertex")).select("src", "hub", "hashes")
    far = body.select(F.col("vertex").alias("of_hub"), F.col("hashes").alias("hub_hashes"))
    pairs = near.join(far.hint("merge"), F.col("hub") == F.col("of_hub")).select("src", "hub", "hashes", "hub_hashes")
    return pairs.mapInArrow(tidy(run), "src long, dst long")


def _across_labels(named: DataFrame, body: DataFrame, percent: int) -> DataFrame | None:
    """Links (src, dst) between documents that share a bucket and have different labels; None if there are
    no such buckets. Documents are dealt by cluster (component of those buckets) and size level, as sets whose
    sizes differ by more than a level can't be linked. Of a cluster's label with most documents no two
    are compared; the others meet each other and it, block by block."""
    buckets = named.groupBy(F.col("band").alias("of_band")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("vertex").alias("hub")).where("a <> b")
    rest = materialize(named.join(buckets, F.col("band") == F.col("of_band")).select("vertex", "n", "label", "hub").distinct())
    if not rest.limit(1).count():
        return None
    clusters = connected_components(rest.select(F.col("vertex").alias("src"), F.col("hub").alias("dst")))
    step = max(math.log(100 / max(1, min(percent, 100))), 1e-9) * 1.0001
    level = F.floor(F.log("n") / step)
    rows = rest.select("vertex", "n", "label").distinct().join(clusters, F.col("vertex") == F.col("id"))
    rows = rows.select("vertex", "n", "label", "component", F.explode(F.array(level - 1, level)).alias("low"), level.alias("level"))
    rows = materialize(rows)

    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(8 * F.col("n")) / BLOCK_BYTES)
    by_label = rows.groupBy("component", "low", "label").agg(weight.alias("w"), F.max((F.col("level") == F.col("low")).cast("int")).alias("own"))
    shares = by_label.groupBy(F.col("component").alias("of"), F.col("low").alias("of_low")).agg(
        F.max_by("label", F.struct("w", -F.col("label"))).alias("most"), F.max("w").alias("w_most"), F.sum("w").alias("w_all"), F.max("own").alias("own"), F.count(F.lit(1)).alias("k")
    )
    parts = shares.where("k > 1 and own = 1").select("of", "of_low", "most", F.ceil("w_most").cast("int").alias("wide"), F.ceil(F.col("w_all") - F.col("w_most")).cast("int").alias("deep"))
    dealt = rows.join(parts, (F.col("component") == F.col("of")) & (F.col("low") == F.col("of_low")))
    is_most = F.col("label") == F.col("most")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vertex"), F.greatest(F.lit(1), F.when(is_most, F.col("wide")).otherwise(F.col("deep")))).cast("int"))

    def numbers(n: str) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)

    block = F.col("block")
    as_most = F.transform(numbers("deep"), lambda j: F.struct(F.lit(1).alias("kind"), block.alias("i"), j.alias("j"), F.lit(False).alias("second")))
    with_most = F.transform(numbers("wide"), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), block.alias("j"), F.lit(True).alias("second")))
    with_rest = F.transform(numbers("deep"), lambda k: F.struct(F.lit(0).alias("kind"), F.least(block, k).alias("i"), F.greatest(block, k).alias("j"), (block > k).alias("second")))
    dealt = dealt.select("component", "low", "vertex", F.explode(F.when(is_most, as_most).otherwise(F.concat(with_most, with_rest))).alias("to")).select("component", "low", "to.*", F.col("vertex").alias("of_vertex"))
    full = dealt.join(body.hint("merge"), F.col("of_vertex") == F.col("vertex")).select("component", "low", "kind", "i", "j", "second", "vertex", "hashes")
    return full.groupBy("component", "low", "kind", "i", "j").applyInArrow(_confirm(percent), "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``percent``
    percent similarity, itself included), kept (doc_id = component_id): one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = materialize(signatures(docs, width))
    known = sigs.where("digest is not null and doc_id is not null")
    groups = known.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    groups, labels = _vertices(known, materialize(groups))

    member = groups.select("vertex", "n", F.explode("bands").alias("band"))
    shared = member.groupBy(F.col("band").alias("of_band")).agg(F.min("vertex").alias("a"), F.max("vertex").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b")
    member = member.join(shared, F.col("band") == F.col("of_band")).select("vertex", "n", "band", "size")
    # how many documents a document meets in its at most BANDS buckets
    member = materialize(member.select("vertex", "n", "band", F.sum("size").over(Window.partitionBy("vertex")).alias("weight")))
    asked = member.select("vertex").distinct().withColumnRenamed("vertex", "asked")
    sources = groups.join(asked.hint("merge"), F.col("vertex") == F.col("asked")).select("vertex", "first_id", "digest")
    body = materialize(_bodies(docs, sources, width))

    for turn in range(STARS):
        ties = materialize(_stars(_named(member, labels), turn, percent))
        if not ties.limit(1).count():
            break
        links = _linked_stars(ties, body, percent)
        labels = _merged(links, labels)
    links = _across_labels(_named(member, labels), body, percent)
    if links is not None:
        labels = _merged(links, labels)
    if labels is None:
        labels = member.select(F.col("vertex").alias("id"), F.col("vertex").alias("component")).limit(0)

    # vertices of the ids below all others are numbers made up for sets whose smallest id names another set
    real = groups.where(F.col("vertex") >= _MADE_UP).select("vertex")
    least = labels.join(real, F.col("id") == F.col("vertex")).groupBy("component").agg(F.min("id").alias("least")).select(F.col("component").alias("of_component"), "least")
    labels = labels.join(least, F.col("component") == F.col("of_component")).select("id", F.col("least").alias("component"))
    named = groups.join(labels, F.col("vertex") == F.col("id"), "left").select("digest", "copies", "vertex", F.coalesce("component", "first_id").alias("component_id"))
    named = named.where("copies > 1 or component_id <> vertex").select(F.col("digest").alias("of_digest"), "component_id")
    out = sigs.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("of_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """id, component over ``links`` and what ``labels`` joined before."""
    if labels is not None:
        links = links.union(labels.select("id", "component"))
    return materialize(connected_components(links))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its component. Columns as before."""
    gone = fresh("gone_id", docs.columns)
    dropped = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped.hint("merge"), F.col("doc_id") == F.col(gone), "left_anti")
