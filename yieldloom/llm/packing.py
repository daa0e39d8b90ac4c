"""Packing documents into token windows: non-negative least squares over a length histogram.

A document's ids (with an end id) are cut into full windows and a remainder. The histogram of remainder
lengths, at most ``window`` rows however large the corpus, is all that the driver sees. It enumerates
pairs and triples of lengths that fill a window exactly, solves their repeat counts against the
histogram by non-negative least squares, rounds them down, and packs what is left greedily: longest
first with whatever still fits. Lengths that leave more than ``slack`` ids empty that way are cut at
powers of two; those pieces, sorted by size, tile windows without a gap. A row finds its place from its
rank among the rows of its length, so no row but small ones of ids and checksums is shuffled.

:func:`pack_in_order` keeps a given order, such as that of a mixture: rows are packed in ranges of its numbers, each in
a task of its own, and sequences are numbered by the ranges and by the numbers of their members.

Ranks go by id, length and checksums, so rows that tie are equal and each piece has one place.

Cases: null text counts as empty, and has its end id alone; repeated rows are packed each; a null id is
carried; texts longer than a window, however long, fill windows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import bucket_ranks, materialize, slices, texts, tidy
from yieldloom.llm.tokens import tokenizer

WINDOW = 2048
END_ID = 1
SLACK = 16
SWEEPS = 60
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def measured(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, order: str | None = None) -> DataFrame:
    """doc_id (and ``order``), doc_tokens, crcs of full windows, the remainder's length and crc, and the crcs of the
    remainder's pieces when cut at powers of two, largest first."""
    end = end_id.to_bytes(4, "little")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            *([T.StructField("slot", T.LongType())] if order else []),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("full", T.ArrayType(T.LongType())),
            T.StructField("rem", T.IntegerType()),
            T.StructField("rem_crc", T.LongType()),
            T.StructField("cut", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        pack = tokenizer(vocabulary).pack
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                n, full, rem, rem_crc, cut = [], [], [], [], []
                for text in texts(batch.column("text")):
                    ids = memoryview(pack(text) + end)
                    count = len(ids) // 4
                    at = count // window * window
                    n.append(count)
                    full.append([zlib.crc32(ids[4 * i : 4 * (i + window)]) for i in range(0, at, window)])
                    rem.append(count - at)
                    rem_crc.append(zlib.crc32(ids[4 * at :]))
                    parts = []
                    for size in powers(count - at):
                        parts.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at += size
                    cut.append(parts)
                longs = pa.list_(pa.int64())
                own = [batch.column("doc_id"), *([batch.column("slot")] if order else [])]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, pa.int64()), pa.array(full, longs), pa.array(rem, pa.int32()), pa.array(rem_crc, pa.int64()), pa.array(cut, longs)],
                    schema.names,
                )

    own = [F.col("doc_id"), F.col("text"), *([F.col(order).cast("long").alias("slot")] if order else [])]
    return docs.select(*own).mapInArrow(tidy(run), schema)


def powers(n: int) -> list[int]:
    """``n`` as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def combinations(lengths: list[int], window: int, triples: int = 6) -> list[tuple[int, ...]]:
    """All pairs, and up to ``triples`` triples for each largest member, that fill ``window`` exactly.
    Middle members are spread evenly over the lengths at hand."""
    have = set(lengths)
    out: list[tuple[int, ...]] = [(a, window - a) for a in lengths if 2 * a >= window and window - a in have]
    ordered = sorted(have, reverse=True)
    for a in ordered:
        middles = [b for b in ordered if b <= a and 2 * b >= window - a and window - a - b in have]
        step = max(1, len(middles) // triples)
        out += [(a, b, window - a - b) for b in middles[::step][:triples]]
    return out


def least_squares(columns: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts x >= 0 that minimise the squared distance of the columns' lengths, repeated x times,
    from the histogram: coordinate descent, each step exact for its column."""
    left = {k: float(v) for k, v in histogram.items()}
    x = [0.0] * len(columns)
    parts = [(tuple(set(c)), {a: c.count(a) for a in c}) for c in columns]
    norm = [sum(m * m for m in mult.values()) for _, mult in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, mult) in enumerate(parts):
            step = max(-x[j], sum(left[a] * mult[a] for a in rows) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a in rows:
                    left[a] -= step * mult[a]
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> tuple[list[tuple[int, int, int, int, int]], int, dict[int, int]]:
    """Where remainders go. Returns runs (length, first rank, count, first sequence, offset), the number
    of sequences so filled, and for each length the rank from which rows are cut at powers of two."""
    left = {k: v for k, v in histogram.items() if v > 0}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def use(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        offset = 0
        for a in combo:
            runs.append((a, taken[a], times, sequences, offset))
            taken[a] += times
            left[a] -= times
            offset += a
        for a in set(combo):
            if not left[a]:
                del left[a]
        sequences += times

    columns = combinations(sorted(left), window)
    solved = least_squares(columns, left)
    for j in sorted(range(len(columns)), key=lambda j: (-solved[j], j)):
        combo = columns[j]
        times = min([int(solved[j]), *(left.get(a, 0) // combo.count(a) for a in combo)])
        if times:
            use(combo, times)
    cut: dict[int, int] = {}
    while left:
        combo, gap, free = [], window, dict(left)
        while fits := [a for a in free if a <= gap]:
            a = max(fits)
            combo.append(a)
            gap -= a
            free[a] -= 1
            if not free[a]:
                del free[a]
        if gap <= slack:
            use(tuple(combo), min(left[a] // combo.count(a) for a in combo))
        else:
            a = combo[0]
            cut[a] = taken[a]
            del left[a]
    return runs, sequences, cut


def _runs_of(rows: DataFrame, runs: list, cut: dict[int, int]) -> DataFrame:
    """``rows`` joined to the runs of their length (at most one row for each length)."""
    by: dict[int, list] = defaultdict(list)
    for length, rank, count, sequence, offset in runs:
        by[length].append((rank, rank + count, sequence, offset))
    table = [(k, by.get(k, []), cut.get(k)) for k in sorted({*by, *cut})]
    schema = "of_rem int, runs array<struct<first:long,upto:long,sequence:long,place:int>>, cut_from long"
    return rows.join(rows.sparkSession.createDataFrame(table, schema), F.col("rem") == F.col("of_rem"), "left")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    rows = materialize(measured(docs, vocabulary, window, end_id))
    histogram = {r["rem"]: r["n"] for r in rows.groupBy("rem").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    histogram.pop(0, None)
    runs, tiled, cut = plan(histogram, window, slack)
    buckets = max(64, total // 100_000)
    bucket: Column = F.coalesce(F.pmod(F.col("doc_id"), F.lit(buckets)), F.lit(0))

    ranked = bucket_ranks(rows.where("rem > 0").withColumn("bucket", bucket), ["rem"], ["doc_id", "doc_tokens", "rem_crc", "full"], "bucket", "rank")
    placed = _runs_of(ranked, runs, cut)
    start = F.col("doc_tokens") - F.col("rem")
    is_cut = F.col("cut_from").isNotNull() & (F.col("rank") >= F.col("cut_from"))
    run = F.expr("filter(runs, r -> r.first <= rank and rank < r.upto)[0]")
    kept = placed.where(~is_cut).withColumn("run", run).select(
        "doc_id",
        start.alias("start"),
        F.col("rem").cast("long").alias("length"),
        F.col("rem_crc").alias("ids_crc32"),
        "doc_tokens",
        (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"),
        F.col("run.place").cast("long").alias("offset"),
    )

    bits = window.bit_length() - 1
    sizes = F.expr(f"filter(transform(sequence({bits - 1}, 0, -1), k -> shiftleft(1, k)), s -> (rem & s) > 0)")
    pieces = (
        placed.where(is_cut)
        .select("doc_id", "doc_tokens", "rem", "bucket", start.alias("begin"), F.explode(F.arrays_zip(sizes.alias("size"), F.col("cut").alias("crc"))).alias("piece"))
        .select("doc_id", "doc_tokens", "bucket", F.col("piece.size").alias("size"), F.col("piece.crc").alias("crc"), (F.col("begin") + F.col("rem") - F.expr("rem & (2 * piece.size - 1)")).alias("start"))
    )
    counts = {s: sum(max(0, histogram[a] - f) for a, f in cut.items() if a & s) for s in (1 << k for k in range(bits - 1, -1, -1))}
    before, sofar = {}, 0
    for s, n in counts.items():
        before[s] = sofar
        sofar += s * n
    cut_sequences = -(-sofar // window)
    ahead = F.create_map(*[F.lit(v) for s, b in before.items() for v in (s, b)])
    place = F.element_at(ahead, F.col("size")).cast("long") + F.col("size") * F.col("piece_rank")
    scraps = bucket_ranks(pieces, ["size"], ["doc_id", "doc_tokens", "crc", "start"], "bucket", "piece_rank").select(
        "doc_id",
        "start",
        F.col("size").cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.lit(tiled) + F.shiftright(place, bits)).cast("long").alias("sequence_id"),
        F.pmod(place, F.lit(window)).cast("long").alias("offset"),
    )

    long = rows.where(F.size("full") > 0).withColumn("bucket", bucket)
    ahead_of = (
        long.groupBy("bucket")
        .agg(F.sum(F.size("full")).alias("n"))
        .select(F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    )
    by = [F.col(c).asc_nulls_first() for c in ("doc_id", "doc_tokens", "rem_crc", "full")]
    earlier = Window.partitionBy("bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    full = (
        long.withColumn("earlier", F.coalesce(F.sum(F.size("full")).over(earlier), F.lit(0)))
        .join(ahead_of, F.col("bucket") == F.col("of_bucket"))
        .select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "crc"), (F.col("earlier") + F.col("ahead") + tiled + cut_sequences).alias("first"))
        .select(
            "doc_id",
            (F.col("k").cast("long") * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            F.col("crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("first") + F.col("k")).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    )
    return kept.unionByName(scraps).unionByName(full)


#: Documents of a range of :func:`pack_in_order`, about.
RANGE = 1 << 14
_PLACED = "range long, local long, slot long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def _pack_range(window: int, slack: int):
    """Packs the rows of one range: remainders by :func:`plan`, then full windows; sequences are numbered by the mean
    number of their members."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["slot"] is None, r["slot"] or 0, r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"], r["rem_crc"], r["full"]))
        by: dict[int, list[dict]] = defaultdict(list)
        for r in rows:
            if r["rem"]:
                by[r["rem"]].append(r)
        runs, sequences, cut = plan({k: len(v) for k, v in by.items()}, window, slack)
        pieces: list[tuple[int, dict, int, int, int, int]] = []
        for length, rank, count, first, offset in runs:
            pieces += [(first + k, r, r["doc_tokens"] - length, length, r["rem_crc"], offset) for k, r in enumerate(by[length][rank : rank + count])]
        scraps = []
        for length, rank in cut.items():
            for r in by[length][rank:]:
                start = r["doc_tokens"] - length
                for size, crc in zip(powers(length), r["cut"], strict=True):
                    scraps.append((-size, r["slot"] or 0, r["doc_id"] or 0, start, crc, len(scraps), r))
                    start += size
        at = 0
        for size, _, _, start, crc, _, r in sorted(scraps, key=lambda x: x[:6]):
            pieces.append((sequences + at // window, r, start, -size, crc, at % window))
            at -= size
        sequences += -(-at // window)
        for r in rows:
            for k, crc in enumerate(r["full"]):
                pieces.append((sequences, r, k * window, window, crc, 0))
                sequences += 1
        slots: dict[int, list[int]] = defaultdict(list)
        for p in pieces:
            slots[p[0]].append(p[1]["slot"] or 0)
        local = {s: k for k, s in enumerate(sorted(slots, key=lambda s: (sum(slots[s]) / len(slots[s]), s)))}
        out = [(table.column("range")[0].as_py(), local[s], r["slot"], r["doc_id"], start, length, crc, r["doc_tokens"], offset) for s, r, start, length, crc, offset in pieces]
        columns = list(zip(*out, strict=True)) or [()] * 9
        names = [c.split()[0] for c in _PLACED.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    return run


def pack_in_order(
    docs: DataFrame, order: str, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, slack: int = SLACK, range_docs: int = RANGE
) -> DataFrame:
    """As :func:`pack`, with sequences in the order of the column ``order`` (long; rows of one number should be few): a range of
    numbers with about ``range_docs`` documents comes before the next. Rows without a number come first. Columns as there,
    and ``order``."""
    rows = materialize(measured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), vocabulary, window, end_id, order))
    size = rows.agg(F.count("slot").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count(F.lit(1)).alias("all")).first()
    low, span = size["low"] or 0, (size["high"] or 0) - (size["low"] or 0) + 1
    width = max(1, span * range_docs // max(1, size["n"]))
    loose = -1 - F.pmod(F.xxhash64("doc_id", "rem_crc", "doc_tokens"), F.lit(1 + size["all"] // range_docs))
    ranged = rows.withColumn("range", F.coalesce(F.expr(f"(slot - {low}) div {width}"), loose))
    placed = materialize(ranged.groupBy("range").applyInArrow(_pack_range(window, slack), _PLACED))
    # sequences before each range: within coarse ranges, and before those
    counts = placed.groupBy("range").agg((F.max("local") + 1).alias("n")).withColumn("coarse", F.shiftright("range", 10))
    upto = Window.unboundedPreceding, -1
    totals = counts.groupBy(F.col("coarse").alias("of_coarse")).agg(F.sum("n").alias("total"))
    totals = totals.select("of_coarse", F.coalesce(F.sum("total").over(Window.orderBy("of_coarse").rowsBetween(*upto)), F.lit(0)).alias("above"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("coarse").orderBy("range").rowsBetween(*upto)), F.lit(0))
    firsts = counts.withColumn("within", within).join(totals, F.col("coarse") == F.col("of_coarse")).select(F.col("range").alias("of_range"), (F.col("within") + F.col("above")).alias("first"))
    out = placed.join(firsts, F.col("range") == F.col("of_range"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local")).alias("sequence_id"), "offset", F.col("slot").alias(order))
