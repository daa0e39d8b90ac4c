"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks of ``block`` rows (16; more beyond 16 million rows). With integer weights that add up to the
cycle W (thousandths; finer ones if those would drift by a block over the data), block i of a source of weight w may run from slot floor(i*W/w) (its release) and must have run
before slot ceil((i+1)*W/w) (its deadline). Each slot takes the released block with the earliest
deadline; ties go to the source that comes first by name. The schedule repeats after W slots, so only
one cycle is worked out, on the driver: blocks grow with the corpus, so that it has at most ``MAX_CYCLE`` slots. A row's
slot then follows from its rank within its source. Until the first source runs out, every prefix of
slots holds each source's weight with a deviation of less than one block; later on its slots are empty.
:func:`mix` keeps all rows under tempered weights, and cuts there under weights that a caller gives.

Only DataFrame operations touch rows. Cases: a null source is a source of its own; a null id ranks
first; repeated rows rank next to each other; an empty table gives an empty result; other columns are
ignored by :func:`schedule` and carried by :func:`mix`.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import bucket_ranks, fresh

BUCKETS = 4096
RESOLUTION = 1000
MAX_SOURCES = 10_000
BLOCK = 16
#: Blocks grow with the corpus, so that there are no more than these, and the driver works out a bounded cycle.
MAX_BLOCKS = 1 << 20
#: Slots of one cycle, 16 MB when they are broadcast.
MAX_CYCLE = 1 << 22
#: The column in which :func:`with_slots` leaves a row's place.
SLOT = "mix_slot"


def block_size(rows: int) -> int:
    """Rows of a block: ``BLOCK``, doubled until the corpus has at most ``MAX_BLOCKS`` of them."""
    size = BLOCK
    while rows > size * MAX_BLOCKS:
        size *= 2
    return size


def tempered(counts: dict[str | None, int], alpha: float) -> dict[str | None, float]:
    """Weights in proportion to rows to the power ``alpha``: 1 keeps the corpus, 0 makes sources equal."""
    powers = {s: n**alpha for s, n in counts.items()}
    total = sum(powers[s] for s in _by_name(powers))
    return {s: p / total for s, p in powers.items()}


def _by_name(sources) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is not None, s or ""))


def integer_weights(weights: dict[str | None, float], resolution: int = RESOLUTION) -> dict[str | None, int]:
    """Weights in thousandths (``resolution``-ths), each at least 1."""
    return {s: max(1, int(w * resolution + 0.5)) for s, w in weights.items()}


def fine_weights(weights: dict[str | None, float], blocks: dict[str | None, int]) -> dict[str | None, int]:
    """Integer weights of a resolution at which no source drifts from its share of ``weights`` by a block
    while it lasts, within as many slots as there are blocks (by then a source has run out). Thousandths
    if they are enough; else finer, with remainders dealt to the largest fractions."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    count = sum(blocks[s] for s in share)
    lasts = {s: min(blocks[s] / share[s], count) for s in share}

    def enough(whole):
        cycle_ = sum(whole.values())
        return all(abs(Fraction(n, cycle_) - share[s]) * lasts[s] < 1 for s, n in whole.items())

    whole, resolution = integer_weights({s: float(x) for s, x in share.items()}), RESOLUTION
    while not enough(whole):
        resolution *= 2
        if resolution > MAX_CYCLE:
            raise ValueError(f"weights need a cycle of more than {MAX_CYCLE} slots; give coarser ones or larger blocks")
        whole = {s: max(1, int(x * resolution)) for s, x in share.items()}
        left = resolution - sum(whole.values())
        for s in sorted(share, key=lambda s: -(share[s] * resolution % 1))[: max(0, left)]:
            whole[s] += 1
    return whole


def cycle(weights: dict[str | None, int]) -> dict[str | None, list[int]]:
    """For each source, the slots of its blocks within one cycle of ``sum(weights)`` slots."""
    total = sum(weights.values())
    slots: dict[str | None, list[int]] = {s: [] for s in weights}
    names = _by_name(weights)
    later = [(0, k) for k in range(len(names))]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    for slot in range(total):
        while later and later[0][0] <= slot:
            k = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(len(slots[names[k]]) + 1) * total // weights[names[k]]), k))
        k = heapq.heappop(ready)[1]
        slots[names[k]].append(slot)
        if len(slots[names[k]]) < weights[names[k]]:
            heapq.heappush(later, (len(slots[names[k]]) * total // weights[names[k]], k))
    return slots


def _plan(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, block: int | None) -> tuple[DataFrame, int]:
    """A row for each source: weight, cycle, slots of one cycle, and the slot from which some source has
    run out (``horizon``, the same in all rows); and the rows of a block. Only row counts of sources come to the driver."""
    found = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; give coarser ones")
    counts = {r["source"]: r["n"] for r in found}
    block = block or block_size(sum(counts.values()))
    wanted = tempered(counts, alpha) if weights is None else {s: weights.get(s, 0.0) for s in counts}
    positive = {s: w for s, w in wanted.items() if w > 0} or {s: 1.0 for s in counts}
    whole = fine_weights(positive, {s: -(-counts[s] // block) for s in positive}) if positive else {}
    total, slots = sum(whole.values()), cycle(whole)

    def slot(s, i):
        return i // whole[s] * total + slots[s][i % whole[s]]

    horizon = min((slot(s, counts[s] // block) for s in whole), default=0)
    schema = "source string, weight long, cycle long, slots array<int>, horizon long"
    rows = [(s, whole.get(s, 0), total, slots.get(s, []), horizon) for s in _by_name(counts)]
    return docs.sparkSession.createDataFrame(rows, schema), block


def _bucket(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(doc_id, F.lit(BUCKETS)), F.lit(0))


def _slotted(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, block: int | None, cut: bool | None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with further columns, and their names by part: rank (from 0), block, weight, cycle, slot,
    in_mix."""
    cut = weights is not None if cut is None else cut
    name = {n: fresh(n, docs.columns) for n in ("bucket", "rank", "block", "weight", "cycle", "slot", "slots", "horizon", "in_mix", "of_source")}
    rows = docs.withColumn(name["bucket"], _bucket(F.col("doc_id")))
    ranked = bucket_ranks(rows, ["source"], "doc_id", name["bucket"], name["rank"])
    plan, block = _plan(docs, weights, alpha, block)
    plan = plan.select(F.col("source").alias(name["of_source"]), *[F.col(n).alias(name[n]) for n in ("weight", "cycle", "slots", "horizon")])
    # at most MAX_SOURCES rows, which hold the MAX_CYCLE slots of one cycle at most
    joined = ranked.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(name["of_source"])))
    joined = joined.withColumn(name["block"], F.expr(f"{name['rank']} div {block}"))
    w = F.col(name["weight"])
    at = F.expr(f"({name['block']} div {name['weight']}) * {name['cycle']} + {name['slots']}[cast({name['block']} % {name['weight']} as int)]")
    joined = joined.withColumn(name["slot"], F.when(w > 0, at).cast("long"))
    # rows of sources of weight 0 have no slot
    within = F.col(name["slot"]) < F.col(name["horizon"]) if cut else F.col(name["slot"]).isNotNull()
    joined = joined.withColumn(name["in_mix"], F.coalesce(within, F.lit(False)))
    kept = ("bucket", "rank", "block", "weight", "cycle", "slot", "in_mix")
    return joined.select(*docs.columns, *[name[n] for n in kept]), name


def schedule(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int | None = None, cut: bool | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, weight (of ``cycle``), source_rank (from 1; by
    doc_id mod 4096, then doc_id), block (from 0), release, deadline, slot (null for weight 0), in_mix.

    With ``cut``, in_mix holds before the slot at which the first source runs out; without, for each row
    that has a slot. Unless it is given, only weights of the caller's cut: tempered ones follow from the
    corpus itself, whose smallest source would bound it."""
    rows, _ = _slotted(docs.select("doc_id", "source"), weights, alpha, block, cut)
    w, c, i = F.col("weight").cast("long"), F.col("cycle").cast("long"), F.col("block")
    return rows.select(
        "doc_id",
        "source",
        w.alias("weight"),
        c.alias("cycle"),
        (F.col("rank") + 1).alias("source_rank"),
        i,
        F.when(w > 0, F.expr("(block * cycle) div weight")).alias("release"),
        F.when(w > 0, F.expr("((block + 1) * cycle + weight - 1) div weight")).alias("deadline"),
        "slot",
        "in_mix",
    )


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int | None = None, cut: bool | None = None
) -> DataFrame:
    """The rows of ``docs`` that are in the mixture (see :func:`schedule`), in the order of their slots.
    Columns as before.

    Slots of a source that has run out stay empty, so the others go on in proportion to their weights.
    """
    rows, name = _slotted(docs, weights, alpha, block, cut)
    return rows.where(F.col(name["in_mix"])).orderBy(name["slot"], name["rank"]).select(*docs.columns)


def with_slots(
    docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int | None = None, cut: bool | None = None
) -> DataFrame:
    """As :func:`mix`, but rows stay where they are and carry their slot in a further column (:data:`SLOT`), for a reader that
    puts them in order when they are small: texts are not sorted."""
    rows, name = _slotted(docs, weights, alpha, block, cut)
    return rows.where(F.col(name["in_mix"])).select(*docs.columns, F.col(name["slot"]).alias(fresh(SLOT, docs.columns)))


def slot_column(columns: list[str]) -> str | None:
    """The column that :func:`with_slots` added last, if there is one."""
    return max((c for c in columns if c.lstrip("_") == SLOT), key=len, default=None)
