"""A Merkle manifest of a data set: a digest for each row, one for each source, one for all, and each row's proof.

Leaves of a source stand in the order of their ids; every :data:`FANOUT` consecutive nodes (the last run:
fewer, even one) become their digest, until one is left, the source's root. The sources' roots, in the order
of the sources, become one root in the same way.

The tree is a rollup of nested structs. A node's rank has one digit for each level. ``LEVELS`` levels
make a block of at most FANOUT ** LEVELS nodes: rows are dealt to tasks by (source, block) once, then one digit
column after the other is grouped away, and each grouping nests its child structs in their parent, all in
the same task. Digests of blocks are the nodes of the next tree, dealt in the same way, so no task or row holds more
than a block however large a source is. Proofs are made from the top down: a block's own proof comes into its
last grouping as one more child row (a union, no join), and a final transform over the nested structs and an
explode emit each row with the siblings on its way.

Cases: a null field counts as ``-`` and an empty one as an empty value; a null source is a source of its own and
comes first; rows with null ids come first and are never tampered with; rows of equal ids stand in the
order of their digests, so repeated rows are leaves side by side; a lone leaf is its source's root; an
empty table gives an empty result; texts of any length are digested whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import materialize

FANOUT = 3
LEVELS = 5
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column] | None = None) -> Column:
    """A row's digest; ``fields`` stands in for columns."""
    return F.sha2(F.concat(*[_field((fields or {}).get(f, F.col(f))) for f in FIELDS]), 256)


def tampered(text: Column) -> Column:
    """The change that verification has to find: line breaks deleted where 2 divides the id's crc32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def ranked(rows: DataFrame, key: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``key`` by ``order``, nulls first) and ``width`` (rows of the key).
    They are sorted into ranges; a range's first ranks come from a table of one row for each range and
    key, so a key may hold any share of the rows."""
    by = [F.col(c).asc_nulls_first() for c in ([key] if key else []) + order]
    of = F.col(key) if key else F.lit(0)
    dealt = materialize(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy(of.alias("of_key"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("of_key")
    before = F.coalesce(F.sum("n").over(each.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("of_key", "of_part", before.alias("before"), F.sum("n").over(each).alias("width"))
    place = F.row_number().over(Window.partitionBy(of, "part").orderBy(*by)).cast("long") - 1
    joined = dealt.withColumn("place", place).join(starts, of.eqNullSafe(F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return joined.select(*rows.columns, (F.col("place") + F.col("before")).alias("rank"), "width")


def _level_width(k: int) -> Column:
    """Nodes of the tree, ``k`` levels above its leaves."""
    return F.expr(f"(width + {FANOUT**k - 1}) div {FANOUT**k}")


_STEPS = "array<struct<sides:array<string>,at:int>>"
_ABOVE = f"struct<subroot:string,root:string,steps:{_STEPS}>"
_DIGITS = [f"d{k}" for k in range(1, LEVELS + 1)]


def _dealt(nodes: DataFrame, payload: Column, spine: DataFrame | None = None) -> DataFrame:
    """Nodes (tree, width, rank, digest) with the digits of their ranks, and rows of their blocks' ``spine``
    (tree, width, block, above), dealt to tasks by block."""
    digits = [F.expr(f"cast((rank div {FANOUT ** (k - 1)}) % {FANOUT} as int)").alias(d) for k, d in enumerate(_DIGITS, 1)]
    block = F.expr(f"rank div {FANOUT**LEVELS}").alias("block")
    rows = nodes.select("tree", "width", block, *digits, "digest", payload.alias("kids"), F.lit(None).cast(_ABOVE).alias("above"))
    if spine is not None:
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*_DIGITS, "digest", "kids")]
        rows = rows.unionByName(spine.select("tree", "width", "block", *none, "above"))
    return rows.repartition("tree", "width", "block")


def _nest(nodes: DataFrame, k: int) -> DataFrame:
    """Groups digit ``k`` away: kids (the child structs in order), digest, above. A node that is alone at its level
    is passed on with its digest as it is."""
    child = F.when(F.col("above").isNull(), F.struct(_DIGITS[k - 1], "digest", "kids"))
    kids = F.sort_array(F.collect_list(child)).alias("kids")
    grouped = nodes.groupBy("tree", "width", "block", *_DIGITS[k:]).agg(kids, F.first("above", ignorenulls=True).alias("above"))
    together = F.sha2(F.concat_ws("", F.transform("kids", lambda c: c["digest"])), 256)
    return grouped.withColumn("digest", F.when(_level_width(k - 1) > 1, together).otherwise(F.get("kids", F.lit(0))["digest"]))


def _block_digests(nodes: DataFrame) -> DataFrame:
    """The next tree's nodes: a row for each block, with its tree, its rank there, and that tree's width (``below``:
    that of the tree under it)."""
    none = F.lit(None).cast("int")
    rows = _dealt(nodes, none)
    for k in range(1, LEVELS + 1):
        rows = _nest(rows, k).withColumn("kids", none)
    return rows.select("tree", _level_width(LEVELS).alias("width"), F.col("block").alias("rank"), "digest", F.col("width").alias("below"))


def _emitted(kids: Column, k: int, steps: Column) -> Column:
    """The payloads below ``kids``, children of a node ``k`` levels up, each with its steps: for each level
    of more than one node the digests of its run and its own place there."""
    run = F.transform(kids, lambda c: c["digest"])

    def below(child: Column, at: Column) -> Column:
        step = F.array(F.struct(run.alias("sides"), at.cast("int").alias("at")))
        onward = F.concat(F.when(_level_width(k - 1) > 1, step).otherwise(F.array().cast(_STEPS)), steps)
        if k == 1:
            return F.array(F.struct(child["kids"].alias("payload"), onward.alias("steps")))
        return _emitted(child["kids"], k - 1, onward)

    return F.flatten(F.transform(kids, below))


def _descend(nodes: DataFrame, payload: Column, spine: DataFrame) -> DataFrame:
    """tree, payload and above of each node: what is above its block (``spine``), and its steps within it."""
    rows = _dealt(nodes, payload, spine)
    for k in range(1, LEVELS + 1):
        rows = _nest(rows, k)
    out = rows.select("tree", "above", F.explode(_emitted(F.col("kids"), LEVELS, F.col("above.steps"))).alias("out"))
    above = F.struct(F.col("above.subroot").alias("subroot"), F.col("above.root").alias("root"), F.col("out.steps").alias("steps"))
    return out.select("tree", "out.payload", above.alias("above"))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks, the blocks of those, and so on, up to one for each tree."""
    most = nodes.agg(F.max("width")).first()[0] or 0
    levels = [nodes]
    while len(levels) == 1 or most > 1:
        levels.append(materialize(_block_digests(levels[-1])))
        most = -(-most // FANOUT**LEVELS)
    return levels


def _prove(levels: list[DataFrame], payload: Column, above: DataFrame) -> DataFrame:
    """tree, payload and above of each node of the lowest level; ``above`` has what is above each root (tree, above)."""
    top = levels[-1].select("tree", "below", "rank")
    of = above.select(F.col("tree").alias("of_tree"), "above")
    spine = top.join(of, F.col("tree").eqNullSafe(F.col("of_tree"))).select("tree", F.col("below").alias("width"), F.col("rank").alias("block"), "above")
    for nodes in reversed(levels[1:-1]):
        found = _descend(nodes, F.struct("below", "rank"), spine)
        spine = materialize(found.select("tree", F.col("payload.below").alias("width"), F.col("payload.rank").alias("block"), "above"))
    return _descend(levels[0], payload, spine)


def manifest(docs: DataFrame, change: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (the siblings' digests, bottom up, left to right), proof_sha256
    (their digest), folded_root (recomputed from the row's leaf after ``change`` of its text and from the siblings), and
    verified (whether that is the root): one row for each row of ``docs``. Without ``change`` all rows are verified as they are."""
    after = F.col("text") if change is None else change
    leaves = docs.select("doc_id", F.col("source").alias("tree"), leaf_digest().alias("digest"), F.nullif(leaf_digest({"text": after}), leaf_digest()).alias("changed"))
    nodes = materialize(ranked(materialize(leaves), "tree", ["doc_id", "digest"]))
    levels = _climb(nodes)
    roots = levels[-1].select("tree", "digest")

    sources = materialize(ranked(roots.withColumnRenamed("tree", "source"), None, ["source"]).withColumn("tree", F.lit("all")))
    over = _climb(sources)
    one = F.struct(F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_STEPS).alias("steps"))
    proved = _prove(over, F.struct("source", "digest"), over[-1].select("tree", one.alias("above")))
    above = F.struct(F.col("payload.digest").alias("subroot"), F.col("above.root").alias("root"), F.col("above.steps").alias("steps"))
    proved = materialize(proved.select(F.col("payload.source").alias("tree"), above.alias("above")))

    rows = _prove(levels, F.struct("doc_id", "digest", "changed"), proved)
    rows = rows.select(F.col("payload.doc_id").alias("doc_id"), F.col("tree").alias("source"), F.col("payload.digest").alias("leaf"), F.col("payload.changed").alias("changed"), "above.*")
    sides = F.flatten(F.transform("steps", lambda s: F.filter(s["sides"], lambda x, i: i != s["at"])))
    rows = rows.select("*", sides.alias("proof")).withColumn("folded_root", fold_proof(F.coalesce("changed", "leaf"), F.col("steps")))
    return rows.select("doc_id", "source", "leaf", "subroot", "root", "proof", F.sha2(F.concat_ws("", "proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def fold_proof(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the digests beside its way up."""

    def up(digest: Column, step: Column) -> Column:
        return F.sha2(F.concat_ws("", F.transform(step["sides"], lambda x, i: F.when(i == step["at"], digest).otherwise(x))), 256)

    return F.aggregate(steps, leaf, up)
