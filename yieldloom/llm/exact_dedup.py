"""Exact deduplication by Grace hashing.

Texts are equal when identical after lower-casing A-Z only. Equal texts are first combined inside each task,
with at most ``TASK_BYTES`` in memory: texts met once go on when the table is full, repeated ones stay, so a
text that fills a third of the corpus reaches the shuffle once for each task. Spark's hash shuffle then makes the first partitions; a partition that doesn't fit ``table_bytes`` is
split again, recursively, into spill files by a freshly seeded hash, until each bucket fits one
open-addressing table (a ``dict`` keyed by the complete text, so complete contents are compared).

Cases: null text counts as empty; empty texts are equal to each other; a null id is below every other;
repeated rows (same id, same text) count each in ``group_size``; an empty table gives an empty result;
other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import fresh, tidy, utf8

TABLE_BYTES = 64 << 20
TASK_BYTES = 16 << 20
FANOUT = 16


def _combine(batch: pa.RecordBatch, text: str, order: str, n: str) -> pa.RecordBatch:
    """One row for each distinct text of ``batch``: the one with the largest ``order``; ``n`` is summed."""
    table: dict[bytes, int] = {}
    counts: list[int] = []
    best: list[int] = []
    ids, rows = batch.column(order).to_pylist(), batch.column(n).to_pylist()
    for i, content in enumerate(utf8(batch.column(text))):
        at = table.setdefault(content.lower(), len(counts))
        if at == len(counts):
            counts.append(rows[i])
            best.append(i)
            continue
        counts[at] += rows[i]
        if ids[best[at]] is None or (ids[i] is not None and ids[i] > ids[best[at]]):
            best[at] = i
    out = batch.take(pa.array(best, pa.int64()))
    return out.set_column(out.schema.get_field_index(n), n, pa.array(counts, pa.int64()))


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def combined(batches: Iterable[pa.RecordBatch], text: str, order: str, n: str, most_bytes: int = TASK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_combine` over a task's ``batches``, where memory allows; a text may come again
    only if it was met once, or if repeated texts alone fill half of ``most_bytes``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_combine(batch, text, order, n))
        size += held[-1].nbytes
        if size > most_bytes:
            table = _combine(_one_batch(held), text, order, n)
            again = pc.greater(table.column(n), 1)
            yield table.filter(pc.invert(again))
            held = [table.filter(again)]
            size = held[0].nbytes
            if size > most_bytes // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _combine(_one_batch(held), text, order, n)


def grace(
    batches: Iterable[pa.RecordBatch], text: str, order: str, n: str, table_bytes: int = TABLE_BYTES, depth: int = 0
) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_combine` over all ``batches``, with at most about ``table_bytes`` in memory."""
    held: list[pa.RecordBatch] = []
    size = 0
    files: list[pa.RecordBatchStreamWriter] = []
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:

        def spill(batch: pa.RecordBatch) -> None:
            parts = [xxhash.xxh3_64_intdigest(c.lower(), seed=depth + 1) % FANOUT for c in utf8(batch.column(text))]
            column = pa.array(parts, pa.int8())
            if not files:
                files.extend(pa.ipc.new_stream(f"{folder}/{k}", batch.schema) for k in range(FANOUT))
            for k in set(parts):
                files[k].write_batch(batch.filter(pc.equal(column, k)))

        for batch in batches:
            if not batch.num_rows:
                continue
            if files:
                spill(batch)
                continue
            held.append(batch)
            size += batch.nbytes
            if size > table_bytes:
                held = [_combine(_one_batch(held), text, order, n)]
                size = held[0].nbytes
                if size > table_bytes // 2 and held[0].num_rows > 1:
                    spill(held[0])
                    held = []
        if held:
            yield _combine(_one_batch(held), text, order, n)
        for k, f in enumerate(files):
            f.close()
            path = Path(folder, str(k))
            with pa.OSFile(str(path)) as source, pa.ipc.open_stream(source) as stream:
                yield from grace(stream, text, order, n, table_bytes, depth + 1)
            path.unlink()


def _with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(*f) for f in fields)])


def survivors(docs: DataFrame, text: str = "text", order: str = "doc_id", table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, str]:
    """One row of ``docs`` for each distinct text, the one with the largest ``order``; and the name of the
    added column that counts the rows of its group."""
    n, key = fresh("group_size", docs.columns), fresh("content_key", docs.columns)

    def partial(batches):
        counted = (b.append_column(n, pa.array([1] * b.num_rows, pa.int64())) for b in batches)
        for batch in combined(counted, text, order, n):
            keys = [xxhash.xxh3_64_intdigest(c.lower()) - (1 << 63) for c in utf8(batch.column(text))]
            yield batch.append_column(key, pa.array(keys, pa.int64()))

    def bucket(batches):
        yield from grace(batches, text, order, n, table_bytes)

    schema = _with_fields(docs.schema, (n, T.LongType()), (key, T.LongType()))
    dealt = docs.mapInArrow(tidy(partial), schema).repartition(F.col(key))
    return dealt.mapInArrow(tidy(bucket), schema).drop(key), n


def deduplicate(docs: DataFrame, text: str = "text", order: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with one row for each distinct text: that with the largest ``order``. Columns as before."""
    rows, n = survivors(docs, text, order, table_bytes)
    return rows.drop(n)


def duplicate_groups(docs: DataFrame, text: str = "text", order: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Only groups of two and more are joined to the rows again; the copies of one text may be any share
    of the corpus, as Spark splits the large side of that join.
    """
    sha = T.StructType([T.StructField("doc_id", docs.schema[order].dataType), T.StructField("sha", T.BinaryType())])

    def digests(batches):
        for batch in batches:
            values = [hashlib.sha256(c.lower()).digest() for c in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", "sha"])

    narrow = docs.select(F.col(order).alias("doc_id"), F.col(text).alias("text"))
    rows, n = survivors(narrow, table_bytes=table_bytes)
    groups = (
        rows.where(F.col(n) > 1)
        .select("doc_id", "text", n)
        .mapInArrow(_group_digests(n), T.StructType([T.StructField("keep_id", sha[0].dataType), T.StructField("sha_of", T.BinaryType()), T.StructField("n", T.LongType())]))
    )
    members = narrow.mapInArrow(tidy(digests), sha)
    joined = members.join(groups, F.col("sha") == F.col("sha_of"), "left")
    keep = F.when(F.col("sha_of").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _group_digests(n: str):
    def digests(batches):
        for batch in batches:
            values = [hashlib.sha256(c.lower()).digest() for c in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary()), batch.column(n)], ["keep_id", "sha_of", "n"])

    return digests
