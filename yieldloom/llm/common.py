"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only in local mode, where they
    are one process, a temporary folder of this application stands in for it."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_folder:
        _own_folder[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[sc.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: its lineage is cut and every
    later use reads the same rows, also after executors are lost. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/yieldloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case ignored)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut so that the texts of a slice stay near ``most_bytes``; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, giving freed Arrow memory back after each batch: two workers share an executor
    with the JVM, and live on for other tasks."""

    def wrapped(batches):
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()

    return wrapped


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5: 0 marks the held-out rows."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def bucket_ranks(df: DataFrame, keys: list[str], order: str | list[str], bucket: str, rank: str) -> DataFrame:
    """``df`` with ``rank``: 0-based position within ``keys`` by (``bucket``, ``order``). Rows that are equal in all
    of ``order`` should be equal altogether, as which of them comes first isn't defined.

    A key may hold any share of the rows: row numbers are taken within (keys, bucket), and the rows
    before each bucket come from a table of one row for each (keys, bucket).
    """
    order = [order] if isinstance(order, str) else order
    keyed = [F.col(k) for k in keys]
    n, before = fresh("n_rows", df.columns), fresh("n_before", df.columns)
    counts = df.groupBy(*keyed, bucket).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keyed).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    inner = Window.partitionBy(*keyed, bucket).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = df.withColumn(rank, F.row_number().over(inner).cast("long") - 1)
    other = {c: fresh(f"of_{c}", [*ranked.columns, before]) for c in (*keys, bucket)}
    counts = counts.select(*[F.col(c).alias(x) for c, x in other.items()], before)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(x)) for c, x in other.items()))
    return ranked.join(counts, same, "inner").withColumn(rank, F.col(rank) + F.col(before)).drop(before, *other.values())
