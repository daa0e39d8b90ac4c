"""Exports, and keyed or file-wise replacement. Replacements return the new table; the caller writes it
to a new place, or merges it where the catalog can."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def export_sections(sections: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """One folder for each section of a report."""
    for name, df in sections.items():
        df.write.mode("errorifexists").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).format(fmt).save(f"{path}/{name}")


def export_event_sections(sections: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    """The sections of a machine log report."""
    export_sections(sections, path, fmt)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with ``rows`` in place of those of the same keys."""
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def replace_file(target: DataFrame, file: str, rows: DataFrame, column: str = "file_name") -> DataFrame:
    """``target`` with all rows of one file replaced."""
    return target.where(~F.col(column).eqNullSafe(F.lit(file))).unionByName(rows.select(*target.columns))


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``), or, in local mode
    only, in a temporary one. What is written there goes when the driver ends."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = f"{shared}/scratch-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/data"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the scratch folder once and read back: later uses see the same rows and don't work them out
    again, also after executors are lost."""
    path = scratch_path(df.sparkSession)
    held = _held.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library has written, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at its end, so a stream doesn't fill the scratch folder: write the results down inside."""
    held: list[str] = []
    outer = _held.set(held)
    try:
        yield
    finally:
        _held.reset(outer)
        for path in held:
            delete(spark, path)
