"""Sums that follow changes: a change adds signed sums of its own rows, and nothing else is read again.

The sums lie in three folders: a base, the deltas of batches that came after it, and a ledger of what the base
holds. A batch writes its delta under its own number, so a batch that comes twice overwrites itself, and one
that the base holds already is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.operators import facts

KEYS = ["line", "report_date"]
MEASURES = ["rows", "input", "good", "defects"]
_SCHEMA = "line string, report_date string, rows long, input long, good long, defects long"


def changes(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted facts that a change feed of unit rows adds (op insert, update_after) and takes back (delete,
    update_before). Another op fails the job."""
    unknown = F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("op", F.lit("null")))).cast("int")
    sign = F.when(F.col("op").isin("insert", "update_after"), 1).when(F.col("op").isin("delete", "update_before"), -1).otherwise(unknown)
    return facts.weighted(feed.where(sign == 1)), facts.weighted(feed.where(sign == -1))


def day_deltas(added: DataFrame, removed: DataFrame) -> DataFrame:
    """line, report_date, rows, input, good, defects: signed sums of weighted facts; days whose sums don't change are left out."""
    signed = added.select(*facts.DIMENSIONS, "quantity").unionByName(removed.select(*facts.DIMENSIONS, (-F.col("quantity")).alias("quantity")))
    entered = F.coalesce("input_included", F.lit(False))

    def total(condition=None):
        return F.coalesce(F.sum("quantity" if condition is None else F.when(condition, F.col("quantity"))), F.lit(0).cast("long"))

    sums = signed.groupBy(*KEYS).agg(total().alias("rows"), total(entered).alias("input"), total(entered & (F.col("status") == "GOOD")).alias("good"), total(entered & (F.col("status") == "FAIL")).alias("defects"))
    return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))


def add_up(sums: DataFrame) -> DataFrame:
    """Sums and deltas as one row for each line and day; days of which nothing is left drop out."""
    out = sums.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return out.where(" or ".join(f"{m} <> 0" for m in MEASURES))


class DaySums:
    """Sums of each line and day under a ``path`` that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not self._exists("ledger"):
            self._record(-1, spark.createDataFrame([], _SCHEMA))

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _record(self, upto: int, sums: DataFrame) -> None:
        # the base counts once the ledger names it
        sums.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
        self.spark.range(1).select(F.lit(upto).cast("long").alias("upto")).write.mode("append").parquet(f"{self.path}/ledger")

    def upto(self) -> int:
        """The last batch that the base holds; -1 at first."""
        return self.spark.read.schema("upto long").parquet(f"{self.path}/ledger").agg(F.max("upto")).first()[0]

    def apply(self, batch: int, added: DataFrame, removed: DataFrame) -> None:
        """Adds what a batch changes, once: weighted facts that count from now on, and those that don't any more."""
        if batch > self.upto():
            day_deltas(added, removed).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def _later(self, base: int, upto: int | None = None) -> DataFrame:
        if not self._exists("deltas"):
            return self.spark.createDataFrame([], _SCHEMA)
        later = self.spark.read.schema(_SCHEMA + ", batch long").option("basePath", f"{self.path}/deltas").parquet(f"{self.path}/deltas").where(F.col("batch") > base)
        return (later if upto is None else later.where(F.col("batch") <= upto)).drop("batch")

    def _state(self, upto: int | None = None) -> DataFrame:
        base = self.upto()
        stored = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/base/upto={base}")
        return add_up(stored.unionByName(self._later(base, upto)))

    def rows(self) -> DataFrame:
        """line, report_date, rows, input, good, defects as they are now."""
        return self._state()

    def fold(self, upto: int) -> None:
        """Takes the deltas of batches up to ``upto`` into the base; they must all have been applied."""
        if upto > self.upto():
            self._record(upto, self._state(upto))
