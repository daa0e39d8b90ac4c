"""Test logs from arriving files to elected units: parsed, checked and published, each batch once.

What a batch changes is written under its number: its candidates, the heads of its files, and signed ids of the
units that win or win no longer. A batch reads the state of the batches before it, so one that comes again after a
failure finds what it found before and overwrites what it wrote. Folding takes finished batches into a base, which
is kept in buckets of units: a batch then reads the base's buckets that it touches, without an exchange of them, the
files that it replaces, and the batches that came after the base.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from yieldloom.operators import archive, election, facts, retention
from yieldloom.sources import readers, sinks
from yieldloom.streaming import streams

LOG_SCHEMA = ", ".join(f"_c{k} string" for k in range(10))
UNIT = (
    "id long, line string, file_name string, job_id string, dedup_key string, dedup_time long, created_at long, report_date string, work_order string,"
    " product_code string, model_name string, status string, defect string, machine string, input_included boolean, is_defect boolean, source_format string"
)
COLUMNS = [field.split()[0] for field in UNIT.split(", ")]
# what an election asks of a unit
_RANKED = ["id", "line", "file_name", "job_id", "dedup_key", "dedup_time", "created_at", "report_date"]
# ids of one batch lie between its number times this and the next one's
BATCH_IDS = 2**40
_TABLES = {
    "candidates": UNIT,
    "heads": "line string, file_name string, job_id string",
    "winners": "id long, sign int",
    "counts": "line string, accepted long, duplicates long, archived_duplicates long",
    "refused": "file_name string, reason string, rows long",
    "ledger": "turn long, folder string, buckets int, groups string",
}


def _unit() -> Column:
    """Line and key in one; a row without a key is a unit of its own, so that no bucket takes them all."""
    return F.concat_ws("\u001f", "line", F.when(election.blank(), F.concat(F.lit("\u0000"), F.col("id").cast("string"))).otherwise(F.col("dedup_key")))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("unit"), F.lit(buckets))


class UnitStore:
    """Published units under a ``path`` that driver and executors share. The base is written in ``buckets``; give as many as
    make a bucket fit a task."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = archive.BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        for name, schema in _TABLES.items():
            spark.createDataFrame([], schema).limit(0).write.mode("overwrite").parquet(f"{path}/{name}/batch=-1")

    def table(self, name: str, before: int | None = None, after: int = -1) -> DataFrame:
        """Rows of one of the tables with their batch; of batches ``before`` one and ``after`` another only, if given."""
        rows = self.spark.read.schema(_TABLES[name] + ", batch long").parquet(f"{self.path}/{name}").where(F.col("batch") > after)
        return rows if before is None else rows.where(F.col("batch") < before)

    def write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def written(self, name: str, batch: int) -> DataFrame:
        """What :meth:`write` has written for a batch."""
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/batch={batch}")

    def _newest(self) -> tuple[int, int, str | None, int, str | None]:
        """The last batch that the base holds (-1: there is no base), how often a base was written, its folder, its buckets and
        the folder of its groups."""
        row = self.table("ledger").agg(F.max(F.struct("batch", "turn", "folder", "buckets", "groups")).alias("last")).first()["last"]
        return (-1, 0, None, self.buckets, None) if row is None else tuple(row)

    def upto(self) -> int:
        """The last batch that the base holds; -1 at first."""
        return self._newest()[0]

    def _base(self, folder: str | None, buckets: int) -> DataFrame:
        """The folded units: unit, bucket, wins and their columns."""
        if folder is None:
            # the limit tells Spark that there is nothing, so that it plans no joins with it
            return self.spark.createDataFrame([], f"{UNIT}, wins int, unit string, bucket int").limit(0)
        name = f"units_{folder}"
        if not self.spark.catalog.tableExists(name):
            at = f"{self.path}/units/{folder}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({UNIT}, wins int, unit string, bucket int) USING parquet PARTITIONED BY (bucket) CLUSTERED BY (unit) SORTED BY (unit) INTO {buckets} BUCKETS LOCATION '{at}'")
            self.spark.catalog.recoverPartitions(name)
        return self.spark.table(name)

    def heads(self, before: int | None = None) -> DataFrame:
        """The job that counts for each file, the newest, and its batch."""
        newest = F.rank().over(Window.partitionBy("file_name").orderBy(F.desc("batch")))
        return self.table("heads", before).withColumn("_n", newest).where("_n = 1").drop("_n")

    def _signed(self, base: DataFrame, after: DataFrame, upto: int, before: int | None) -> DataFrame:
        """Rows of the base and rows that came after it, with ``wins`` as it is now."""
        signs = self.table("winners", before, upto).groupBy(F.col("id").alias("of_id")).agg(F.sum("sign").alias("_n"))
        rows = base.select(*COLUMNS, "wins").unionByName(after.select(*COLUMNS, F.lit(0).alias("wins")))
        wins = F.col("wins") + F.coalesce("_n", F.lit(0)) > 0
        return rows.join(signs, F.col("id") == F.col("of_id"), "left").select(*COLUMNS, wins.alias("wins"))

    def _rows(self, before: int | None = None) -> DataFrame:
        upto, _, folder, buckets, _ = self._newest()
        if before is not None and before <= upto:
            raise ValueError(f"batch {before} has been folded into the base")
        return self._signed(self._base(folder, buckets), self.table("candidates", before, upto), upto, before)

    def winners(self, before: int | None = None) -> DataFrame:
        """Units that count."""
        return self._rows(before).where("wins").select(*COLUMNS)

    def touched(self, rows: DataFrame, before: int) -> DataFrame:
        """Live rows of the units and of the files that ``rows`` hold, with ``wins``, as they were ``before`` a batch. To the
        driver come at most as many numbers as the base has buckets and ``rows`` has files."""
        upto, _, folder, buckets, _ = self._newest()
        heads = self.heads(before)
        replaced = heads.join(rows.select("file_name").distinct(), "file_name", "left_semi")
        batches = [r["batch"] for r in replaced.select("batch").distinct().collect()]
        stored = election.active_candidates(self.table("candidates").where(F.col("batch").isin(batches)), replaced).select(*COLUMNS) if batches else rows.limit(0)
        keys = rows.select(*COLUMNS).unionByName(stored).where(~election.blank()).select(_unit().alias("unit")).distinct()
        base = self._base(folder, buckets)
        if folder is not None:
            keys = sinks.staged(keys)
            hit = [r["bucket"] for r in keys.select(_bucket(buckets).alias("bucket")).distinct().collect()]
            base = base.where(F.col("bucket").isin(hit)).join(keys, "unit", "left_semi")
        after = self.table("candidates", before, upto).where(~election.blank()).withColumn("unit", _unit()).join(keys, "unit", "left_semi")
        found = election.active_candidates(self._signed(base, after, upto, before), heads)
        return found.unionByName(stored.where(election.blank()).withColumn("wins", F.lit(True)))

    def fold(self, upto: int) -> None:
        """Takes the batches up to ``upto`` into the base, without rows whose file has been replaced; they must all be
        finished. The base counts once the ledger names it; the one before it stays for those who read it, older ones go."""
        if upto > self.upto():
            self._rebase(upto, self._live(upto), self._newest()[4])

    def compact(self, upto: int, cutoff: dt.date, archived: archive.Archive) -> None:
        """Folds the batches up to ``upto``, and moves units dated before the ``cutoff`` into weighted groups, verified
        (:func:`retention.compact_verified`), and their keys into the archive; other rows of archived keys go too. The ledger
        names base and groups together. Later batches need the archive and the cutoff; if a compaction fails, run it again
        before the next batch."""
        known = self.groups()
        winners = self.winners(upto + 1)
        _, merged = retention.compact_verified(winners, facts.compact_groups(winners.limit(0)) if known is None else known, cutoff, archived)
        name = uuid.uuid4().hex
        merged.write.parquet(f"{self.path}/groups/{name}")
        moved = F.col("wins") & F.coalesce(retention.dated_before(cutoff), F.lit(False))
        self._rebase(upto, archived.without(self._live(upto).where(~moved)), name)

    def groups(self) -> DataFrame | None:
        """Weighted groups of compacted units; None before there are any."""
        name = self._newest()[4]
        return None if name is None else self.spark.read.parquet(f"{self.path}/groups/{name}")

    def _live(self, upto: int) -> DataFrame:
        return election.active_candidates(self._rows(upto + 1), self.heads(upto + 1))

    def _rebase(self, upto: int, rows: DataFrame, groups: str | None) -> None:
        folder, turn = uuid.uuid4().hex, self._newest()[1] + 1
        placed = rows.withColumns({"wins": F.col("wins").cast("int"), "unit": _unit()}).withColumn("bucket", _bucket(self.buckets)).repartition(self.buckets, "unit")
        placed.write.format("parquet").partitionBy("bucket").bucketBy(self.buckets, "unit").sortBy("unit").option("path", f"{self.path}/units/{folder}").saveAsTable(f"units_{folder}")
        entry = self.spark.range(1).select(F.lit(turn).cast("long").alias("turn"), F.lit(folder).alias("folder"), F.lit(self.buckets).alias("buckets"), F.lit(groups).cast("string").alias("groups"))
        entry.write.mode("append").parquet(f"{self.path}/ledger/batch={upto}")
        for old in self.table("ledger").where(F.col("turn") == turn - 2).collect():
            self.spark.sql(f"DROP TABLE IF EXISTS units_{old['folder']}")
            sinks.delete(self.spark, f"{self.path}/units/{old['folder']}")



def refusals(units: DataFrame, cutoff: str | None = None, archived: archive.Archive | None = None, groups: DataFrame | None = None) -> DataFrame:
    """file_name, reason, rows: files that may not be published, for each reason with its rows. 'time': a time can't be read;
    'cutoff': dates before the archive's; 'earlier': rows earlier than the archived ones of their keys; 'guarded': the file has
    archived rows."""
    rows = units.select("file_name", "line", "dedup_key", "dedup_time", "report_date")
    reasons = [F.when(F.col("report_date").isNull(), "time")]
    if cutoff is not None:
        reasons.append(F.when(F.col("report_date") < cutoff, "cutoff"))
    if archived is not None:
        rows = archived.beside(rows)
        reasons.append(F.when(F.col("archived") & archive.earlier(), "earlier"))
    found = rows.select("file_name", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))
    if groups is not None:
        kept = groups.select("file_name").distinct()
        found = found.unionByName(units.join(kept, "file_name", "left_semi").select("file_name", F.lit("guarded").alias("reason")))
    return found.groupBy("file_name", "reason").agg(F.count(F.lit(1)).alias("rows"))


def parse_batch(rows: DataFrame, batch: int, line: str) -> DataFrame:
    """Units of raw log rows (_c0 to _c9, source_file), de-duplicated within each file, with ids of the batch that grow with
    their rows, and a job for each file."""
    raw = rows.withColumnsRenamed({"source_file": "file_name"}).withColumn("row_id", F.monotonically_increasing_id())
    # written down once, as the numbers above depend on how the files were read
    units = sinks.staged(readers.log_units(raw.where(F.concat_ws("", *[F.trim(f"_c{k}") for k in range(10)]) != ""), line))
    # a row's number is its task's above 33 bits and its place there: places follow those of the tasks before, without a sort
    task = F.shiftright("row_id", 33)
    ends = units.groupBy(task.alias("_task")).agg((F.max(F.col("row_id").bitwiseAND(2**33 - 1)) + 1).alias("_rows"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_task", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    # a row for each task that read files
    numbered = election.dedup_file(units).join(F.broadcast(starts), task == F.col("_task"))
    place = F.col("_start") + F.col("row_id").bitwiseAND(2**33 - 1) + 1
    own = {"id": place + F.lit(batch * BATCH_IDS), "job_id": F.concat(F.lit(f"{batch}-"), F.md5("file_name")), "created_at": F.lit(batch).cast("long"), "source_format": F.lit("current-v2")}
    return numbered.withColumns(own).select(*COLUMNS)


def publish_batch(store: UnitStore, rows: DataFrame, batch: int, line: str = "DAF", cutoff: str | None = None, archived: archive.Archive | None = None, groups: DataFrame | None = None) -> None:
    """One batch of raw log rows into the store; files with refusals stay out as a whole and are listed. A batch that the
    base holds already changes nothing. Files with archived rows are known by ``groups``, or else by the store's own."""
    if batch <= store.upto():
        return
    groups = store.groups() if groups is None else groups
    with sinks.released(store.spark):
        units = sinks.staged(parse_batch(rows, batch, line))
        refused = sinks.staged(refusals(units, cutoff, archived, groups))
        store.write("candidates", batch, units.join(refused.select("file_name").distinct(), "file_name", "left_anti").select(*COLUMNS))
        # read back where they are, as what follows asks for rows and heads again and again
        good = store.written("candidates", batch)
        store.write("heads", batch, good.select("line", "file_name", "job_id").distinct())
        head = store.written("heads", batch)
        part = sinks.staged(store.touched(good, batch).select(*_RANKED, "wins"))
        done = archive.publish(part.where("wins").select(*_RANKED), part.select(*_RANKED), store.heads(batch), good.select(*_RANKED), head, archived, groups, cutoff, hold=True)
        signed = done.added.select("id", F.lit(1).alias("sign")).unionByName(done.removed.select("id", F.lit(-1).alias("sign")))
        changed = signed.groupBy("id").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        for name, table in {"refused": refused, "counts": done.counts, "winners": changed}.items():
            store.write(name, batch, table)


def stream_logs(spark: SparkSession, source: str, store: UnitStore, checkpoint: str, per_trigger: int = 100, fold_every: int = 20, **policy: object) -> StreamingQuery:
    """Publishes the log files that arrive under ``source`` (with a header each), and stops when there are no more. Finished
    batches are folded when ``fold_every`` of them wait."""

    def publish(part: DataFrame, batch: int) -> None:
        # the batch before this one is finished, or this one wouldn't have begun
        if batch - 1 - store.upto() >= fold_every:
            store.fold(batch - 1)
        publish_batch(store, part, batch, **policy)

    rows = streams.stream_files(spark, source, LOG_SCHEMA, "csv", per_trigger, header=True, enforceSchema=True, escape='"', multiLine=True)
    return streams.stream_ingest(rows, publish, checkpoint)
