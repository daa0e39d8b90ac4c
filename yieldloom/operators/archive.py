"""The archive of units that compaction has moved into weighted groups, and publication over it.

A unit that is archived counts in its group for good: it never wins again, an upload that holds an earlier row of it
is refused, and a file with archived rows can be neither replaced nor deleted. So every upload asks which
of its keys are archived. The archived keys are kept as a table bucketed by unit (line and key in one), with a
partition for each bucket: membership is a join without an exchange of the archive, and only the
buckets that an upload touches are read.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.operators import election, facts
from yieldloom.operators.election import KEY, blank
from yieldloom.sources.sinks import scratch_path, staged

BUCKETS = 64
KEYS = ["line", "dedup_key", "dedup_time", "file_name"]


def unit() -> Column:
    return F.concat_ws("\u001f", "line", "dedup_key")


class Archive:
    """Archived keys (line, dedup_key, dedup_time, file_name) under a table name."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    @classmethod
    def create(cls, keys: DataFrame, name: str | None = None, buckets: int = BUCKETS, path: str | None = None) -> Archive:
        """A new table of ``keys``; without a ``path`` it lies in the scratch folder and goes with the driver."""
        spark = keys.sparkSession
        out = cls(spark, name or f"archived_units_{uuid.uuid4().hex}", buckets)
        out._write(keys, path or scratch_path(spark), "errorifexists")
        return out

    def append(self, keys: DataFrame) -> None:
        """Adds the keys of a further compaction; those that are there already stay as they are."""
        fresh = staged(self.without(keys.select(*KEYS)))
        self._write(fresh, None, "append")

    def _bucket(self) -> Column:
        # the number that Spark gives to the bucket of a unit
        return F.pmod(F.hash("unit"), F.lit(self.buckets))

    def _write(self, keys: DataFrame, path: str | None, mode: str) -> None:
        rows = keys.where(~blank()).select(unit().alias("unit"), *KEYS).withColumn("bucket", self._bucket()).repartition(self.buckets, "unit")
        writer = rows.write.mode(mode).format("parquet").partitionBy("bucket").bucketBy(self.buckets, "unit").sortBy("unit")
        (writer if path is None else writer.option("path", path)).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*KEYS)

    def touched(self, rows: DataFrame) -> DataFrame:
        """The archive's part in the buckets that ``rows`` (with ``unit``) touch: unit, archived_time, archived_file. At
        most as many numbers as there are buckets come to the driver."""
        hit = [r["bucket"] for r in rows.select(self._bucket().alias("bucket")).distinct().collect()]
        part = self.spark.table(self.name).where(F.col("bucket").isin(hit))
        return part.select(F.col("unit").alias("of_unit"), F.col("dedup_time").alias("archived_time"), F.col("file_name").alias("archived_file"))

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` with archived_time, archived_file and archived (whether their key is there)."""
        keyed = rows.withColumn("unit", F.when(~blank(), unit()))
        # the archive stands in its buckets and is not shuffled; the upload is
        joined = keyed.join(self.touched(keyed.where("unit is not null")).hint("merge"), F.col("unit") == F.col("of_unit"), "left")
        return joined.select(*rows.columns, "archived_time", "archived_file", F.col("of_unit").isNotNull().alias("archived"))

    def without(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose key is not archived; rows without a key stay."""
        return self.beside(rows).where("not archived").select(*rows.columns)


def earlier(time: str = "dedup_time", archived: str = "archived_time") -> Column:
    """Whether an incoming row comes before the archived one of its key: a missing time comes last on both sides."""
    return F.coalesce(F.col(time) < F.col(archived), F.col(time).isNotNull() & F.col(archived).isNull())


class Publication(NamedTuple):
    """winners and heads as they are now; counts (line, accepted, duplicates, archived_duplicates); pairs (line, file_name)
    of the files whose content may have changed; the unit rows that count now (added) or no longer (removed), of touched units
    only: a row may be in both."""

    winners: DataFrame
    heads: DataFrame
    counts: DataFrame
    pairs: DataFrame
    added: DataFrame
    removed: DataFrame

    def digests(self, stored: DataFrame) -> DataFrame:
        """Stored :func:`facts.day_digests` after the change, from the touched units alone."""
        return facts.change_digests(stored, facts.weighted(self.added), facts.weighted(self.removed))

    def summaries(self, stored: DataFrame, details: DataFrame, groups: DataFrame | None = None) -> DataFrame:
        """Stored summaries with those of the touched files made anew (``details``: heads with their fallback columns);
        those of files that have no head any more are gone."""
        now = facts.refresh_summaries(facts.fact_view(self.winners, None, groups), details, self.pairs)
        kept = stored.join(self.pairs, ["line", "file_name"], "left_anti").select(*now.columns)
        return kept.unionByName(now)


def _refuse_archived(groups: DataFrame | None, heads: DataFrame, what: str) -> None:
    if groups is not None and not election.guard_archived(groups, heads).isEmpty():
        raise ValueError(f"a file with archived rows can't be {what}")


def publish(
    winners: DataFrame,
    candidates: DataFrame,
    heads: DataFrame,
    incoming: DataFrame,
    head: DataFrame,
    archive: Archive | None = None,
    groups: DataFrame | None = None,
    cutoff: str | None = None,
    hold: bool = False,
) -> Publication:
    """Makes ``head`` (line, file_name, job_id; all lines of its files) count, with its rows ``incoming``.

    Refused (ValueError), with nothing changed: a file with archived rows (of ``groups``) in place, dates before the
    ``cutoff``, and rows earlier than the archived ones of their keys. Keys that win in another file, or are archived
    from one, count as duplicates. Keys of the files' old winners and of the new rows are ranked again, unless they
    are archived; other winners stay. Only the upload's own keys, and what the archive says of them, are written down
    before the result is asked for; with ``hold`` the elected rows too, for callers that ask for several parts of it."""
    names = head.select("file_name").distinct()
    replaced = heads.join(names, "file_name", "left_semi")
    _refuse_archived(groups, replaced.select("line", "file_name"), "replaced")
    incoming = election.reject_archived_dates(incoming, cutoff).select(*candidates.columns)
    heads_now = heads.join(names, "file_name", "left_anti").select(*head.columns).unionByName(head)

    own = incoming.where(~blank())
    own = own.select(*candidates.columns)
    if archive is None:
        beside = own.select(*KEY, "id", "file_name", F.lit(False).alias("archived"), F.lit(None).cast("string").alias("archived_file"))
    else:
        asked = archive.beside(own.select(*KEY, "id", "file_name", "dedup_time"))
        beside = staged(asked.select(*KEY, "id", "file_name", "archived", "archived_file", (F.col("archived") & earlier()).alias("refused")))
        if not beside.where("refused").isEmpty():
            raise ValueError("the upload holds records earlier than archived ones")

    # keys of the files' stored rows (their old winners among them) and of the new ones
    stored = candidates.where(~blank()).join(names, "file_name", "left_semi").select(*KEY)
    touched = stored.withColumn("archived", F.lit(False)).unionByName(beside.select(*KEY, "archived")).groupBy(*KEY).agg(F.max("archived").alias("archived"))
    live = touched.where("not archived").select(*KEY)
    pool = candidates.where(~blank()).join(live, KEY, "left_semi").select(*candidates.columns)
    pool = election.active_candidates(pool, heads_now).unionByName(own.join(live, KEY, "left_semi").select(*candidates.columns))
    elected = election.first_by(pool, KEY, election.order())
    elected = staged(elected) if hold else elected
    loose = election.active_candidates(incoming.where(blank()), head)

    kept = winners.join(touched.select(*KEY), KEY, "left_anti").select(*candidates.columns)
    stay = kept.join(names.withColumnRenamed("file_name", "of_file"), blank() & (F.col("file_name") == F.col("of_file")), "left_anti")
    now = stay.unionByName(elected).unionByName(loose)
    lost = winners.where(blank()).join(names, "file_name", "left_semi").select(*candidates.columns)
    lost = lost.unionByName(winners.join(touched.select(*KEY), KEY, "left_semi").select(*candidates.columns))
    accepted = election.active_candidates(elected, head).unionByName(loose).groupBy("line").agg(F.count(F.lit(1)).alias("accepted"))
    hit = winners.where(~blank()).join(touched.select(*KEY), KEY, "left_semi").select(*KEY, F.col("file_name").alias("winner_file"))
    elsewhere = beside.join(hit, KEY).where("winner_file <> file_name").select("id", "line").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("duplicates"))
    before = beside.where("archived and archived_file <> file_name").groupBy("line").agg(F.count(F.lit(1)).alias("archived_duplicates"))
    counts = accepted.join(elsewhere, "line", "full").join(before, "line", "full").fillna(0).select("line", "accepted", "duplicates", "archived_duplicates")
    files = [df.select("line", "file_name") for df in (replaced, head, hit.withColumnRenamed("winner_file", "file_name"), elected)]
    return Publication(now, heads_now, counts, files[0].union(files[1]).union(files[2]).union(files[3]).distinct(), elected.unionByName(loose), lost)


def delete_file(winners: DataFrame, candidates: DataFrame, heads: DataFrame, line: str, file: str, archive: Archive | None = None, groups: DataFrame | None = None) -> Publication:
    """Winners and heads without one file; the next earliest candidate of each freed key that isn't archived is
    promoted. A file with archived rows (of ``groups``) is refused; one that isn't there changes nothing."""
    gone = (F.col("line") == line) & (F.col("file_name") == file)
    _refuse_archived(groups, heads.where(gone).select("line", "file_name"), "deleted")
    heads_now = heads.where(~gone)
    freed = winners.where(gone & ~blank()).select(*KEY)
    if archive is not None:
        freed = archive.without(freed)
    freed = freed.distinct()
    pool = candidates.where(~blank()).join(freed, KEY, "left_semi").select(*candidates.columns)
    promoted = election.first_by(election.active_candidates(pool, heads_now), KEY, election.order())
    now = winners.where(~gone).unionByName(promoted.select(*winners.columns))
    pairs = promoted.select("line", "file_name").union(heads.where(gone).select("line", "file_name")).distinct()
    counts = promoted.groupBy("line").agg(F.count(F.lit(1)).alias("accepted")).select("line", "accepted", F.lit(0).cast("long").alias("duplicates"), F.lit(0).cast("long").alias("archived_duplicates"))
    return Publication(now, heads_now, counts, pairs, promoted, winners.where(gone))
