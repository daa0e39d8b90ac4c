"""Which record of a unit counts: de-duplication within and across files, publication and deletion.

A *candidate* is an uploaded unit row (id, line, file_name, job_id, dedup_key, dedup_time, created_at and
facts); *heads* name the job that counts for each (line, file_name). Of the candidates of the heads, the
earliest of each (line, dedup_key) wins; rows without a key never compete.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["line", "dedup_key"]
ORDER = ("dedup_time", "created_at", "id")


def first_by(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key by the order ``by``. Spark keeps each task's first rows only, before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def order() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ORDER]


def blank(column: str = "dedup_key") -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _own_key(row: str) -> Column:
    """The dedup key; a key of its own for a row without one, so that one pass ranks both kinds."""
    return F.when(blank(), F.concat(F.lit("\u0000"), F.col(row).cast("string"))).otherwise(F.col("dedup_key"))


def dedup_file(df: DataFrame, order: str = "row_id") -> DataFrame:
    """The earliest row of each key within a file; the first of equally early ones; a missing time comes
    last, rows without a key stay."""
    by = [F.coalesce("dedup_time", F.lit(2**63 - 1)), F.col(order)]
    return first_by(df.withColumn("_key", _own_key(order)), ["line", "file_name", "_key"], by).drop("_key")


def active_candidates(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates of the job that counts for their file."""
    return candidates.join(heads.select("line", "file_name", "job_id"), ["line", "file_name", "job_id"], "left_semi").select(*candidates.columns)


def elect_winners(candidates: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The winner of each (line, key) by time (missing last), upload and id; all rows without a key."""
    live = candidates if heads is None else active_candidates(candidates, heads)
    return first_by(live.withColumn("_key", _own_key("id")), ["line", "_key"], order()).drop("_key")


def winner_rows(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Full rows of winners that are known by candidate_id."""
    return candidates.join(winners.select(F.col("candidate_id").alias("id")), "id", "left_semi").select(*candidates.columns)


def reelect(keys: DataFrame, candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """Winners of some keys only: the keys restrict the candidates before they are ranked."""
    of_keys = candidates.where(~blank()).join(keys.select(*KEY).distinct(), KEY, "left_semi").select(*candidates.columns)
    return first_by(active_candidates(of_keys, heads), KEY, order())


def merge_batches(old: DataFrame, new: DataFrame, unknown: str = "未分類機台") -> DataFrame:
    """The earliest row of each key of two tables; its machine, if unknown, comes from a later row."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    window = Window.partitionBy(*KEY).orderBy(F.col("dedup_time").asc_nulls_last(), "_turn", "id")
    known = F.first(F.nullif("machine", F.lit(unknown)), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keyed = both.where(~blank()).withColumns({"_n": F.row_number().over(window), "machine": F.coalesce(known, F.col("machine"))})
    return both.where(blank()).drop("_turn").unionByName(keyed.where("_n = 1").drop("_n", "_turn"))


def count_duplicates(incoming: DataFrame, winners: DataFrame) -> DataFrame:
    """Incoming rows by line whose key already wins in another file: line, duplicates."""
    a, b = incoming.where(~blank()).alias("a"), winners.where(~blank()).alias("b")
    same = (F.col("a.line") == F.col("b.line")) & (F.col("a.dedup_key") == F.col("b.dedup_key")) & (F.col("a.file_name") != F.col("b.file_name"))
    return a.join(b, same, "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("duplicates"))


def new_keys(candidates: DataFrame, archive: DataFrame) -> DataFrame:
    """Candidates whose key is not archived."""
    return candidates.join(archive.select(*KEY), KEY, "left_anti").select(*candidates.columns)


def superseded(candidates: DataFrame, winners: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates that neither win nor belong to a head."""
    rest = candidates.join(winners.select("id"), "id", "left_anti")
    return rest.join(heads.select("line", "file_name", "job_id"), ["line", "file_name", "job_id"], "left_anti").select(*candidates.columns)


def earlier_than_archive(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """Incoming rows earlier than the archived row of their key: an upload with any is to be refused."""
    old = archive.select("line", "dedup_key", F.col("dedup_time").alias("archived_time"))
    # a missing time comes last on both sides
    before = F.coalesce(F.col("dedup_time") < F.col("archived_time"), F.col("dedup_time").isNotNull() & F.col("archived_time").isNull())
    return incoming.join(old, KEY).where(before).select(*incoming.columns, "archived_time")


def reject_earlier(incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """``incoming``, or an error if it has rows earlier than archived ones."""
    if not earlier_than_archive(incoming, archive).isEmpty():
        raise ValueError("the upload holds records earlier than archived ones")
    return incoming


def before_cutoff(incoming: DataFrame, cutoff: str | None) -> DataFrame:
    """Rows dated before the archive's cutoff."""
    return incoming.where(F.lit(False)) if cutoff is None else incoming.where(F.col("report_date") < cutoff)


def reject_archived_dates(incoming: DataFrame, cutoff: str | None) -> DataFrame:
    """``incoming``, or an error if it has rows dated before the cutoff."""
    if not before_cutoff(incoming, cutoff).isEmpty():
        raise ValueError(f"the upload holds dates before {cutoff}")
    return incoming


def publish(winners: DataFrame, candidates: DataFrame, heads: DataFrame, incoming: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`archive.publish` where nothing is archived: new winners, new heads, and for each line the rows
    accepted and the duplicates of other files."""
    from yieldloom.operators import archive

    done = archive.publish(winners, candidates, heads, incoming, head)
    return done.winners, done.heads, done.counts.select("line", "accepted", "duplicates")


def delete_file(winners: DataFrame, candidates: DataFrame, heads: DataFrame, line: str, file: str) -> tuple[DataFrame, DataFrame]:
    """:func:`archive.delete_file` where nothing is archived: winners and heads without one file."""
    from yieldloom.operators import archive

    done = archive.delete_file(winners, candidates, heads, line, file)
    return done.winners, done.heads


def file_exists(heads: DataFrame, summaries: DataFrame, line: str, file: str) -> bool:
    """Whether a file is known to the heads or the summaries."""
    found = (F.col("line") == line) & (F.col("file_name") == file)
    return not heads.where(found).select("file_name").unionByName(summaries.where(found).select("file_name")).isEmpty()


def files_exist(heads: DataFrame, summaries: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (line, file_name) with ``found``: whether the heads or the summaries know the file."""
    names = ["line", "file_name"]
    known = heads.select(*names).unionByName(summaries.select(*names)).join(asked.select(*names).distinct(), names, "left_semi").distinct()
    return asked.join(known.withColumn("found", F.lit(True)), names, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def guard_archived(archived: DataFrame, files: DataFrame) -> DataFrame:
    """Those of ``files`` that have archived rows and may not be replaced or deleted."""
    return files.join(archived.select("line", "file_name"), ["line", "file_name"], "left_semi")


def chunks_complete(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """job_id, line, complete: whether parts 0 to expected - 1 have all arrived."""
    got = chunks.groupBy("job_id", "line").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count_distinct("part").alias("n"))
    joined = ledger.join(got, ["job_id", "line"], "left")
    whole = (F.col("n") == F.col("expected")) & (F.col("first") == 0) & (F.col("last") == F.col("expected") - 1)
    return joined.select("job_id", "line", F.coalesce(whole, F.col("expected") == 0).alias("complete"))


def upload_status(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """job_id, line, received, expected."""
    got = chunks.groupBy("job_id", "line").agg(F.count_distinct("part").alias("received"))
    return ledger.join(got, ["job_id", "line"], "left").select("job_id", "line", F.coalesce("received", F.lit(0)).alias("received"), "expected")


def chunk_replay(chunks: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arriving parts that are new, and those that contradict a part of the same number."""
    key = ["job_id", "line", "part"]
    fresh = arriving.join(chunks.select(*key), key, "left_anti").dropDuplicates(key)
    known = chunks.select(*key, F.col("hash").alias("_hash"), F.col("n_rows").alias("_rows"))
    return fresh, arriving.join(known, key).where("not (hash <=> _hash and n_rows <=> _rows)").select(*arriving.columns)


def is_duplicate_upload(ledger: DataFrame, arriving: DataFrame, keys: tuple[str, ...] = ("production_date", "content_hash")) -> DataFrame:
    """Arriving uploads whose content is already there."""
    return arriving.join(ledger.select(*keys), list(keys), "left_semi")


def claim_dates(batches: DataFrame) -> DataFrame:
    """For each date the newest batch that holds it (batch_id, date, uploaded_at); batches that hold none
    any more drop out."""
    return first_by(batches, ["date"], [F.desc("uploaded_at"), F.desc("batch_id")])


def normalise_memory(df: DataFrame, overrides: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The newest model of each product code (overrides win), and the codes with several models."""
    from yieldloom.functions.text import NO_MODEL_NAME, product_code

    model = F.upper(F.trim("model"))
    rows = df.withColumns({"code": product_code(F.col("code")), "model": model}).where((F.col("code") != "") & (F.col("model") != "") & (F.col("model") != NO_MODEL_NAME))
    newest = first_by(rows, ["code"], [F.desc("updated_at"), F.asc("model")])
    fixed = F.try_element_at(F.create_map(*[F.lit(v) for p in overrides.items() for v in p]), F.col("code")) if overrides else F.lit(None)
    conflicts = rows.groupBy("code").agg(F.count_distinct("model").alias("models")).where("models > 1")
    return newest.select("code", F.coalesce(fixed, F.col("model")).alias("model")), conflicts


def unique_by_name(df: DataFrame, order: str, name: str = "name") -> DataFrame:
    """One row for each name, case and outer space ignored: the last."""
    return first_by(df.withColumn("_name", F.upper(F.trim(name))), ["_name"], [F.desc(order)]).drop("_name")


def machine_references(rows: DataFrame) -> DataFrame:
    """dedup_key and machine of reference rows; a key with several machines has machine null."""
    return rows.where(~blank()).groupBy("dedup_key").agg(F.when(F.count_distinct("machine") == 1, F.first("machine", ignorenulls=True)).alias("machine"))


def unmatched_references(references: DataFrame, log: DataFrame) -> DataFrame:
    """References whose key the log doesn't hold yet."""
    return references.join(log.select("dedup_key"), "dedup_key", "left_anti")


def apply_machine(df: DataFrame, references: DataFrame, unknown: str = "未分類機台") -> DataFrame:
    """Rows of machine-classified lines with the machine of their key's reference; their own machine where
    there is none."""
    from yieldloom.functions.text import MACHINE_LINES

    ref = references.select(F.col("dedup_key").alias("_key"), F.col("machine").alias("_machine"))
    joined = df.join(ref, (F.col("dedup_key") == F.col("_key")) & F.col("line").isin(*MACHINE_LINES), "left")
    machine = F.when(F.col("line").isin(*MACHINE_LINES), F.coalesce("_machine", "machine", F.lit(unknown))).otherwise(F.col("machine"))
    return joined.withColumn("machine", machine).select(*df.columns)


def settle_references(log: DataFrame, references: DataFrame, now: dt.datetime, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """``log`` with the machines of its references (:func:`apply_machine`), and the references (dedup_key, machine, said_at)
    that go on waiting: those that no row has met yet, unless they are ``days`` old at ``now``. Where references of a
    key contradict each other, rows get no machine from them and the references wait until they are too old."""
    from yieldloom.functions.text import MACHINE_LINES

    agreed = machine_references(references).where(F.col("machine").isNotNull())
    met = agreed.join(log.where(F.col("line").isin(*MACHINE_LINES)).select("dedup_key"), "dedup_key", "left_semi")
    waiting = references.where(~blank() & (F.col("said_at") > F.lit(now - dt.timedelta(days=days)))).join(met.select("dedup_key"), "dedup_key", "left_anti")
    return apply_machine(log, agreed), waiting.select(*references.columns)


def backfill(batches: DataFrame, schema: str, ties: list[str] = []) -> DataFrame:  # noqa: B006 (never changed)
    """Unit rows of stored file batches (line, file_name, uploaded_at, records): the newest batch of each
    file (of equally new ones the one with the largest ``ties``), its records in order, and a job id made from the file's name."""
    newest = first_by(batches, ["line", "file_name"], [F.desc("uploaded_at"), *[F.desc(c) for c in ties]])
    rows = newest.select("line", "file_name", F.col("uploaded_at").alias("created_at"), F.md5("file_name").alias("job_id"), F.posexplode(F.from_json("records", f"array<struct<{schema}>>")).alias("row_id", "_r"))
    return rows.select("line", "file_name", "created_at", "job_id", "row_id", "_r.*")


def backfill_winners(batches: DataFrame, schema: str, ties: list[str] = []) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B006 (never changed)
    """Candidates, heads and winners of stored file batches: all that is needed to publish over them later. The records
    carry id, dedup_key and dedup_time."""
    candidates = backfill(batches, schema, ties)
    heads = candidates.select("line", "file_name", "job_id").distinct()
    return candidates, heads, elect_winners(candidates)
