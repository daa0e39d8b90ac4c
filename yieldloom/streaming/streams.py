"""Structured Streaming forms of ingest, counting, machine references and earliest-wins de-duplication."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import TimestampType

from yieldloom.functions import text
from yieldloom.operators.election import blank


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 100, **options: object) -> DataFrame:
    """Rows of files that arrive under ``path``, each file once, with its name."""
    rows = spark.readStream.schema(schema).options(maxFilesPerTrigger=per_trigger, **options).format(fmt).load(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def stream_ingest(rows: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``publish(rows, batch_id)`` once; all that is there now, then stops.
    ``publish`` writes under the batch id, so that a repeated batch replaces itself."""
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_file_summaries(changes: DataFrame, refresh: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A change feed (op, id, line): ``refresh(lines, removed, batch_id)`` gets the lines that inserts and updates
    touch and the ids that deletes remove, a batch at a time; it writes under the batch id."""

    def run(batch: DataFrame, number: int) -> None:
        refresh(batch.where("op <> 'delete'").select("line").distinct(), batch.where("op = 'delete'").select("id").distinct(), number)

    return stream_ingest(changes, run, checkpoint)


def stream_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """start, type, qty: events counted in tumbling windows; later ones than ``late`` are left out."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), "type").agg(F.count(F.lit(1)).alias("qty"))
    return counted.select(F.col("window.start").alias("start"), "type", "qty")


def upload_sessions(activity: DataFrame, gap: str = "24 hours", ts: str = "ts") -> DataFrame:
    """job_id, start, end, parts: an upload's activity without pauses of ``gap``."""
    grouped = activity.withWatermark(ts, gap).groupBy("job_id", F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("parts"))
    return grouped.select("job_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "parts")


def use_state_store(spark: SparkSession) -> None:
    """State of keyed streams in RocksDB, which typed state and timers ask for: it spills to disk and is
    checkpointed by changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Rows of a bucket are kept in chunks of so many at most.
CHUNK = 10_000
#: Timestamps within a row that waits, to the microsecond.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Waiting(StatefulProcessor):
    """Log rows that wait for the reference of their key, and references that wait for rows, of a bucket of keys. Each call of
    the state is a round trip from Python, so the keys of a bucket share them: what a visit adds is a chunk of rows, and
    chunks are read only when a reference comes or a row has waited in vain."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # key, time and row of each
        self.rows = handle.getListState("rows", "chunk binary")
        # machine (null where references contradict each other) and time by key; the earliest time of a row that waits; the timer
        self.held = handle.getValueState("held", "refs binary, first long, due long")

    def handleInputRows(self, key: tuple[int], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh, said = [], []
        for part in rows:
            for unit, at, reference, machine, row in zip(*(part[c].tolist() for c in ("unit", "ms", "reference", "machine", "row")), strict=True):
                if reference:
                    said.append((unit, at, machine if isinstance(machine, str) else None))
                else:
                    fresh.append((unit, at, row))
        return self._settle(self.held.get(), fresh, said, timerValues)

    def handleExpiredTimer(self, key: tuple[int], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.held.get()
        if before is None:
            return iter(())
        fired = before[2] == expiredTimerInfo.getExpiryTimeInMs()
        return self._settle((*before[:2], None if fired else before[2]), [], [], timerValues)

    def _settle(self, before: tuple | None, fresh: list[tuple], said: list[tuple], timers: TimerValues) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        over = now - self.keep
        refs, first, due = ({}, None, None) if before is None else (pickle.loads(before[0]), *before[1:])
        for unit, at, machine in said:
            known = refs.get(unit)
            refs[unit] = (machine, at) if known is None else (machine if machine == known[0] else None, max(known[1], at))
        read = first is not None and (first <= over or any(refs[unit][0] for unit, _, _ in said))
        waiting = [r for chunk, in self.rows.get() for r in pickle.loads(chunk)] + fresh if read else fresh
        out, stay, met = [], [], set()
        for unit, at, row in waiting:
            machine = refs[unit][0] if unit in refs else None
            if machine:
                met.add(unit)
            if machine or at <= over:
                out.append((row, machine or text.UNKNOWN_MACHINE))
            else:
                stay.append((unit, at, row))
        if read:
            self.rows.clear()
            first = None
        for k in range(0, len(stay), CHUNK):
            self.rows.appendValue((pickle.dumps(stay[k : k + CHUNK]),))
        refs = {unit: ref for unit, ref in refs.items() if unit not in met and ref[1] > over}
        first = min([at for _, at, _ in stay] + ([] if first is None else [first]), default=None)
        waits = [ref[1] for ref in refs.values()] + ([] if first is None else [first])
        end = max(min(waits) + self.keep, now) + 1 if waits else None
        if due is not None and due != end:
            self.handle.deleteTimer(due)
        if end is not None and due != end:
            self.handle.registerTimer(end)
        if waits:
            self.held.update((pickle.dumps(refs), first, end))
        elif before is not None:
            self.held.clear()
        return iter([pd.DataFrame(out, columns=["_row", "machine_by_reference"])] if out else [])


def stream_machine_join(log: DataFrame, references: DataFrame, days: int = 30, ts: str = "ts", late: str = "1 day", buckets: int = 4096) -> DataFrame:
    """Each log row once, with ``machine_by_reference``: the machine of the reference of its key. A reference
    serves the rows that wait for it or come with it, and is gone once it has matched. Rows wait ``days``
    for a reference and references as long for rows, by the watermark (``late``); rows that waited in vain,
    and rows without a key or a time, get a fixed name. References without a time are left out. References of one key that contradict each other match
    nothing. Both streams carry ``ts``. Keys share their state in ``buckets``: give as many as make a bucket fit a task, as a bucket's
    rows are read when references of its keys come; a checkpoint holds to their number. Asks for :func:`use_state_store`."""
    exact = [f.name for f in log.schema if isinstance(f.dataType, TimestampType)]  # as whole microseconds, whatever the session's zone
    held = log.withColumns({c: F.unix_micros(c) for c in exact}) if exact else log
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    packed = F.to_json(F.struct(*[(F.unix_micros(c) if c in exact else F.col(c)).alias(c) for c in log.columns]), _EXACT)
    rows = log.select(F.col("dedup_key").alias("unit"), F.col(ts).alias("_at"), at.alias("ms"), F.lit(False).alias("reference"), F.lit(None).cast("string").alias("machine"), packed.alias("row"))
    refs = references.select(F.col("dedup_key").alias("unit"), F.col(ts).alias("_at"), at.alias("ms"), F.lit(True).alias("reference"), "machine", F.lit(None).cast("string").alias("row"))
    keyed = rows.unionByName(refs).where(~blank("unit") & F.col("_at").isNotNull()).withWatermark("_at", late)
    dealt = keyed.withColumn("_bucket", F.pmod(F.hash("unit"), F.lit(buckets)))
    found = dealt.groupBy("_bucket").transformWithStateInPandas(_Waiting(days * 86_400_000), "_row string, machine_by_reference string", "Append", "EventTime")
    loose = log.where(blank() | F.col(ts).isNull()).select("*", F.lit(text.UNKNOWN_MACHINE).alias("machine_by_reference"))
    read = found.select(F.from_json("_row", held.schema, _EXACT | {"mode": "FAILFAST"}).alias("_row"), "machine_by_reference").select("_row.*", "machine_by_reference")
    return read.withColumns({c: F.timestamp_micros(c) for c in exact}).select(*loose.columns).unionByName(loose)


WINNER = "line string, dedup_key string, id long, dedup_time long"
_LAST = 2**63 - 1


class _Earliest(StatefulProcessor):
    """The earliest row so far of each key of a bucket, until the watermark has passed it by ``keep``. Each call of the state
    is a round trip from Python, so all keys of a bucket share them."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # time, id and end of each (line, key); the timer
        self.best = handle.getValueState("best", "held binary, due long")

    def handleInputRows(self, key: tuple[int], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, str], tuple[int, int]] = {}
        for part in rows:
            for line, unit, *new in zip(*(part[c].tolist() for c in ("line", "dedup_key", "dedup_time", "id")), strict=True):
                # a missing line is no text
                of, new = (line if isinstance(line, str) else None, unit), tuple(new)
                if of not in best or new < best[of]:
                    best[of] = new
        before = self.best.get()
        held, due = ({}, None) if before is None else (pickle.loads(before[0]), before[1])
        now = timerValues.getCurrentWatermarkInMs()
        better = {of: new for of, new in best.items() if of not in held or new < held[of][:2]}
        for of, new in better.items():
            held[of] = (*new, max((now if new[0] == _LAST else new[0]) + self.keep, now))
        held = {of: v for of, v in held.items() if v[2] >= now}
        end = max((v[2] for v in held.values()), default=now) + 1
        if due != end:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(end)
        self.best.update((pickle.dumps(held), end))
        return iter([pd.DataFrame([(*of, new[1], new[0]) for of, new in better.items()], columns=["line", "dedup_key", "id", "dedup_time"])] if better else [])

    def handleExpiredTimer(self, key: tuple[int], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # by then the last of the bucket's keys is over
        self.best.clear()
        return iter(())


def stream_dedup(rows: DataFrame, days: int = 30, buckets: int = 4096) -> DataFrame:
    """The winner so far of each (line, key), again whenever an earlier row arrives (update mode); rows
    without a key, null or empty, all pass, as they never compete. Rows with a key that are ``days`` older
    than the newest row are late and left out, as the batch policy refuses them; a key's state goes when
    it is as old, with the next rows of its bucket, and a sink keeps the earlier of its own and a new winner. Keys share
    their state in ``buckets``, of which a batch reads and writes those that it touches; a checkpoint holds to their number. Asks
    for :func:`use_state_store`."""
    fields = rows.select("line", "dedup_key", F.col("id").cast("long").alias("id"), F.col("dedup_time").cast("long").alias("dedup_time"))
    timed = fields.where(~blank()).withColumn("_at", F.timestamp_millis("dedup_time")).withWatermark("_at", f"{days} days")
    dealt = timed.withColumn("_bucket", F.pmod(F.hash("line", "dedup_key"), F.lit(buckets)))
    timeless = dealt.withColumn("dedup_time", F.coalesce("dedup_time", F.lit(_LAST)))
    winners = timeless.groupBy("_bucket").transformWithStateInPandas(_Earliest(days * 86_400_000), WINNER, "Update", "EventTime")
    return winners.withColumn("dedup_time", F.nullif("dedup_time", F.lit(_LAST))).unionByName(fields.where(blank()))


def within_days(day: Column, cutoff: str) -> Column:
    """Rows that the late-data policy still takes: not dated before the cutoff."""
    return day >= cutoff
