"""Dates of logs and reports: ISO texts that may be invalid, serials, stamps, ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Taipei"
_ISO = r"^\d{4}-\d{2}-\d{2}$"


def day_of(c: Column) -> Column:
    """The date of an ISO text, null if it isn't one."""
    return F.when(c.rlike(_ISO), c.try_cast("date"))


def is_valid_iso_date(c: Column) -> Column:
    return F.coalesce(day_of(c).isNotNull(), F.lit(False))


_HALF = "(?i)上午|下午|AM|PM"


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s 　]+", " "))


def _half(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, _HALF, 0))


def _bare(text: Column, half: Column) -> Column:
    # a cleaned text has no two spaces in a row before its half goes
    return F.when(half != "", F.regexp_replace(F.regexp_replace(text, _HALF, " "), " +", " ")).otherwise(text)


def _serial(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,6}(\.\d+)?$"), text.try_cast("double"))


def _written(bare: Column) -> Column:
    return F.regexp_extract(bare, r"\d{4}[/-]\d{1,2}[/-]\d{1,2}(?:[ T]+\d{1,2}(?::\d{2}){0,2})?", 0)


def _numbers(written: Column) -> Column:
    """Year, month and day of a text, and hour, minute and second as far as they are there; null without a day."""
    # an empty text goes before it is cast: a cast that fails costs more than all patterns
    return F.transform(F.split(F.nullif(written, F.lit("")), "[/: T-]+"), lambda part: part.try_cast("int"))


def _datetime(serial: Column, half: Column, numbers: Column) -> Column:
    def at(k: int) -> Column:
        return F.coalesce(F.get(numbers, F.lit(k)), F.lit(0))

    # a clock of twelve hours: 12 stands for 0, and the afternoon adds 12; hours past 12 are taken as they are
    hour = F.when(half.isin("下午", "pm") & (at(3) < 12), at(3) + 12).when(half.isin("上午", "am") & (at(3) == 12), 0).otherwise(at(3))
    written = F.try_make_timestamp_ntz(at(0), at(1), at(2), hour, at(4), at(5).cast("decimal(16,6)"))
    counted = F.timestamp_add("SECOND", F.round(F.pmod(serial, F.lit(1.0)) * 86400).cast("long"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")).cast("timestamp_ntz"))
    return F.when(serial.isNotNull(), F.when(serial >= 1, counted)).when(F.get(numbers, F.lit(0)).isNotNull() & (at(5) < 60), written)


def parse_datetime(c: Column) -> Column:
    """Date and time from y/m/d or y-m-d with an optional time and 上午/下午/AM/PM, or from a
    spreadsheet serial number; null if there is none or the date doesn't exist."""
    text = _clean(c)
    return _datetime(_serial(text), _half(text), _numbers(_written(_bare(text, _half(text)))))


def with_datetime(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with :func:`parse_datetime` of ``c``, in steps: each pattern is matched once a row, whatever asks for its groups."""
    text, half, serial, written, numbers = (f"_{name}_{part}" for part in ("text", "half", "serial", "written", "numbers"))
    steps = df.withColumn(text, _clean(c)).withColumns({half: _half(F.col(text)), serial: _serial(F.col(text))})
    steps = steps.withColumn(written, F.when(F.col(serial).isNull(), _written(_bare(F.col(text), F.col(half))))).withColumn(numbers, _numbers(F.col(written)))
    return steps.withColumn(name, _datetime(*[F.col(part) for part in (serial, half, numbers)])).drop(text, half, serial, written, numbers)


def parse_stamp(c: Column) -> Column:
    """The date of a yyyyMMdd-HHmmss stamp, null if it isn't one."""
    text = F.trim(c)
    pattern = r"^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})$"
    time_ok = (F.regexp_extract(text, pattern, 4) <= "23") & (F.regexp_extract(text, pattern, 5) <= "59") & (F.regexp_extract(text, pattern, 6) <= "59")
    return F.when(text.rlike(pattern) & time_ok, F.regexp_replace(text, pattern, "$1-$2-$3").try_cast("date"))


def parse_fpy_date(c: Column) -> Column:
    """ISO text of a serial number or of a y-m-d date with / . or -; other texts as they are."""
    text = F.trim(c.cast("string"))
    bare = F.regexp_replace(text, r"[/.]", "-")
    pattern = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    iso = F.concat_ws("-", F.regexp_extract(bare, pattern, 1), F.lpad(F.regexp_extract(bare, pattern, 2), 2, "0"), F.lpad(F.regexp_extract(bare, pattern, 3), 2, "0"))
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int")).cast("string")
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), serial).when(bare.rlike(pattern), iso).otherwise(text)


def date_from_filename(c: Column, today: Column) -> Column:
    """The date that a file name holds: 20yymmdd anywhere, or mmdd in front (of last year if it would lie
    ahead of ``today``); else ``today``."""
    def day(digits: Column) -> Column:
        return F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")

    month_day = F.regexp_extract(c, r"^(\d{4})(?:[-_\s.]|$)", 1)
    this, last = (day(F.concat((F.year(today) - back).cast("string"), month_day)) for back in (0, 1))
    return F.coalesce(day(F.regexp_extract(c, r"(?:^|\D)(20\d{6})(?:\D|$)", 1)), F.when(this <= today, this).when(this > today, last), today)


def business_date(ts: Column) -> Column:
    """The business day of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def shift_date(d: Column, n: int) -> Column:
    return F.date_add(d, n)


def previous_workday(d: Column) -> Column:
    """The day before; Friday on Sundays and Mondays."""
    back = F.when(F.dayofweek(d) == 2, F.lit(-3)).when(F.dayofweek(d) == 1, F.lit(-2)).otherwise(F.lit(-1))
    return F.date_add(d, back)


def week_start(d: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def date_span(first: Column, last: Column, missing: Column) -> Column:
    """One date, 'a～b' for two, or ``missing``."""
    return F.when(first.isNull(), missing).when(first == last, first).otherwise(F.concat(first, F.lit("～"), last))


def quick_range(mode: str, offset: int, today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of the day, the week (Sunday to Saturday) or the month ``offset`` away."""
    if mode == "day":
        day = today + dt.timedelta(days=offset)
        return day, day
    if mode == "week":
        start = today - dt.timedelta(days=(today.weekday() + 1) % 7) + dt.timedelta(weeks=offset)
        return start, start + dt.timedelta(days=6)
    if mode == "month":
        months = today.year * 12 + today.month - 1 + offset
        start = dt.date(months // 12, months % 12 + 1, 1)
        after = dt.date((months + 1) // 12, (months + 1) % 12 + 1, 1)
        return start, after - dt.timedelta(days=1)
    raise ValueError(f"no such mode: {mode}")


def offset_of(mode: str, start: dt.date, today: dt.date) -> int:
    """Which offset of :func:`quick_range` begins at ``start``'s period."""
    first = quick_range(mode, 0, today)[0]
    if mode == "month":
        return (start.year - first.year) * 12 + start.month - first.month
    days = (start - first).days
    return days if mode == "day" else days // 7


def nearest_date(dates: DataFrame, day: str | dt.date, column: str = "report_day") -> DataFrame:
    """The available date that is nearest to ``day``; the earlier of two as near."""
    target = F.lit(str(day)).cast("date")
    return dates.agg(F.min_by(column, F.struct(F.abs(F.datediff(column, target)), F.col(column))).alias(column))


def date_range(df: DataFrame, start: str = "", end: str = "", column: str = "report_date") -> DataFrame:
    """Rows whose ISO date lies within the bounds, both included; an empty bound is open, and rows
    without a date go if there is any bound."""
    if start or end:
        df = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    if start:
        df = df.where(F.col(column) >= start)
    return df.where(F.col(column) <= end) if end else df


def overlaps(df: DataFrame, start: str = "", end: str = "", first: str = "date_start", last: str = "date_end") -> DataFrame:
    """Rows whose range touches the bounds; empty bounds are open."""
    if start:
        df = df.where(F.col(last) >= start)
    return df.where(F.col(first) <= end) if end else df


def available_dates(df: DataFrame, n: int, column: str = "report_date", entered: str = "input_quantity") -> DataFrame:
    """The last ``n`` dates with input, ascending."""
    days = df.where((F.col(entered) > 0) & (F.col(column) != "")).select(column).distinct()
    return days.orderBy(F.desc(column)).limit(n).orderBy(column)


def date_segments(df: DataFrame, start: str, end: str, days: int = 7, column: str = "report_date") -> DataFrame:
    """Rows within the bounds with the segment of at most ``days`` days that they fall into: segment
    (from 0), segment_start, segment_end."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = date_range(df, start, end, column).where(is_valid_iso_date(F.col(column)))
    number = F.call_function("div", F.datediff(day_of(F.col(column)), first), F.lit(days)).cast("int")
    begin = F.date_add(first, number * days)
    return inside.withColumns({"segment": number, "segment_start": begin, "segment_end": F.least(F.date_add(begin, days - 1), last)})
