"""Rates, weights, shares and carried remainders. Rates are rounded half up in whole numbers, so that
every engine gives the same digits."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _half_up(part: Column, base: Column, digits: int) -> Column:
    scale = 10**digits
    up = F.call_function("div", part.cast("long") * (200 * scale) + base.cast("long"), base.cast("long") * 2)
    return F.when(base > 0, up / F.lit(float(scale))).otherwise(F.lit(0.0))


def map_rate(part: Column, base: Column) -> Column:
    """100 * part / base to two digits; 0 without a base."""
    return _half_up(part, base, 2)


def ratio1(part: Column, base: Column) -> Column:
    """100 * part / base to one digit; 0 without a base."""
    return _half_up(part, base, 1)


def floor_yield(entered: Column, defects: Column) -> Column:
    """Yield in percent, cut (never rounded up) after two digits; 100 if nothing was entered."""
    cut = F.floor((entered - defects) / entered * 10000) / F.lit(100.0)
    return F.when(F.coalesce(entered, F.lit(0)) == 0, F.lit(100.0)).otherwise(cut)


def plain_yield(good: Column, entered: Column) -> Column:
    """Yield in percent to two digits; 100 if nothing was entered."""
    return F.when(entered > 0, map_rate(good, entered)).otherwise(F.lit(100.0))


def quantity(value: Column) -> Column:
    """A row's weight: the whole part of a positive number, at least 1; 1 for anything else."""
    number = value.try_cast("double")
    return F.when(number > 0, F.greatest(F.lit(1), F.floor(number))).otherwise(F.lit(1)).cast("long")


def with_share(df: DataFrame, part: list[str], value: str = "qty", name: str = "share", digits: int = 1) -> DataFrame:
    """``df`` with each row's share of ``value`` within ``part`` (the whole table if empty), in percent."""
    if part:
        return df.withColumn(name, _half_up(F.col(value), F.sum(value).over(Window.partitionBy(*part)), digits))
    # the total comes as a table of one row, not through a window that holds all rows in one task
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, _half_up(F.col(value), F.col("_total"), digits)).drop("_total")


def with_rank(df: DataFrame, part: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the row's position (from 1) within ``part`` by ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def with_bucketed_rank(df: DataFrame, part: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """As :func:`with_rank`, where rows of a smaller ``bucket`` come first. Rows are numbered within
    (part, bucket), and a table of one row for each of those holds how many come before, so one ``part`` may
    hold any share of the rows."""
    # names that df doesn't have
    tag = "_" * (1 + max((len(c) for c in [*df.columns, name] if c.startswith("_")), default=0))
    at, size, before = (f"{tag}{c}" for c in ("bucket", "size", "before"))
    numbered = df.withColumn(at, bucket)
    own = Window.partitionBy(*part, at).orderBy(*order)
    earlier = Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy(*part, at).agg(F.count(F.lit(1)).alias(size))
    sums = sizes.select(*[F.col(c).alias(f"{tag}of_{c}") for c in [*part, at]], F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    same = [F.col(c).eqNullSafe(F.col(f"{tag}of_{c}")) for c in [*part, at]]
    ranked = numbered.withColumn(name, F.row_number().over(own)).join(sums, reduce(and_, same))
    return ranked.withColumn(name, F.col(name) + F.col(before)).select(*df.columns, name)


def carry_floor(value: Column, divisor: Column, part: list[str], order: list[str]) -> Column:
    """What each row gets of floor(running sum / divisor): remainders are carried to later rows."""
    window = Window.partitionBy(*part).orderBy(*order)
    upto = F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.call_function("div", upto, divisor) - F.call_function("div", before, divisor)
