"""JSON records and arrays, row comparison and validation rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_records(df: DataFrame, col: str, schema: str, name: str = "record", ordinal: str = "ordinal") -> DataFrame:
    """One row for each element of a JSON array of objects, with its position from 0."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(F.from_json(col, f"array<struct<{schema}>>")).alias(ordinal, name))


def explode_metadata(df: DataFrame, col: str, schema: str) -> DataFrame:
    """``df`` with the fields of each object of a JSON array as columns; a row without any has none."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(F.from_json(col, f"array<struct<{schema}>>")).alias("_m")).select(*others, "_m.*")


def with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """``df`` with the columns of ``bounds``, an aggregate of one row, which is broadcast."""
    return df.crossJoin(F.broadcast(bounds))


def explode_buckets(df: DataFrame, col: str, key: str = "bucket", inner: str = "name", value: str = "qty") -> DataFrame:
    """One row for each entry of a JSON object of objects of numbers; other shapes give none."""
    others = [c for c in df.columns if c != col]
    outer = df.select(*others, F.explode(F.from_json(col, "map<string,map<string,string>>")).alias(key, "_inner"))
    rows = outer.select(*others, key, F.explode("_inner").alias(inner, value))
    return rows.where(positive_qty(F.col(value))).withColumn(value, F.col(value).cast("double"))


def positive_qty(c: Column) -> Column:
    """Whether a text is a plain positive number."""
    return F.coalesce(c.rlike(r"^\d+(\.\d+)?$") & (c.try_cast("double") > 0), F.lit(False))


def json_text(c: Column, key: str) -> Column:
    return F.get_json_object(c, f"$.{key}")


def json_merge(first: Column, second: Column) -> Column:
    """Two JSON objects of texts in one; the second's values win."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (first, second))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def json_without(c: Column, keys: Sequence[str]) -> Column:
    """A JSON object of texts without some keys."""
    return F.to_json(F.map_filter(F.from_json(c, "map<string,string>"), lambda k, _: ~k.isin(list(keys))))


def to_record(df: DataFrame, columns: Sequence[str], residual: str | None = None, name: str = "record") -> DataFrame:
    """A JSON object rebuilt from typed columns (nulls left out), over what ``residual`` holds."""
    own = F.to_json(F.struct(*columns))
    return df.withColumn(name, own if residual is None else json_merge(F.col(residual), own))


def changed(a: str, b: str, columns: Sequence[str]) -> Column:
    """Whether two aliased tables differ in any of ``columns``, nulls being equal."""
    return reduce(or_, (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def payload_mismatch(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """Rows whose JSON payload disagrees with the typed columns. ``fields``: JSON key to column; a
    numeric column is compared as a number if the JSON value is one."""
    kinds = dict(df.dtypes)
    tests = []
    for key, column in fields.items():
        value = json_text(F.col(payload), key)
        if kinds[column] in ("int", "bigint", "double", "smallint"):
            value = F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast(kinds[column]))
        else:
            value = value.cast(kinds[column])
        tests.append(~value.eqNullSafe(F.col(column)))
    return df.where(F.col(payload).isNotNull() & reduce(or_, tests))


def assert_same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with repeats) that only one of two tables has, and which; empty if they are equal."""
    left = a.exceptAll(b).withColumn("only_in", F.lit("first"))
    return left.unionByName(b.select(*a.columns).exceptAll(a).withColumn("only_in", F.lit("second")))


def merge_maps(primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value of both tables; the primary's value wins."""
    other = fallback.select(F.col(key), F.col(value).alias("_other"))
    return primary.select(key, value).join(other, key, "full").select(key, F.coalesce(value, "_other").alias(value))


def failures(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def require(ok: Column, message: Column) -> Column:
    """A filter that keeps rows for which ``ok`` holds and fails the job at any other."""
    return F.coalesce(F.when(ok, F.lit(True)), F.raise_error(message).cast("boolean"))
