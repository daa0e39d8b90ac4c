"""Breakdowns of defects by type, location, model, work order and day, all from one grouping-sets pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions import rates
from yieldloom.operators import star
from yieldloom.sources.sinks import staged

DIMS = {"type": "type", "location": "location", "model": "model", "work_order": "wo_number", "day": "production_date"}
TWO = [("type", "location"), ("type", "model"), ("type", "work_order"), ("location", "work_order"), ("location", "model"), ("location", "type"), ("model", "type"), ("model", "location"), ("model", "work_order"), ("work_order", "type"), ("work_order", "location"), ("day", "type")]
THREE = [("type", "location", "model"), ("type", "location", "work_order")]


def cross_tabs(scan: DataFrame, sets: list[tuple[str, ...]] = TWO) -> DataFrame:
    """kind (such as 'type_location'), a, b[, c], qty of the defects of a production scan."""
    defects = scan.where("qty is not null").select(*[F.col(c).cast("string").alias(n) for n, c in DIMS.items()], "qty")
    names = list(DIMS)
    unordered = sorted({tuple(sorted(s, key=names.index)) for s in sets})
    grouped = defects.groupingSets([[F.col(c) for c in s] for s in unordered], *[F.col(c) for c in names]).agg(
        *[F.col(c) for c in names], F.grouping_id(*names).alias("g"), F.sum("qty").alias("qty")
    )
    masks = {s: sum(1 << (len(names) - 1 - names.index(c)) for c in names if c not in s) for s in unordered}
    views = []
    for s in sets:
        mask = masks[tuple(sorted(s, key=names.index))]
        views.append(F.when(F.col("g") == mask, F.struct(F.lit("_".join(s)).alias("kind"), *[F.col(c).alias(k) for c, k in zip(s, "abc", strict=False)])))
    out = grouped.select("qty", F.explode(F.array_compact(F.array(*views))).alias("v"))
    return out.select("v.*", "qty")


def cross_tabs3(scan: DataFrame) -> DataFrame:
    """kind, a, b, c, qty of the three-way breakdowns."""
    return cross_tabs(scan, THREE)


def sub_breakdowns(scan: DataFrame) -> DataFrame:
    """The breakdowns within each model and work order."""
    return cross_tabs(scan, [s for s in TWO if s[0] in ("model", "work_order")])


def smt_pareto(scan: DataFrame, by: str = "type") -> DataFrame:
    """name, qty and one-digit share of all defects, by type or location."""
    found = scan.where("qty is not null").groupBy(F.col(DIMS[by]).alias("name")).agg(F.sum("qty").alias("qty"))
    return rates.with_share(found, [], "qty")


def smt_by(scan: DataFrame, by: str) -> DataFrame:
    """name, input, defects, rate and share by model or work_order."""
    out = star.production_totals(scan, [DIMS[by]]).withColumnRenamed(DIMS[by], "name")
    return rates.with_share(out.withColumn("rate", rates.map_rate(F.col("defects"), F.col("input"))), [], "defects")


def smt_daily(scan: DataFrame) -> DataFrame:
    """production_date, input, defects, defect_rate, yield_rate (100 without input)."""
    out = star.production_totals(scan, ["production_date"])
    return out.withColumns({"defect_rate": rates.map_rate(F.col("defects"), F.col("input")), "yield_rate": rates.plain_yield(F.col("input") - F.col("defects"), F.col("input"))})


def top_k(df: DataFrame, k: int, by: list[Column]) -> DataFrame:
    """The first ``k`` rows by an order."""
    return df.orderBy(*by).limit(k)


def rank_order() -> list[Column]:
    """Defects descending, then input descending, then name."""
    return [F.desc("defects"), F.desc("input"), F.asc("name")]


def systemic_locations(scan: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` places with most defects: name, qty, share, days with defects, all days, systemic (on at
    least half of the days)."""
    # places and days are few: one pass over the scan, whose joins the days, the places and their total would each work out again
    cells = staged(scan.groupBy(F.col("location").alias("name"), "production_date").agg(F.sum("qty").alias("qty")))
    days = cells.agg(F.count_distinct("production_date").alias("total_days"))
    found = cells.where("qty is not null").groupBy("name").agg(F.sum("qty").alias("qty"), F.count_distinct("production_date").alias("appear_days"))
    out = rates.with_share(found, [], "qty").crossJoin(F.broadcast(days))
    return top_k(out.withColumn("systemic", F.col("appear_days") * 2 >= F.col("total_days")), k, [F.desc("qty"), F.asc("name")])


def type_trend(scan: DataFrame) -> DataFrame:
    """production_date, type, qty."""
    return scan.where("qty is not null").groupBy("production_date", "type").agg(F.sum("qty").alias("qty"))


def top_types(scan: DataFrame, k: int = 5) -> DataFrame:
    return top_k(smt_pareto(scan), k, [F.desc("qty"), F.asc("name")]).select("name")


def heatmap(scan: DataFrame, types: int = 8, locations: int = 12) -> DataFrame:
    """type, location, qty of the leading types and places, with the largest cell."""
    # both rankings are sums of the same cells, whose one shuffle is read again for them
    cells = scan.where("qty is not null").groupBy("type", "location").agg(F.sum("qty").alias("qty"))

    def leading(by: str, k: int) -> DataFrame:
        return top_k(cells.groupBy(by).agg(F.sum("qty").alias("_of")), k, [F.desc("_of"), F.asc(by)]).select(by)

    found = cells.where("qty > 0").join(leading("type", types), "type", "left_semi").join(leading("location", locations), "location", "left_semi")
    # at most ``types`` times ``locations`` rows
    return found.select("type", "location", "qty", F.max("qty").over(Window.partitionBy()).alias("largest"))


def defect_trend(scan: DataFrame, name: str) -> DataFrame:
    """production_date, qty of one defect and its share of the day's defects."""
    return rates.with_share(type_trend(scan), ["production_date"], "qty").where(F.col("type") == name).drop("type")


def drill(scan: DataFrame, kind: str, key: str) -> DataFrame:
    """What one type, place, model or work order is made of: of, name, qty, share."""
    sets = [s for s in TWO if s[0] == kind]
    found = cross_tabs(scan, sets).where(F.col("a") == key)
    out = found.select(F.substring_index("kind", "_", -1).alias("of"), F.col("b").alias("name"), "qty")
    return rates.with_share(out, ["of"], "qty")


def flatten_cross(scan: DataFrame, first: str = "type", second: str = "location") -> DataFrame:
    """a, b, qty and b's share within a."""
    return rates.with_share(cross_tabs(scan, [(first, second)]).drop("kind"), ["a"], "qty")


def daily_detail(scan: DataFrame) -> DataFrame:
    """production_date and its defects as 'typexqty, …', most first."""
    parts = F.sort_array(F.collect_list(F.struct((-F.col("qty")).alias("q"), "type", "qty")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit("x"), p["qty"].cast("string"))), ", ")
    return type_trend(scan).groupBy("production_date").agg(text.alias("detail"))


def sort_by(df: DataFrame, key: str, direction: str | None = None) -> DataFrame:
    """Sorted by a column: numbers downwards and texts upwards unless told; a missing text is ''."""
    kind = dict(df.dtypes)[key]
    column = F.coalesce(F.col(key), F.lit("")) if kind == "string" else F.col(key)
    down = direction == "desc" if direction else kind != "string"
    return df.orderBy(column.desc() if down else column.asc())


def sort_label(df: DataFrame, column: str, collation: str = "zh_Hant") -> DataFrame:
    """Sorted by a label as Chinese readers expect."""
    return df.orderBy(F.collate(F.col(column), collation))


def page(df: DataFrame, limit: int, offset: int, most: int = 100) -> DataFrame:
    """A page of an ordered table; ``limit`` stays within 1 and ``most``."""
    return df.offset(max(0, offset)).limit(min(max(1, limit), most))
