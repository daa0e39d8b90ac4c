"""Machine event logs: classification, day and hour counts, attribution to models by schedule.

Events have file_name, date (ISO text), time (HH:mm:ss…) and message; classified events also type
(SUCCESS, NG, IGNORE or null if unknown) and category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text

NO_MODEL = "無機種區分"


def classify(events: DataFrame, mapping: DataFrame, rules=text.EVENT_RULES) -> DataFrame:
    """``events`` with type and category: by the first rule with a keyword in the message, else by the
    learned mapping (message, defect), whose ignorable causes are ignored, else null."""
    learned = mapping.select(text.event_message(F.col("message")).alias("_key"), text.normalize_category(F.col("defect")).alias("_cause"), F.lit(True).alias("_known")).dropDuplicates(["_key"])
    ruled = events.withColumn("_rule", text.rule_event(F.col("message"), rules)).withColumn("_m", text.event_message(F.col("message")))
    joined = ruled.join(learned, F.col("_m") == F.col("_key"), "left")
    kind = F.coalesce(F.col("_rule.type"), F.when(F.col("_known") & F.col("_cause").isNotNull(), text.NG).when(F.col("_known"), text.IGNORE))
    cause = F.coalesce(F.col("_rule.category"), F.when(F.col("_known"), F.coalesce("_cause", F.lit(text.IGNORED_CAUSE))))
    return joined.withColumns({"type": kind, "category": cause}).select(*events.columns, "type", "category")


def unknown_messages(classified: DataFrame) -> DataFrame:
    """Messages that nothing classifies: message, n, sample."""
    rows = classified.where("type is null").withColumn("key", text.event_message(F.col("message")))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("sample")).withColumnRenamed("key", "message")


def event_buckets(classified: DataFrame) -> DataFrame:
    """file_name, date, success, ng, ignored, unclassified, parsed."""
    n = {"success": F.col("type") == text.SUCCESS, "ng": F.col("type") == text.NG, "ignored": F.col("type") == text.IGNORE, "unclassified": F.col("type").isNull()}
    return classified.groupBy("file_name", "date").agg(*[F.count_if(c).alias(k) for k, c in n.items()], F.count(F.lit(1)).alias("parsed"))


def event_causes(classified: DataFrame) -> DataFrame:
    """file_name, date, category, message, hour, qty of stops."""
    rows = classified.where(F.col("type") == text.NG)
    return rows.groupBy("file_name", "date", "category", text.event_message(F.col("message")).alias("message"), text.hour_key(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("qty"))


def hourly_success(classified: DataFrame) -> DataFrame:
    """file_name, date, hour, qty of successes."""
    rows = classified.where(F.col("type") == text.SUCCESS)
    return rows.groupBy("file_name", "date", text.hour_key(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("qty"))


def divide_success(hours: DataFrame, divisor: str = "success_divisor") -> DataFrame:
    """Hourly successes divided by each file's divisor, remainders carried to the day's later hours."""
    each = rates.carry_floor(F.col("qty"), F.col(divisor), ["file_name", "date"], ["hour"])
    return hours.withColumn("qty", each).where("qty > 0")


def pair_slot(events: DataFrame, divisor: str = "success_divisor", order: tuple[str, ...] = ("time", "id")) -> DataFrame:
    """Success events of a file and day of which only every divisor-th counts (the others drop out). They
    are numbered within minutes, by the first five characters of the first of ``order``."""
    hit = rates.with_bucketed_rank(events.where(F.col("type") == text.SUCCESS), ["file_name", "date"], F.substring(order[0], 1, 5), [F.col(c) for c in order], "_n")
    kept = hit.where(F.col("_n") % F.col(divisor) == 0).drop("_n")
    return kept.unionByName(events.where(F.col("type") != text.SUCCESS))


def renormalise(buckets: DataFrame, causes: DataFrame, hourly_ng: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored buckets (file_name, date, success, ng, ignored, success_divisor), causes (…, category,
    message, qty) and hourly stops (…, hour, qty, ignored_qty) after causes became ignorable: they leave
    the stops, successes are divided, and where an hour is unknown the day's hourly stops shrink in
    proportion. Returns buckets, causes by final category, hourly stops."""
    day = ["file_name", "date"]
    final = text.normalize_category(F.coalesce("category", "message"))
    drop = final.isNull() | text.ignored_cause(F.coalesce("message", F.lit("")))
    marked = causes.withColumns({"final": final, "drop": F.coalesce(drop, F.lit(True))})
    kept = marked.where("not `drop`").groupBy(*day, F.col("final").alias("category")).agg(F.sum("qty").alias("qty"))
    ignored = marked.where("`drop`").groupBy(*day).agg(F.sum("qty").alias("_ignored"))
    new = buckets.join(ignored, day, "left").withColumn("_ignored", F.coalesce("_ignored", F.lit(0)))
    new = new.withColumns(
        {
            "success": F.call_function("div", F.col("success"), F.col("success_divisor")),
            "ng": F.greatest(F.lit(0), F.col("ng") - F.col("_ignored")),
            "ignored": F.col("ignored") + F.col("_ignored"),
        }
    ).drop("_ignored")
    hours = hourly_ng.withColumn("_left", F.greatest(F.lit(0), F.col("qty") - F.coalesce("ignored_qty", F.lit(0))))
    per = Window.partitionBy(*day)
    hours = hours.withColumns({"_total": F.sum("_left").over(per), "_given": F.sum(F.coalesce("ignored_qty", F.lit(0))).over(per)}).join(ignored, day, "left")
    open_ = F.greatest(F.lit(0), F.coalesce("_ignored", F.lit(0)) - F.col("_given"))
    scale = F.when((open_ > 0) & (F.col("_total") > 0), F.greatest(F.lit(0), F.col("_total") - open_) / F.col("_total")).otherwise(F.lit(1.0))
    hours = hours.withColumn("qty", F.round(F.col("_left") * scale, 2)).where("qty > 0").select(*day, "hour", "qty")
    return new, kept, hours


def _success_rate(success: Column, ng: Column) -> Column:
    return rates.plain_yield(success, success + ng)


def event_kpi(buckets: DataFrame) -> DataFrame:
    """success, ng, ignored, unclassified, parsed, success_rate (100 without records), downtime_rate."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("success", "ng", "ignored", "unclassified", "parsed")]
    s, n = F.col("success"), F.col("ng")
    return buckets.agg(*sums).withColumns({"success_rate": _success_rate(s, n), "downtime_rate": rates.map_rate(n, s)})


def event_daily(buckets: DataFrame) -> DataFrame:
    """date, success, ng, success_rate, downtime_rate, ng_rate."""
    out = buckets.groupBy("date").agg(F.sum("success").alias("success"), F.sum("ng").alias("ng"))
    s, n = F.col("success"), F.col("ng")
    return out.withColumns({"success_rate": _success_rate(s, n), "downtime_rate": rates.map_rate(n, s), "ng_rate": rates.map_rate(n, s + n)})


def event_pareto(causes: DataFrame, buckets: DataFrame) -> DataFrame:
    """category, qty, share of all records, share of stops, messages."""
    total = buckets.agg(F.sum("success").alias("_s"), F.sum("ng").alias("_n"))
    out = causes.groupBy("category").agg(F.sum("qty").alias("qty"), F.count_distinct("message").alias("messages")).crossJoin(F.broadcast(total))
    q = F.col("qty")
    return out.select("category", "qty", "messages", rates.ratio1(q, F.col("_s") + F.col("_n")).alias("record_share"), rates.ratio1(q, F.col("_n")).alias("share"))


def cause_messages(causes: DataFrame) -> DataFrame:
    """category, message, qty and the message's share of its category."""
    out = causes.groupBy("category", "message").agg(F.sum("qty").alias("qty"))
    return rates.with_share(out, ["category"], "qty")


def cause_hours(causes: DataFrame, notes: DataFrame) -> DataFrame:
    """category, hour, qty, share of its category, and the notes of that hour."""
    out = rates.with_share(causes.groupBy("category", "hour").agg(F.sum("qty").alias("qty")), ["category"], "qty")
    return attach_notes(out, notes)


def attach_notes(hours: DataFrame, notes: DataFrame, since: str = "", until: str = "") -> DataFrame:
    """``hours`` with the notes (date, hour, note) of each hour in date order; several are dated. An hour's text holds
    the notes of the asked dates (``since`` to ``until``, both included), so give the range of the view; :func:`hour_notes`
    has a row for each note instead, for any range."""
    own = dates.date_range(notes.where("note <> ''"), since, until, "date")
    parts = F.sort_array(F.collect_list(F.struct("date", "note")))
    dated = F.transform(parts, lambda p: F.concat(p["date"], F.lit("："), p["note"]))
    joined = own.groupBy("hour").agg(F.when(F.count(F.lit(1)) > 1, F.array_join(dated, "\n")).otherwise(F.max("note")).alias("note"))
    return hours.join(joined, "hour", "left").withColumn("note", F.coalesce("note", F.lit("")))


def hour_notes(hours: DataFrame, notes: DataFrame) -> DataFrame:
    """``hours`` with a row for each note of the hour (note_date, note), one without where there is none."""
    own = notes.where("note <> ''").select("hour", F.col("date").alias("note_date"), "note")
    return hours.join(own, "hour", "left")


def hour_detail(causes: DataFrame, date: str, hour: str) -> DataFrame:
    """Causes in one hour of a day: category, qty, share of the category's day; the day's causes if no
    hour is known for them."""
    day = causes.where(F.col("date") == date).groupBy("category", "hour").agg(F.sum("qty").alias("qty"))
    out = day.withColumn("total", F.sum("qty").over(Window.partitionBy("category")))
    known = F.max(F.when(F.col("hour") != "", 1).otherwise(0)).over(Window.partitionBy("category"))
    out = out.withColumn("_known", known).where((F.col("hour") == hour) | (F.col("_known") == 0))
    return out.select("category", "qty", rates.ratio1(F.col("qty"), F.col("total")).alias("share"))


def active_days(classified: DataFrame) -> DataFrame:
    """One row: days with successes or stops."""
    return classified.where(F.col("type").isin(text.SUCCESS, text.NG)).agg(F.count_distinct("date").alias("days"))


def hour_profile(success: DataFrame, ng: DataFrame, active: DataFrame) -> DataFrame:
    """24 rows: hour, production, ng (means over the days of :func:`active_days`), success_rate,
    downtime_rate."""
    hours = records.with_bounds(success.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour")), active)
    days = F.greatest(F.lit(1), F.col("days"))
    s = success.groupBy("hour").agg(F.sum("qty").alias("_s"))
    n = ng.groupBy("hour").agg(F.sum("qty").alias("_n"))
    out = hours.join(s, "hour", "left").join(n, "hour", "left")
    made, bad = (F.round(F.coalesce(c, F.lit(0)) / days, 2) for c in ("_s", "_n"))
    out = out.select("hour", made.alias("production"), bad.alias("ng"))
    cents, stops = F.round(F.col("production") * 100).cast("long"), F.round(F.col("ng") * 100).cast("long")
    return out.withColumns({"success_rate": _success_rate(cents, stops), "downtime_rate": rates.map_rate(stops, cents)})


def attach_model(events: DataFrame, schedules: DataFrame) -> DataFrame:
    """``events`` with the model whose schedule (date, start_time, end_time, model, priority) holds their
    minute; the schedule of the highest priority where several do; a fixed name where none does.

    A day's schedules are first cut into spans that don't overlap, each with its model, so that an event
    is read once and meets at most one span of its day.
    """
    rows = events.withColumn("_minute", text.minute_of_day(F.col("time")))
    spans = schedule_spans(schedules)
    inside = (F.col("date") == F.col("_date")) & (F.col("_from") <= F.col("_minute")) & (F.col("_minute") < F.col("_to"))
    return rows.join(spans, inside, "left").select(*events.columns, F.coalesce("_model", F.lit(NO_MODEL)).alias("model"))


def schedule_spans(schedules: DataFrame) -> DataFrame:
    """_date, _from, _to (minutes, the end left out), _model: the spans between any two neighbouring ends of
    a day's schedules that some schedule covers, with the model of the one of highest priority."""
    s = schedules.select(F.col("date").alias("_date"), text.minute_of_day(F.col("start_time")).alias("_from"), text.minute_of_day(F.col("end_time"), True).alias("_to"), F.struct("priority", "model").alias("_best"))
    s = s.where("_from < _to")
    ends = s.select("_date", F.explode(F.array("_from", "_to")).alias("_at")).distinct()
    spans = ends.select(F.col("_date").alias("_day"), F.col("_at").alias("_a"), F.lead("_at").over(Window.partitionBy("_date").orderBy("_at")).alias("_b")).where("_b is not null")
    covered = spans.join(s, (F.col("_day") == F.col("_date")) & (F.col("_from") <= F.col("_a")) & (F.col("_b") <= F.col("_to")))
    best = covered.groupBy("_day", "_a", "_b").agg(F.max("_best").alias("_best"))
    return best.select(F.col("_day").alias("_date"), F.col("_a").alias("_from"), F.col("_b").alias("_to"), F.col("_best.model").alias("_model"))


def overlap_chains(schedules: DataFrame) -> DataFrame:
    """id, date, a, b (minutes) and chain of schedules: a sweep by start, in which a chain ends where no earlier schedule
    of the day is still open. Schedules of different chains don't overlap; an empty one has no chain."""
    s = schedules.select("id", "date", text.minute_of_day(F.col("start_time")).alias("a"), text.minute_of_day(F.col("end_time"), True).alias("b")).where("a < b")
    sweep = Window.partitionBy("date").orderBy("a", "id")
    open_until = F.max("b").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    opens = s.withColumn("_opens", F.coalesce(F.col("a") >= open_until, F.lit(True)).cast("int"))
    return opens.withColumn("chain", F.sum("_opens").over(sweep)).drop("_opens")


def schedule_overlaps(schedules: DataFrame) -> DataFrame:
    """Pairs of schedules of a day that overlap: date, first, second (ids). Only chains of several are looked at, and
    there only schedules that are open in the quarter of an hour in which the other one starts. Null times and
    schedules that don't last overlap with nothing."""
    chained = overlap_chains(schedules)
    busy = chained.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("date", "chain"))).where("_n > 1")
    x = busy.select(F.col("date").alias("d"), F.col("chain").alias("c"), F.col("id").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.explode(F.sequence(F.expr("a div 15"), F.expr("(b - 1) div 15"))).alias("q"))
    y = busy.select("date", "chain", F.col("id").alias("y"), F.col("a").alias("ya"), F.expr("a div 15").alias("quarter"))
    # the later start lies within the other schedule; of equal starts, the smaller id goes first
    meets = (F.col("d") == F.col("date")) & (F.col("c") == F.col("chain")) & (F.col("q") == F.col("quarter")) & (F.col("ya") < F.col("xb")) & ((F.col("xa") < F.col("ya")) | ((F.col("xa") == F.col("ya")) & (F.col("x") < F.col("y"))))
    return x.join(y, meets).select("date", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))


def _model_rates(out: DataFrame) -> DataFrame:
    s, n = F.col("success"), F.col("ng")
    return out.withColumns({"total": s + n, "success_rate": _success_rate(s, n), "downtime_rate": rates.map_rate(n, s)})


def event_by_model(classified: DataFrame, schedules: DataFrame) -> DataFrame:
    """model, success, ng, total, rates from single events."""
    rows = attach_model(classified.where(F.col("type").isin(text.SUCCESS, text.NG)), schedules)
    out = rows.groupBy("model").agg(F.count_if(F.col("type") == text.SUCCESS).alias("success"), F.count_if(F.col("type") == text.NG).alias("ng"))
    return _model_rates(out)


def hourly_by_model(success: DataFrame, ng: DataFrame, buckets: DataFrame, schedules: DataFrame) -> DataFrame:
    """As :func:`event_by_model`, from hourly counts: an hour counts for the model at its 30th minute;
    what no hour holds counts for no model."""
    s = success.select("file_name", "date", "hour", F.col("qty").alias("success"), F.lit(0).cast("double").alias("ng"))
    n = ng.select("file_name", "date", "hour", F.lit(0).alias("success"), F.col("qty").cast("double").alias("ng"))
    hours = s.unionByName(n).groupBy("file_name", "date", "hour").agg(F.sum("success").alias("success"), F.sum("ng").alias("ng"))
    placed = attach_model(hours.where("hour <> ''").withColumn("time", F.concat("hour", F.lit(":30"))), schedules)
    seen = placed.groupBy("file_name", "date").agg(F.sum("success").alias("_s"), F.sum("ng").alias("_n"))
    rest = buckets.join(seen, ["file_name", "date"], "left").select(
        F.lit(NO_MODEL).alias("model"),
        F.greatest(F.lit(0), F.col("success") - F.coalesce("_s", F.lit(0))).alias("success"),
        F.greatest(F.lit(0.0), F.col("ng") - F.coalesce("_n", F.lit(0.0))).alias("ng"),
    )
    out = placed.select("model", "success", "ng").unionByName(rest.where("success > 0 or ng > 0"))
    return _model_rates(out.groupBy("model").agg(F.sum("success").alias("success"), F.sum("ng").cast("long").alias("ng")))
