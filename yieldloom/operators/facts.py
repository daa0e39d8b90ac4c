"""The unified fact view and what is summed over it: process figures, file summaries, fingerprints.

Facts have line, file_name, report_date, work_order, product_code, model_name, status, defect, machine,
input_included, is_defect, source_format and a weight ``quantity``; unit rows weigh 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text

DIMENSIONS = ["line", "file_name", "report_date", "work_order", "product_code", "model_name", "status", "defect", "machine", "input_included", "is_defect", "source_format"]
NO_ORDER = "未識別工單"


def weighted(units: DataFrame) -> DataFrame:
    """Unit rows as facts of weight 1."""
    texts = ("work_order", "product_code", "model_name", "status", "defect", "machine", "source_format")
    return units.select(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in DIMENSIONS], F.lit(1).cast("long").alias("quantity"))


def fact_view(winners: DataFrame, archived: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Winning unit rows, archived unit rows and weighted groups as one table of facts."""
    out = weighted(winners)
    if archived is not None:
        out = out.unionByName(weighted(archived))
    return out if groups is None else out.unionByName(groups.select(*DIMENSIONS, "quantity"))


def compact_groups(units: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Unit rows counted by all dimensions, added to existing groups."""
    facts = fact_view(units, None, groups)
    return facts.groupBy(*DIMENSIONS).agg(F.sum("quantity").alias("quantity"))


def attach_group(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts with the group_id of the group that has the same dimensions."""
    others = [c for c in facts.columns if c not in DIMENSIONS]
    texts = ("work_order", "product_code", "model_name", "status", "defect", "machine", "source_format")
    keep = facts.select(*others, *[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in DIMENSIONS])
    b = groups.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_of_{c}") for c in DIMENSIONS], "group_id")
    cond = reduce(lambda x, y: x & y, (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"_of_{c}") for c in DIMENSIONS))
    return keep.join(b, cond, "left").select(*keep.columns, "group_id")


def _sum(condition: Column | None = None, value: str = "quantity") -> Column:
    return F.coalesce(F.sum(F.col(value) if condition is None else F.when(condition, F.col(value))), F.lit(0))


def _entered() -> Column:
    return F.coalesce(F.col("input_included"), F.lit(False))


def _counts() -> list[Column]:
    return [
        _sum(_entered()).alias("input"),
        _sum(_entered() & (F.col("status") == "GOOD")).alias("good"),
        _sum(_entered() & (F.col("status") == "FAIL")).alias("defects"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"yield_rate": rates.map_rate(F.col("good"), F.col("input")), "defect_rate": rates.map_rate(F.col("defects"), F.col("input"))})


def unknown_status() -> Column:
    return (F.col("status") != "") & ~F.col("status").isin("GOOD", "FAIL")


def process_kpi(facts: DataFrame) -> DataFrame:
    """One row for each line: input, good, defects, rates, unknown_status, days, rows, files."""
    out = facts.groupBy("line").agg(
        *_counts(),
        _sum(unknown_status()).alias("unknown_status"),
        F.count_distinct(F.when(_entered(), F.nullif("report_date", F.lit("")))).alias("days"),
        _sum().alias("rows"),
        F.count_distinct("file_name").alias("files"),
    )
    return _rates(out)


def _breakdown(facts: DataFrame, keys: list[str]) -> DataFrame:
    return _rates(facts.where(_entered()).groupBy(*keys).agg(*_counts()))


def by_model(facts: DataFrame) -> DataFrame:
    """line, model, input, good, defects, rates and the share of the line's defects."""
    named = facts.withColumn("model", F.coalesce(F.nullif("model_name", F.lit("")), F.lit(text.NO_MODEL_NAME)))
    return rates.with_share(_breakdown(named, ["line", "model"]), ["line"], "defects", digits=2)


def by_work_order(facts: DataFrame) -> DataFrame:
    """line, work_order, models (joined by ' / '), input, good, defects, rates, share of defects."""
    named = facts.withColumns({"model": F.coalesce(F.nullif("model_name", F.lit("")), F.lit(text.NO_MODEL_NAME)), "work_order": F.coalesce(F.nullif("work_order", F.lit("")), F.lit(NO_ORDER))})
    kept = named.where(_entered()).groupBy("line", "work_order").agg(*_counts(), F.array_join(F.sort_array(F.collect_set("model")), " / ").alias("models"))
    return rates.with_share(_rates(kept), ["line"], "defects", digits=2)


def daily(facts: DataFrame) -> DataFrame:
    """line, report_date, input, good, defects, rates."""
    return _breakdown(facts.where(F.coalesce(F.col("report_date"), F.lit("")) != ""), ["line", "report_date"])


def pareto(facts: DataFrame) -> DataFrame:
    """line, defect, qty, share of input and share of defects; missing names as their line calls them."""
    entered = facts.where(_entered())
    total = entered.groupBy("line").agg(*_counts()).select(F.col("line").alias("_line"), "input", "defects")
    fails = entered.where(F.col("status") == "FAIL").groupBy("line", text.defect_label(F.col("line"), F.col("defect")).alias("defect")).agg(F.sum("quantity").alias("qty"))
    out = fails.join(total, F.col("line") == F.col("_line"))
    return out.select("line", "defect", "qty", rates.map_rate(F.col("qty"), F.col("input")).alias("input_share"), rates.map_rate(F.col("qty"), F.col("defects")).alias("share"))


def focus_defect(details: DataFrame, name: str | None, column: str = "defect") -> DataFrame:
    """A detail list restricted to one defect; totals are computed apart and stay."""
    return details if name in (None, "all") else details.where(F.col(column) == name)


def dim_filter(df: DataFrame, model: str = "all", work_order: str = "all") -> DataFrame:
    """Rows of one model and one work order; 'all' matches everything."""
    if model != "all":
        df = df.where(F.col("model_name") == model)
    return df if work_order == "all" else df.where(F.col("work_order") == work_order)


def _with_machine(facts: DataFrame) -> DataFrame:
    named = F.coalesce(F.nullif("machine", F.lit("")), F.lit(text.UNKNOWN_MACHINE))
    return facts.where(F.col("line").isin(*text.MACHINE_LINES)).withColumn("machine", named)


def by_machine(facts: DataFrame) -> DataFrame:
    """line, machine, input, good, defects, rates for machine-classified lines that have rows; the known
    machines are always there."""
    rows = _with_machine(facts)
    found = rows.groupBy("line", "machine").agg(*_counts())
    lines = rows.select("line").distinct()
    labels = lines.select("line", F.explode(F.array(*[F.lit(m) for m in text.MACHINE_LABELS])).alias("machine"))
    every = labels.join(found, ["line", "machine"], "full")
    return _rates(every.select("line", "machine", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("input", "good", "defects")]))


def machine_cross(facts: DataFrame, dimension: str) -> DataFrame:
    """line, machine, the dimension, input, good, defects, rates."""
    return _breakdown(_with_machine(facts), ["line", "machine", dimension])


def detail_cross(facts: DataFrame) -> DataFrame:
    """Two-way breakdowns of inputs and defects: kind ('defect_model', 'defect_order', 'model_order'),
    line, a, b, qty and b's share within a, from one pass."""
    model = F.coalesce(F.nullif("model_name", F.lit("")), F.lit(text.NO_MODEL_NAME))
    order = F.coalesce(F.nullif("work_order", F.lit("")), F.lit(NO_ORDER))
    fail = F.col("status") == "FAIL"
    defect = text.defect_label(F.col("line"), F.col("defect"))
    pairs = F.array(
        F.when(fail, F.struct(F.lit("defect_model").alias("kind"), defect.alias("a"), model.alias("b"))),
        F.when(fail, F.struct(F.lit("defect_order").alias("kind"), defect.alias("a"), order.alias("b"))),
        F.struct(F.lit("model_order").alias("kind"), model.alias("a"), order.alias("b")),
    )
    long = facts.where(_entered()).select("line", "quantity", F.explode(F.array_compact(pairs)).alias("p"))
    out = long.groupBy("p.kind", "line", "p.a", "p.b").agg(F.sum("quantity").alias("qty"))
    return rates.with_share(out, ["kind", "line", "a"], "qty", digits=2)


def refresh_summaries(facts: DataFrame, heads: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Summary of each head (line, file_name, and fallbacks model_name, product_code, work_order,
    report_date, date_start, date_end): weighted sums, joined names, date range, rates. With ``pairs``
    only those files are summarised."""
    if pairs is not None:
        heads = heads.join(pairs.select("line", "file_name").distinct(), ["line", "file_name"], "left_semi")
    own = facts.join(heads.select("line", "file_name"), ["line", "file_name"], "left_semi")
    up, entered = F.upper("status"), _entered()

    def names(value: Column) -> Column:
        return F.nullif(F.array_join(F.sort_array(F.collect_set(value)), "、"), F.lit(""))

    iso = F.when(F.col("report_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("report_date"))
    odd = (F.col("status") != "") & ~up.isin("GOOD", "FAIL")
    sums = own.groupBy("line", "file_name").agg(
        _sum().alias("row_count"),
        _sum(entered).alias("input_count"),
        _sum(entered & (up == "GOOD")).alias("good_count"),
        _sum(entered & (up == "FAIL")).alias("fail_count"),
        _sum(odd).alias("unknown_status_count"),
        names(F.nullif("model_name", F.lit(""))).alias("_model"),
        names(F.nullif("product_code", F.lit(""))).alias("_code"),
        names(F.nullif("work_order", F.lit(""))).alias("_order"),
        names(F.when(odd, F.col("status"))).alias("_odd"),
        F.min(iso).alias("_first"),
        F.max(iso).alias("_last"),
    )
    out = heads.join(sums, ["line", "file_name"], "left")
    first, last = F.coalesce("_first", "date_start"), F.coalesce("_last", "date_end")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("row_count", "input_count", "good_count", "fail_count", "unknown_status_count")}
    return out.select(
        "line",
        "file_name",
        F.coalesce("_model", "model_name", F.lit(text.NO_MODEL_NAME)).alias("model_name"),
        F.coalesce("_code", "product_code", F.lit("未識別產品代碼")).alias("product_code"),
        F.coalesce("_order", "work_order", F.lit(NO_ORDER)).alias("work_order"),
        dates.date_span(first, last, F.coalesce("report_date", F.lit("未識別日期"))).alias("report_date"),
        first.alias("date_start"),
        last.alias("date_end"),
        *[v.alias(c) for c, v in n.items()],
        rates.map_rate(n["good_count"], n["input_count"]).alias("yield_rate"),
        rates.map_rate(n["fail_count"], n["input_count"]).alias("defect_rate"),
        F.coalesce("_odd", F.lit("無")).alias("unknown_status_text"),
    )


def drop_ghosts(summaries: DataFrame) -> DataFrame:
    """Summaries without those that count rows but nothing in them."""
    nothing = (F.col("input_count") == 0) & (F.col("good_count") == 0) & (F.col("fail_count") == 0) & (F.col("unknown_status_count") == 0)
    return summaries.where(~((F.col("row_count") > 0) & nothing))


def files_by_date(facts: DataFrame) -> DataFrame:
    """report_date, line, file_name, input, good, defects."""
    return facts.groupBy("report_date", "line", "file_name").agg(*_counts())


def merge_summaries(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial sums added up by their keys."""
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in keys])


def daily_cross(facts: DataFrame) -> DataFrame:
    """The pre-aggregate that narrower questions are answered from: line, report_date, model_name,
    work_order, defect, machine, status, quantity."""
    return facts.where(_entered()).groupBy("line", "report_date", "model_name", "work_order", "defect", "machine", "status").agg(F.sum("quantity").alias("quantity"))


def slice_summary(cross: DataFrame, model: str = "all", work_order: str = "all") -> DataFrame:
    """Day totals of a model or work order from :func:`daily_cross`."""
    return daily(dim_filter(cross, model, work_order).withColumn("input_included", F.lit(True)))


def summary_day(summaries: DataFrame, date: str) -> DataFrame:
    """Facts of one day from file summaries alone: a row each for good, failed and unknown units."""
    day = summaries.where((F.col("date_start") <= date) & (F.col("date_end") >= date))
    parts = F.array(
        *[
            F.struct(F.lit(s).alias("status"), F.col(c).alias("quantity"), F.lit(s != "UNKNOWN").alias("input_included"))
            for s, c in (("GOOD", "good_count"), ("FAIL", "fail_count"), ("UNKNOWN", "unknown_status_count"))
        ]
    )
    rows = day.select("line", "file_name", "model_name", "work_order", F.explode(parts).alias("p"))
    return rows.select("line", "file_name", "model_name", "work_order", F.lit(date).alias("report_date"), "p.status", "p.quantity", "p.input_included").where("quantity > 0")


def producing_dates(*stores: DataFrame) -> DataFrame:
    """Distinct line and report_day of several stores; invalid dates are left out."""
    day = dates.day_of(F.col("report_date"))
    rows = [s.select("line", day.alias("report_day")) for s in stores]
    return reduce(DataFrame.unionByName, rows).where("report_day is not null").distinct()


def affected(old: DataFrame, new: DataFrame, column: str = "report_date") -> DataFrame:
    """Values that either table has."""
    return old.select(column).union(new.select(column)).distinct()


def removed_ids(before: DataFrame, after: DataFrame, column: str = "id") -> DataFrame:
    return before.select(column).join(after.select(column), column, "left_anti")


def label_union(tables: list[DataFrame], column: str) -> DataFrame:
    """Distinct non-empty labels of several tables."""
    rows = reduce(DataFrame.unionByName, [t.select(column) for t in tables])
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").distinct()


def defect_options(line: str, stores: list[DataFrame], column: str = "defect") -> DataFrame:
    """Distinct trimmed defect names of several stores of a line; its name for missing ones counts too."""
    rows = reduce(DataFrame.unionByName, [s.select(text.defect_label(F.lit(line), F.col(column)).alias("name")) for s in stores])
    return rows.distinct()


LANES = ["low", "high"]
_MODULUS = "cast('18446744073709551616' AS decimal(20,0))"


def _lanes(columns: list[str], missing: str) -> list[Column]:
    """Two 64-bit numbers from a row's content."""
    content = F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]))
    return [F.conv(F.substring(content, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def _lane_sums(weights: Column, lanes: list[Column]) -> list[Column]:
    return [F.sum(weights.cast("decimal(18,0)") * lane).alias(name) for name, lane in zip(LANES, lanes, strict=True)]


def _folded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(f"cast(pmod({c}, {_MODULUS}) AS decimal(20,0))") for c in LANES})


def day_digests(facts: DataFrame) -> DataFrame:
    """line, report_date, low, high, quantity: a fingerprint of the weighted content of each line and day. Each unit adds the
    hash of its dimensions, modulo 2^64, so neither order nor grouping matters, and content can be added to a
    fingerprint and taken from it again."""
    sums = facts.groupBy("line", "report_date").agg(*_lane_sums(F.col("quantity"), _lanes(DIMENSIONS, "\u0000")), F.sum("quantity").alias("quantity"))
    return _folded(sums)


def change_digests(digests: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Stored :func:`day_digests` after facts were added and removed: only those facts are read. Days without content
    drop out."""
    every = digests
    if added is not None:
        every = every.unionByName(day_digests(added))
    if removed is not None:
        negative = {c: (-F.col(c)).alias(c) for c in (*LANES, "quantity")}
        every = every.unionByName(day_digests(removed).select("line", "report_date", *negative.values()))
    sums = every.groupBy("line", "report_date").agg(*[F.sum(c).alias(c) for c in (*LANES, "quantity")])
    return _folded(sums).where("quantity <> 0 or low <> 0 or high <> 0")


def line_digests(digests: DataFrame, cutoff: str | None = None) -> DataFrame:
    """line, digest, quantity from :func:`day_digests`, of the days before ``cutoff`` if there is one."""
    days = digests if cutoff is None else digests.where(dates.is_valid_iso_date(F.col("report_date")) & (F.col("report_date") < cutoff))
    sums = _folded(days.groupBy("line").agg(*[F.sum(c).alias(c) for c in LANES], F.sum("quantity").alias("quantity")))
    return sums.select("line", _printed().alias("digest"), "quantity")


def _printed() -> Column:
    return F.concat_ws("-", *[F.lpad(F.conv(F.col(c).cast("string"), 10, 16), 16, "0") for c in LANES])


def dashboard_digest(facts: DataFrame, groups: DataFrame, cutoff: str | None = None) -> DataFrame:
    """line, digest, quantity, group_count for every line: the fingerprint of its weighted content, the
    same before and after unit rows are compacted into groups."""
    old = groups if cutoff is None else groups.where(dates.is_valid_iso_date(F.col("report_date")) & (F.col("report_date") < cutoff))
    n = old.groupBy("line").agg(F.count(F.lit(1)).alias("group_count"))
    joined = line_digests(day_digests(facts), cutoff).join(n, "line", "full")
    return per_line(facts.sparkSession, joined, {"digest": "0" * 16 + "-" + "0" * 16, "quantity": 0, "group_count": 0})


def per_line(spark, df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with a row for each line; missing values take their defaults."""
    lines = spark.createDataFrame([(x,) for x in text.LINES], "line string")
    return lines.join(df, "line", "left").fillna(defaults)


def line_versions(summaries: DataFrame) -> DataFrame:
    """line, rows and a fingerprint of its summary rows, whatever their order: hashes of rows added up in two lanes
    modulo 2^64."""
    one = F.lit(1)
    sums = summaries.groupBy("line").agg(F.count(one).alias("rows"), *_lane_sums(one, _lanes(sorted(summaries.columns), "")))
    return _folded(sums).select("line", "rows", _printed().alias("version"))


def file_details(winners: DataFrame, line: str, start: str = "", end: str = "") -> DataFrame:
    """file_name, place, id, record: the records of each file as JSON texts, with their place (from 1) in the
    order of time (missing last), upload and id. A sink that writes a file's records in one text sorts by
    (file_name, place); a file may hold any share of the rows."""
    rows = dates.date_range(winners.where(F.col("line") == line), start, end)
    record = F.to_json(F.struct("dedup_key", "dedup_time", "report_date", "work_order", "model_name", "status", "defect", "machine"))
    order = [F.col("dedup_time").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id")]
    hour = F.coalesce(F.floor(F.col("dedup_time") / 3_600_000), F.lit(2**62))
    ranked = rates.with_bucketed_rank(rows, ["file_name"], hour, order, "place")
    return ranked.select("file_name", "place", "id", record.alias("record"))


def unknown_products(units: DataFrame) -> DataFrame:
    """Product codes without a known model: rows, a sample text, work orders."""
    rows = units.where((F.col("model_name") == text.NO_MODEL_NAME) & (F.col("product_code") != ""))
    return rows.groupBy("product_code").agg(F.count(F.lit(1)).alias("rows"), F.min("product_code").alias("sample"), F.sort_array(F.collect_set("work_order")).alias("work_orders"))


def learn_mappings(units: DataFrame, known: DataFrame) -> DataFrame:
    """code and model of codes that ``known`` doesn't have yet: the model of the first row of each."""
    rows = units.where((F.col("product_code") != "") & (F.col("model_name") != text.NO_MODEL_NAME))
    first = rows.groupBy(F.col("product_code").alias("code")).agg(F.min_by("model_name", "id").alias("model"))
    return first.join(known.select("code"), "code", "left_anti")


def resolve_model(df: DataFrame, memory: DataFrame, column: str = "product_code") -> DataFrame:
    """``df`` with model_name by the overrides, the known models, then the learned memory (code, model)."""
    learned = memory.select(F.col("code").alias("_code"), F.col("model").alias("_model"))
    joined = df.join(learned, F.col(column) == F.col("_code"), "left")
    return joined.withColumn("model_name", F.coalesce(text.known_model(F.col(column)), "_model", F.lit(text.NO_MODEL_NAME))).drop("_code", "_model")


GRAM = 3


def _grams(value: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters, none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(value) - (size - 1))
    runs = F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(size))))
    return F.when(F.length(value) >= size, runs)


def _containing(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """_text and _model of each text that contains a rule's text, by an inverted index: a rule is looked up under the rarest of its
    runs of ``GRAM`` characters, a shorter one under its whole text, and what is found is verified."""
    gram = F.explode(_grams(F.col("_rule"), GRAM)).alias("_gram")
    of_rules = rules.where(F.length("_rule") >= GRAM).select("_rule", "_model", gram)
    of_texts = texts.select("_text", F.explode(_grams(F.col("_text"), GRAM)).alias("_gram"))
    asked = of_rules.select("_gram").distinct()
    often = of_texts.join(asked, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a run that no text has keeps the rule from being found at all
    counted = of_rules.join(often, "_gram", "left").groupBy("_rule", "_model").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_gram"))
    out = of_texts.join(counted, "_gram").where(F.contains("_text", "_rule")).select("_text", "_model")
    for size in range(1, GRAM):
        short = rules.where(F.length("_rule") == size).select(F.col("_rule").alias("_gram"), "_model")
        runs = texts.select("_text", F.explode(_grams(F.col("_text"), size)).alias("_gram"))
        out = out.unionByName(runs.join(short, "_gram").select("_text", "_model"))
    return out


def match_rules(df: DataFrame, rules: DataFrame, column: str = "product_text", key: str = "id") -> DataFrame:
    """key, model, conflict: the model on which all matching rules (match_type exact or contains,
    match_text, model) agree, null and a conflict if they don't. Distinct texts are matched once, by equality
    joins only: exact rules by their text, others by :func:`_containing`."""
    keyed = df.select(key, text.match_text(F.col(column)).alias("_text"))
    r = rules.select("match_type", text.match_text(F.col("match_text")).alias("_rule"), F.upper(F.trim("model")).alias("_model")).where("_rule <> '' and _model <> ''")
    texts = keyed.select("_text").where("_text <> ''").distinct()
    exact = texts.join(r.where("match_type = 'exact'").select(F.col("_rule").alias("_text"), "_model"), "_text")
    hits = exact.unionByName(_containing(texts, r.where("match_type = 'contains'").select("_rule", "_model").distinct()))
    found = hits.groupBy("_text").agg(F.min("_model").alias("_least"), F.max("_model").alias("_most"))
    out = keyed.join(found, "_text", "left")
    agreed = F.coalesce(F.col("_least") == F.col("_most"), F.lit(True))
    return out.select(key, F.when(agreed, F.col("_least")).alias("model"), (~agreed).alias("conflict"))


def upsert_rules(rules: DataFrame) -> DataFrame:
    """Rules in their stored form; rows without id, text or model, or of another kind, are refused."""
    clean = rules.select("id", "match_type", text.match_text(F.col("match_text")).alias("match_text"), F.upper(F.trim("model")).alias("model"))
    ok = (F.col("id") != "") & (F.col("match_text") != "") & (F.col("model") != "") & F.col("match_type").isin("exact", "contains")
    return clean.where(records.require(ok, F.lit("a rule needs id, kind, text and model")))


def new_members(facts: DataFrame, dimension: DataFrame, column: str, name: str = "name") -> DataFrame:
    """Names that facts have and the dimension lacks, case and outer space ignored; one spelling each."""
    key = F.upper(F.trim(F.col(column)))
    found = facts.where(F.coalesce(F.trim(F.col(column)), F.lit("")) != "").groupBy(key.alias("_key")).agg(F.min(F.trim(column)).alias(name))
    return found.join(dimension.select(F.upper(F.trim(name)).alias("_key")), "_key", "left_anti").select(name)
