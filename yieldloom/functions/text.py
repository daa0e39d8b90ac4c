"""Cleaning and classifying texts of test logs, product labels and machine messages."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NO_MODEL_NAME = "未識別機種"

#: Product codes of old labels, looked for in this order.
OLD_PRODUCT_CODES = ("RFPCB,DAF,TAROKO 14''", "RFPCB,DAF,TAROKO 14,SYNAPTICS", "MS3633-T07")

#: Models that win over any learned mapping.
CODE_OVERRIDES = {"FP-D01321BE11": "B24-ELAN", "FP-D01524BK11": "B27-ELAN"}

#: The models of known product codes.
KNOWN_MODELS = {
    "FP-D01607MB11": "TK14-Goodix",
    "FP-D01809MB11": "TK16-Goodix",
    "FP-D01630MB11": "TK14-Synaptics",
    "FP-D01831MB11": "TK16-Synaptics",
    "FP-D01608MB12": "TK14-Goodix",
    "FP-D01631MB12": "TK14-Synaptics",
    "FP-D01609MB11": "TK13-Goodix",
    "FP-D01632MB11": "TK13-Synaptics",
    "MS3633-T07": "HP-C-Deck",
    "FP-D01614MB11": "CY26-14-GOODIX",
    "FP-D01614MB12": "CY26-14-GOODIX",
    "FP-D01634MB11": "CY26-14-SYNAPTICS",
    "FP-D01634MB12": "CY26-14-SYNAPTICS",
    "FP-D01810MB11": "CY26-16-GOODIX",
    "FP-D01810MB12": "CY26-16-GOODIX",
    "FP-D01820MB11": "CY26-16-SYNAPTICS",
    "FP-D01820MB12": "CY26-16-SYNAPTICS",
    "FP-D01304BE11": "B24-GOODIX",
    "FP-D01321BE11": "B24-ELAN",
    "FP-D01524BK11": "B27-ELAN",
}

LINES = ("DAF", "FT1", "FT2", "LIGHTING", "ASSEMBLY")

#: What a log's first column may call a line, white space removed, in upper case.
LINE_ALIASES = {
    "DAF": "DAF",
    "DAF外觀檢查": "DAF",
    "FT1": "FT1",
    "功能一測試": "FT1",
    "FT2": "FT2",
    "功能二測試": "FT2",
    "LIGHTING": "LIGHTING",
    "點亮測試": "LIGHTING",
    "外觀檢查點亮測試": "LIGHTING",
    "ASSEMBLY": "ASSEMBLY",
    "輝度機": "ASSEMBLY",
    "輝度機測試": "ASSEMBLY",
}

#: Machine names by the operator number that marks them.
MACHINES = (("176", "1號機"), ("137", "2號機"))
MACHINE_LABELS = tuple(m for _, m in MACHINES)
UNKNOWN_MACHINE = "未分類機台"
MACHINE_LINES = ("DAF", "FT1")
MACHINE_MARK = "DAF熱壓投入"

SUCCESS, NG, IGNORE = "SUCCESS", "NG", "IGNORE"
MACHINE_CAUSE = "調機異常項目"
IGNORED_CAUSE = "偽異常項目"

#: Keywords of machine messages in the order in which they are tried, with category and kind.
EVENT_RULES = (
    (("取图像成功", "取圖像成功"), "生產成功", SUCCESS),
    (("出標送料超時(R)", "出標送料超時（R）"), MACHINE_CAUSE, NG),
    (("偽異常項目", "偽異常", "伪异常项目", "伪异常"), IGNORED_CAUSE, IGNORE),
    (("Mark1失敗", "Mark1失败"), "Mark點辨識失敗", NG),
    (("请手动清除", "請手動清除"), "吸取Mylar失敗", NG),
    (
        (
            "HeadC1底部影像识别失败",
            "HeadC2底部影像识别失败",
            "HeadC3底部影像识别失败",
            "HeadC4底部影像识别失败",
            "HeadC1底部影像識別失敗",
            "HeadC2底部影像識別失敗",
            "HeadC3底部影像識別失敗",
            "HeadC4底部影像識別失敗",
            "Head底部影像识别失败",
            "Head底部影像識別失敗",
        ),
        "Head底部影像識別失敗",
        NG,
    ),
    (
        (
            "錯誤軸未定位",
            "错误轴未定位",
            "軸未定位",
            "轴未定位",
            "單軸相對移動發生錯誤",
            "单轴相对移动发生错误",
            "板卡-第3軸異常",
            "板卡-第3轴异常",
            "錯誤碼2147483690",
            "错误码2147483690",
            "CZ2軸未到等待位置",
            "CZ2轴未到等待位置",
        ),
        "調機時軸未定位",
        NG,
    ),
    (("吸嘴1取板失敗", "吸嘴1取板失败", "吸嘴2取料失敗", "吸嘴2取料失败"), "產品取件失敗", NG),
    (("吸嘴3取板失敗", "吸嘴3取板失败", "吸嘴4取板失敗", "吸嘴4取板失败"), "板子取回失敗", NG),
    (("防護門開啟", "防护门开启"), "防護門開啟", NG),
    (("等待減速信號超時", "等待减速信号超时"), "減速信號超時", NG),
    (
        (
            "找Pcb目标匹配相识度低于",
            "找PCB目标匹配相识度低于",
            "找Pcb目標匹配相識度低於",
            "找PCB目標匹配相識度低於",
        ),
        "忽略",
        IGNORE,
    ),
)

_WHITE = r"[\s 　﻿]+"


def clean_text(c: Column) -> Column:
    """White space of any kind becomes one space, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), _WHITE, " "))


def normalize_text(c: Column) -> Column:
    return F.upper(clean_text(c))


def model_name(c: Column) -> Column:
    """Model name in upper case; a fixed name where it is missing."""
    return F.coalesce(F.nullif(normalize_text(c), F.lit("")), F.lit(NO_MODEL_NAME))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def match_text(c: Column) -> Column:
    """Text for rules: compatibility form (NFKC), one space for white space, upper case."""
    return normalize_text(_nfkc(F.coalesce(c.cast("string"), F.lit(""))))


def _codes(text: Column) -> Column:
    pattern = r"(?:^|(?<=[^A-Z0-9_-]))(FP-[A-Z0-9]+(?:-[A-Z0-9]+)*)(?=$|[^A-Z0-9_-])"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def _code(text: Column, codes: Column) -> Column:
    old = F.coalesce(*[F.when(F.contains(text, F.lit(code)), F.lit(code)) for code in OLD_PRODUCT_CODES], F.lit(""))
    return F.when(F.size(codes) == 1, codes[0]).when(F.size(codes) > 1, F.lit("")).otherwise(old)


def _identity(code: Column, text: Column) -> Column:
    return F.when(code != "", code).when(text.rlike("FP-[A-Z0-9]+"), F.lit("")).otherwise(text)


def product_code(c: Column) -> Column:
    """The only FP- code that stands alone in the text, '' if there are several different ones; without
    one, the first of the old codes that it contains, else ''."""
    text = normalize_text(c)
    return _code(text, _codes(text))


def product_identity(c: Column) -> Column:
    """The product code; without one the matching text, unless that mentions an FP- code."""
    return _identity(product_code(c), match_text(c))


def with_identity(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with :func:`product_identity` of ``c``, in steps: each pattern is matched once a row, whatever asks for what it finds."""
    text, codes, code, match = (f"_{name}_{part}" for part in ("text", "codes", "code", "match"))
    steps = df.withColumns({text: normalize_text(c), match: _nfkc(F.coalesce(c.cast("string"), F.lit("")))})
    steps = steps.withColumn(codes, F.when(F.contains(text, F.lit("FP-")), _codes(F.col(text))).otherwise(F.array().cast("array<string>")))
    steps = steps.withColumn(code, _code(F.col(text), F.col(codes)))
    steps = steps.withColumn(match, F.when(F.col(code) == "", normalize_text(F.col(match))))
    return steps.withColumn(name, _identity(F.col(code), F.col(match))).drop(text, codes, code, match)


def process_line(c: Column) -> Column:
    """The line that a process column names, or null."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in LINE_ALIASES.items() for v in pair]), F.replace(normalize_text(c), F.lit(" "), F.lit("")))


def known_model(code: Column) -> Column:
    """The model of a product code by the overrides, then the known models; null if unknown."""
    table = KNOWN_MODELS | CODE_OVERRIDES
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), code)


def machine_of(c: Column) -> Column:
    """The machine that an operator text names, or ''."""
    operator = F.regexp_replace(normalize_text(c), "[^A-Z0-9]", "")
    return F.coalesce(*[F.when(F.contains(operator, F.lit(k)), F.lit(m)) for k, m in MACHINES], F.lit(""))


def is_machine_ref(c: Column) -> Column:
    return F.contains(F.replace(normalize_text(c), F.lit(" "), F.lit("")), F.lit(MACHINE_MARK))


def parse_rate(c: Column) -> Column:
    """A rate with or without a percent sign; null if it is no number."""
    return F.trim(F.replace(c.cast("string"), F.lit("%"), F.lit(""))).try_cast("double")


def parse_qty(c: Column) -> Column:
    """A whole number that may have thousands commas; empty is 0, anything else null."""
    text = F.trim(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(","), F.lit("")))
    return F.when(text == "", F.lit(0)).when(text.rlike(r"^\d+$"), text.try_cast("long")).cast("long")


def aoi_side(c: Column) -> Column:
    """BOT or TOP for the process of an optical inspection, else null."""
    name = F.upper(F.regexp_replace(_nfkc(F.coalesce(c.cast("string"), F.lit(""))), _WHITE, ""))
    return F.when(name.isin("背面AOI", "BACKAOI", "BACKSIDEAOI"), F.lit("BOT")).when(name.isin("正面AOI", "FRONTAOI", "FRONTSIDEAOI"), F.lit("TOP"))


def model_side(c: Column) -> Column:
    """TOP or BOT if a model name ends in _TOP, -BOT and the like, else ''."""
    return F.upper(F.regexp_extract(c, r"(?i)[_-](TOP|BOT)$", 1))


def model_base(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)[_-](TOP|BOT)$", "")


def defect_label(line: Column, c: Column) -> Column:
    """The defect's name, or what its line calls a missing one."""
    missing = F.when(line == "FT2", F.lit("偵測失效")).otherwise(F.lit("未填寫不良原因"))
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), missing)


def event_message(c: Column) -> Column:
    return clean_text(c)


def ignored_cause(c: Column) -> Column:
    return clean_text(c).rlike("(?i)偽異常|伪异常")


def normalize_category(c: Column) -> Column:
    """A cause by its final name; null if it is empty or to be ignored."""
    text = clean_text(c)
    return (
        F.when((text == "") | ignored_cause(c), F.lit(None))
        .when(text.rlike(r"(?i)出標送料超時\s*[（(]\s*r\s*[）)]"), F.lit(MACHINE_CAUSE))
        .otherwise(text)
    )


def rule_event(message: Column, rules: Sequence[tuple[Sequence[str], str, str]] = EVENT_RULES) -> Column:
    """(type, category) by the first rule one of whose keywords the message contains, else null."""
    out = None
    for words, category, kind in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(message, F.lit(w))
        value = F.struct(F.lit(kind).alias("type"), F.lit(category).alias("category"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


_EVENT = r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s+(\d{1,2}:\d{2}:\d{2})(?:[:.]?(\d{1,6}))?\s*(.*)$"
_DAY = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$"


def parse_event_line(c: Column, fallback: Column) -> Column:
    """(date, time, message) of a line of a machine log; ``fallback`` dates lines without one. The pattern
    is matched once: its groups are joined by a control character and split again."""
    text = F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit("")))
    mark = "\u0001"

    def ymd(p: Column) -> Column:
        return F.concat_ws("-", F.get(p, F.lit(0)), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lpad(F.get(p, F.lit(2)), 2, "0"))

    def dated(p: Column) -> Column:
        fraction = F.when(p[4] != "", F.concat(F.lit(":"), p[4])).otherwise(F.lit(""))
        return F.struct(ymd(p).alias("date"), F.concat(p[3], fraction).alias("time"), F.trim(p[5]).alias("message"))

    def tabbed(p: Column) -> Column:
        day = F.split(F.regexp_replace(F.trim(p[0]), _DAY, mark.join(("$1", "$2", "$3"))), mark)
        own = F.transform(F.array(day), lambda d: F.when(F.size(d) == 3, ymd(d)).otherwise(fallback))[0]
        return F.struct(own.alias("date"), F.trim(p[1]).alias("time"), F.trim(F.array_join(F.slice(p, 3, 1 << 20), "\t")).alias("message"))

    groups = F.split(F.regexp_replace(text, _EVENT, mark.join(f"${k}" for k in range(1, 7))), mark)
    cells = F.split(text, "\t")
    plain = F.struct(fallback.alias("date"), F.lit("").alias("time"), text.alias("message"))
    kinds = F.transform(F.array(F.struct(groups.alias("g"), cells.alias("c"))), lambda x: F.when(F.size(x["g"]) == 6, dated(x["g"])).when(F.size(x["c"]) >= 3, tabbed(x["c"])).otherwise(plain))
    return F.when(text != "", kinds[0])


def hour_key(c: Column) -> Column:
    """Hour of a time of day, '00' to '23'; '' without one."""
    hour = F.regexp_extract(c, r"^(\d{1,2})", 1)
    return F.when(hour == "", F.lit("")).otherwise(F.lpad(F.least(F.lit(23), hour.try_cast("int")).cast("string"), 2, "0"))


def minute_of_day(c: Column, is_end: bool = False) -> Column:
    """Minutes since midnight of HH:mm; an end of 23:59 is the end of the day; null if invalid."""
    clock = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), F.lpad(F.regexp_extract(c, r"^(\d{1,2}:\d{2})", 1), 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    value = F.hour(clock) * 60 + F.minute(clock)
    return F.when(value == 1439, F.lit(1440)).otherwise(value) if is_end else value


def schedule_priority(schedule_id: Column, created: Column) -> Column:
    """The later of the time stamp in a schedule's id and its creation, in milliseconds."""
    stamp = F.regexp_extract(schedule_id, r"ASSY_MODEL_(\d{10,})", 1).try_cast("long")
    return F.greatest(F.coalesce(stamp, F.lit(0)), F.coalesce(created, F.lit(0)))


def sha_hex(c: Column) -> Column:
    return F.sha2(c, 256)
