"""Quality rules: base statistics of texts and a learned decision list over them.

Sequential covering: rules for low quality are grown one condition at a time by information gain on two
thirds of the labelled rows, pruned from the end on the last third, and kept while they are precise
there; rows that a rule covers leave before the next is grown. The list becomes an ordered Spark
conditional expression over the statistics, so every verdict can be read.

The list is learned from about ``sample_docs`` labelled documents (a documented bound for the
classifier); statistics are taken from every whole text. Cases: null texts have no words; empty texts
fail the base rules; without labels the list is empty and the base rules decide; repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored (:func:`statistics`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import slices, utf8
from yieldloom.llm.minhash import _mix, _odd, word_hashes

SAMPLE_DOCS = 20_000
LEAST_PRECISION = 0.9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares that conditions may test.
SHARES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "distinct_share")

_WORD_END = np.zeros(256, bool)
_WORD_END[[0x20, *range(0x09, 0x0E)]] = True


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b"!?|#*$%&<>=~^")


def text_statistics(text: bytes) -> tuple:
    """The values of COUNTS, then of SHARES, for one text."""
    data = np.frombuffer(text, np.uint8)
    seen = np.bincount(data, minlength=256)
    spaces = int(seen[_WORD_END].sum())
    points = len(data) - int(seen[0x80:0xC0].sum())
    words = word_hashes(text, fold=False)
    n = len(words)
    repeated = 0
    if n > 2:
        windows = _mix(words[:-2] * _odd[0] + words[1:-1] * _odd[1] + words[2:] * _odd[2])
        _, number, count = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[number] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    lines, duplicates, known = 0, 0, set()
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in known
            known.add(line)
    chars, symbols = points - spaces, int(seen[_SYMBOL].sum())
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    one = max(1, n)
    shares = (
        chars / one,
        symbols / one,
        duplicates / max(1, lines),
        repeated / one,
        upper / max(1, upper + lower),
        int(seen[_DIGIT].sum()) / max(1, chars),
        int(seen[_MARK].sum()) / one,
        n / max(1, lines),
        len(np.unique(words)) / one,
    )
    return (n, chars, symbols, duplicates, repeated, *shares)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long) and SHARES (double) for each row of ``docs``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in COUNTS), *(T.StructField(n, T.DoubleType()) for n in SHARES)])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                cols = list(zip(*map(text_statistics, utf8(batch.column("text"))), strict=True)) or [()] * (len(COUNTS) + len(SHARES))
                kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(SHARES)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Low quality if every condition (statistic, sign, threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for name, sign, threshold in self.conditions:
            out &= values[name] >= threshold if sign == ">=" else values[name] <= threshold
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, threshold in self.conditions:
            out = out & (F.col(name) >= threshold if sign == ">=" else F.col(name) <= threshold)
        return out


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition with the largest gain among rows ``inside``."""
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    before = np.log2(p0 / (p0 + n0))
    best, choice = 0.0, None
    for name, v in values.items():
        own, is_bad = v[inside], bad[inside]
        order = np.argsort(own, kind="stable")
        own, is_bad = own[order], is_bad[order]
        cuts = np.flatnonzero(own[1:] > own[:-1]) + 1
        if not len(cuts):
            continue
        below_bad = np.cumsum(is_bad)[cuts - 1]
        middle = (own[cuts] + own[cuts - 1]) / 2
        for sign, p, n in (("<=", below_bad, cuts - below_bad), (">=", p0 - below_bad, (n0 - cuts) + below_bad)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0)
            k = int(gain.argmax())
            if gain[k] > best + 1e-9:
                best, choice = float(gain[k]), (name, sign, float(middle[k]))
    return best, choice


def decision_list(values: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = LEAST_PRECISION) -> list[Rule]:
    """Rules for ``bad`` rows by sequential covering; every third row prunes, the others grow."""
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad & ~prune).sum() >= 5:
        inside, conditions = left & ~prune, []
        while len(conditions) < most_conditions and (inside & ~bad).any():
            gain, condition = _best_condition(values, bad, inside)
            if condition is None:
                break
            conditions.append(condition)
            inside &= Rule((condition,)).holds(values)
        best, worth = None, -1.0
        for k in range(len(conditions), 0, -1):
            rule = Rule(tuple(conditions[:k]))
            hit = rule.holds(values) & left & prune
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            if p and (p - n) / (p + n) > worth + 1e-9:
                best, worth = rule, (p - n) / (p + n)
        if best is None or (worth + 1) / 2 < least_precision:
            break
        rules.append(best)
        left &= ~best.holds(values)
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """A decision list from about ``sample_docs`` rows of ``labels`` (doc_id, quality), chosen by a hash of
    the id; the driver gets the statistics of those documents."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    n = known.count()
    if not n:
        return []
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = known.where(dice < min(1.0, sample_docs / n)).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "of")
    texts = docs.join(chosen.select("of"), F.col("doc_id") == F.col("of"), "left_semi")
    rows = statistics(texts).join(chosen, F.col("doc_id") == F.col("of")).drop("of").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    rows = rows.iloc[np.random.default_rng(0).permutation(len(rows))]
    return decision_list({k: rows[k].to_numpy(float) for k in SHARES}, (rows["quality"] == 0).to_numpy())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Which rule rejects a row first (from 1), 0 if none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, rule (the one that rejects, 0 if none) for each row of ``docs``."""
    rows = statistics(docs).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
