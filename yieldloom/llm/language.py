"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted over labelled texts and then
frozen. A byte that a context has seen costs -log2(count / (total + distinct)); otherwise the escape,
-log2(distinct / (total + distinct)), is paid and the next shorter context asked, down to a uniform
order -1 (method C). A text's code length under each language gives the posterior, under equal priors.
ASCII letters are lower-cased; all 256 bytes are symbols, whatever the script.

As the trees are frozen, the exact cost of each seen run of three or four bytes, escapes included, is worked
out once and looked up: tables have a row for each run seen in the sample, in any language, not for each
possible one.

Labels are taken from a sample of about ``sample_docs`` documents a language (a documented bound for the
classifier); every text is predicted, whole. Cases: null texts and texts without a letter are ``und``
with score 0; without labelled texts all are; ties go to the first language by name; repeated rows are
scored alike; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import fresh, slices, tidy, utf8

SAMPLE_DOCS = 800
MAX_LANGUAGES = 500
UNKNOWN = "und"
_STEP = 1 << 18


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts in one array, three line feeds before each; and where each begins."""
    data = np.frombuffer(b"".join(b"\n\n\n" + t.lower() for t in texts), np.uint8)
    return data, np.cumsum([0, *(len(t) + 3 for t in texts[:-1])])


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram (four bytes as a number), n over all texts of ``docs``; summed within tasks first."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            contents = utf8(batch.column("text"))
            for lang in sorted(set(langs)):
                data, starts = _joined([contents[k] for k in np.flatnonzero(langs == lang)])
                data = data.astype(np.uint32)
                grams = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
                pads = (starts[:, None] + np.arange(3) - 3).ravel()
                inside = np.ones(len(grams), bool)
                inside[pads[(pads >= 0) & (pads < len(grams))]] = False
                found, n = np.unique(grams[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Rows:
    """Places of numbers in a sorted array, -1 for those it lacks: a small table of the frequent ones,
    addressed by a hash, and binary search for the rest."""

    def __init__(self, numbers: np.ndarray, weight: np.ndarray):
        self.numbers = numbers
        self.bits = max(8, int(2 * len(numbers)).bit_length())
        self.table = np.zeros(1 << self.bits, np.int32)
        order = np.argsort(weight, kind="stable")  # the last one to write a slot is the most frequent
        self.table[self._slot(numbers[order])] = order

    def _slot(self, wanted: np.ndarray) -> np.ndarray:
        return ((wanted.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.numbers):
            return np.full(len(wanted), -1, np.int32)
        at = self.table[self._slot(wanted)]
        other = np.flatnonzero(self.numbers[at] != wanted)
        if len(other):
            sought = wanted[other]
            place = np.minimum(np.searchsorted(self.numbers, sought), len(self.numbers) - 1).astype(np.int32)
            at[other] = np.where(self.numbers[place] == sought, place, -1)
        return at


class ContextTrees:
    """Frozen statistics of all languages: seen runs of four and of three bytes, their costs, and what
    escapes cost (a row each, a column for each language)."""

    def __init__(self, langs: list[str], of: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = langs
        runs4, runs3 = np.unique(grams), np.unique(np.append(grams >> 8, grams & 0xFFFFFF))
        size = len(langs)
        self.cost4 = np.zeros((len(runs4), size), np.float32)
        self.cost3 = np.zeros((len(runs3), size), np.float32)
        self.escape3 = np.zeros((len(runs3), size), np.float32)  # of contexts of three bytes
        self.cost2 = np.zeros((1 << 16, size), np.float32)
        self.escape2 = np.zeros((1 << 16, size), np.float32)
        weight4, weight3 = np.zeros(len(runs4)), np.zeros(len(runs3))
        for k in range(size):
            c4 = np.bincount(np.searchsorted(runs4, grams[of == k]), weights=counts[of == k], minlength=len(runs4))
            c3 = np.bincount(np.searchsorted(runs3, runs4 & 0xFFFFFF), weights=c4, minlength=len(runs3))
            c2 = np.bincount(runs3 & 0xFFFF, weights=c3, minlength=1 << 16)
            c1 = c2.reshape(256, 256).sum(0)
            cost1, _ = self._order(c1, np.zeros(256, int), np.full(256, 8.0), 1)
            cost2, _ = self._order(c2, np.arange(1 << 16) >> 8, np.tile(cost1, 256), 256)
            cost3, escape2 = self._order(c3, runs3 >> 8, cost2[runs3 & 0xFFFF], 1 << 16)
            context = np.searchsorted(runs3, runs4 >> 8)
            cost4, escape3 = self._order(c4, context, cost3[np.searchsorted(runs3, runs4 & 0xFFFFFF)], len(runs3))
            self.cost2[:, k], self.escape2[:, k] = cost2, escape2
            self.cost3[:, k], self.escape3[:, k], self.cost4[:, k] = cost3, escape3, cost4
            weight4, weight3 = weight4 + c4, weight3 + c3
        self.rows4, self.rows3 = _Rows(runs4, weight4), _Rows(runs3, weight3)

    @staticmethod
    def _order(counts: np.ndarray, context: np.ndarray, lower: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """Costs of the runs of one order, and what an escape costs in each of its contexts (nothing in
        one that was never seen), given what the runs cost in the next lower order."""
        total = np.bincount(context, weights=counts, minlength=contexts)
        distinct = np.bincount(context[counts > 0], minlength=contexts)
        with np.errstate(divide="ignore", invalid="ignore"):
            own = -np.log2(counts / (total + distinct)[context])
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
        return np.where(counts > 0, own, escape[context] + lower), escape

    def _costs(self, run: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of four bytes after the three before it."""
        at = self.rows4.find(run)
        cost = self.cost4[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            run = run[new]
            at = self.rows3.find(run & 0xFFFFFF)
            cost[new] = np.where((at >= 0)[:, None], self.cost3[at], self.escape2[run >> 8 & 0xFFFF] + self.cost2[run & 0xFFFF])
            context = self.rows3.find(run >> 8)
            cost[new] += np.where((context >= 0)[:, None], self.escape3[context], 0)
        return cost

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data, starts = _joined(texts)
        bits = np.zeros((len(texts), len(self.langs)))
        owner_end = np.append(starts[1:], len(data))
        for low in range(3, len(data), _STEP):
            high = min(len(data), low + _STEP)
            s = data[low - 3 : high].astype(np.int64)
            cost = self._costs(s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:])
            first = np.searchsorted(owner_end, low, side="right")
            last = np.searchsorted(starts, high, side="left")
            begins = np.maximum(starts[first:last], low)
            pads = (starts[first:last, None] + np.arange(3)).ravel() - low
            cost[pads[(pads >= 0) & (pads < high - low)]] = 0
            bits[first:last] += np.add.reduceat(cost, begins - low, axis=0, dtype=np.float64)
        return bits

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text, and its posterior."""
        bits = self.code_lengths(texts)
        best = bits.argmin(1)
        with np.errstate(over="ignore"):
            odds = np.exp2(-(bits - bits.min(1, keepdims=True)))
        return best, 1 / odds.sum(1)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ContextTrees | None:
    """Trees of the languages of ``labelled`` (doc_id, text, lang), from about ``sample_docs`` documents
    of each, chosen by a hash of the id. The driver gets the counts of distinct four-byte runs of that
    sample. None if there is no labelled text."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return None
    share = F.create_map(*[F.lit(v) for r in found for v in (r["lang"], min(1.0, sample_docs / r["n"]))])
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    counts = gram_counts(labelled.where(dice < F.element_at(share, F.col("lang")))).toPandas()
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique())
    of = counts["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy()
    return ContextTrees(langs, of, counts["gram"].to_numpy(), counts["n"].to_numpy())


_HAS_LETTER = r"\p{L}"


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(_HAS_LETTER), F.lit(False))


def detect(docs: DataFrame, trees: ContextTrees | None, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a predicted language and its posterior (0 to 1)."""
    if trees is None:
        return docs.withColumns({prediction: F.lit(UNKNOWN), score: F.lit(0.0)})
    letter = fresh("has_letter", [*docs.columns, prediction, score])
    frozen = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        own = frozen.value
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                if not batch.num_rows:
                    continue
                best, posterior = own.predict(utf8(batch.column("text")))
                ok = batch.column(letter).to_pylist()
                langs = [own.langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
                kept = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != letter]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(np.where(ok, posterior, 0.0), pa.float64())], schema.names)

    return docs.withColumn(letter, has_letter(F.col("text"))).mapInArrow(tidy(run), schema)
