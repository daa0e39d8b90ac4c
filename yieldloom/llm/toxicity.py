"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence is toxic with probability s(bias + sum of the weights of its
distinct features), s the logistic function, and a document unless all of its sentences are clean
(noisy-or): score = 1 - prod(1 - s). Only document labels train it, by gradient steps on the noisy-or likelihood with
weights that start at, and are held near, their features' log odds; and the trained sentence scores then point at the offending sentences. Features are the lower-cased words
and their beginnings of 4 to 7 letters (forms of one stem share those); a likelihood-ratio test over
labelled documents chooses them, each that passes (the sample bounds their number).

Labels are taken from about ``sample_docs`` documents (a documented bound for the classifier); every text
is scored, whole. Cases: null texts are empty, and empty texts have one empty sentence, so a score;
without labels of both kinds the score is the share of toxic labels, or 0; repeated rows are scored
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yieldloom.llm.common import slices, texts

SAMPLE_DOCS = 8_000
LEAST_DOCS, LEAST_RATIO, ODDS_SHARE = 4, 16.0, 0.7
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_MOST_WORDS = 1 << 18


def features(word: str) -> list[str]:
    """Features of a lower-cased word."""
    return [word, *(word[:k] + "*" for k in range(4, 8) if len(word) > k)]


def likelihood_ratio(a: int, b: int, toxic: int, clean: int) -> float:
    """2 log likelihood ratio of a feature in ``a`` of ``toxic`` and ``b`` of ``clean`` documents."""

    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (a + b) / (toxic + clean)
    return 2 * (part(a, toxic, a / toxic) + part(b, clean, b / clean) - part(a, toxic, p) - part(b, clean, p)) if 0 < p < 1 else 0.0


def likelihood_ratio_column(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """:func:`likelihood_ratio` of columns."""

    def part(k: Column, n: int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)

    p = (a + b) / (toxic + clean)
    ratio = 2 * (part(a, toxic, a / toxic) + part(b, clean, b / clean) - part(a, toxic, p) - part(b, clean, p))
    return F.when((p > 0) & (p < 1), ratio).otherwise(0.0)


class SentenceModel:
    """Weights of features and a bias; scores sentences and documents."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, tuple[str, ...]] = {}

    def hits(self, word: str) -> tuple[str, ...]:
        """Features of a lower-cased word that have a weight; kept for a bounded number of words."""
        if len(self.words) >= _MOST_WORDS:
            self.words.clear()
        self.words[word] = found = tuple(f for f in features(word) if f in self.weights)
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of sentences of 0.5 and more."""
        total, sentences, found = 0.0, 0, []
        known, hits = self.words, self.hits
        for m in _SENTENCE.finditer(text):
            sentences += 1
            of: set[str] = set()
            for w in _WORD.findall(m[0].lower()):
                own = known.get(w)
                if own is None:
                    own = hits(w)
                if own:
                    of.update(own)
            if of:
                z = self.bias + math.fsum(self.weights[f] for f in of)
                total += np.logaddexp(0.0, z)
                if z >= 0:
                    found.append((m.start(), m.end(), float(1 / (1 + math.exp(-z)))))
                sentences -= 1
        if not sentences and not total:
            sentences = 1
        total += sentences * math.log1p(math.exp(self.bias))
        return float(-math.expm1(-total)), found


def document_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features(w)}


def choose(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Features that stand out in toxic documents, with their log odds, from (feature, toxic documents,
    clean documents)."""
    stands_out = ((f, a, b) for f, a, b in counts if a >= LEAST_DOCS and a * clean > b * toxic and likelihood_ratio(a, b, toxic, clean) >= LEAST_RATIO)
    return {f: log_odds(a, b, toxic, clean) for f, a, b in sorted(stands_out)}


def log_odds(a: int, b: int, toxic: int, clean: int) -> float:
    return math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))


def bag(text: str, number: dict[str, int]) -> tuple[int, list[list[int]]]:
    """How many sentences have no chosen feature, and the features of each of the others."""
    plain, hits = 0, []
    for m in _SENTENCE.finditer(text):
        found = sorted({number[f] for w in set(_WORD.findall(m[0].lower())) for f in features(w) if f in number})
        if found:
            hits.append(found)
        else:
            plain += 1
    return (plain, hits) if plain or hits else (1, [])


def prior(share: float) -> SentenceModel:
    """The model without features whose score of one sentence is ``share``."""
    p = min(max(share, 0.0), 1 - 1e-6)
    return SentenceModel({}, math.log(p / (1 - p)) if p else -700.0)


def fit_bags(chosen: dict[str, float], bags: list[tuple[int, list[list[int]]]], toxic: np.ndarray, rounds: int = 300, rate: float = 0.2, decay: float = 0.2) -> SentenceModel:
    """Weights by Adam steps on the noisy-or likelihood of the documents' labels; ``decay`` pulls them to
    ODDS_SHARE of the features' log odds (``chosen``)."""
    plain = np.array([b[0] for b in bags], float)
    docs = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    sentences = [s for b in bags for s in b[1]]
    sent = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences]).astype(int)
    feat = np.array([f for s in sentences for f in s], int)
    middle = ODDS_SHARE * np.array(list(chosen.values()))
    x = np.append(middle, -7.0)
    m, v = np.zeros_like(x), np.zeros_like(x)
    y = toxic.astype(float)
    for t in range(1, rounds + 1):
        z = np.bincount(sent, weights=x[feat], minlength=len(sentences)) + x[-1]
        a = np.bincount(docs, weights=np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, x[-1])
        clean = np.exp(-a)
        da = (1 - y) - y * clean / np.maximum(1e-9, 1 - clean)
        dz = da[docs] / (1 + np.exp(-z))
        g = np.append(np.bincount(feat, weights=dz[sent], minlength=len(chosen)), dz.sum() + (da * plain).sum() / (1 + math.exp(-x[-1])))
        g = g / len(y) + decay * np.append(x[:-1] - middle, 0.0) / max(1, len(chosen))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return SentenceModel(dict(zip(chosen, x[:-1].tolist(), strict=True)), float(x[-1]))


def fit(documents: list[str], toxic: np.ndarray) -> SentenceModel:
    """A model of a few documents, in memory."""
    n1 = int(toxic.sum())
    if not 0 < n1 < len(toxic):
        return prior(n1 / len(toxic) if len(toxic) else 0.0)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(documents, toxic, strict=True):
        counts[int(label)].update(document_features(text))
    chosen = choose(((f, a, counts[0][f]) for f, a in counts[1].items()), n1, len(toxic) - n1)
    number = {f: k for k, f in enumerate(chosen)}
    return fit_bags(chosen, [bag(t, number) for t in documents], toxic)


def _counted(batches):
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                counts[label].update(document_features(text))
            names = sorted(set().union(*counts))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))], ["feature", "a", "b"])


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> SentenceModel:
    """A model from about ``sample_docs`` rows of ``labels`` (doc_id, toxic), chosen by a hash of the id.
    Features are counted and tested, and sentences reduced to those that pass, in Spark; the driver gets
    these features and the reduced sentences of the sample."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("of"), (F.col("toxic") == 1).cast("int").alias("label"))
    n = known.count()
    if not n:
        return prior(0.0)
    dice = F.pmod(F.xxhash64(F.col("of"), F.lit(10)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = known.where(dice < min(1.0, sample_docs / n)).groupBy("of").agg(F.max("label").alias("label"))
    # about sample_docs rows, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("doc_id", "text", "label")
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        return prior(n1 / (n1 + n0) if n1 + n0 else 0.0)
    counted = rows.mapInArrow(_counted, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ratio = likelihood_ratio_column(F.col("a"), F.col("b"), n1, n0)
    counted = counted.where((F.col("a") >= LEAST_DOCS) & (F.col("a") * n0 > F.col("b") * n1) & (ratio >= LEAST_RATIO))
    chosen = {r["feature"]: log_odds(r["a"], r["b"], n1, n0) for r in sorted(counted.collect())}
    number = {f: k for k, f in enumerate(chosen)}

    def reduced(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                bags = [bag(t, number) for t in texts(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([b[0] for b in bags], pa.int64()), pa.array([b[1] for b in bags], pa.list_(pa.list_(pa.int32())))], ["doc_id", "label", "plain", "hits"])

    schema = T.StructType([docs.schema["doc_id"]]).add("label", T.IntegerType()).add("plain", T.LongType()).add("hits", T.ArrayType(T.ArrayType(T.IntegerType())))
    found = sorted(rows.mapInArrow(reduced, schema).collect(), key=lambda r: (r["doc_id"], r["plain"], r["hits"]))
    return fit_bags(chosen, [(r["plain"], r["hits"]) for r in found], np.array([r["label"] == 1 for r in found]))


def score(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """doc_id, score, offending (start, end, score of sentences, in code points) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    spans = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("score", T.DoubleType()))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("offending", spans)])

    def run(batches):
        own = SentenceModel(*shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                out = [own.score(t) for t in texts(batch.column("text"))]
                found = [[{"start": s, "end": e, "score": p} for s, e, p in o[1]] for o in out]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([o[0] for o in out], pa.float64()), pa.array(found, kind)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
