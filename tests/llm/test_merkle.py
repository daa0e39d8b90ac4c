"""Manifests against plain Python trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from yieldloom.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, subroot string, tree string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)]
    return digest("".join(fields))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def steps_of(levels, at):
    out = []
    for below in levels[:-1]:
        out.append((below[at // 3 * 3 : at // 3 * 3 + 3], at % 3))
        at //= 3
    return out


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row.source, []).append(((row.doc_id is not None, row.doc_id or 0, leaf(row, row.text)), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([k[2] for k, _ in sorted(by[s], key=lambda x: x[0])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for at, (key, row) in enumerate(sorted(by[s], key=lambda x: x[0])):
            steps = steps_of(trees[s], at) + steps_of(top, n)
            text = row.text
            if text is not None and row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf(row, text)
            for run, i in steps:
                fold = digest("".join(fold if j == i else x for j, x in enumerate(run)))
            proof = "".join(x for run, i in steps for j, x in enumerate(run) if j != i)
            out.append((row.doc_id, key[2], trees[s][-1][0], top[-1][0], digest(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    rows = merkle.manifest(docs, merkle.tampered(F.col("text")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=str)


def test_odd_rows(spark):
    """Null and repeated ids, null and empty fields, a lone leaf, a null source, repeated rows, clashing names."""
    rows = [(k, f"line\n{k}", "en", "a", k) for k in range(29)] + [(3, "line\n3", "en", "a", 3)] * 2 + [(3, "other", "en", "a", 3)]
    rows += [(None, None, None, None, None), (None, "a\nb", None, "", 0), (None, "a\nb", None, "a", 0), (5, "", None, None, 0), (6, "x\ny", "z", "ü", 3), (7, "y" * 300_000 + "\n", "z", "ü", 3)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = found(docs)
    assert got == plain(docs.collect())
    assert {r[6] for r in got} == {True, False}
    assert found(docs.limit(0)) == []


def test_many_blocks_and_verification(spark):
    """A source of many blocks beside a thousand of one row; without a change every proof holds."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.concat(F.lit("s"), "id")).alias("source"), F.lit(3).alias("n_chars"))
    assert found(rows) == plain(rows.collect())
    assert merkle.manifest(rows).where("not verified").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_one_small_source(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"))
    assert found(rows) == plain(rows.collect())
