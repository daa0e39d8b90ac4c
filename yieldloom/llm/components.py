"""Connected components of an edge table, by contraction, minimum labels and pointer jumping.

Cases: an edge with a null end is none; loops and repeated edges change nothing; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import materialize

CONTRACTIONS = 2


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """id and label: the smallest of an id and its neighbours."""
    both = edges.union(edges.select("dst", "src"))
    return both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "id")


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels, and the edges between different labels: ids of a star become one, so few edges are left.
    Whatever was connected stays so, as an id and its label share an edge, which is contracted too."""
    labels = materialize(_least_neighbour(edges))
    a, b = (labels.select(F.col("id").alias(f"of_{x}"), F.col("label").alias(x)) for x in ("a", "b"))
    named = edges.join(a, F.col("src") == F.col("of_a")).join(b, F.col("dst") == F.col("of_b")).where("a <> b")
    return labels, materialize(named.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())


def _propagate(edges: DataFrame) -> DataFrame:
    """id and component of each id: labels move over edges and along themselves, so that the distance to
    the smallest halves each round, until none changes."""
    both = materialize(edges.union(edges.select("dst", "src")).distinct())
    labels = materialize(_least_neighbour(both))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.src).select("id", "label", F.least("label", "near").alias("next"))
        ahead = labels.select(F.col("id").alias("of"), F.col("label").alias("further"))
        step = step.join(ahead, F.col("next") == F.col("of")).select("id", F.least("next", "further").alias("label"), F.col("label").alias("was"))
        labels = materialize(step)
        if not labels.where("label <> was").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) for each id of ``edges`` (src, dst; either direction, repeats and
    loops allowed). Labels and edges stay in Spark; each round is written to the shared folder, and the
    driver sees only whether any edge is left or any label has changed."""
    edges = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    levels = []
    while len(levels) < CONTRACTIONS and (not levels or edges.limit(1).count()):
        labels, edges = _contract(edges)
        levels.append(labels)
    found = _propagate(edges) if edges.limit(1).count() else edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    for labels in reversed(levels):
        above = found.select(F.col("id").alias("of"), "component")
        found = labels.join(above, F.col("label") == F.col("of"), "left").select("id", F.coalesce("component", "label").alias("component"))
    return found
