"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component: smallest id reachable.

    In each round every vertex points to the smallest label of its neighbours and
    itself, edges are rewritten through these pointers, and loops and repeats go.
    Labels are hashed anew before each round (``xxhash64`` of a long is one to one),
    so that the order is a random one and chains shrink like everything else: by a
    constant factor a round in expectation. Everything stays in tables: aggregates
    have map-side partials, and joins on a hub can be split.
    """
    label = F.xxhash64
    edges = edges.select("a", "b").where("a <> b")
    mapping = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", label("id"))
    edges, written = edges.select(label("a").alias("a"), label("b").alias("b")), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        pointer = materialise(pointer.select(F.col("a").alias("v"), "to"), "pointer")
        mapping = mapping.join(pointer.withColumnRenamed("v", "label"), "label", "left")
        mapping = mapping.select("id", label(F.coalesce("to", "label")).alias("label"))
        for end, to in (("a", "x"), ("b", "y")):
            edges = edges.join(pointer.withColumnsRenamed({"v": end, "to": to}), end)
        edges = edges.where("x <> y").select(label(F.least("x", "y")).alias("a"), label(F.greatest("x", "y")).alias("b")).distinct()
        edges = materialise(edges, "edges")
        written += [pointer, edges]
        if edges.isEmpty():
            break
    mapping = materialise(mapping, "mapping")
    smallest = mapping.groupBy("label").agg(F.min("id").alias("component"))
    out = materialise(mapping.join(smallest, "label").select("id", "component"), "components")  # no edges at all: no rows
    discard(mapping, *written)
    return out
