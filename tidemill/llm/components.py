"""Connected components of an edge table: by alternating large-star and small-star rounds, few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stage_table


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each vertex's neighbours to the least of its neighbourhood.

    The least is pre-aggregated, so a hub's rows meet in a join that adaptive execution can split
    and never as one group.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


#: So many edges, 16 MB, are joined by one task: rounds of jobs would take longer.
FEW_EDGES = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the least vertex that each reaches: roots hook onto lesser ones until none is left."""
    vertices, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(vertices))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return vertices, vertices[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (up := root[root]).tobytes() == root.tobytes():
            root = up


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[x.to_numpy() for x in batch.columns] for batch in batches if batch.num_rows]
        if columns:
            vertex, component = joined(*(np.concatenate(c) for c in zip(*columns)))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(component)], names=["vertex", "component"])

    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    return ends.coalesce(1).mapInArrow(run, "vertex long, component long")


def connected_components(edges: DataFrame, rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """(vertex, component): the least vertex reachable.  edges: integer columns a and b, any direction.

    Vertices without edges aren't returned; self-loops and repeated edges are ignored; edges with a
    null end are dropped.  Every round writes its edges to the shared folder, so no lineage grows.
    """
    spark = edges.sparkSession
    now = stage_table(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if 0 < sums[0] <= few:
            return _in_one_task(now)
        if sums[0] == 0 or sums == state:
            break
        state = sums
        step = stage_table(_stars(_stars(now, True), False), "edges")
        drop_tables(spark, now)
        now = step
    stars = now.select(F.greatest("a", "b").alias("vertex"), F.least("a", "b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("vertex"), "component").distinct())
