"""Connected components by contraction, without any list of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of 0..n-1, by edges a-b; whole arrays at a time."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def thinned(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: each run of rows keeps a spanning forest of itself."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = roots(len(ids), both[: len(u)], both[len(u) :])
            move = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[move]]), pa.array(ids[move])], names=["u", "v"])

    return edges.select("u", "v").where("u <> v").mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(v, root) of every vertex with an edge; root is the smallest id of its component.

    Each round points a vertex to its smallest neighbour if that is smaller,
    follows pointers a few steps, and contracts the edges to what they point
    to; every round at least halves the vertices that still have edges. Joins
    are on vertices against a table with one row for each.
    """
    edges = materialize(thinned(edges), gather=True)
    maps = []
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        up = materialize(up)  # its size is then known when the joins below are planned
        far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        for _ in range(jumps):
            up = up.join(far, "p").select("u", F.col("q").alias("p"))
        up = materialize(up)
        maps.append(up)
        a, b = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        edges = materialize(thinned(edges.distinct()))
    if not maps:
        return edges.select("v", F.col("u").alias("root"))
    out = maps[-1]
    for up in reversed(maps[:-1]):
        further = out.select(F.col("u").alias("p"), F.col("p").alias("q"))
        out = up.join(further, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    return out.select(F.col("u").alias("v"), F.col("p").alias("root"))
