"""Connected components by repeated contraction, all in DataFrames.

Each round every node takes the neighbour (or itself) of least random priority, edges are renamed to the chosen
nodes, and loops and repeats go. The number of nodes that still have edges falls by a constant factor a round
whatever the shape, chains included. Hub nodes are reduced by partial minima; joins read written tables on both
sides, so Spark may split a hub's partition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: (u, v) longs, either direction, repeats allowed. Returns (node, root) for each node that has an edge."""
    kept = Staged(spark)
    pairs = edges.where("u <> v").select("u", "v")
    live = kept.put(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    roots, turn = None, 0
    while not live.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("p"), c.alias("n"))
        chosen = live.groupBy("u").agg(F.least(F.min(rank(F.col("v"))), F.first(rank(F.col("u")))).alias("m"))
        chosen = kept.put(chosen.select("u", F.col("m.n").alias("to")), "cc-map")
        if roots is None:
            new_roots = kept.put(chosen.select(F.col("u").alias("node"), F.col("to").alias("root")), "cc-roots")
        else:
            m = chosen.select(F.col("u").alias("root"), F.col("to"))
            new_roots = kept.put(roots.join(m, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
            kept.drop(roots)
        half = kept.put(live.join(chosen, "u").select(F.col("to").alias("x"), F.col("v").alias("u")), "cc-half")
        nxt = kept.put(half.join(chosen, "u").select(F.col("x").alias("u"), F.col("to").alias("v")).where("u <> v").distinct(), "cc-edges")
        for old in (live, half, chosen):
            kept.drop(old)
        live, roots, turn = nxt, new_roots, turn + 1
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links found by one task, those that join what was apart."""
    up: dict[int, int] = {}
    keep = []
    for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[b] = a
            keep.append(i)
    return u[keep], v[keep]
