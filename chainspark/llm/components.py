"""Connected components of a link table by star contraction, in written rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspark.session import cut_lineage


def _forest(batches):
    """Replace the links of a batch by one link from each node to the smallest it reaches there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def _round(edges: DataFrame) -> DataFrame:
    """Large star, then small star, on links u > v."""
    # large star: neighbours above a node go to the smallest in its neighbourhood
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .where("u <> v").distinct())
    # small star: a node and its smaller neighbours go to the smallest of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True when every node has one link down, to a node without any."""
    centres = edges.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
    per = edges.groupBy("u").count().join(centres, "u", "left")
    return per.where("count > 1 OR centre").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b: bigint); component: its smallest node.

    Links are first contracted inside each batch of a task. Then rounds of large star and small
    star (each node passes its neighbours to the smallest one) run until only stars are left,
    about the logarithm of the longest path. A round needs minima with map-side combine and joins,
    whose hot centres are what adaptive execution splits; its result is written. Nothing of the
    links reaches the driver. Null ends and loops link nothing; an empty table gives an empty table.
    """
    edges = cut_lineage(links.select(F.col("a").cast("bigint").alias("u"), F.col("b").cast("bigint").alias("v"))
                        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                        .mapInArrow(_forest, "u bigint, v bigint").distinct())  # u > v throughout
    while not _is_forest_of_stars(edges):
        edges = cut_lineage(_round(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
