"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.llm.common import written


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): component is the smallest node reachable; nodes without links don't appear.

    Each round only groups by node with partial aggregation and joins on it; the driver sees a row count and a
    checksum of the links. Every round is written to the shared folder. Null ends and self links are ignored.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = written(links.where("u is not null and v is not null and u <> v").select(u.alias("u"), v.alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("b")))
        low = both.groupBy("n").agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(low, "n").where("b > n").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
