"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of the links (a, b) but the smallest of each component, which is the label.

    Self-links and nulls are ignored; no links give no rows. Each step is a sum-like aggregation and a join on
    its key, written out so that no lineage grows; the driver sees a count and a checksum.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(pairs, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, a table of minima is a side that adaptive execution can join to a hot node's rows in parts.
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(low.hint("merge"), "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = written(small, "edges")
        before, state = state, _state(small)
        for done in (edges, least, large, low):
            forget(done)
        edges = small
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
