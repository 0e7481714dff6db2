"""Connected components of small ids by propagation of least labels, written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.sources.scratch import dropped, written


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: nodes (id) that edges (a, b) connect share the least of their ids.

    A round gives each label the least label that an edge of its nodes leads to, and then each node its label's
    label, so a chain takes rounds by the logarithm of its length. The driver sees a count a round.
    """
    labels = written(nodes.select("id", F.col("id").alias("label")), "labels")
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    while True:
        at = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: E731, B023
        seen = both.join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b")
        lower = written(seen.where("b_label < a_label").groupBy(F.col("a_label").alias("label")).agg(F.min("b_label").alias("to")), "hooks")
        if not lower.head(1):
            break
        hooked = labels.join(lower.hint("merge"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        # The label of a node's label is looked up in the same pass: both sides are small steps from written tables.
        up = hooked.where("id <> label").select(F.col("id").alias("label"), F.col("label").alias("to"))
        hooked = hooked.join(up.hint("merge"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        before, labels = labels, written(hooked, "labels")
        for done in (before, lower):
            dropped(done)
    return labels
