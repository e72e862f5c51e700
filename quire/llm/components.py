"""Connected components by repeated contraction, with tables in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import forget, written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for all ends of edges (a, b: long).

    Each round points every node at its least neighbour, follows the pointers twice and contracts
    the edges; an edge from each label to where it points keeps longer chains in the graph until
    they are short. Aggregates combine before the shuffle and joins have one row a node on the
    right, so a node with many edges is split by Spark's skew handling."""
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    spark = edges.sparkSession
    known: DataFrame | None = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-up")
        hop = lambda rows, by, to, up=up: rows.join(up.select(F.col("node").alias(by), F.col("up").alias(to)), by)
        label = written(hop(up, "up", "label").select("node", "label"), "cc-hops")
        first, second = (label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_up")) for c in ("a", "b"))
        met = left.join(first, "a").join(second, "b").select("a_up", "b_up")
        chains = hop(label.select("label").distinct(), "label", "b_up").select(F.col("label").alias("a_up"), "b_up")
        rest = written(met.union(chains).where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "cc-edges")
        forget(left, up)
        left = rest
        if known is None:
            known = label
            continue
        step = label.select(F.col("node").alias("label"), F.col("label").alias("to"))
        now = written(known.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        forget(known, label)
        known = now
    forget(left)
    return known if known is not None else spark.createDataFrame([], "node long, label long")
