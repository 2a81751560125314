"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pivotlake.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b): label is the least node of the component.

    A round takes the least label among a node and its neighbours, then the label of
    that label. Each round is written to the shared folder; rounds end when no label
    changes. A node with very many neighbours is one row of a combining aggregate.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("lower"))
        above = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = lower.join(above, F.col("lower") == F.col("at")).select("node", F.least("lower", "above").alias("label"), F.col("label").alias("before"))
        jumped = stored(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label != before").isEmpty():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of :func:`components` after more ``edges`` (a, b): only components that these
    join are gone through again."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    known = stored(labels.select("node", "label").union(new), "labels")
    of = lambda end: known.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("a_label != b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    above = components(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return stored(known.join(above, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")
