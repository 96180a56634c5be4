"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.plans.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(u, v)``; label is the least node.

    Each round takes the least label of the neighbours and then follows labels one
    step (label of the label), so chains halve.  Every round is written to the
    shared folder: lineage stays short and a lost executor costs no round.  Only
    the number of changed labels comes to the driver.  An empty edge table gives an
    empty result; loops (u = v) and repeated edges change nothing.
    """
    both = written(
        edges.select("u", "v")
        .union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        .distinct(),
        "cc-edges",
    )
    # the first round needs no join: a node's label starts as its least neighbour
    labels = written(
        both.groupBy(F.col("u").alias("node")).agg(
            F.least(F.min("v"), F.first("u")).alias("label")
        ),
        "cc-labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(
            stepped.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("next", "label")).alias("label")
            ),
            "cc-labels",
        )
        changed = labels.filter(F.col("old") != F.col("label")).count()
        labels = labels.drop("old")
        if not changed:
            return labels
