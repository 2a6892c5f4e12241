"""Connected components of an edge table, by rounds of distributed minimum propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): every node of the edges (u, v) with the smallest node it is connected with.

    A round gives each node the least label among its neighbours and itself, then the label of that label; the
    number of rounds is about logarithmic in the longest path. Each round's labels are written to the shared
    folder. Self-loops make single nodes, repeated edges count once, an edge with a null end is none; no edges make no
    rows.
    """
    edges = edges.filter("u IS NOT NULL AND v IS NOT NULL")
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), "labels"
    )
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels.node == heard.u).select(
            "node", F.col("label").alias("was"), F.least("label", "heard").alias("label")
        )
        far = near.select(F.col("node").alias("root"), F.col("label").alias("further"))
        jumped = near.join(far, near.label == far.root).select("node", "was", F.least("label", "further").alias("label"))
        made = materialise(jumped, "labels")
        if made.filter("was <> label").limit(1).count() == 0:
            return made.select("node", F.col("label").alias("component"))
        labels = made.select("node", "label")
