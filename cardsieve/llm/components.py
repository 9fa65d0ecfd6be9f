"""Connected components of an edge table, by label spreading with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import keep


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the (a, b) edges; label is the least node reachable.

    Each round takes the least label among a node's neighbours and then the label of that
    label, so paths shrink by half or more; each round is written to the shared folder. A
    node with very many neighbours is only ever summed up (map-side) or joined as the many
    side of a join on the unique labels, which AQE can split. Rows with a null end and
    loops are left out; no edges give no rows.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    both = keep(edges.union(edges.select("b", "a")), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("a"), F.min("b")).alias("label")
    )
    labels = keep(labels, "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("label", "near").alias("next"), "label"
        )
        ends = labels.select(F.col("node").alias("next"), F.col("label").alias("end"))
        moved = keep(
            lower.join(ends, "next").select(
                "node", F.least("next", "end").alias("label"), F.col("label").alias("before")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels
