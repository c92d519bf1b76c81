"""Connected components of many small-degree graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pointprep.plans.salt import salted_join
from pointprep.plans.skew import hot_row_limit
from pointprep.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "case_id", node: str = "node") -> DataFrame:
    """Smallest node id of each node's component as ``label``.

    ``edges`` has ``key``, ``src`` and ``dst`` once per undirected pair. A round takes
    the smallest label among neighbours and then the label of that label, which
    halves the remaining distance, so long chains need few rounds. Each round is
    written out, which keeps the plan short and survives lost executors.
    """
    labels = materialize(nodes.select(key, node, F.col(node).alias("label")), "labels")
    both = edges.select(key, "src", "dst").unionAll(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(both, "links")
    if both.isEmpty():
        return labels
    # No label can be carried by more nodes than there are.
    heavy = [] if labels.count() <= hot_row_limit(nodes.sparkSession) else None
    # Labels only fall, so this ends.
    while True:
        offered = (
            both.join(labels, (both[key] == labels[key]) & (both["src"] == labels[node]))
            .select(both[key].alias(key), F.col("dst").alias(node), "label")
            .groupBy(key, node)
            .agg(F.min("label").alias("__offer"))
        )
        taken = labels.join(offered, [key, node], "left").select(
            key, node, F.col("label").alias("__old"), F.least("label", F.coalesce("__offer", "label")).alias("__new")
        )
        taken = materialize(taken, "offers")
        # Only labels that have themselves moved can shorten a path.
        moved = taken.filter(F.col("__new") < F.col(node)).select(
            key, F.col(node).alias("__new"), F.col("__new").alias("__jump")
        )
        # Most nodes of a large component carry the same label.
        jumped = salted_join(taken, moved, [key, "__new"], [node], "left", hot=heavy).select(
            key, node, "__old", F.least("__new", F.coalesce("__jump", "__new")).alias("label")
        )
        jumped = materialize(jumped, "labels")
        changed = jumped.filter(F.col("label") != F.col("__old")).limit(1).count()
        labels = jumped.select(key, node, "label")
        if changed == 0:
            return labels
