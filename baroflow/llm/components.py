"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every node in ``edges(a, b)``.

    Labels spread to neighbours and then jump to their label's label, so that the number of
    rounds grows with the logarithm of a component's diameter. Each round's labels are
    written to the shared folder, which cuts the lineage. A node with very many edges is
    aggregated before it is shuffled; nothing but a count comes to the driver. Self-loops,
    repeated and reversed edges do no harm; an empty table gives no rows.
    """
    both = stage(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a is not null and b is not null").distinct(),
        "edges",
    )
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    labels = stage(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "id", "left").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        labels = stage(
            spread.join(jump, "component", "left").select("id", "was", F.least("component", "beyond").alias("component")),
            "labels",
        )
        if labels.where("component < was").isEmpty():
            return labels.select("id", "component")
