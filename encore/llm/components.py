"""Connected components of a link table, as repeated joins.

Every node takes the smallest label among its neighbours' labels, then labels are followed to their
own labels (pointer jumping), until nothing changes. Each round is written to the shared folder, so
the lineage stays short and both sides of the next join are plain tables: a node with very many
links is an oversized partition that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import compact
from encore.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, component) for each linked node.

    ``component`` is the smallest node that links lead to. Links to oneself, repeated links and
    either direction are all right; links with a null end are ignored. No links give no rows.
    """
    links = links.select("a", "b").filter("a <> b")
    both = compact(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                   "links")
    # The first round needs no join: the smallest neighbour.
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        offered = both.join(
            labels.select(F.col("node").alias("b"), F.col("label").alias("offer")), "b"
        ).groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        nearer = materialise(
            labels.join(offered, "node").select(
                "node", F.col("label").alias("before"), F.least("label", "offer").alias("label")),
            "labels")
        jumped = materialise(
            nearer.join(
                nearer.select(F.col("node").alias("label"), F.col("label").alias("further")), "label"
            ).select("node", F.least("label", "further").alias("label"), "before"), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> before").isEmpty():
            return labels.withColumnRenamed("label", "component")
