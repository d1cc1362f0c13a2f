"""Connected components, for many graphs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut_lineage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, graph: Sequence[str] = ()) -> DataFrame:
    """``(graph keys, id, label)``: the label is the smallest id of the component.

    ``edges`` is ``(graph keys, src, dst)``, ``nodes`` ``(graph keys, id)``; without ``nodes`` they are the ends
    of the edges, and the first round is one sum over the edges.
    Each round every edge offers the smaller of its two labels to both ends and
    to their current labels, and then labels jump to the label of their label,
    which takes a logarithmic number of rounds.  Offers and labels are combined
    on the map side; the label table has one row per node, so a component that holds
    most nodes is only a frequent *probe* key, which AQE splits.
    """
    graph = list(graph)
    pairs = cut_lineage(edges.select(*graph, "src", "dst"))
    if nodes is None:
        ends = pairs.select(*graph, F.explode(F.array("src", "dst")).alias("id"), F.least("src", "dst").alias("label"))
        labels = cut_lineage(ends.groupBy(*graph, "id").agg(F.min("label").alias("label")))
    else:
        labels = cut_lineage(nodes.select(*graph, "id").distinct().withColumn("label", F.col("id")))
    for _ in range(MAX_ROUNDS):
        at_src = labels.select(*graph, F.col("id").alias("src"), F.col("label").alias("_ls"))
        at_dst = labels.select(*graph, F.col("id").alias("dst"), F.col("label").alias("_ld"))
        seen = pairs.join(at_src, [*graph, "src"]).join(at_dst, [*graph, "dst"]).filter(F.col("_ls") != F.col("_ld"))
        low, high = F.least("_ls", "_ld"), F.greatest("_ls", "_ld")
        offers = seen.select(*graph, F.explode(F.array("src", "dst", high)).alias("id"), F.lit(None).alias("label"), low.alias("_offer"))
        # labels and offers meet in one sum; every offer goes to a node
        both = labels.withColumn("_offer", F.lit(None)).unionByName(offers).groupBy(*graph, "id").agg(F.min("label").alias("label"), F.min("_offer").alias("_offer"))
        hooked = cut_lineage(both.select(*graph, "id", F.least("label", "_offer").alias("label"), F.col("_offer").isNotNull().alias("_moved")))
        if hooked.filter("_moved").isEmpty():
            return hooked.select(*graph, "id", "label")
        jump = hooked.select(*graph, F.col("id").alias("label"), F.col("label").alias("_up"))
        labels = cut_lineage(
            hooked.join(jump, [*graph, "label"]).select(*graph, "id", F.col("_up").alias("label"))
        )
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
