"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import checkpoint, hot_keys, spread_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of each node's component. links: pairs of comparable nodes.

    Each round takes the smallest root among the neighbours' and then the root's root, and ends when
    nothing changes; the round's result is checkpointed, so that no lineage grows. Nodes with many links are
    pre-aggregated before the shuffle, and what a node with many links or many nodes' common root has to say
    is sent to their rows, so that no group is collected.

    Defined results: links with a null end, and of a node to itself, are no links; repeated links count once;
    nodes without a link are not there; an empty table gives an empty result; other columns are ignored.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    both = checkpoint(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hubs = hot_keys(both, ["v"])
    roots = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = spread_join(both, roots.select(F.col("node").alias("v"), "root"), ["v"], hot=hubs).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = checkpoint(roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low")))
        # a root that has a smaller neighbour passes it on to all nodes below it
        passed = hooked.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("passed"))
        lowered = hooked.join(passed, "node", "left").select("node", F.col("root").alias("was"), F.least("low", F.coalesce("passed", "low")).alias("root"))
        lowered = checkpoint(lowered)
        jump = lowered.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = checkpoint(spread_join(lowered, jump, ["root"], "left", hot_keys(lowered, ["root"])).select("node", "was", F.coalesce("over", "root").alias("root")))
        if new.where("root != was").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
