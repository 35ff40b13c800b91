"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import common

#: Links from which on a node is a hub, whose links are dealt to SALTS tasks.
HUB_LINKS, SALTS = 2000, 16


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of the links (a, b); both are longs, none is null.

    Every round each node takes the least label among its own and its neighbours', then the label of that label, so
    chains halve; it ends when no label changes. A node's neighbours are only aggregated, never gathered. Links of hubs are
    salted; labels are looked up under several salts as well, among the labels that are still to move: of a large component
    most nodes have its final label, which is none of these."""
    both = common.settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    nodes = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component"), (F.count("*") > HUB_LINKS).alias("hub")).withColumnRenamed("a", "node")
    labels = common.settle(nodes)
    hubs = labels.where("hub").select(F.col("node").alias("b"), F.lit(True).alias("_hub"))
    edges = both
    hub_count = hubs.limit(common.HOT_KEYS + 1).count()
    salted = 0 < hub_count <= common.HOT_KEYS
    if salted:  # beyond that there are so many hubs that none of them fills a task
        marked = both.join(F.broadcast(hubs), "b", "left")
        edges = common.settle(marked.select("a", "b", F.when(F.col("_hub"), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).alias("salt")))
    salts = lambda many: F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt")
    while True:
        if salted:
            near = edges.join(labels.select(F.col("node").alias("b"), "component", salts(F.col("hub"))), ["b", "salt"])
        else:
            near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_least"))
        taken = labels.join(near, "node").select("node", "hub", F.col("component").alias("_old"), F.least("component", "_least").alias("_new"))
        moving = labels.where("node <> component").select(F.col("node").alias("_new"), F.col("component").alias("_of"), salts(F.lit(True)))
        jumped = taken.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(moving, ["_new", "salt"], "left")
        label = F.least("_new", F.coalesce("_of", "_new"))
        after = common.settle(jumped.select("node", "hub", label.alias("component"), (label < F.col("_old")).alias("_moved")))
        labels = after.drop("_moved")
        if not after.where("_moved").limit(1).count():
            return labels.drop("hub")
