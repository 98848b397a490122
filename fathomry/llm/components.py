"""Connected components of a link table, by merging labels and jumping over parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

MAX_ROUNDS = 60
#: A label of more than this part of all nodes is a hub; at most so many labels are hubs.
HUBS = 2000
#: Rows of a hub that one task takes, about.
HUB_ROWS = 64


def _jump(least: DataFrame) -> DataFrame:
    """(node, label, moved): each node's label m replaced by m's own label, if it has one.

    Labels that stand at many nodes are few by their definition (``HUBS`` at most), so they
    are broadcast with the number of salts that their nodes are dealt over.
    """
    most = least.groupBy("m").agg(F.count(F.lit(1)).alias("c"))
    floor = max(HUB_ROWS, least.count() // HUBS)
    hubs = F.broadcast(most.where(F.col("c") > floor).select("m", F.ceil(F.col("c") / floor).cast("int").alias("salts")))
    up = least.select(F.col("node").alias("m"), F.col("m").alias("mm")).join(hubs, "m", "left")
    up = up.select("m", "mm", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("node"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = least.join(hubs, "m", "left").select("node", "m", salt.alias("salt"))
    return dealt.join(up, ["m", "salt"], "left").select("node", F.coalesce("mm", "m").alias("label"), F.col("mm").isNotNull().alias("moved"))


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node that isn't itself the least of its component.

    ``links`` has columns (node, label), both long, label < node.  Each round a node keeps
    the least of its labels, the labels that lose are linked to it, and every node takes its
    label's own label; chains halve each round.  Labels are pre-aggregated before the
    shuffle, the nodes of a hub are dealt over salts (``_jump``), and each round's table is
    written to the shared folder, so that neither a hub nor the loss of an executor stops
    it.  Nothing is collected but counts.
    """
    pairs = scratch(links.select("node", "label").distinct(), f"{name}-0")
    for k in range(1, MAX_ROUNDS):
        least = scratch(pairs.groupBy("node").agg(F.min("label").alias("m")), f"{name}-{k}-least")
        jumped = _jump(least)
        merged = (
            pairs.join(least, "node")
            .where("label != m")
            .select(F.col("label").alias("node"), F.col("m").alias("label"), F.lit(True).alias("moved"))
        )
        new = scratch(jumped.unionByName(merged).groupBy("node", "label").agg(F.max("moved").alias("moved")), f"{name}-{k}")
        pairs = new.select("node", "label")
        if new.where("moved").isEmpty():
            return pairs.withColumnRenamed("label", "root")
    raise RuntimeError(f"{name}: components didn't settle in {MAX_ROUNDS} rounds")
