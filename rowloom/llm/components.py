"""Connected components: of links within a task, and of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import stored

#: Nodes (16 bytes each) whose labels are broadcast.
BROADCAST_ROWS = 1_000_000


def merge_links(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows a and b of ids as a forest of (id, id of the root)."""
    root = np.arange(len(ids))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (src, dst); label is the smallest node reached.

    Rounds of hooking and shortcutting on labels: each node's parent takes the
    smallest grandparent seen over its links, so the number of rounds grows with
    the logarithm of the longest chain. Only counts leave the executors. Labels
    are broadcast up to BROADCAST_ROWS nodes; beyond, a component's root, which
    many rows meet, is a skewed key that joins of stored rows are split by.
    """
    both = links.select("src", "dst").union(links.select("dst", "src")).toDF("src", "dst").where("src <> dst").distinct()
    links = stored(both)
    labels = stored(links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    few = labels.count() <= BROADCAST_ROWS
    met = F.broadcast if few else (lambda df: df)
    while True:
        parents = labels.select(F.col("node").alias("p"), F.col("label").alias("grand"))
        seen = labels.join(met(parents), F.col("label") == F.col("p")).select("node", "label", "grand")
        over = links.join(met(seen.select(F.col("node").alias("dst"), "grand")), "dst").groupBy("src").agg(F.min("grand").alias("low"))
        hooked = over.join(met(seen), F.col("node") == F.col("src")).select("node", "label", "grand", "low")
        offers = hooked.select(F.explode(F.array(F.struct("node", F.least("label", "grand", "low").alias("label")), F.struct(F.col("label").alias("node"), F.least("grand", "low").alias("label")))).alias("o")).select("o.node", "o.label")
        after = stored(offers.groupBy("node").agg(F.min("label").alias("label")))
        changed = after.join(met(labels.withColumnRenamed("label", "old")), "node").where("label <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
