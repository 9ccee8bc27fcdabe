"""Connected components by joins: smallest labels spread over links, with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import scratch, stored

#: Links (16 bytes each) up to which the driver joins them itself.
FEW = 250_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links a - b, and a node of its component, the same for all of the component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        parent[find(x)] = find(y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


@scratch()
def components(links: DataFrame, order: DataFrame, few: int = FEW) -> DataFrame:
    """Stored (node, comp) for every node of ``links`` (a, b); comp is the struct (rank, node) of its component's first node.

    order: (node, rank) of every node; nodes come in the order of their rank, then their number.
    Each round a node takes the least label among its neighbours, then the label of that
    label. Rounds end when nothing changes; the number of rounds grows about as the logarithm
    of the longest path. All of it is joins and pre-aggregated groups; hubs are split by AQE.
    Up to ``few`` links are joined by the driver instead, as each round has several shuffles.
    """
    if links.limit(few + 1).count() <= few:
        pairs = links.select("a", "b").toArrow()
        nodes, roots = labels_of(pairs["a"].to_numpy(), pairs["b"].to_numpy())
        known = links.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots})).join(order, "node")
        first = known.groupBy("root").agg(F.min(F.struct("rank", "node")).alias("comp"))
        return stored(known.select("node", "root").join(first, "root").select("node", "comp"), "components", outlive=True)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(both.select(F.col("a").alias("node")).distinct().join(order, "node").select("node", F.struct("rank", "node").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        took = labels.join(near, "node").select("node", F.least("comp", "near").alias("took"), F.col("comp").alias("was"))
        roots = labels.select(F.col("node").alias("root_node"), F.col("comp").alias("root"))
        jumped = took.join(roots, F.col("took.node") == F.col("root_node")).select("node", F.least("took", "root").alias("comp"), "was")
        jumped = stored(jumped, "labels")
        changed = jumped.filter("comp != was").limit(1).count()
        labels = jumped.select("node", "comp")
        if not changed:
            return stored(labels, "components", outlive=True)
