"""Connected components of an edge table: blocks are contracted within tasks, what is left by rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import Scratch

#: Edges that one task contracts at most, on average.
BLOCK_EDGES = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # Roots take the least label next to them, then every node its root's.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract_block(batches):
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        nodes, labels = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """node and label (the least node of its component) of every node that has an edge. ``edges`` has columns a and b, a written table.

    Edges are dealt into blocks of bounded size; each becomes stars around its
    components' least nodes. One block is the answer. Several are joined in
    rounds: a node takes the least label of its neighbours and then the label
    of its label, so long chains close in about as many rounds as their length
    has binary digits. Each round is written to the shared folder.
    """
    blocks = max(1, -(-edges.count() // block_edges))
    stars = scratch.table(edges.select("a", "b").repartition(blocks).mapInArrow(_contract_block, "a long, b long"), "stars")
    if blocks == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    both = scratch.table(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("met"))
        up = labels.select(F.col("node").alias("met"), F.col("label").alias("up"))
        following = scratch.table(met.join(up, "met").select("node", F.least("met", "up").alias("label"), (F.least("met", "up") != F.col("old")).alias("moved")), "labels")
        moved = following.filter("moved").limit(1).count()
        scratch.drop(labels)
        labels = following.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
