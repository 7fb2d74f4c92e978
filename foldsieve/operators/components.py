"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsieve.session import work_table

MOST_ROUNDS = 100
#: Edges that one task joins in memory: some 100 MB with their nodes. More take rounds over all executors.
FEW = 1 << 20


def smallest_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node of each one's component: roots hook to smaller roots, paths are halved."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        open_edges = p != q
        if not open_edges.any():
            return nodes, nodes[root]
        x, y, p, q = (v[open_edges] for v in (x, y, p, q))
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
            types = held[0].schema.field(0).type
            for at in range(0, len((found := smallest_members(a, b))[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(f[at : at + (1 << 16)], types) for f in found], names=["node", "component"])

    return work_table(edges.select("a", "b").coalesce(1).mapInArrow(run, schema), "labels")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node of each component, for nodes that have an edge.

    Rounds of taking the smallest label among neighbours, each followed by a
    jump to the label's own label, so that chains close in about the logarithm
    of their length. Labels are tables in the shared folder; a hot node's
    neighbours are reduced by partial minima before they meet. Up to FEW edges,
    by count, are joined in the memory of one task instead, with the same result.
    """
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a <> b").distinct()
    pairs = work_table(pairs, "edges")
    if pairs.count() <= FEW:
        return _in_one_task(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = work_table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")
        )
        lower = work_table(lower, "lower")
        target = lower.select(F.col("node").alias("t"), F.col("c").alias("jumped"))
        after = lower.join(target, lower["c"] == target["t"], "left").select(
            "node", "old", F.least("c", F.coalesce("jumped", "c")).alias("c")
        )
        after = work_table(after, "labels")
        labels = after.select("node", "c")
        if after.where("old <> c").limit(1).count() == 0:
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError("the components did not settle")
