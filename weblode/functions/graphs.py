"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each node of a batch to the smallest node that it reaches within the batch."""
    for batch in batches:
        parent: dict[int, int] = {}

        def top(node: int) -> int:
            path = []
            while parent.setdefault(node, node) != node:
                path.append(node)
                node = parent[node]
            for seen in path:
                parent[seen] = node
            return node

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(top, nodes)), pa.int64())], names=["a", "b"])


def component_labels(links: DataFrame, workdir: str | None = None) -> DataFrame:
    """Smallest node that each node of ``links`` (a, b: long) reaches: (node, label).

    Links are contracted: in a round each node points to its smallest neighbour, pointers are followed twice, and links between what they
    lead to remain.  A round more than halves the nodes that still have links, so rounds grow with the logarithm of their number.
    """
    left = staged(links.mapInArrow(_spanning, "a long, b long").distinct().filter("a != b"), workdir, "links")
    labels = staged(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), workdir, "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), workdir, "up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = staged(up.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("top")), workdir, "jump")
        to = lambda name: jump.select(F.col("node").alias(name), F.col("top").alias(f"{name}_top"))
        labels = staged(
            labels.join(to("label"), "label", "left").select("node", F.coalesce("label_top", "label").alias("label")), workdir, "labels"
        )
        left = staged(
            left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
            .mapInArrow(_spanning, "a long, b long").distinct().filter("a != b"),
            workdir, "links",
        )
    return labels
