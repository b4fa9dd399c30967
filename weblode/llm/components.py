"""Connected components of a table of links, by joins; nothing of the graph reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by links of each node to the smallest node it reaches within the batch."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of each node of ``links`` (a long, b long): (node, component).

    Labels take the smallest label among neighbours and then jump to that label's own label, until nothing changes.
    """
    edges = stored(links.mapInArrow(_forest, "a long, b long").distinct().filter("a != b"), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        top = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = stored(
            lower.join(top, "component").select("node", "old", F.least("component", "top").alias("component")), "labels"
        )
        changed = not new.filter("old != component").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
