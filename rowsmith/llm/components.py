"""Connected components by repeated contraction of a links table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.shared import written

#: Links that one task finishes once the rounds have left no more.
TAIL = 20_000


def finished(links: DataFrame) -> DataFrame:
    """a, to: the smallest node of each component, for at most TAIL links, in one task."""

    def run(batches):
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for t in batches:
            for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
        nodes = list(parent)
        if nodes:
            yield pa.RecordBatch.from_pydict({"a": pa.array(nodes, pa.int64()), "to": pa.array([top(x) for x in nodes], pa.int64())})

    return links.select("a", "b").coalesce(1).mapInArrow(run, "a long, to long")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the undirected links (a, b); one root per component.

    In each round every node joins its first neighbour (or stays), in the order
    of the ids and of fresh hashes by turns, and the links are renamed. Stars
    around a small id vanish in one round and long chains lose a fixed share of
    their nodes in each, so the rounds grow with the logarithm of the nodes.
    """
    links = written(links.where("a <> b").distinct())
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root"))
    turn = 0
    while (left := links.count()) > 0:
        if left <= TAIL:
            moved = finished(links).select(F.col("a").alias("root"), "to")
            return labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        both = links.select("a", "b").union(links.select("b", "a"))
        first = F.min(F.struct(order("b").alias("o"), F.col("b").alias("n")))
        own = F.struct(order("a").alias("o"), F.col("a").alias("n"))
        step = both.groupBy("a").agg(first.alias("f")).select("a", F.least("f", own)["n"].alias("to"))
        step = written(step)
        renamed = (
            links.join(step, "a")
            .select(F.col("to").alias("a1"), "b")
            .join(step.select(F.col("a").alias("b"), F.col("to").alias("b1")), "b")
            .select(F.col("a1").alias("a"), F.col("b1").alias("b"))
            .where("a <> b")
            .distinct()
        )
        moved = step.select(F.col("a").alias("root"), "to")
        labels = written(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        links = written(renamed)
        turn += 1
    return labels
