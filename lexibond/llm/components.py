"""Connected components of an edge table."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import lean
from lexibond.sources.work import forget, written

#: A node with more neighbours than this, and than ``SHARE`` of the edges, is a hub; so there are at most 2 / SHARE hubs.
HUB, SHARE = 100, 1e-5
#: Nodes that a task holds while it contracts its edges.
HELD = 500_000


def _star(edges: DataFrame, key: str, other: str, near: DataFrame, count: int) -> DataFrame:
    """Edges with the least neighbour of ``key``, as ``near`` says with the number of neighbours ``n``.

    Hubs' least neighbours are broadcast, 200,000 rows at most, so that a hub's edges stay where they are.
    """
    most = max(HUB, count * SHARE)
    hubs = F.broadcast(near.where(F.col("n") > most).select(key, F.col("m").alias("hub_m")))
    marked = edges.join(hubs, key, "left")
    others = marked.where("hub_m is null").select(key, other).join(near.where(F.col("n") <= most).select(key, "m"), key).select(key, other, "m")
    return others.unionByName(marked.where("hub_m is not null").select(key, other, F.col("hub_m").alias("m")))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each task joins the nodes of its own edges, and gives a star for each set.

    A task holds ``HELD`` nodes at most; beyond that it gives the stars it has and begins anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            nodes = [x for x in parent if root(x) != x]
            out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["u", "v"])
            parent.clear()
            return out

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield stars()
        yield stars()

    return edges.select("u", "v").mapInArrow(lean(run), "u bigint, v bigint")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge up, or is where edges end."""
    up = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("end"))
    ends = edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("end"))
    nodes = up.unionByName(ends).groupBy("x").agg(F.sum("up").alias("up"), F.max("end").alias("end"))
    return not nodes.agg(F.count(F.when(F.col("up") + F.col("end") > 1, 1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``u, v``: the smallest node of its component.

    Tasks contract the edges they hold. Then large-star and small-star steps by turns, until all are stars: each links a
    node's neighbours to the least of them, so the number of edges never grows, and a component of any diameter ends as
    a star after about log steps. Every step is written to the shared folder, which cuts the lineage, and the step before
    it deleted; only counts reach the driver.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(contracted(edges.where("u <> v")).distinct(), "edges")
    while not _are_stars(now):
        count = now.count()
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _star(both.where("b > a"), "a", "b", near, count).where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = written(large, "large-star")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _star(large, "u", "v", near, count).where("v <> m").select(*pair("v", "m")).unionByName(near.select("u", F.col("m").alias("v")))
        before, now = now, written(small.distinct(), "small-star")
        forget(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
