"""Connected components of a distributed edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import drop_saved, save


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach.

    Alternating large-star and small-star steps: each keeps connectivity and hangs
    nodes on smaller ones, until every node hangs on the smallest of its component.
    Edges that are so from the start take no step.
    Every step is written to the shared folder. Minima are pre-aggregated before
    the shuffle, so a node with very many links doesn't gather them in one task.
    """
    now = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            # Every node hangs on one smaller node, which hangs on none.
            out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._logspark_path = now._logspark_path
            return out
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        drop_saved(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = save(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_saved(large)
    raise RuntimeError("components did not settle")


def components_any_style(edges: DataFrame, a: str = "a", b: str = "b", in_one_task: int = 1_000_000) -> DataFrame:
    """As :func:`components`; up to ``in_one_task`` edges (some 100 MB of a worker's memory) one task joins by union-find.

    Beyond that the alternating stars do, with the same result: this only saves many small stages.
    """
    spark = edges.sparkSession
    ship(spark)
    kept = save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b"), "edges")
    if kept.count() > in_one_task:
        return components(kept)

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p] if p in parent else p
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["node", "component"])

    return save(kept.coalesce(1).mapInArrow(run, "node bigint, component bigint"), "components")
