"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task of a step handles, and tasks at least.
TASK_EDGES, TASKS = 500_000, 8


def _least(rows: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u, combined before the shuffle."""
    return rows.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of each node of edges (a, b); component is its smallest node,
    or, after at most so many steps, one that it is connected with.

    Alternates large-star and small-star steps until the edges form stars. A step
    joins a node's edges with the smallest of its neighbours, an aggregate that is
    stored, so that a node with very many edges is no task of its own: the join can be split. Edges with a null end or from a node to
    itself count for nothing; a node without other edges does not appear.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame, tasks: int | None = None) -> DataFrame:
        paths.append(common.scratch(spark, "links"))
        (df.coalesce(tasks) if tasks else df).write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    links = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # Steps add no edges.
    tasks = max(TASKS, -(-links.count() // TASK_EDGES))
    before, step = None, 0
    while True:
        step += 1
        # Larger neighbours move to the smallest of the node and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(kept(_least(both), tasks), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")), tasks)
        # Then the node and its smaller neighbours to the smallest of those.
        least = kept(_least(large), tasks)
        small = large.join(least, F.col("u") == F.col("k")).where("v <> m").select("v", "m")
        links = kept(least.union(small).toDF("u", "v").distinct(), tasks)
        now = before if step == most else tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        for path in paths[:-1]:
            common.drop_path(spark, path)
        del paths[:-1]
        if now == before:
            if step == most:  # an end may still have an edge of its own
                links = links.union(links.select("v", "v")).groupBy("u").agg(F.min("v").alias("v"))
                return links.toDF("node", "component")
            # Each u now has one v.
            return links.toDF("node", "component").union(links.select("v", "v").distinct())
        before = now
