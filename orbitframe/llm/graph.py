"""Connected components of links, by contraction of least-neighbour forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (a node of the component, the same for all of it) for every node that has a link.

    Each node points to its least neighbour, or to itself if that is less. These pointers are a
    forest; doubling them takes as many steps as the logarithm of its depth and touches nodes alone,
    never links. Then each link moves to the roots of its ends, and links within a tree are gone.
    A tree has two nodes at least, so the nodes that still have links halve with each pass: a star
    of any size is done after one. Least neighbours are pre-aggregated, tables are written between
    jobs, and nothing is gathered on the driver but whether links or changes are left.
    """
    spark = links.sparkSession
    ends = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v")
    edges, edges_at = scratch.written(ends.distinct(), "links")
    passes: list[tuple[DataFrame, str]] = []
    while edges.limit(1).count():
        both = edges.union(edges.select("v", "u"))
        roots, at = scratch.written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")), "roots")
        while True:
            up = roots.select(F.col("u").alias("root"), F.col("root").alias("top")).filter("root <> top")
            step = roots.join(up, "root", "left").select("u", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
            new, new_at = scratch.written(step, "roots")
            scratch.drop(spark, at)
            roots, at = new.select("u", "root"), new_at
            if not new.filter("moved").limit(1).count():
                break
        low = roots.select("u", F.col("root").alias("ru"))
        high = roots.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        rest = edges.join(low, "u").join(high, "v").filter("ru <> rv")
        left, left_at = scratch.written(rest.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        scratch.drop(spark, edges_at)
        edges, edges_at = left, left_at
        passes.append((roots, at))
    scratch.drop(spark, edges_at)
    if not passes:
        return links.select(F.col(a).alias("node"), F.col(a).alias("comp")).filter(F.lit(False))
    named = passes[-1][0]
    for roots, _ in passes[-2::-1]:
        after = named.select(F.col("u").alias("root"), F.col("root").alias("last"))
        named = roots.join(after, "root", "left").select("u", F.coalesce("last", "root").alias("root"))
    if len(passes) > 1:
        named, _ = scratch.written(named, "components")
        scratch.drop(spark, *(at for _, at in passes))
    return named.select(F.col("u").alias("node"), F.col("root").alias("comp"))
