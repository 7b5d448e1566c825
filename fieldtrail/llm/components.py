"""Distributed connected components: nodes point to their least neighbour, and edges are drawn anew between the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrail.llm.common import stage, unstage


def _roots(pointers: DataFrame) -> DataFrame:
    """``pointers`` (node, component), a staged table of trees, followed to their roots by doubling."""
    while True:
        up = pointers.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = stage(pointers.select("node", "component").join(up, "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("component")).alias("moved")))
        unstage(pointers)
        pointers = jumped
        if jumped.where("moved").isEmpty():
            return jumped


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each end of an edge; the component is its least node. Null ends, loops and repeats are ignored.

    Each round every node points to the least of itself and its neighbours, and edges go to the roots of the trees that this
    makes; those inside a tree are done with, so an edge is gone through again only while its ends are apart. Nothing gathers a
    component or a node's neighbours in one place: edges meet roots in joins that can be split, and minima are combined
    before the shuffle. Edges and roots are written to the shared folder each round. The result is a staged table.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    apart, labels = stage(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), None
    while True:
        both = apart.unionByName(apart.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = _roots(stage(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component"))))
        root = lambda k: roots.select(F.col("node").alias(k), F.col("component").alias(f"{k}_root"))
        drawn = apart.join(root("u"), "u").join(root("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        drawn = stage(drawn.where("u <> v").distinct())
        unstage(apart)
        if labels is None:
            labels = stage(roots.select("node", "component"))
        else:
            higher = labels.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
            now = stage(higher.select("node", F.coalesce("root", "component").alias("component")))
            unstage(labels)
            labels = now
        unstage(roots)
        apart = drawn
        if apart.isEmpty():
            unstage(apart)
            return labels


def merged(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels``, as from components(), after more edges: only what these join is gone through again. The result is a staged table."""
    at = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"{k}_component"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    joined = components(ends.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")))
    new = joined.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    lower = joined.select(F.col("node").alias("component"), F.col("component").alias("lower"))
    out = stage(labels.select("node", "component").unionByName(new).join(lower, "component", "left").select("node", F.coalesce("lower", "component").alias("component")))
    unstage(joined)
    return out
