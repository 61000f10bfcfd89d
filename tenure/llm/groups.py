"""Linking inside candidate buckets without pairing everyone with everyone.

A bucket holds nodes that might be linked.  Its hub is its most connected
member; each node is offered to its most frequent hub only, so a group of m
copies makes m candidate pairs.  Verified links form components.  Only buckets
that then still hold several components are looked at again: nodes that
provably have no link outside their component leave, and the others meet
across components.  No link between components is lost, and none inside a
component is looked for.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.session import stage_shared


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the connected component of every node that has an edge, from edges (a, b).

    Each round every node takes the smallest node of its neighbourhood as its label, and the graph
    shrinks to the edges between different labels, until none are left.  Node ids are hashes, so a
    round removes a constant share of the nodes in expectation.  Rounds are written tables.
    """
    mapping = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stage_shared(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
            "node", F.least("node", "b").alias("label")), "labels")
        if mapping is None:
            mapping = step
        else:
            later = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            mapping = stage_shared(mapping.join(later, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")), "labels")
        a = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        b = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stage_shared(edges.join(a, "a").join(b, "b").where("la <> lb").select(
            F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return mapping


def offers(members: DataFrame) -> DataFrame:
    """Pairs (a, b): every node of ``members`` (bucket, node, k members) with its most frequent hub."""
    weight = members.groupBy("node").agg(F.sum("k").alias("weight"))
    weighted = stage_shared(members.select("bucket", "node").join(weight, "node"), "weighted")
    hubs = weighted.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    offered = weighted.join(hubs, "bucket").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("k"))
    return stage_shared(offered.groupBy("node").agg(F.max_by("hub", F.struct("k", "hub")).alias("b")).select(
        F.col("node").alias("a"), "b"), "offers")


def mixed_only(members: DataFrame, *more: Column) -> DataFrame:
    """The members of buckets that hold several components, with further aggregates of each bucket."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *more).where("lo <> hi")
    return members.join(mixed.drop("lo", "hi"), "bucket")


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], leave: Callable[[DataFrame], DataFrame],
         across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect every component of the candidates in ``members`` (bucket, node, k, ...).

    ``verify`` returns the true links among pairs; ``leave`` returns labelled members of mixed buckets
    without those that can have no link across, maybe with further columns; ``across`` returns links
    (all, or enough to connect what is connected) between members of one bucket with different labels.
    """
    edges = stage_shared(verify(offers(members)), "links")
    labelled = stage_shared(members.join(components(edges), "node", "left").withColumn(
        "label", F.coalesce("label", "node")), "labelled")
    rest = stage_shared(mixed_only(leave(labelled)), "mixed")
    return edges.unionByName(stage_shared(across(rest), "late_links"))


def across_blocks(rest: DataFrame, held: DataFrame, size: Column, most: int,
                  run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on groups of ``rest``'s members, each with its row of ``held`` (node, ...).

    Buckets are cut by a hash of the node into blocks whose members' ``size`` adds up to about ``most``;
    every pair of blocks of a bucket (i, j; a node's own is ``block``) is one group.  So what a task
    holds is bounded whatever the bucket's size, and ``run`` returns links, not pairs.
    """
    weight = rest.groupBy("bucket").agg(F.ceil(F.sum(size) / F.lit(most)).cast("int").alias("blocks"))
    block = rest.join(weight, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
    return dealt.join(held, "node").groupBy("bucket", "i", "j").applyInArrow(run, schema)
