"""Connected components of an edge table, without collecting edges, nodes or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of edges (a, b); component: the smallest id it reaches.

    Alternates the two star contractions of Kiveris et al. (2014): each node links its larger
    neighbours, then its smaller ones, to the smallest that it knows. Rounds grow with the
    logarithm of the size of a component. A node's neighbours are only aggregated to a minimum and joined,
    never gathered in one row, and aggregates are written before they are joined so that
    adaptive execution can split a hot node. Loops and nulls are ignored; no edges give no rows.
    """
    e = scratch.keep(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        # large star: neighbours above u link to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: u and its neighbours below link to the smallest of those
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        new = scratch.keep(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        # done when every node above has one edge and no node is at both ends
        ends = new.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(
            new.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("low"))
        )
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
        tangled = ends.where("up > 1 or up = 1 and low = 1").limit(1).count()
        scratch.drop(e, least, large, low)
        e = new
        if not tangled:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
