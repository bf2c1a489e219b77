"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of ``bits`` bits are cut into m segments, m the whole number from bits / log2(number of distinct codes) up.
Round r probes, for each query that is still open, every value at Hamming distance r of each of
its segments. A code that differs from the query in fewer than m * (r + 1) bits differs in at
most r bits in some segment, so after round r all codes nearer than that have been met and verified. A query closes
when its kth verified distance is covered in this sense; radii grow for the others only. From the first round on that has k, the join
itself passes only codes at most as far as the query's kth so far.

Equal codes are one entry of the index, with their k smallest ids: no more of them can be among
k results. Limits per key are taken before the shuffle (row_number below a constant).

Cases: a null code is neither indexed nor a query; ties are broken by id; fewer than k rows give all
of them; repeated ids are separate rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm._spark import Scratch


def sign_code(vector: Column, bits: int = 64) -> Column:
    """A long whose bit i says that component i is above 0; null for a null vector, absent or null components give 0."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.slice(vector, 1, bits), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _cuts(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [bits * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in at) for at in combinations(range(width), radius)]


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """(query_id, rank, id, distance): the k rows of index nearest to each query in Hamming distance.

    index, queries: columns id and code (long). rank starts at 1 and orders by (distance, id).
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "hamming")
    index, queries = index.where("code is not null"), queries.where("code is not null")
    by_id = Window.partitionBy("code").orderBy("id")
    members = scratch.keep(index.select("code", "id").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k))
    codes = scratch.keep(members.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    distinct = max(2, codes.count())
    cuts = _cuts(bits, max(1, math.ceil(bits / math.log2(max(4, distinct)))))
    segment = lambda: F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _part(F.col("code"), *c).alias("val")) for j, c in enumerate(cuts)]))
    entries = scratch.keep(codes.select("code", "least", "n", segment().alias("x")).select("x.seg", "x.val", "code", "least", "n"))
    open_ = scratch.keep(queries.select("code").distinct().withColumn("bound", F.lit(bits)))
    found, done = None, []
    nearest = Window.partitionBy("q").orderBy("distance", "least")
    for radius in range(max(w for _, w in cuts) + 1):
        masks = {}
        for j, (_, width) in enumerate(cuts):
            masks.setdefault(width, (_masks(width, radius), []))[1].append(j)
        probes = None
        for flips, segs in masks.values():
            if not flips:
                continue
            one = open_.select(F.col("code").alias("q"), "bound", F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _part(F.col("code"), *cuts[j]).alias("v")) for j in segs])).alias("x"))
            one = one.select("q", "bound", "x.seg", F.explode(F.transform(F.lit(flips).cast("array<long>"), lambda m: F.col("x.v").bitwiseXOR(m))).alias("val"))
            probes = one if probes is None else probes.unionByName(one)
        probes = scratch.keep(probes)
        p, e = probes.alias("p"), entries.alias("e")
        distance = F.bit_count(F.col("p.q").bitwiseXOR(F.col("e.code")))
        near = (F.col("p.seg") == F.col("e.seg")) & (F.col("p.val") == F.col("e.val")) & (distance <= F.col("p.bound"))
        met = p.join(e, near).select("p.q", "e.code", "e.least", "e.n", distance.alias("distance"))
        if found is not None:
            met = met.unionByName(found.join(open_.select(F.col("code").alias("q")), "q", "left_semi"))
        best = scratch.keep(met.distinct().withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth"))
        covered = len(cuts) * (radius + 1) - 1
        seen = best.withColumn("ids", F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        kth = scratch.keep(seen.where(F.col("ids") >= k).groupBy(F.col("q").alias("code")).agg(F.min("distance").alias("kth")))
        closed = kth.where(F.col("kth") <= covered).select(F.col("code").alias("q"))
        still = scratch.keep(open_.join(kth, "code", "left").where(F.col("kth").isNull() | (F.col("kth") > covered)).select("code", F.coalesce("kth", "bound").cast("int").alias("bound")))
        done.append(best.join(closed, "q", "left_semi"))
        scratch.drop(probes)
        found, open_ = best, still
        if not open_.limit(1).count():
            break
    else:
        done.append(found.join(open_.select(F.col("code").alias("q")), "q", "left_semi"))
    pairs = done[0]
    for more in done[1:]:
        pairs = pairs.unionByName(more)
    rank = Window.partitionBy("q").orderBy("distance", "id")
    ranked = pairs.select("q", "code", "distance").join(members.select("code", "id"), "code").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    found = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(ranked, "q")
    return scratch.finish(found.select("query_id", "rank", "id", F.col("distance").cast("long").alias("distance")))
