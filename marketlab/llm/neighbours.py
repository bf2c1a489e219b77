"""Embedding near-dedup by NN-descent.

A neighbour graph over distinct vectors starts from the leaves of random hyperplane trees and is
refined by neighbours-of-neighbours joins: each vector's neighbours, and those that name
it, are compared with each other. Lists hold ``k`` entries. A vector whose list holds
nothing below the threshold is saturated: its list may hide more links, within its component and to others. So
components with such a vector are cut in cells of at most about ``BLOCK`` vectors, and every vector of another component is compared
with all of a cell that its angle to the cell's centre lets it reach: linked ones make components one.
Then the lists of such a component are enlarged to the whole component, in blocks that give counts of links rather than pairs.
Recall is audited against all vectors, in blocks, on two stated sets of queries: vectors of least hash, which tell of isolated pairs, and
vectors of least hash that have a link, which tell of links that are missing beside found ones. Below the target the graph
gets as many trees again and further rounds; after the last attempt an error is raised, so no result is of lower recall.

The number of trees follows from the number of vectors: enough that two vectors at the threshold share a leaf of some tree with a
probability of 0.995, without any refinement.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are their own component; vectors of different lengths are not linked; equal vectors are one node,
linked with each other; rows of one id are vectors of their own, so repeated rows are links of each other; a null id is no component's name unless it has
no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm._graph import components
from marketlab.llm._spark import Scratch

LEAF = 64
BLOCK = 400  # vectors of a cell
SIDE = 4096  # vectors of a block whose links are counted
ATTEMPTS = 6
CELLS = 8192  # centres that are broadcast at a time


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _leaf_keys(trees: list[int], bits: int):
    """For each vector and tree, the sides of ``bits`` random hyperplanes as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(1).take(pa.array(rows)))
                for tree in trees:
                    planes = np.random.default_rng([tree, int(dim)]).standard_normal((int(dim), bits))
                    key = ((x @ planes) > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(rows), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[rows]), pa.array(np.full(len(rows), tree, np.int32)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(key.astype(np.int64))],
                        ["id", "tree", "dim", "leaf"],
                    )

    return run


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> pa.Table:
    np.fill_diagonal(sims, -2.0)
    take = min(k, len(ids) - 1)
    at = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    u = np.repeat(ids, take)
    return pa.table({"u": u, "v": ids[at.ravel()], "sim": np.take_along_axis(sims, at, 1).ravel()})


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _leaf_pairs(k: int):
    def run(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return _EDGES.empty_table()
        x = _matrix(t["x"])
        return _best(t["id"].to_numpy(), x @ x.T, k)

    return run


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each list; keep what beats the worst entry of either list."""
    for batch in batches:
        near = batch.column(0)
        inner = near.values
        offsets = near.offsets.to_numpy()
        ids = inner.field("id").to_numpy()
        worst = inner.field("worst").to_numpy(zero_copy_only=False)
        lists = inner.field("x")
        u, v, s = [], [], []
        for k in range(len(near)):
            a, b = int(offsets[k]), int(offsets[k + 1])
            if b - a < 2:
                continue
            x = _matrix(lists.slice(a, b - a))
            sims = x @ x.T
            i, j = np.nonzero(np.triu(sims > np.minimum(worst[a:b, None], worst[None, a:b]), 1))
            u.append(ids[a + i])
            v.append(ids[a + j])
            s.append(sims[i, j])
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays([cat(u, np.int64), cat(v, np.int64), cat(s, np.float64)], schema=_EDGES)


def _block_counts(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        ids, side, size = t["id"].to_numpy(), t["side"].to_numpy(), t["size"].to_numpy()
        x = _matrix(t["x"])
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        both = bool((side == 2).any())
        of, back = np.zeros(len(left)), np.zeros(len(right))
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            hit = (x[rows] @ x[right].T) >= threshold
            hit &= ids[rows][:, None] != ids[right][None, :]
            of[lo : lo + 512] = hit @ size[right].astype(np.float64)
            if both:
                back += size[rows].astype(np.float64) @ hit
        out_ids, out = [ids[left]], [of]
        if both:
            out_ids.append(ids[right])
            out.append(back)
        return pa.table({"id": np.concatenate(out_ids), "links": np.concatenate(out).astype(np.int64)})

    return run


def _cell(t: pa.Table) -> pa.Table:
    """The centre of a cell and the largest angle of its members to it."""
    x = _matrix(t["x"])
    centre = x.mean(axis=0)
    length = np.sqrt(centre @ centre)
    centre = centre / length if length > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1.0, 1.0)).max())
    return pa.table({"component": t["component"][:1], "cell": t["cell"][:1], "dim": t["dim"][:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius]})


def _reached(cells: dict[int, tuple[np.ndarray, ...]], threshold: float):
    """Cells of other components that may hold a link of a vector: those not further than their radius and the angle of a link.

    Two crowded components meet once, from the one of the larger id.
    """
    link = math.acos(max(-1.0, min(1.0, threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            comps, crowded = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                if int(dim) not in cells:
                    continue
                of, number, centres, radii = cells[int(dim)]
                # 1e-6: the rounding of arccos near 1
                least = np.where(radii + link + 1e-6 >= math.pi, -2.0, np.cos(np.minimum(radii + link + 1e-6, math.pi)))
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), 512):
                    part = rows[lo : lo + 512]
                    x = _matrix(batch.column(1).take(pa.array(part)))
                    near = x @ centres.T >= least - 1e-12
                    near &= np.where(crowded[part][:, None], comps[part][:, None] > of[None, :], comps[part][:, None] != of[None, :])
                    i, j = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part[i]]), pa.array(of[j]), pa.array(number[j])], ["id", "component", "cell"])

    return run


def _bridges(threshold: float):
    """For each vector that reaches a cell, its nearest link there, if any."""

    def run(t: pa.Table) -> pa.Table:
        ids, guest = t["id"].to_numpy(), t["guest"].to_numpy()
        out, own = np.flatnonzero(guest), np.flatnonzero(~guest)
        if not len(out):
            return pa.table({"u": ids[:0], "v": ids[:0]})
        x = _matrix(t["x"])
        sims = x[out] @ x[own].T
        at = sims.argmax(axis=1)
        hit = np.flatnonzero(sims[np.arange(len(out)), at] >= threshold)
        return pa.table({"u": ids[out[hit]], "v": ids[own[at[hit]]]})

    return run


def _audit(queries: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """True links of the query vectors, ids and unit vectors for each length: (query, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in queries:
                    continue
                ids, asked = queries[int(dim)]
                rows = np.flatnonzero(dims == dim)
                own = batch.column(0).to_numpy()[rows]
                hit = asked @ _matrix(batch.column(1).take(pa.array(rows))).T >= threshold
                hit &= ids[:, None] != own[None, :]
                i, j = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j])], ["u", "v"])

    return run


def trees_for(threshold: float, bits: int, target: float = 0.995) -> int:
    """Trees of ``bits`` hyperplanes of which two vectors of cosine ``threshold`` share a leaf of one or more with a probability of ``target``."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if together >= target else math.ceil(math.log(1 - target) / math.log1p(-together))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    k: int = 10,
    trees: int | None = None,
    most_rounds: int = 4,
    audit: int = 200,
    target: float = 0.99,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    audited: list | None = None,
) -> DataFrame:
    """(id_col, n_links, component_id, kept): links of cosine >= threshold, in double precision; one row for each row of vectors.

    audit: the number of query vectors of each of the two sets whose links are
    counted against all vectors; while the graph has less than ``target`` of them and
    fewer than ATTEMPTS attempts were made, it gets as many trees again; after the last an error is raised. trees: by default trees_for().
    audited: gets (links asked for, links found) of each attempt.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    good = F.coalesce(F.col("x").isNotNull() & ~bad & (norm > 0), F.lit(False))
    marked = src.withColumn("good", good)
    # equal vectors share a key of fixed size; a hot one is aggregated before the shuffle
    key = F.unhex(F.sha2(F.to_json(F.col("x").cast("array<double>")), 256)).alias("key")
    keyed = marked.where("good").select("id", key)
    # numbers are fixed once the table is written
    groups = marked.where("good").select("id", key, "x").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("x").alias("x"))
    groups = scratch.keep(groups.select(F.monotonically_increasing_id().alias("node"), "key", "rep", "size", "x"))
    nodes = groups.select(F.col("node").alias("id"), "x", F.size("x").alias("dim"), "size")
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    trees = trees_for(threshold, bits) if trees is None else trees
    some = lambda df: df.orderBy(F.xxhash64("x"), "id").limit(audit).select("id", "x", "dim").toPandas()
    sample = some(nodes)
    nearest = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    best = lambda df: df.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth")

    def grouped(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links both ways, components, and the members of those with a full list of links, which are compared whole."""
        links = scratch.keep(found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        comps = scratch.keep(components(links.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
        full = links.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        crowded = scratch.keep(
            comps.join(full.select(F.col("u").alias("id")), "id", "left_semi").select("component").distinct()
            .join(comps, "component").groupBy("component").agg(F.count("*").alias("members"))
        )
        return links, comps, scratch.keep(comps.join(crowded, "component"))

    def between(comps: DataFrame, inside: DataFrame) -> DataFrame | None:
        """Links (u, v) of vectors to crowded components other than their own: one for each vector and cell that have any."""
        cell = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).cast("int")
        members = scratch.keep(inside.select("id", "component", cell.alias("cell")).join(nodes.select("id", "x", "dim"), "id"))
        cells = scratch.keep(members.groupBy("component", "cell").applyInArrow(_cell, "component long, cell int, dim int, centre array<double>, radius double"))
        n_cells = cells.count()
        if not n_cells:
            return None
        seen = scratch.keep(
            nodes.select("id", "x", "dim").join(comps, "id", "left").join(inside.select("id", F.lit(True).alias("crowded")), "id", "left")
            .select("id", "x", "dim", F.coalesce("component", "id").alias("component"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
        )
        reach = None
        chunks = math.ceil(n_cells / CELLS)
        for chunk in range(chunks):
            got = cells.where(F.expr(f"pmod(xxhash64(component, cell), {chunks}) = {chunk}")).toPandas()
            by_dim = {
                int(dim): (g["component"].to_numpy(np.int64), g["cell"].to_numpy(np.int32), np.array(g["centre"].tolist(), np.float64), g["radius"].to_numpy(np.float64))
                for dim, g in got.groupby("dim")
            }
            found = scratch.keep(seen.mapInArrow(_reached(by_dim, threshold), "id long, component long, cell int"))
            reach = found if reach is None else reach.unionByName(found)
        # a cell that many reach is compared in parts
        parts = scratch.keep(reach.groupBy("component", "cell").agg(F.ceil(F.count("*") / (4.0 * BLOCK)).cast("int").alias("parts")))
        guests = (
            reach.join(parts, ["component", "cell"]).select("id", "component", "cell", F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part"))
            .join(nodes.select("id", "x"), "id").select("id", "component", "cell", "part", "x", F.lit(True).alias("guest"))
        )
        hosts = members.join(parts, ["component", "cell"]).select("id", "component", "cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "x", F.lit(False).alias("guest"))
        out = scratch.keep(guests.unionByName(hosts).groupBy("component", "cell", "part").applyInArrow(_bridges(threshold), "u long, v long"))
        scratch.drop(members, cells, seen)
        return out

    graph = None
    for attempt in range(ATTEMPTS):
        keys = nodes.mapInArrow(_leaf_keys(list(range(attempt * trees, (attempt + 1) * trees)), bits), "id long, tree int, dim int, leaf long")
        keys = scratch.keep(keys)
        sizes = scratch.keep(keys.groupBy("tree", "dim", "leaf").agg(F.ceil(F.count("*") / (4.0 * LEAF)).alias("parts")))
        dealt = keys.join(sizes, ["tree", "dim", "leaf"]).select("id", "tree", "dim", "leaf", F.expr("pmod(xxhash64(id, tree), parts)").alias("part"))
        pairs = dealt.join(nodes.select("id", "x"), "id").groupBy("tree", "dim", "leaf", "part").applyInArrow(_leaf_pairs(k), "u long, v long, sim double")
        graph = scratch.keep(best(pairs if graph is None else pairs.unionByName(graph)))
        for _ in range(most_rounds):
            worst = graph.groupBy("u").agg(F.min("sim").alias("low"), F.count("*").alias("have"))
            worst = worst.select(F.col("u").alias("id"), F.when(F.col("have") < k, F.lit(-1.0)).otherwise(F.col("low")).alias("worst"))
            members = nodes.select("id", "x").join(worst, "id")
            named = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
            back = graph.withColumn("nth", F.row_number().over(named)).where(F.col("nth") <= k)
            edges = graph.select(F.col("u").alias("hub"), F.col("v").alias("id")).unionByName(back.select(F.col("v").alias("hub"), F.col("u").alias("id"))).distinct()
            lists = edges.join(members, "id").groupBy("hub").agg(F.collect_list(F.struct("id", "worst", "x")).alias("near")).select("near")
            new = lists.mapInArrow(_local_joins, "u long, v long, sim double")
            both = new.unionByName(new.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).unionByName(graph)
            newer = scratch.keep(best(both))
            moved = newer.where(F.col("sim") >= threshold).join(graph, ["u", "v"], "left_anti").count()
            scratch.drop(graph)
            graph = newer
            if not moved:
                break
        links = graph.where(F.col("sim") >= threshold).select("u", "v")
        links, comps, inside = grouped(links)
        # links that lists hide lead from a crowded component to another one as well
        bridges = between(comps, inside)
        if bridges is not None and bridges.limit(1).count():
            links, comps, inside = grouped(links.unionByName(bridges))
        asked = pd.concat([sample, some(nodes.join(links.select(F.col("u").alias("id")), "id", "left_semi"))]).drop_duplicates("id")
        if not len(asked):
            break
        by_dim = {}
        for dim, group in asked.groupby("dim"):
            x = np.array(group["x"].tolist(), dtype=np.float64)
            by_dim[int(dim)] = group["id"].to_numpy(np.int64), x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        true = scratch.keep(nodes.select("id", "x", "dim").mapInArrow(_audit(by_dim, threshold), "u long, v long"))
        missed = true.join(links, ["u", "v"], "left_anti")
        # links inside a crowded component are all met by its blocks
        by_u = inside.select(F.col("id").alias("u"), F.col("component").alias("cu"))
        by_v = inside.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        missed = missed.join(by_u, "u", "left").join(by_v, "v", "left").where("cu is null or cv is null or cu <> cv").count()
        total = true.count()
        recall = 1.0 if not total else 1 - missed / total
        if audited is not None:
            audited.append((total, total - missed))
        if recall >= target:
            break
        if attempt == ATTEMPTS - 1:
            raise RuntimeError(f"the graph holds {total - missed} of {total} audited links ({recall:.4f}), less than {target}")
    # node's own block with every other: (i, j), i <= j; blocks of SIDE, so a vector of a component of n is sent n / SIDE times
    inside = inside.withColumn("blocks", F.ceil(F.col("members") / SIDE).cast("int"))
    own = F.expr("cast(pmod(xxhash64(id), blocks) as int)")
    placed = inside.select("id", "component", "blocks", own.alias("b")).select(
        "id", "component", F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(b, o) as i, greatest(b, o) as j, cast(case when b = o then 0 when b < o then 1 else 2 end as int) as side))")).alias("p")
    )
    counts = (
        placed.select("id", "component", "p.i", "p.j", "p.side")
        .join(nodes.select("id", "x", "size"), "id")
        .groupBy("component", "i", "j")
        .applyInArrow(_block_counts(threshold), "id long, links long")
    )
    single = (
        links.join(inside.select(F.col("id").alias("u")), "u", "left_anti")
        .join(nodes.select(F.col("id").alias("v"), "size"), "v")
        .select(F.col("u").alias("id"), F.col("size").alias("links"))
    )
    linked = counts.unionByName(single).groupBy("id").agg(F.sum("links").alias("links"))
    per_node = (
        groups.select("key", "node", "rep", "size").join(linked.withColumnRenamed("id", "node"), "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left")
        .select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    per_node = scratch.keep(per_node)
    named = per_node.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_key = scratch.keep(per_node.join(named, "component").select("key", "n_links", "component_id"))
    keyed_all = keyed.join(per_key, "key").select("id", "n_links", "component_id")
    return scratch.finish(
        keyed_all.unionByName(marked.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
        .select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
