"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). A
pattern offers its words once, and again for each repetition at a rising cost; each source asks for its
quota. The min-cost flow from patterns to sources says how many words each pattern gives, so
repetition is spread where it costs least. A source that shares no document with another has one pattern, whose flow is its quota; those
are solved where they are, as rows, however many there are. Patterns of overlapping sources go to the driver, which augments many paths at once.
Documents are then selected by seeded hash.

Every document of a pattern is taken floor(give / size) times; those with the least hashes once
more, up to the remainder. The cut is found by radix descent over the hash: per pattern and
bucket only sums are aggregated, three times 256 buckets, so no pattern's documents are sorted
or gathered, however large the pattern is.

The driver holds the patterns of overlapping sources: at most ``most_patterns``, an error beyond.

Cases: an empty or null source set takes part in no quota and is never taken; a null source is a source of its own, last in order; a null
or blank text has size 0 and taken 0; repeated rows are documents, those of one id taken equally often;
an empty table gives an empty result; columns of any names are carried on, but a column named like one of the result gives way to it.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm._spark import Scratch

#: Times that a document can be taken, and so times a source's size that its target can reach.
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
_BITS, _DEPTH = 8, 3
_RANGES = 256  # ranges of source names that are numbered apart
RESULT = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text: Column) -> Column:
    """Number of runs other than U+0020 and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[float], repeats: int = REPEATS) -> list[dict[int, float]]:
    """Words that each pattern gives to each of its sources, at the least cost.

    The nth time that a pattern's words are taken costs n - 1 for each word. Only edges from the start have a cost, so a path costs what
    its first edge does, and successive shortest paths are maximum flows in turn, each continuing the one before with one more
    repetition admitted. Each is found by blocking flows over shortest paths, which augment all paths of a length together. Flows are real numbers.
    """
    n, m = len(sizes), len(quotas)
    slack = 1e-9 * max(1.0, sum(quotas))
    flow: list[dict[int, float]] = [dict.fromkeys(dict.fromkeys(s), 0.0) for s in members]
    givers: list[list[int]] = [[] for _ in range(m)]
    for p, own in enumerate(flow):
        for s in own:
            givers[s].append(p)
    given, taken = [0.0] * n, [0.0] * m
    for time in range(1, repeats + 1):
        while True:
            # levels of patterns and sources from the patterns that have words left
            of_pattern = [0 if time * sizes[p] - given[p] > slack else -1 for p in range(n)]
            of_source = [-1] * m
            queue, last = deque((p, True) for p in range(n) if of_pattern[p] == 0), None
            while queue:
                at, pattern = queue.popleft()
                if pattern:
                    level = of_pattern[at] + 1
                    if last is not None and level > last:
                        break
                    for s in flow[at]:
                        if of_source[s] < 0:
                            of_source[s] = level
                            if quotas[s] - taken[s] > slack:
                                last = level
                            queue.append((s, False))
                else:
                    level = of_source[at] + 1
                    for p in givers[at]:
                        if of_pattern[p] < 0 and flow[p][at] > slack:
                            of_pattern[p] = level
                            queue.append((p, True))
            if last is None:
                break
            # a blocking flow: each edge is tried once
            out_p, out_s = [iter(f) for f in flow], [iter(g) for g in givers]
            ahead: list = [next(i, None) for i in out_p]
            back: list = [next(i, None) for i in out_s]
            for begin in range(n):
                while of_pattern[begin] == 0 and time * sizes[begin] - given[begin] > slack and ahead[begin] is not None:
                    path = [begin]  # pattern, source, pattern, source, ...
                    while path:
                        if len(path) % 2:
                            p = path[-1]
                            while ahead[p] is not None and of_source[ahead[p]] != of_pattern[p] + 1:
                                ahead[p] = next(out_p[p], None)
                            if ahead[p] is None:
                                path.pop()
                                if path:
                                    s = path[-1]
                                    back[s] = next(out_s[s], None)
                                continue
                            path.append(ahead[p])
                        else:
                            s = path[-1]
                            if quotas[s] - taken[s] > slack:
                                break
                            while back[s] is not None and (of_pattern[back[s]] != of_source[s] + 1 or flow[back[s]][s] <= slack):
                                back[s] = next(out_s[s], None)
                            if back[s] is None:
                                path.pop()
                                p = path[-1]
                                ahead[p] = next(out_p[p], None)
                                continue
                            path.append(back[s])
                    if not path:
                        break
                    undone = [flow[path[i + 1]][path[i]] for i in range(1, len(path) - 1, 2)]
                    room = min(time * sizes[begin] - given[begin], quotas[path[-1]] - taken[path[-1]], *undone)
                    given[begin] += room
                    taken[path[-1]] += room
                    for i in range(0, len(path), 2):
                        flow[path[i]][path[i + 1]] += room
                    for i in range(1, len(path) - 1, 2):
                        flow[path[i + 1]][path[i]] -= room
    return [{s: f for s, f in own.items() if f > 0} for own in flow]


def _numbered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources with nth, their place in the order of code points, null last: places in ranges, and the counts of the ranges before."""
    last = F.col("source").isNull()
    ranged = scratch.keep(sources.repartitionByRange(_RANGES, last, "source").withColumn("range", F.spark_partition_id()))
    counts = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # at most _RANGES rows
    before, so_far = [], 0
    for r in sorted(counts):
        before.append((r, so_far))
        so_far += counts[r]
    small = F.broadcast(sources.sparkSession.createDataFrame(before, "range int, before long"))  # at most _RANGES rows
    place = F.row_number().over(Window.partitionBy("range").orderBy(last, "source"))
    return ranged.join(small, "range").withColumn("nth", F.col("before") + place - 1).drop("range", "before")


def share(sources: DataFrame, weights: Sequence[float], total: int, scratch: Scratch, most: float = REPEATS) -> DataFrame:
    """sources (source, own, ...) with target: total by weight, each at most ``most`` times own; the excess is shared again by weight.

    What a unit of weight gets only rises from round to round, so a source that is capped once stays so, and each round is two sums.
    """
    parts = F.array(*[F.lit(float(w)) for w in weights])
    weighed = scratch.keep(_numbered(sources, scratch).withColumn("weight", F.element_at(parts, (F.col("nth") % len(weights) + 1).cast("int"))))
    unit, capped = None, -1
    while True:
        over = F.lit(False) if unit is None else F.col("weight") * unit > most * F.col("own")
        got = weighed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("own"))).alias("own"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if got["n"] == capped or got["weight"] is None:
            break
        unit, capped = (total - most * (got["own"] or 0)) / got["weight"], got["n"]
    cap = most * F.col("own").cast("double")
    return weighed.withColumn("target", cap if got["weight"] is None else F.when(over, cap).otherwise(F.col("weight") * unit)).drop("nth", "weight")


def _planned(rows: DataFrame, weights: Sequence[float], most_patterns: int, scratch: Scratch) -> DataFrame:
    """(pattern, source_size, target, base, cut) of rows (pattern, size, u)."""
    spark = rows.sparkSession
    patterns = scratch.keep(rows.groupBy("pattern").agg(F.sum("size").alias("size")))
    # the words of documents of no source are shared too
    total = patterns.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    memberships = patterns.where(F.size("pattern") > 0).select("pattern", "size", F.size("pattern").alias("wide"), F.explode("pattern").alias("source"))
    sources = memberships.groupBy("source").agg(F.sum("size").alias("own"), F.max("wide").alias("widest"))
    sources = scratch.keep(share(sources, weights, total, scratch))
    of = memberships.alias("m").join(sources.alias("s"), F.col("m.source").eqNullSafe(F.col("s.source")))
    of = of.groupBy("pattern").agg(F.first("size").alias("size"), F.sum("own").alias("source_size"), F.sum("target").alias("target"), F.max("widest").alias("widest"))
    of = scratch.keep(of)
    # overlapping sources
    tied = of.where("widest > 1").select("pattern", "size").limit(most_patterns + 1).collect()
    if len(tied) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns of overlapping sources")
    tied = sorted(tied, key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    quota = {r["source"]: r["target"] for r in sources.where("widest > 1").collect()}  # no more than there are in the patterns
    at = {s: i for i, s in enumerate(sorted(quota, key=lambda s: (s is None, s or "")))}
    flow = min_cost_flow([r["size"] for r in tied], [[at[s] for s in r["pattern"]] for r in tied], [quota[s] for s in at])
    give = spark.createDataFrame([(r["pattern"], float(sum(f.values()))) for r, f in zip(tied, flow)], "pattern array<string>, flow double")
    most = (REPEATS * F.col("size")).cast("double")
    plan = of.join(give, "pattern", "left").withColumn("give", F.least(F.when(F.col("widest") > 1, F.coalesce("flow", F.lit(0.0))).otherwise(F.col("target")), most))
    # no division by 0 where all texts are blank
    plan = plan.withColumn("base", F.when(F.col("size") > 0, F.floor(F.col("give") / F.greatest("size", F.lit(1)) + 1e-9)).otherwise(0).cast("int"))
    plan = scratch.keep(plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("give") - F.col("base") * F.col("size"))))
    cuts = _cuts(rows, plan.where("rest > 0 and size > 0").select("pattern", "rest"), scratch)
    return scratch.keep(plan.join(cuts, "pattern", "left").select("pattern", "source_size", "target", "base", F.coalesce("cut", F.lit(0)).alias("cut")))


def _cuts(rows: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, cut): for each of asked (pattern, rest), the bound below which hashes are taken once more: the words below it are nearest to rest."""
    state = asked.select("pattern", "rest", F.lit(0).cast("long").alias("have"), F.lit(0).alias("head"), F.lit(None).cast("int").alias("cut"))
    for depth in range(_DEPTH):
        shift = _BITS * (_DEPTH - 1 - depth)
        live = state.where("cut is null")
        here = rows.join(live.select("pattern", "head"), "pattern").where(F.shiftright("u", shift + _BITS) == F.col("head"))
        sums = here.groupBy("pattern", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("z"))
        # at most 256 rows for each pattern
        sums = sums.withColumn("upto", F.sum("z").over(Window.partitionBy("pattern").orderBy("bucket")))
        first = sums.join(live.select("pattern", "rest", "have"), "pattern").where("have + upto > rest").groupBy("pattern").agg(F.min(F.struct("bucket", "upto", "z")).alias("x"))
        have = F.col("have") + F.col("x.upto") - F.col("x.z")
        end = F.shiftleft(F.col("head") + 1, shift + _BITS)
        if depth == _DEPTH - 1:
            # the last hash is taken if that is nearer
            end = F.when(F.col("x").isNull(), end).otherwise(F.col("x.bucket") + F.when(F.col("rest") - have > F.col("x.z") / 2, 1).otherwise(0))
        else:
            end = F.when(F.col("x").isNull(), end)
        state = scratch.keep(
            state.join(first, "pattern", "left").select("pattern", "rest", F.coalesce(have, "have").alias("have"), F.coalesce("x.bucket", "head").alias("head"), F.coalesce("cut", end.cast("int")).alias("cut"))
        )
    return state.select("pattern", "cut")


def _mixed(docs: DataFrame, members: Column, size: Column, weights: Sequence[float], seed: int, id_col: str, most_patterns: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of RESULT under names that no column has, and those names."""
    names = {c: f"{c}_{uuid.uuid4().hex}" for c in (*RESULT, "pattern", "u")}
    scratch = Scratch(docs.sparkSession, "mixing")
    # 24 bits of a digest of seed and id
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS * _DEPTH // 4), 16, 10).cast("int")
    pattern = F.coalesce(F.array_sort(F.array_distinct(members)), F.array().cast("array<string>"))
    marked = docs.withColumns({names["pattern"]: pattern, names["mix_size"]: size.cast("long"), names["u"]: u})
    rows = scratch.keep(marked.select(*[F.col(names[c]).alias(d) for c, d in (("pattern", "pattern"), ("mix_size", "size"), ("u", "u"))]))
    plan = _planned(rows, weights, most_patterns, scratch)
    scratch.retain(plan)
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in plan.columns}
    plan = plan.select(*[F.col(c).alias(d) for c, d in own.items()])
    joined = marked.join(plan, F.col(names["pattern"]) == F.col(own["pattern"]), "left")
    copies = F.col(own["base"]) + F.when(F.col(names["u"]) < F.col(own["cut"]), 1).otherwise(0)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        names["mix_size"],
        F.col(own["source_size"]).alias(names["mix_source_size"]),
        F.col(own["target"]).alias(names["mix_target"]),
        F.when((F.col(names["mix_size"]) > 0) & copies.isNotNull(), copies).otherwise(0).alias(names["mix_copies"]),
    ), names


def mix(docs: DataFrame, members: Column, size: Column, weights: Sequence[float] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", most_patterns: int = 200_000) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (int): how often the mix takes the document.

    members: array of the names of a document's sources, null for the null source. mix_source_size and mix_target: sums over
    the document's sources. Weights repeat over the sources in code point order, null last. Sources share all words (a
    document of several sources counts in each one's size). The plan has a row for each pattern: Spark broadcasts it if it is small and
    else joins by pattern.
    """
    mixed, names = _mixed(docs, members, size, weights, seed, id_col, most_patterns)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT], *[F.col(names[c]).alias(c) for c in RESULT])


def repeat(docs: DataFrame, members: Column, size: Column, weights: Sequence[float] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", most_patterns: int = 200_000) -> DataFrame:
    """The mix itself: each document's row as often as the mix takes it, with the columns of docs."""
    mixed, names = _mixed(docs, members, size, weights, seed, id_col, most_patterns)
    nth = f"nth_{uuid.uuid4().hex}"
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col(names["mix_copies"]))).alias(nth)).drop(nth)


SQL = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '')), 1, 6) as int) as u
  from documents),
s as (
  select source, cast(sum(size) as bigint) as own, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight
  from d group by source),
-- capped sources are those that reach their cap first
w as (
  select *, 3 * own / weight as reach, row_number() over (order by 3 * own / weight, source nulls last) as nth,
    coalesce(sum(3 * own) over (order by 3 * own / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by 3 * own / weight, source nulls last rows between current row and unbounded following) as open,
    sum(own) over () as total
  from s),
l as (select arg_min((total - before) / open, nth) as unit from w where (total - before) / open <= reach),
t as (select source, own, case when unit is null or unit * weight > 3 * own then cast(3 * own as double) else unit * weight end as target from s, l),
p as (
  select source, own, target, case when own > 0 then cast(floor(least(target, 3 * own) / own + 1e-9) as bigint) else 0 end as base from t),
r as (select *, greatest(0, least(target, 3 * own) - base * own) as rest from p),
g as (
  select source, u, sum(size) as z, sum(sum(size)) over (partition by source order by u) as upto from d group by source, u),
c as (
  select g.source, g.u, upto <= rest or (upto - z <= rest and rest - (upto - z) > z / 2) as more
  from g join r on g.source is not distinct from r.source)
select d.doc_id, d.size, r.own as source_size, r.target,
  cast(d.size * (r.base + case when c.more and r.rest > 0 then 1 else 0 end) as bigint) as taken
from d join r on d.source is not distinct from r.source
join c on d.source is not distinct from c.source and d.u = c.u
"""
