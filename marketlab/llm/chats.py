"""Chat formatting with cumulative-snapshot collapse.

A log that saves a conversation after each turn holds every prefix of it. Each conversation gets a
rolling hash of its turns: hash t covers turns 1 to t. One whose last hash is a
proper-prefix hash of another, longer one is a snapshot and is dropped by an anti-join; of
identical ones the smallest id stays. The rest are rendered.

A turn's hash is of its place, role and text, four times 64 bits with different seeds; a prefix's is the exclusive or of those of its turns, a running
aggregate, so a conversation costs time in proportion to its turns. Prefix hashes are made distinct on the map side before the anti-join,
so a first turn that a third of all conversations share is one row for each task.

Cases: turns are ordered by (turn, role, text), nulls first; a null role renders as "unknown", null text
as empty, and both differ from those strings in the hash; a null conversation id is not a conversation and its rows
are dropped; an empty table gives an empty result; other columns are ignored. A conversation is one row of the result and is held as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.llm._spark import Scratch

#: Fixed values of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SEEDS = (1, 2, 3, 4)


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations of turns (conv_id, turn, role, text)."""
    scratch = Scratch(turns.sparkSession, "chats")
    said = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(c).cast("string"), F.lit(":"), c))
    render = F.array_join(
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))), ""
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = [F.xxhash64(F.lit(seed), "n", said(F.col("role")), said(F.col("text"))) for seed in SEEDS]
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        turns.where("conv_id is not null")
        .select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .withColumn("n", F.row_number().over(order))
        .withColumns({f"h{seed}": h for seed, h in zip(SEEDS, own)})
        .withColumn("hash", F.concat_ws(":", *[F.bit_xor(f"h{seed}").over(upto) for seed in SEEDS]))
    )
    # the rows of a conversation are together already
    whole = (
        marked.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "hash"))).alias("turns"))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), render.alias("rendered"), F.col("turns.hash").alias("hashes"))
    )
    whole = scratch.keep(whole)
    own = F.element_at("hashes", -1)
    first = scratch.keep(whole.groupBy(own.alias("own")).agg(F.min("conv_id").alias("conv_id")))
    prefixes = scratch.keep(
        whole.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("own")).distinct()
    )
    keep = first.join(prefixes, "own", "left_anti").select("conv_id")
    return scratch.finish(whole.join(keep, "conv_id").select("conv_id", "n_turns", "rendered"))


SQL = """
with t as (
  select conv_id, turn, role, text,
    case when role is null then '-' else '+' || length(role) || ':' || role end
    || case when text is null then '-' else '+' || length(text) || ':' || text end as said
  from conversations where conv_id is not null),
w as (
  select conv_id,
    row_number() over o as n,
    count(*) over (partition by conv_id) as n_turns,
    string_agg(said, '') over (o rows between unbounded preceding and current row) as prefix
  from t window o as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
whole as (select conv_id, n_turns, prefix from w where n = n_turns),
kept as (
  select min(conv_id) as conv_id from whole
  where not exists (select 1 from w where w.n < w.n_turns and w.prefix = whole.prefix)
  group by prefix)
select conv_id, count(*) as n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
    order by turn nulls first, role nulls first, text nulls first) as rendered
from t where conv_id in (select conv_id from kept) group by conv_id
"""
