"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of ``words`` words. A shingle weighs tf * idf, by the number of documents that have that
shingle. Texts are cut in slices; each slice sends its distinct shingles, with its own counts, to ranges of their hashes, where they are
added, and gets back those that more than one document has: what is absent has one. Nothing of this is broadcast,
and a shingle of every document is sent once for each slice.

Equal texts are one class. own(x) is the weight of the shingles of x that no other text of the corpus has. A text of weight W(x) whose
own(x) is more than (1 - ``threshold``) W(x) is similar enough to none. Of the others, one text of each class is signed: ``bands * rows``
samples of improved consistent weighted sampling (Ioffe, 2010), grouped in bands.

Sampling is exact but does not evaluate every shingle. With r, c ~ Gamma(2, 1) and y in
(x exp(-r), x], a value a = c / (y exp(r)) is at least c exp(-r) / x. Triples (r, c) come from a
fixed table sorted by c exp(-r), indexed by a hash of shingle and sample, so an index above a bound proves a > bound / x; only
the rest is evaluated. The least value is below b / total weight with probability 1 - exp(-b); where it is not, b grows.

Linking. A bucket is the texts that share a band. Members are verified against one of them, the pivot: first
any, then the one with the least share of its own weight, the text that others were made from, or near it. Links give components; a bucket whose
members are not all in one component is open. In buckets that are still open then, the pairs of different components are verified, but for
those that exact bounds on their weights rule out. So no link that shares a band is lost, a group of near copies costs a few comparisons for
each member, and what of it was edited too much to be near any other is told by what is known of it already:

* two texts share at most min(W(x) - own(x), W(y) - own(y)), which must be t / (1 + t) of W(x) + W(y) or more for a similarity of t.
* of the pivot p the verification knows what x shares with it, so what x misses of p and what x has beyond p. Two texts differ by at most
  T = (1 - t) / (1 + t) (W(x) + W(y)) if they are similar enough. They differ by what each differs from p, less twice what they differ from p in alike, which is
  at most the lesser of what they miss and the lesser of what they have beyond p and is not their own.

Cases: a null text links with nothing and stays; equal texts (also empty or without words) are copies; texts of fewer words than a shingle have
one shingle of all their words; tf counts repeats; repeated rows are copies of each other, and rows of one id with
different texts are documents of their own; a null id comes last in its group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm._graph import components
from marketlab.llm._spark import Scratch
from marketlab.llm._words import U, Words, bytes_of, mix, ngrams, slices

_DRAWS = 1 << 20
_CHUNK = 1 << 16  # shingles sampled together
_SLICE = 1 << 22  # bytes of texts whose shingles are counted together, in a small corpus
_MOST_SLICE = 1 << 26  # and in a large one
_RANGE = 1 << 23  # bytes of texts for each range of hashes, likewise
_TASK = 1 << 24  # bytes of texts for each task that samples
_FIRST_BOUND = 3.0


def shingles(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text's word hashes, and how often each occurs."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0)
    s = np.sort(ngrams(h, min(words, len(h))))
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    return s[edge[:-1]], np.diff(edge).astype(np.float64)


def idf(counts: np.ndarray, documents: int) -> np.ndarray:
    """1 + ln((N + 1) / (n + 1)) / ln(N + 2), from 1 for what every document has to nearly 2 for what one of many has.

    Normalized so that the weights of a group of thousands of copies, whose shared shingles are common, stay comparable
    with those of their edits.
    """
    return (1.0 + np.log((documents + 1.0) / (counts + 1.0)) / np.log(documents + 2.0)).astype(np.float32)


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weight that two texts given as (sorted shingles, weights) have in common."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    j = np.flatnonzero(a[0][at] == b[0])
    return float(np.minimum(a[1][at[j]], b[1][j]).sum())


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 if either text is empty."""
    both = shared(a, b)
    return both / (float(a[1].sum()) + float(b[1].sum()) - both) if both else 0.0


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples (c exp(-r), r, c) in order of the first."""
    rng = np.random.default_rng(20)
    r, c = rng.gamma(2.0, 1.0, _DRAWS), rng.gamma(2.0, 1.0, _DRAWS)
    q = c * np.exp(-r)
    order = np.argsort(q)
    return q[order], r[order], c[order]


def _salts(samples: int) -> np.ndarray:
    return np.random.default_rng(21).integers(0, 1 << 63, samples, dtype=np.uint64) * U(2) + U(1)


def _evaluate(elements: np.ndarray, logs: np.ndarray, index: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(a, t) of each element for one sample."""
    _, r, c = _draws()
    beta = (mix(elements ^ salt) >> U(11)).astype(np.float64) * 2.0**-53
    r, c = r[index], c[index]
    t = np.floor(logs / r + beta)
    return c * np.exp(-r * (t - beta) - r), t


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sample(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(texts, samples) 64-bit values; two texts' are equal with a probability of their weighted Jaccard similarity.

    Text k has elements[offsets[k]:offsets[k + 1]], at least one.
    """
    q, _, _ = _draws()
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(texts), sizes)
    scale = 1.0 / np.add.reduceat(weights, offsets[:-1])
    logs = np.log(weights)
    share = weights * scale[owner]
    limit = np.searchsorted(q, _FIRST_BOUND * share, "right").astype(np.uint64)
    out = np.zeros((texts, len(salts)), np.uint64)
    for j, salt in enumerate(salts):
        factor, rows, above = _FIRST_BOUND, None, limit
        while True:
            # rows: the elements of the texts that are still open, all at first
            e = elements if rows is None else elements[rows]
            index = (salt * e) >> U(44)
            at = np.flatnonzero(index < above)
            picked = at if rows is None else rows[at]
            a, t = _evaluate(elements[picked], logs[picked], index[at].astype(np.int64), salt)
            of = owner[picked]
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            if len(edge):
                low = np.minimum.reduceat(a, edge)
                who = of[edge]
                first = np.flatnonzero(a == np.repeat(low, np.diff(np.append(edge, len(of)))))
                first = first[np.flatnonzero(np.diff(of[first], prepend=-1))]
                good = low <= factor * scale[who]
                who, first = who[good], first[good]
                out[who, j] = mix(elements[picked[first]] + mix(t[first].astype(np.int64).view(np.uint64) + U(0x632BE59BD9B4E019)))
            else:
                who = np.zeros(0, np.int64)
            if rows is None:
                open_ = np.ones(texts, bool)
            open_[who] = False
            left = np.flatnonzero(open_)
            if not len(left):
                break
            # at the fourth turn nothing is left out
            factor = factor * 4 if factor < 100 else math.inf
            rows = _runs(offsets[:-1][left], sizes[left])
            above = np.searchsorted(q, factor * share[rows], "right").astype(np.uint64) if factor < math.inf else U(_DRAWS)
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) of samples (texts, bands * rows)."""
    values = values.reshape(len(values), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15), values.shape[:2]).copy()
    for j in range(values.shape[2]):
        keys = mix(keys + values[:, :, j])
    return keys


def _sliced(most: int):
    """Texts (id, text) with the number of their slice, their place in it, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        have, bytes_ = 0, 0
        for batch in batches:
            for lo, hi in slices(batch.column(1), min(most, 1 << 22)):
                part = batch.slice(lo, hi - lo)
                data, offsets = bytes_of(part.column(1))
                if have and bytes_ + len(data) > most:
                    number, have, bytes_ = number + 1, 0, 0
                view = memoryview(data)
                sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, number)), pa.array(np.arange(have, have + hi - lo, dtype=np.int32)), part.column(0), pa.array(sha, pa.binary()), part.column(1)],
                    ["slice", "nth", "id", "sha", "text"],
                )
                have, bytes_ = have + hi - lo, bytes_ + len(data)

    return run


def packed(s: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their differences, lowest bytes first: the highest are nearly all 0 and take no room once compressed."""
    d = np.diff(s, prepend=U(0))
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def small(n: np.ndarray) -> bytes:
    """Counts as bytes, of the least width that holds them."""
    most = int(n.max()) if len(n) else 0
    return n.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64).tobytes()


def of_small(blob: bytes, length: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16}.get(len(blob) // max(1, length), np.uint64)).astype(np.int64)


def _added(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of s, and the sum of n of each."""
    order = np.argsort(s, kind="stable")
    s = s[order]
    edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[edge], np.add.reduceat(n[order], edge)


def _slice_counts(words: int, ranges: int):
    """(range, slice, shingles, n) of texts (slice, sha, text): how many texts of a slice have each of its shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            # a slice may come in several batches: their counts are added like those of others
            for number in np.unique(numbers):
                here = pa.array(np.flatnonzero(numbers == number))
                codes = batch.column(1).take(here).dictionary_encode().indices.to_numpy()
                # copies are cut into shingles once
                _, first, copies = np.unique(codes, return_index=True, return_counts=True)
                w = Words(batch.column(2).take(here.take(pa.array(first))))
                h = w.hashes()
                every = [shingles(h[w.first[k] : w.first[k + 1]], words)[0] for k in range(len(first))]
                if not sum(map(len, every)):
                    continue
                s, n = _added(np.concatenate(every), np.repeat(copies, [len(x) for x in every]))
                # s is sorted, so ranges of the upper 32 bits are runs of it
                of = ((s >> U(32)) * U(ranges) >> U(32)).astype(np.int32)
                edge = np.flatnonzero(np.diff(of, prepend=-1))
                stop = np.append(edge[1:], len(s))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of[edge]), pa.array(np.full(len(edge), number)),
                        pa.array([packed(s[i:j]) for i, j in zip(edge, stop)], pa.binary()),
                        pa.array([small(n[i:j]) for i, j in zip(edge, stop)], pa.binary()),
                    ],
                    ["range", "slice", "shingles", "n"],
                )

    return run


def _of_blobs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, how many of each row)."""
    s = [unpacked(x) for x in t["shingles"].to_pylist()]
    n = [of_small(x, len(y)) for x, y in zip(t["n"].to_pylist(), s)]
    if not s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(s), np.concatenate(n), np.array([len(x) for x in s], np.int64)


_COUNTED = pa.schema([("slice", pa.int64()), ("shingles", pa.binary()), ("n", pa.binary())])


def _range_counts(t: pa.Table) -> pa.Table:
    """For the slices of one range of hashes, their shingles that several texts have, and how many."""
    s, n, lengths = _of_blobs(t)
    order = np.argsort(s, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]]))
    total = np.zeros(len(s), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], edge), np.diff(np.append(edge, len(s))))
    ends = np.cumsum(lengths)
    shared, counts, numbers = [], [], []
    for number, lo, hi in zip(t["slice"].to_pylist(), ends - lengths, ends):
        many = np.flatnonzero(total[lo:hi] > 1) + lo
        if len(many):
            numbers.append(number)
            shared.append(packed(s[many]))
            counts.append(small(total[many]))
    return pa.table([pa.array(numbers, pa.int64()), pa.array(shared, pa.binary()), pa.array(counts, pa.binary())], schema=_COUNTED)


_SIGNED = "node long, keys array<long>, total double, own double, copies long, seen binary, text string"


def _bands(words: int, bands: int, rows: int, documents: int, threshold: float):
    """Signatures of those of the chosen texts of one slice that can be similar enough to any other: no more than 1 - threshold of their weight is their own.

    own: the weight that no other text has; seen: how many documents have each of a text's distinct shingles, as bytes.
    """
    names = [x.split()[0] for x in _SIGNED.split(", ")]

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        salts = _salts(bands * rows)
        chosen = counted.filter(counted["node"].is_valid())
        place = np.argsort(texts["nth"].to_numpy())
        picked = texts["text"].take(pa.array(place[np.searchsorted(texts["nth"].to_numpy()[place], chosen["nth"].to_numpy())]))
        column = picked.combine_chunks() if isinstance(picked, pa.ChunkedArray) else picked
        node, copies = chosen["node"].to_numpy(), chosen["copies"].to_numpy()
        shared, n, _ = _of_blobs(counted.filter(counted["node"].is_null()))
        order = np.argsort(shared)
        shared, n = shared[order], n[order]
        parts = []
        for lo, hi in slices(column, 1 << 20):
            w = Words(column.slice(lo, hi - lo))
            h = w.hashes()
            got = [shingles(h[w.first[k] : w.first[k + 1]], words) for k in range(hi - lo)]
            live = [k for k, (s, _) in enumerate(got) if len(s)]
            while live:
                # about _CHUNK shingles at a time
                take = max(1, int(np.searchsorted(np.cumsum([len(got[k][0]) for k in live]), _CHUNK)))
                some, live = live[:take], live[take:]
                s, tf = (np.concatenate([got[k][i] for k in some]) for i in (0, 1))
                offsets = np.cumsum([0, *[len(got[k][0]) for k in some]])
                seen = np.ones(len(s), np.int64)
                if len(shared):
                    at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
                    seen = np.where(shared[at] == s, n[at], seen)
                weights = tf * idf(seen, documents)
                rows_ = np.array(some) + lo
                sizes = np.diff(offsets)
                total = np.add.reduceat(weights, offsets[:-1])
                own = np.add.reduceat(np.where(seen == np.repeat(copies[rows_], sizes), weights, 0.0), offsets[:-1])
                hope = total - own >= total * (threshold - 1e-9)
                if not hope.any():
                    continue
                at = np.repeat(hope, sizes)
                s, weights, seen, rows_ = s[at], weights[at], seen[at], rows_[hope]
                offsets = np.cumsum([0, *sizes[hope]])
                keys = band_keys(sample(s, weights, offsets, salts), bands)
                parts.append(
                    pa.table(
                        [
                            pa.array(node[rows_]),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(rows_) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel())),
                            pa.array(total[hope]),
                            pa.array(own[hope]),
                            pa.array(copies[rows_]),
                            pa.array([small(seen[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                            column.take(pa.array(rows_)),
                        ],
                        names,
                    )
                )
        return pa.concat_tables(parts) if parts else _signed_schema.empty_table()

    return run


_signed_schema = pa.schema(
    [("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("total", pa.float64()), ("own", pa.float64()), ("copies", pa.int64()), ("seen", pa.binary()), ("text", pa.string())]
)


def _weighed(text: pa.Array, seen: bytes, words: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, weights) of one text."""
    s, tf = shingles(Words(text).hashes(), words)
    return s, tf * idf(of_small(seen, len(s)), documents)


def _verify(words: int, threshold: float, documents: int):
    """Of pairs (a, b, text_a, seen_a, text_b, seen_b), the weight that they share, and whether they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, tuple] = OrderedDict()

        def weighed(id_: int, batch: pa.RecordBatch, at: int, k: int) -> tuple:
            got = known.get(id_)
            if got is None:
                got = known[id_] = _weighed(batch.column(at).slice(k, 1), batch.column(at + 1)[k].as_py(), words, documents)
                if len(known) > 256:
                    known.popitem(last=False)
            else:
                known.move_to_end(id_)
            return got

        for batch in batches:
            ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            both, link = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = weighed(int(ids[0][k]), batch, 2, k), weighed(int(ids[1][k]), batch, 4, k)
                both[k] = shared(a, b)
                link[k] = both[k] / (float(a[1].sum()) + float(b[1].sum()) - both[k]) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(link)], ["a", "b", "both", "link"])

    return run


def may_link(threshold: float) -> Column:
    """Whether the texts of columns total, own, both (what is shared with the pivot), pivot (its weight), and of the same columns with _b, can
    be similar enough, up to rounding. Null in both or both_b says nothing."""
    x, own, both, p = map(F.col, ("total", "own", "both", "pivot"))
    y, own_y, both_y = map(F.col, ("total_b", "own_b", "both_b"))
    most = (1 - threshold) / (1 + threshold) * (x + y)
    apart = (x + p - 2 * both) + (y + p - 2 * both_y)
    alike = F.least(p - both, p - both_y) + F.least(x - both - own, y - both_y - own_y)
    return F.coalesce(apart - 2 * alike <= most + 1e-6 * (x + y), F.lit(True))


def _classes(docs: DataFrame, words: int, threshold: float, bands: int, rows: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((id, sha) of every text that isn't null, (sha, group_id, group_sha, group_size) of every distinct text)."""
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    documents, size = whole.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    grown = lambda least: max(least, min(_MOST_SLICE, size // 4096))
    ranges = max(1, math.ceil(size / grown(_RANGE)))
    tasks = max(math.ceil(size / _TASK), spark.sparkContext.defaultParallelism)

    sliced = scratch.keep(whole.mapInArrow(_sliced(grown(_SLICE)), "slice long, nth int, id long, sha binary, text string"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "slice", "nth"))
    # numbers are fixed once the table is written
    classes = scratch.keep(
        sliced.groupBy("sha").agg(first.alias("p"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "sha", "copies", F.col("p.id").alias("rep"), "p.slice", "p.nth")
    )
    keyed = scratch.keep(sliced.select("id", "sha"))
    sent = sliced.select("slice", "sha", "text").mapInArrow(_slice_counts(words, ranges), "range int, slice long, shingles binary, n binary")
    # as many tasks as the input asks for, so that what one reads does not grow
    counted = scratch.keep(sent.repartition(tasks, "range").groupBy("range").applyInArrow(_range_counts, "slice long, shingles binary, n binary"))
    plan = counted.select("slice", "shingles", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("nth", "int"), ("node", "long"), ("copies", "long")))).unionByName(
        classes.select("slice", F.lit(None).cast("binary").alias("shingles"), F.lit(None).cast("binary").alias("n"), "nth", "node", "copies")
    )
    # a stated number of partitions is not coalesced by size: sampling costs far more than reading
    of_slice = lambda df: df.repartition(tasks, "slice").groupBy("slice")
    signed = scratch.keep(of_slice(sliced.select("slice", "nth", "text")).cogroup(of_slice(plan)).applyInArrow(_bands(words, bands, rows, documents, threshold), _SIGNED))
    scratch.drop(sliced, counted)
    members = signed.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "total", "own")
    crowd = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = scratch.keep(members.join(crowd, "key", "left_semi"))
    needed = members.select(F.col("id").alias("node")).distinct()
    texts = scratch.keep(signed.select("node", "copies", "seen", "text").hint("merge").join(needed, "node", "left_semi"))
    scratch.drop(signed)

    # whether the texts id and b can be similar enough by what is their own, up to rounding
    x, own_x, y, own_y = map(F.col, ("total", "own", "total_b", "own_b"))
    possible = F.least(x - own_x, y - own_y) >= (x + y) * (threshold / (1 + threshold) - 1e-9)
    beside = [F.col(c).alias(d) for c, d in (("id", "b"), ("component", "cb"), ("total", "total_b"), ("own", "own_b"))]
    checked = comps = None

    def verify(met: DataFrame) -> None:
        """Verify the pairs (id, b) that were not yet, and join the components that new links join."""
        nonlocal checked, comps
        pairs = met.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        pairs = scratch.keep(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"))
        if not pairs.limit(1).count():
            return
        a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"), F.col("seen").alias(f"seen_{c}")) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "seen_a", "text_b", "seen_b")
        new = scratch.keep(both.mapInArrow(_verify(words, threshold, documents), "a long, b long, both double, link boolean"))
        checked = new if checked is None else checked.unionByName(new)
        links = new.where("link").select("a", "b")
        if not links.limit(1).count():
            return
        if comps is None:
            comps = scratch.keep(components(links, scratch))
            return
        of = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        newer = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch)
        newer = scratch.keep(newer)
        old = comps.join(newer.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        comps = scratch.keep(old.unionByName(newer.join(comps.select("id"), "id", "left_anti")))

    def still_open(state: DataFrame) -> DataFrame:
        """The buckets whose members are of several components now."""
        state = state.select("key", "id", "total", "own")
        now = state if comps is None else state.join(comps, "id", "left")
        now = now.withColumn("component", F.coalesce("component", "id") if comps is not None else F.col("id"))
        mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        return scratch.keep(now.join(mixed, "key", "left_semi"))

    def pivots_of(state: DataFrame, order: Column) -> DataFrame:
        least = F.min(F.struct(order, F.xxhash64("id"), "id", "component", "total", "own")).alias("p")
        return scratch.keep(state.groupBy("key").agg(least).select("key", "p.*").select("key", *beside))

    state = still_open(members)
    verify(state.join(pivots_of(state, F.lit(0.0)), "key").where((F.col("component") != F.col("cb")) & possible))
    state = still_open(state)
    # every member, so that the bounds below know them all
    pivots = pivots_of(state, F.col("own") / F.col("total"))
    met = state.join(pivots, "key").where("id <> b")
    verify(met)
    known = spark.createDataFrame([], "a long, b long, both double") if checked is None else checked.select("a", "b", "both")
    state = still_open(state)
    met = state.join(pivots.select("key", "b", F.col("total_b").alias("pivot")), "key").withColumns({"a": F.greatest("id", "b"), "b": F.least("id", "b")})
    # the pivot shares all of its weight with itself
    met = scratch.keep(met.join(known, ["a", "b"], "left").withColumn("both", F.when(F.col("a") == F.col("b"), F.col("total")).otherwise(F.col("both"))).drop("a", "b"))
    other = met.select("key", *beside, F.col("both").alias("both_b"))
    verify(met.join(other, "key").where((F.col("id") > F.col("b")) & (F.col("component") != F.col("cb")) & possible & may_link(threshold)))
    if comps is None:
        comps = spark.createDataFrame([], "id long, component long")
    of_class = classes.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").select("sha", "copies", "rep", F.coalesce("component", "node").alias("component"))
    of_class = scratch.keep(of_class)
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "sha"))
    groups = scratch.keep(of_class.groupBy("component").agg(least.alias("p"), F.sum("copies").alias("group_size")))
    of_sha = of_class.join(groups, "component").select("sha", F.col("p.rep").alias("group_id"), F.col("p.sha").alias("group_sha"), "group_size")
    of_sha = scratch.keep(of_sha)
    scratch.retain(keyed, of_sha)
    return keyed, of_sha


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    bands: int = 24,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, group_id, group_size, kept), one row for each row of docs: group_id is the least id of the document's group; one row of a group is kept.

    With 24 bands of 5 a pair of similarity 0.8 shares no band with a probability of 0.00007.
    """
    keyed, of_sha = _classes(docs, words, threshold, bands, rows, id_col, text_col, Scratch(docs.sparkSession, "minhash"))
    # repeated rows are told apart by their number
    found = keyed.groupBy("id", "sha").agg(F.count("*").alias("n")).join(of_sha, "sha")
    found = found.withColumn("nth", F.explode(F.expr("sequence(1L, n)")))
    first = F.col("id").eqNullSafe(F.col("group_id")) & (F.col("sha") == F.col("group_sha")) & (F.col("nth") == 1)
    found = found.select("id", "group_id", "group_size", first.alias("kept"))
    nulls = docs.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("id"))
    nulls = nulls.select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return found.unionByName(nulls).select(F.col("id").alias(id_col), "group_id", "group_size", "kept")


def deduplicate(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept: one of each group. Of rows with equal id and text the least by its other columns."""
    keyed, of_sha = _classes(docs, words, threshold, bands, rows, id_col, text_col, Scratch(docs.sparkSession, "minhash"))
    counts = keyed.groupBy("id", "sha").agg(F.count("*").alias("n"))
    # names that no column of docs has
    id_, sha_, n_, row_ = (f"{x}_{uuid.uuid4().hex}" for x in ("id", "sha", "n", "row"))
    # one row for each group
    kept = of_sha.where("sha = group_sha").join(counts, "sha").where("id <=> group_id").select(F.col("id").alias(id_), F.col("sha").alias(sha_), F.col("n").alias(n_))
    sha = F.unhex(F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
    own = [F.col(f"`{c}`") for c in docs.columns]
    some = docs.where(F.col(text_col).isNotNull()).join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (sha == F.col(sha_)))
    once = some.where(F.col(n_) == 1).select(*own)
    twice = some.where(F.col(n_) > 1).groupBy(id_, sha_).agg(F.min(F.struct(*own)).alias(row_)).select(f"{row_}.*")
    return once.unionByName(twice).unionByName(docs.where(F.col(text_col).isNull()))
