"""Substring dedup: runs of words that occur more than once are removed wherever they occur.

Level-wise doubling. At each length, only windows that are repeated at that length alone go on
to about twice the length, until the full window is reached or no candidates survive. A window
names the shorter window by which it is tried: of all places in it, that with the least hash.
The choice depends on the window's words only, so equal windows choose the same place, no repeat is lost,
and only the chosen places (about one in fourteen words at the first level) are
counted. Counts are of distinct values for each document with a flag for several
places, so that they are aggregated before they are shuffled; a value in a third of all
documents meets a plain two-sided join that adaptive execution can split.
The last level compares 128-bit fingerprints of whole windows.

Copies of whole texts are found first; one of each group goes through the levels, marked as repeated.

Cases: a null text has no words; a text shorter than the window keeps all its words; windows
may overlap themselves in one document; rows of one id are documents of their own, so repeated rows are copies; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import Scratch
from marketlab.llm._words import U, Words, join, mix, ngrams, slices

_ROWS = 512


def levels(window: int) -> list[int]:
    """Lengths of the levels, each at most twice the one before: 9, 18, 35 for 35."""
    out = [window]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _grow(h: np.ndarray, steps: list[int]) -> list[np.ndarray]:
    """Hashes of windows at every level, each joined from two windows of the level below."""
    out = [ngrams(h, steps[0])]
    for short, long in zip(steps, steps[1:]):
        out.append(join(out[-1], long - short))
    return out


def _digest(words: Words, data: bytes, lo: int, hi: int, keep: np.ndarray | None = None) -> str:
    at = range(lo, hi) if keep is None else (np.flatnonzero(keep) + lo)
    s, e = words.starts, words.ends
    return hashlib.sha256(b" ".join([data[s[i] : e[i]] for i in at])).hexdigest()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _uniques(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(v, return_counts=True)
    return u, n > 1


class _Doc:
    """One text's windows of full length and the value that each has at each level."""

    def __init__(self, h: np.ndarray, g: np.ndarray | None, window: int):
        self.steps = levels(window)
        self.n = len(h) - window + 1
        self.h, self.g, self.window = h, g, window
        if self.n > 0:
            self.at = _grow(h, self.steps)

    def value(self, level: int) -> np.ndarray:
        """For each full window, the value by which it is tried at a level below the last."""
        return sliding_min(self.at[level], self.window - self.steps[level] + 1)

    def places(self, level: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values among the chosen windows, and whether one has several places in the text."""
        want = np.unique(self.value(level)[chosen])
        all_, many = _uniques(self.at[level])
        return want, many[np.searchsorted(all_, want)]

    def whole(self) -> np.ndarray:
        """128-bit fingerprints of all full windows, as pairs."""
        return np.stack([self.at[-1], _grow(self.g, self.steps)[-1]], axis=1)


def _first(window: int):
    """Texts (name, text) with a number for each row, and their values of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                words = Words(part)
                h, data = words.hashes(), words.data.tobytes()
                n, sha, values, many, key = [], [], [], [], []
                for k in range(hi - lo):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    n.append(b - a)
                    sha.append(_digest(words, data, a, b))
                    doc = _Doc(h[a:b], None, window)
                    if doc.n > 0:
                        v, m = doc.places(0, np.ones(doc.n, bool))
                        values.append(_signed(v))
                        many.append(m)
                    else:
                        values.append([])
                        many.append([])
                ids = np.arange(row, row + hi - lo)
                row += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), names.slice(lo, hi - lo), part, pa.array(n, pa.int64()), pa.array(sha), pa.array(values, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.bool_()))],
                    ["id", "name", "text", "n_words", "sha", "values", "many"],
                )

    return run


def _candidates(doc: _Doc, alive: list[np.ndarray]) -> np.ndarray:
    """Full windows whose values at all levels so far are repeated."""
    out = np.ones(doc.n, bool)
    for level, values in enumerate(alive):
        out &= np.isin(doc.value(level), values)
    return out


def _values(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column[k].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) if column[k].is_valid else np.zeros(0, np.uint64)


def _next(window: int, level: int):
    """Values of the next level for texts that still have candidates; at the last level one row for each window and its place.

    copied: the whole text occurs elsewhere, so all of its windows do.
    """
    last = level == len(levels(window)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1))
                h = words.hashes()
                g = words.hashes(1) if last else None
                ids, first, second, place, many = [], [], [], [], []
                for k in range(part.num_rows):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    doc = _Doc(h[a:b], g[a:b] if last else None, window)
                    chosen = _candidates(doc, [_values(part.column(3 + i), k) for i in range(level)])
                    copied = part.column(2)[k].as_py()
                    if last:
                        at = np.flatnonzero(chosen)
                        pairs = doc.whole()[at]
                        first.append(pairs[:, 0])
                        second.append(pairs[:, 1])
                        place.append(at)
                        many.append(np.full(len(at), copied))
                    else:
                        u, m = doc.places(level, chosen)
                        first.append(u)
                        second.append(np.zeros(len(u), np.uint64))
                        place.append(np.zeros(len(u), np.int32))
                        many.append(m | copied)
                    ids.append(np.full(len(first[-1]), part.column(0)[k].as_py(), np.int64))
                cat = lambda x, kind: np.concatenate(x).astype(kind, copy=False) if x else np.zeros(0, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cat(ids, np.int64)), pa.array(_signed(cat(first, np.uint64))), pa.array(_signed(cat(second, np.uint64))), pa.array(cat(place, np.int32)), pa.array(cat(many, bool))],
                    ["id", "v", "w", "place", "many"],
                )

    return run


def _last(window: int):
    """Remove each word covered by a repeated window; columns id, text, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                words = Words(part.column(1))
                data = words.data.tobytes()
                removed, sha, kept = [], [], []
                for k in range(part.num_rows):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    edge = np.zeros(b - a + 1, np.int64)
                    at = part.column(2)[k].values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed.append(int((~keep).sum()))
                    sha.append(_digest(words, data, a, b, keep))
                    kept.append(b" ".join([data[words.starts[i] : words.ends[i]] for i in np.flatnonzero(keep) + a]).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["id", "n_removed", "sha", "kept"]
                )

    return run


def _repeated(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """The keys that occur at two places or more."""
    n = rows.groupBy(*keys).agg((F.count("*") + F.sum(F.col("many").cast("int"))).alias("n"))
    return scratch.keep(n.where("n > 1").select(*keys))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept): each document without the words of repeated windows.

    kept: the kept words joined by one space. It is null where nothing is removed, and where the whole
    text is a copy (then nothing is kept if it has ``window`` words or more). window: at least 13.
    Rows are told apart by a number of their own, so ids may repeat or be null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    src = docs.select(F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("text"))
    # numbers of rows are fixed once the table is written, so later steps read its texts
    base = scratch.keep(src.mapInArrow(_first(window), "id long, name long, text string, n_words long, sha string, values array<long>, many array<boolean>"))
    heads = base.select("id", "name", "n_words", "sha")
    copies = scratch.keep(
        heads.where(F.col("n_words") >= window)
        .groupBy("sha", "n_words")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        .where("copies > 1")
    )
    marked = scratch.keep(
        heads.join(copies, ["sha", "n_words"], "left").select("id", "name", "n_words", "sha", F.col("copies").isNotNull().alias("copied"), F.coalesce("first", "id").alias("first"))
    )
    rows = base.select("id", F.explode(F.arrays_zip("values", "many")).alias("x")).select("id", F.col("x.values").alias("v"), F.col("x.many").alias("many"))
    known = _repeated(rows, ["v"], scratch)
    alive = rows.join(known, "v", "left_semi").groupBy("id").agg(F.collect_list("v").alias("alive0"))
    alive = scratch.keep(alive.join(marked.where("id = first").select("id", "copied"), "id"))
    state = scratch.keep(base.select("id", "text").join(alive, "id").select("id", "text", "copied", "alive0"))
    scratch.drop(base, known, alive)
    steps = levels(window)
    for level in range(1, len(steps)):
        last = level == len(steps) - 1
        rows = scratch.keep(state.mapInArrow(_next(window, level), "id long, v long, w long, place int, many boolean"))
        keys = ["v", "w"] if last else ["v"]
        known = _repeated(rows, keys, scratch)
        # copies are removed whole, so at the last level they only count for others
        back = rows.where("not many") if last else rows
        value = F.collect_list("place").alias("places") if last else F.collect_list("v").alias(f"alive{level}")
        found = scratch.keep(back.join(known, keys, "left_semi").groupBy("id").agg(value))
        scratch.drop(rows, known)
        if last:
            # what is left of the state is the text
            newer = scratch.keep(state.select("id", "text").join(found, "id").select("id", "text", "places"))
        else:
            newer = scratch.keep(state.join(found, "id").select(*state.columns, f"alive{level}"))
        scratch.drop(state, found)
        state = newer
    done = scratch.keep(state.mapInArrow(_last(window), "id long, n_removed long, sha string, kept string"))
    scratch.drop(state)
    nothing = hashlib.sha256(b"").hexdigest()
    return scratch.finish(
        marked.select("id", "name", "n_words", F.col("sha").alias("whole"), "copied")
        .join(done, "id", "left")
        .select(
            F.col("name").alias(id_col),
            "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
            "kept",
        )
    )
