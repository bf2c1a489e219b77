"""Hierarchical multi-length packing of documents into context windows.

Context sizes halve from the longest (1024, 512, 256, 128): sequences of those lengths need no padding.
A document gives as many whole longest windows as it fills; the rest of it is routed to the
shortest tier that holds it. Each tier is packed from the longest down: a window takes the largest
document of its tier, and its gap is filled from the shorter tiers, by the best fit first and
then by a cut piece, so windows are full while any shorter document is left. What remains at the end is cut to powers of two.

Windows are then dealt to step groups of equal size in tokens, each to the group that has the
fewest tokens and, of those, the least attention cost (the sum of squared piece lengths).

Each task packs what it reads, some thousand documents at a time, with what the batch before left over;
nothing is shuffled, and a task that is run again gives the same rows.

Cases: a null text is empty, and an empty document is its end id alone; a null id stays null; repeated rows are packed
each; an empty table gives no rows. Texts of any length are cut as needed.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import ship
from marketlab.llm._tokens import Encoder
from marketlab.llm._words import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
END_ID = 0


class Shelf:
    """Pieces ordered by length, to be taken by best fit. A piece is (length, key, start)."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.pieces = sorted(pieces)

    def __len__(self) -> int:
        return len(self.pieces)

    def longest(self) -> tuple[int, int, int]:
        return self.pieces.pop()

    def fit(self, room: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``room``."""
        i = bisect.bisect_right(self.pieces, (room, 1 << 62, 0))
        return self.pieces.pop(i - 1) if i else None

    def cut(self, room: int) -> tuple[int, int, int] | None:
        """``room`` ids off the shortest piece that is longer; the rest stays."""
        if not self.pieces:
            return None
        length, key, start = self.pieces.pop(bisect.bisect_right(self.pieces, (room, 1 << 62, 0)))
        bisect.insort(self.pieces, (length - room, key, start + room))
        return room, key, start


def pack(lengths: list[tuple[int, int]], sizes: tuple[int, ...], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows of the documents (key, length), and the pieces left over (none where last is true).

    A window is a list of pieces (length, key, start).
    """
    windows, tiers = [], [[] for _ in sizes]
    for key, n in lengths:
        start = 0
        while n - start >= sizes[0]:
            windows.append([(sizes[0], key, start)])
            start += sizes[0]
        if rest := n - start:
            tier = max(i for i, s in enumerate(sizes) if s >= rest)
            tiers[tier].append((rest, key, start))
    shelves = [Shelf(t) for t in tiers]
    for i, size in enumerate(sizes):
        own, shorter = shelves[i], shelves[i + 1 :]
        while len(own):
            window = [own.longest()]
            room = size - window[0][0]
            while room:
                piece = None
                for shelf in (*shorter, own):
                    piece = piece or shelf.fit(room)
                if piece is None:
                    # all that is left is longer than the gap
                    piece = next((s.cut(room) for s in [*shorter[::-1], own] if len(s)), None)
                if piece is None:
                    break
                window.append(piece)
                room -= piece[0]
            if not room:
                windows.append(window)
            elif not last:
                return windows, window
            else:
                windows += _powers(window)
    return windows, []


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut pieces into windows whose lengths are powers of two."""
    total, out = sum(p[0] for p in pieces), []
    rest = list(pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        window = []
        while room:
            n, key, start = rest.pop(0)
            take = min(n, room)
            window.append((take, key, start))
            if take < n:
                rest.insert(0, (n - take, key, start + take))
            room -= take
        out.append(window)
    return out


def balance(windows: list[list[tuple[int, int, int]]], step: int) -> list[int]:
    """A step group for each window: groups hold ``step`` tokens (the last may hold fewer) and about the same attention cost."""
    total = [sum(p[0] for p in w) for w in windows]
    cost = [sum(p[0] ** 2 for p in w) for w in windows]
    groups = max(1, -(-sum(total) // step))
    heap = [(0, 0, g) for g in range(groups)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-total[k], -cost[k])):
        have, spent, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (have + total[k], spent + cost[k], g))
    return out


def _packer(sizes: tuple[int, ...], step: int, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encoder = Encoder(path)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence, group = task << 36, task << 36
        held: dict[int, tuple] = {}  # key: id, ids
        left: list[tuple[int, int, int]] = []
        key = 0

        def flush(docs: list[tuple[int, int]], last: bool) -> pa.RecordBatch:
            nonlocal sequence, group, left
            # left over pieces come first, as documents that begin where they begin
            moved = {}
            for n, k, s in left:
                nonlocal_key = -len(moved) - 1
                moved[nonlocal_key] = (k, s)
            work = [(nk, n) for nk, (n, _, _) in zip(moved, left)] + docs
            windows, rest = pack(work, sizes, last)
            true = lambda p: (p[0], *((moved[p[1]][0], moved[p[1]][1] + p[2]) if p[1] < 0 else (p[1], p[2])))
            left = [true(p) for p in rest]
            steps = balance(windows, step)
            out: list[list] = [[] for _ in range(9)]
            for window, g in zip(windows, steps):
                total, at = sum(p[0] for p in window), 0
                for p in window:
                    n, k, s = true(p)
                    doc, ids = held[k]
                    for column, value in zip(out, (doc, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids), sequence, at, total, group + g)):
                        column.append(value)
                    at += n
                sequence += 1
            group += max(steps, default=-1) + 1
            keep = {k for _, k, _ in left}
            for k in [k for k in held if k not in keep]:
                del held[k]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        docs: list[tuple[int, int]] = []
        waiting = 0
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 22):
                ids, offsets = encoder.encode(batch.column(1).slice(lo, hi - lo))
                names_of = batch.column(0).slice(lo, hi - lo).to_pylist()
                for k in range(hi - lo):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(END_ID)).astype("<u4")
                    held[key] = (names_of[k], own)
                    docs.append((key, len(own)))
                    key += 1
                    waiting += len(own)
                if waiting >= 4_000_000:
                    yield flush(docs, False)
                    docs, waiting = [], 0
        if docs or left:
            yield flush(docs, True)

    return run


def pack_documents(docs: DataFrame, longest: int = 1024, tiers: int = 4, step_sequences: int = 16, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    longest: the longest context, a power of two; each further tier is half as long. tokenizer: path of a byte-level BPE file
    that every executor can read, by default byte_bpe_50k.json of public_tokenizers.
    step_sequences: longest windows in a step group.
    """
    ship(docs.sparkSession)
    sizes = tuple(longest >> i for i in range(tiers))
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return src.mapInArrow(_packer(sizes, step_sequences * longest, tokenizer), SCHEMA)
