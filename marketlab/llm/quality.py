"""Quality classifier: a byte-level convolutional network in NumPy.

Each byte has a learned vector; ``filters`` learned filters read ``width`` bytes at a time over
chunks of ``chunk`` bytes that overlap by width - 1, so every place of the whole document is
read in exactly one chunk. A filter is max-pooled over its chunk; a document's features are the means and the
maxima over its chunks, and one logistic unit combines them.

For scoring, embedding and filters are folded into one table for each pair of neighbouring bytes, so a filter response is the sum
of width / 2 rows. All texts are read whole, in the tasks that scan them; nothing is shuffled.

The network is fitted on the driver on at most ``most`` documents of each label (a documented bound), on up to
``chunks`` chunks of each, by Adam with a fixed seed.

Cases: a null text counts as empty; an empty text has no features above 0 and gets the score of that; documents that are not labelled
are only scored; without both labels in the sample every score is the share of label 1 (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import ship
from marketlab.llm._training import labelled, remainder
from marketlab.llm._words import bytes_of, slices

CHUNK, WIDTH, FILTERS, EMBED = 512, 6, 16, 8


@dataclass
class Network:
    embed: np.ndarray  # 256, EMBED
    conv: np.ndarray  # WIDTH, EMBED, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    shift: float

    def tables(self) -> list[np.ndarray]:
        """Row b0 * 256 + b1 of table i: what the bytes at 2i and 2i + 1 add to each filter."""
        one = [(self.embed @ self.conv[j]).astype(np.float32) for j in range(WIDTH)]
        return [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Scores of the texts whose bytes are data[offsets[k]:offsets[k + 1]]."""
        lengths = np.diff(offsets)
        mean, most = np.zeros((len(lengths), FILTERS), np.float32), np.zeros((len(lengths), FILTERS), np.float32)
        if len(data):
            # zero bytes stand after each text, so that its last windows don't reach into the next
            gap = WIDTH - 1
            padded = np.zeros(len(data) + gap * len(lengths), np.uint8)
            at = np.arange(len(data)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
            padded[at] = data
            pair = padded[:-1].astype(np.int32) * 256 + padded[1:]
            begin = offsets[:-1] + np.arange(len(lengths)) * gap
            pools = []
            live = np.flatnonzero(lengths)
            # chunk starts within each text
            n_chunks = -(-lengths[live] // CHUNK)
            owner = np.repeat(live, n_chunks)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
            start = begin[owner] + nth * CHUNK
            stop = np.minimum(start + CHUNK, begin[owner] + lengths[owner])
            # windows over the zero bytes between texts belong to no chunk
            for lo in range(0, len(owner), 64):
                a, b = start[lo], stop[min(lo + 64, len(owner)) - 1]
                response = tables[0][pair[a:b]]
                for i in range(1, len(tables)):
                    take = pair[a + 2 * i : b + 2 * i]
                    response[: len(take)] += tables[i][take]
                edges = np.stack([start[lo : lo + 64], stop[lo : lo + 64]], axis=1).ravel() - a
                if edges[-1] == len(response):
                    edges = edges[:-1]
                pools.append(np.maximum.reduceat(response, edges, axis=0)[::2])
            pooled = np.maximum(np.concatenate(pools) + self.bias.astype(np.float32), 0)
            edge = np.searchsorted(owner, live)
            mean[live] = np.add.reduceat(pooled, edge, axis=0) / n_chunks[:, None]
            most[live] = np.maximum.reduceat(pooled, edge, axis=0)
        z = np.concatenate([mean, most], axis=1).astype(np.float64) @ self.out + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[bytes], y: np.ndarray, chunks: int = 4, steps: int = 400, batch: int = 32, seed: int = 3) -> Network:
    """Adam on the log loss; both labels are drawn equally often."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
    p = [rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), np.zeros(1)]
    p = [x.astype(np.float32) for x in p]
    groups = [np.flatnonzero(y == v) for v in (0, 1)]
    if not all(len(g) for g in groups):
        return Network(p[0], p[1], p[2], np.zeros(2 * FILTERS), float(np.log(share / (1 - share))))
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    size = CHUNK + WIDTH - 1
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        x = np.zeros((batch, chunks, size), np.uint8)
        real, ends = np.zeros((batch, chunks), bool), np.zeros((batch, chunks), np.int64)
        for i, k in enumerate(rows):
            t = texts[k]
            have = max(1, -(-len(t) // CHUNK))
            picked = range(have) if have <= chunks else rng.choice(have, chunks, replace=False)
            for j, c in enumerate(picked):
                part = np.frombuffer(t[c * CHUNK : c * CHUNK + size], np.uint8)
                x[i, j, : len(part)] = part
                real[i, j], ends[i, j] = True, min(CHUNK, len(part))
        flat = x.reshape(batch * chunks, size)
        e = p[0][flat]
        n = CHUNK
        cols = np.concatenate([e[:, j : j + n] for j in range(WIDTH)], axis=2)  # chunks, places, WIDTH * EMBED
        w = p[1].reshape(WIDTH * EMBED, FILTERS)
        response = cols.reshape(-1, WIDTH * EMBED) @ w
        response = response.reshape(batch * chunks, n, FILTERS)
        # places past the end of a text are not read
        response[np.arange(n)[None, :] >= ends.reshape(-1, 1)] = -1e9
        best = response.argmax(axis=1)
        top = np.take_along_axis(response, best[:, None, :], 1)[:, 0] + p[2]
        pooled = np.maximum(top, 0).reshape(batch, chunks, FILTERS) * real[:, :, None]
        count = real.sum(1)[:, None]
        mean, where = pooled.sum(1) / count, pooled.argmax(axis=1)
        most = np.take_along_axis(pooled, where[:, None, :], 1)[:, 0]
        f = np.concatenate([mean, most], axis=1)
        z = f @ p[3] + p[4]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((prob - y[rows]) / batch).astype(np.float32)
        g_out, g_shift = f.T @ dz, dz.sum(keepdims=True)
        df = dz[:, None] * p[3][None, :]
        dpool = np.repeat((df[:, :FILTERS] / count)[:, None, :], chunks, axis=1)
        np.put_along_axis(dpool, where[:, None, :], np.take_along_axis(dpool, where[:, None, :], 1) + df[:, None, FILTERS:], 1)
        dpool = (dpool * real[:, :, None]).reshape(batch * chunks, FILTERS) * (top > 0)
        g_bias = dpool.sum(0)
        # gradient reaches the best place of each chunk only
        picked = np.take_along_axis(cols, best[:, :, None], 1)  # chunks, FILTERS, WIDTH * EMBED
        g_conv = np.einsum("cf,cfd->df", dpool, picked).reshape(WIDTH, EMBED, FILTERS)
        back = np.einsum("cf,df->cfd", dpool, w).reshape(-1, EMBED)
        at = best[:, :, None] + np.arange(WIDTH)
        letters = np.take_along_axis(flat[:, None, :].repeat(FILTERS, 1), at, 2).ravel()
        g_embed = np.zeros_like(p[0])
        np.add.at(g_embed, letters, back)
        for i, g in enumerate((g_embed, g_conv, g_bias, g_out, g_shift)):
            g = g + 1e-4 * p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
            p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(p[0], p[1], p[2], p[3].astype(np.float64), float(p[4][0]))


def _scorer(network: Network, text: int, least: float | None = None):
    """Append the score of column ``text``; with ``least``, keep only rows of that score or more, without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables()
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                score = network.score(*bytes_of(part.column(text)), tables)
                if least is None:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])
                elif (keep := score >= least).any():
                    yield part.filter(pa.array(keep))

    return run


def train(docs: DataFrame, labels: DataFrame, train_on: Column, most: int = 1500, seed: int = 3) -> Network:
    """Fit on at most ``most`` documents of each label among the labels where train_on holds."""
    rows = labelled(docs, labels, "quality", train_on, most, seed)
    return fit([t.encode("utf-8") for t in rows["text"]], rows["y"].to_numpy(float), seed=seed)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, most: int = 1500, seed: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels (doc_id, quality) of the held-out fold are not learned."""
    ship(docs.sparkSession)
    network = train(docs, labels, remainder(F.col("doc_id"), folds) != held, most, seed)
    src = docs.select("text", "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    scored = src.mapInArrow(_scorer(network, 0), "text string, doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 1500, seed: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more; all labels are learned from."""
    ship(docs.sparkSession)
    network = train(docs, labels, F.lit(True), most, seed)
    return docs.mapInArrow(_scorer(network, docs.columns.index("text"), threshold), docs.schema)
