"""Toxicity: a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

The kernel of two strings sums, over all subsequences of ``ORDER`` letters that they share, decay to the power of
the spans that they cover (Lodhi et al., 2002), normalized; letters need not be adjacent, so an
insult with gaps, inserted letters or another ending stays near its plain form. Nyström landmarks turn the
kernel into a few features, on which a linear machine is trained.

A text is cut in sentences, at ends of lines and at words that end in a full stop, exclamation or question mark. A sentence is read in windows: each word, cut to
overlapping windows of ``WINDOW`` letters if longer; and each run of single letters as one string with its gaps ("i d i o t"); as they are and with the letters alone. A sentence's score is that of its worst window, and a
document's that of its worst sentence, through a logistic calibration. Labels are of documents, so sentences are labelled in turns with the
machine (multiple-instance learning): all windows of a clean document's sentences are negative; of a toxic document, one sentence or more holds a positive
window, at first one that is common in toxic documents and absent from clean ones, later the worst by the machine so far; its other sentences are left out.

Limits of the units: neighbouring words are not read as one string unless they are single letters. (Pairs of short words were tried: on held-out documents they cost
recall, 0.67 instead of 0.93 at the threshold, and three times the time.)

Windows are scored once for each distinct string and kept for the task; every text is read whole, where it is scanned.
The machine is fitted on the driver on at most ``most`` documents of each label (a documented bound).

Cases: a null text counts as empty; a text without windows of ``ORDER`` letters gets the lowest score; without both labels in the sample every
score is the share of label 1 (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import ship
from marketlab.llm._training import labelled, remainder
from marketlab.llm._words import Words, slices

ORDER, DECAY, WINDOW, STRIDE = 4, 0.6, 14, 7
LANDMARKS = 96
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-–—"
_KEEP = 1_000_000


def letters(units: list[str]) -> np.ndarray:
    """Code points, one row for each unit, padded with 0."""
    width = max(1, max(map(len, units), default=1))
    return np.array(units, dtype=f"<U{width}").view(np.uint32).reshape(len(units), width)


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The unnormalized kernel of each row of x with itself."""
    n, width = x.shape
    d = np.float32(DECAY)
    prefix = [np.ones((width + 1, n), np.float32), *(np.zeros((width + 1, n), np.float32) for _ in range(ORDER - 1))]
    total = np.zeros(n, np.float32)
    cols = np.ascontiguousarray(x.T)
    for i in range(width):
        same = ((cols[i] == cols) & (cols[i] != 0)).astype(np.float32) * (d * d)
        total += (same * prefix[-1][:-1]).sum(axis=0)
        for order in range(ORDER - 1, 0, -1):
            run = same * prefix[order - 1][:-1]
            for j in range(1, width):
                run[j] += d * run[j - 1]
            prefix[order][1:] = prefix[order][1:] * d + run
    return total


def kernels(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Unnormalized kernels of each row of x with each row of z."""
    n, m, width = len(x), len(z), z.shape[1]
    d = np.float32(DECAY)
    prefix = [[np.ones((n, m), np.float32)] * (width + 1)] + [[np.zeros((n, m), np.float32) for _ in range(width + 1)] for _ in range(ORDER - 1)]
    total = np.zeros((n, m), np.float32)
    for i in range(x.shape[1]):
        c = x[:, i, None]
        same = [((c == z[None, :, j]) & (c != 0)).astype(np.float32) * (d * d) for j in range(width)]
        for j in range(width):
            total += same[j] * prefix[ORDER - 1][j]
        # longest first: each order reads the shorter one as it was before this letter
        for order in range(ORDER - 1, 0, -1):
            run = np.zeros((n, m), np.float32)
            row = prefix[order]
            for j in range(width):
                run = run * d + same[j] * prefix[order - 1][j]
                row[j + 1] = row[j + 1] * d + run
    return total


def _roots(units: list[str]) -> np.ndarray:
    """Square roots of the self kernels."""
    out = np.zeros(len(units), np.float32)
    length = np.fromiter(map(len, units), np.int64, len(units))
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        for lo in range(0, len(rows), 4096):
            at = rows[lo : lo + 4096]
            out[at] = np.sqrt(np.maximum(self_kernel(letters([units[i] for i in at])), 1e-12))
    return out


def _normal(a: list[str], b: list[str]) -> np.ndarray:
    """Normalized kernels of the strings of a with those of b."""
    z, out = letters(b), []
    for lo in range(0, len(a), 512):
        out.append(kernels(letters(a[lo : lo + 512]), z))
    return np.concatenate(out) / np.maximum(_roots(a), 1e-6)[:, None] / np.maximum(_roots(b), 1e-6)[None, :]


@lru_cache(64)
def _places(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ascending choices of four of ``width`` places as two pairs: the pairs, and for each choice its pairs and the decay of its span."""
    pairs = {p: i for i, p in enumerate(combinations(range(width), 2))}
    four = list(combinations(range(width), 4))
    span = np.array([DECAY ** (f[3] - f[0] + 1) for f in four], np.float32)
    i, j = np.array(list(pairs)).T
    return i, j, np.array([pairs[f[:2]] for f in four]), np.array([pairs[f[2:]] for f in four]), span


class Folded:
    """A weighted sum of kernels with fixed strings as one weight for each subsequence of ORDER = 4 letters."""

    def __init__(self, marks: list[str], weights: np.ndarray):
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for t in marks for c in t}))}
        self.base = len(self.codes) + 1
        found: dict[int, float] = {}
        for mark, weight, root in zip(marks, weights, _roots(marks)):
            if len(mark) < ORDER:
                continue
            for key, span in zip(self._keys([mark])[:, 0].tolist(), _places(len(mark))[4].tolist()):
                found[key] = found.get(key, 0.0) + weight * span / float(root)
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()] or [0.0], np.float32)
        self.dense = None
        if self.base <= 56:
            self.dense = np.zeros(self.base**4, np.float32)
            self.dense[self.keys] = self.values[: len(self.keys)]

    def _keys(self, units: list[str]) -> np.ndarray:
        """Keys of the subsequences of strings of one length, a column for each string; letters of no fixed string are 0."""
        x = letters(units)
        points, where = np.unique(x, return_inverse=True)
        code = np.array([self.codes.get(chr(c), 0) for c in points], np.int64)[where.reshape(x.shape)].T
        i, j, first, second, _ = _places(x.shape[1])
        pair = code[i] * self.base + code[j]
        return pair[first] * (self.base * self.base) + pair[second]

    def sums(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units), np.float32)
        length = np.fromiter(map(len, units), np.int64, len(units))
        for size in np.unique(length):
            if size < ORDER:
                continue
            span = _places(int(size))[4]
            rows = np.flatnonzero(length == size)
            for lo in range(0, len(rows), 256):
                at = rows[lo : lo + 256]
                keys = self._keys([units[k] for k in at])
                if self.dense is not None:
                    value = self.dense[keys]
                elif len(self.keys):
                    place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    value = np.where(self.keys[place] == keys, self.values[place], np.float32(0))
                else:
                    continue
                out[at] = span @ value
        return out


@dataclass
class Machine:
    landmarks: list[str]
    root: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def features(self, units: list[str]) -> np.ndarray:
        if not units:
            return np.zeros((0, self.root.shape[1]), np.float32)
        return _normal(units, self.landmarks) @ self.root.astype(np.float32)

    def decide(self, units: list[str]) -> np.ndarray:
        """The decision for each string: that of features(), with kernel, landmarks and weights folded into a weight for each subsequence."""
        folded = Folded(self.landmarks, (self.root @ self.weights).astype(np.float64))
        return folded.sums(units) / np.maximum(_roots(units), 1e-6) + np.float32(self.bias)

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def windows(token: str) -> list[str]:
    """The windows of one word or run of single letters, as it is and without what stands between its letters; its start and
    end count as letters."""
    out = []
    plain = token.strip(_EDGE)
    joined = "".join(c for c in plain if c.isalnum())
    for form in (plain, joined) if joined != plain and len(joined) >= 3 else (plain,):
        form = f"^{form}$"
        if len(form) <= WINDOW:
            out.append(form)
        else:
            out += [form[i : i + WINDOW] for i in range(0, len(form) - STRIDE, STRIDE)]
    return out


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct strings of data[starts[i]:ends[i]], in no order, and which each is."""
    sizes = ends - starts
    after = np.cumsum(sizes)
    flat = data[np.arange(int(after[-1]) if len(after) else 0) + np.repeat(starts - (after - sizes), sizes)]
    cuts = np.concatenate([[0], after]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(flat)]).dictionary_encode()
    return [b.decode("utf-8").strip().strip(_EDGE) for b in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)


def strings(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct strings, index of the string of each occurrence, its text, its sentence): words, and runs of three or more single letters.

    Sentences are numbered through all texts.
    """
    low = pc.utf8_lower(texts)
    w = Words(low)
    n = len(w.starts)
    none = np.zeros(0, np.int64)
    if not n:
        return [], none, none, none
    found, codes = _coded(w.data, w.starts, w.ends)
    text = np.repeat(np.arange(len(low)), np.diff(w.first))
    # letters: characters, not bytes, so bytes that continue a character don't count
    more = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    lines = np.concatenate([[0], np.cumsum(w.data == 0x0A)])
    size = more[w.ends] - more[w.starts]
    # a sentence ends after a word
    stop = np.isin(w.data[w.ends - 1], np.frombuffer(b".!?", np.uint8))
    stop[:-1] |= (lines[w.starts[1:]] > lines[w.ends[:-1]]) | (text[1:] != text[:-1])
    sentence = np.concatenate([[0], np.cumsum(stop)[:-1]])
    # a letter may have a mark after it
    single = (size == 1) | (size == 2) & np.isin(w.data[w.ends - 1], np.frombuffer(b".,:;!?", np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    runs, first = [], []
    for a, b in zip(edge[::2], edge[1::2]):
        while a < b:
            end = min(b, int(np.searchsorted(sentence, sentence[a], "right")))
            if end - a >= 3:
                runs.append(len(found))
                first.append(a)
                found.append(w.data[w.starts[a] : w.ends[end - 1]].tobytes().decode("utf-8"))
            a = end
    first = np.array(first, np.int64)
    return found, np.concatenate([codes, np.array(runs, np.int64)]), np.concatenate([text, text[first]]), np.concatenate([sentence, sentence[first]])


def _svm(f: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 200.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Squared hinge loss with an L2 penalty, by accelerated gradient."""
    x = np.concatenate([f, np.ones((len(f), 1))], axis=1).astype(np.float64)
    w = weight / weight.sum() * c
    penalty = np.append(np.ones(f.shape[1]), 1e-3)
    reach = 2 * np.linalg.eigvalsh((x * w[:, None]).T @ x)[-1] + 1
    b, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - (penalty * ahead - 2 * x.T @ (w * y * slack)) / reach
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, b = step + (old - 1) / t * (step - b), step
    return b[:-1], float(b[-1])


def _calibrate(decision: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the labels to the decisions, labels drawn in to (n + 1) / (n + 2) as Platt does."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([decision, np.ones(len(y))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        ab = ab - np.linalg.solve(h, x.T @ (p - goal))
    return float(ab[0]), float(ab[1])


def _spread(ranked: list[int], names: list[str], most: int) -> list[int]:
    """The first of each kind: strings in order, without those that are near one taken before."""
    own = [names[u] for u in ranked]
    near, out = _normal(own, own), []
    for i in range(len(ranked)):
        if len(out) < most and all(near[i, j] < 0.35 for j in out):
            out.append(i)
    return [ranked[i] for i in out]


def fit(texts: list[str], y: np.ndarray, negatives: int = 6000, turns: int = 4, seed: int = 5) -> Machine:
    """Train on labelled documents; see the module's text."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0, 1))
        edge = float(np.log(np.clip(share, 1e-9, 1 - 1e-9) / np.clip(1 - share, 1e-9, 1)))
        return Machine(["aaa"], np.zeros((1, 1)), np.zeros(1), 0.0, 0.0, edge)
    found, codes, owner, sentence = strings(pa.array(texts))
    parts = [windows(s) for s in found]
    names = sorted({u for p in parts for u in p if len(u) >= ORDER})
    at = {u: i for i, u in enumerate(names)}
    # windows of each sentence of each document
    said: list[dict[int, set[int]]] = [{} for _ in texts]
    for code, k, j in zip(codes.tolist(), owner.tolist(), sentence.tolist()):
        said[k].setdefault(j, set()).update(at[u] for u in parts[code] if u in at)
    bags: list[set[int]] = [set().union(*d.values()) for d in said]
    toxic = [k for k in range(len(texts)) if y[k] == 1]
    clean = [k for k in range(len(texts)) if y[k] == 0]
    in_toxic = Counter(u for k in toxic for u in bags[k])
    in_clean = Counter(u for k in clean for u in bags[k])
    # first witnesses: strings of several toxic documents and of no clean one
    # (a copied document makes its words look common, so a share of the toxic documents is asked for)
    enough = max(3, 0.01 * len(toxic))
    sure = {u for u, n in in_toxic.items() if n >= enough and in_clean[u] <= 0.01 * n} or {u for u, n in in_toxic.items() if not in_clean[u]}
    witness = {k: bags[k] & sure for k in toxic if bags[k] & sure}
    rng = np.random.default_rng(seed)
    never = sorted(set(in_clean) - sure)
    pool = [never[i] for i in rng.permutation(len(never))[:negatives]]
    hard: list[int] = []
    machine = None
    everything = np.array(sorted(set(never) | set(in_toxic)))
    for turn in range(turns):
        ranked = Counter(u for own in witness.values() for u in own)
        good = _spread([u for u, _ in ranked.most_common(300)], names, LANDMARKS * 3 // 4)
        marks = good + (hard + pool)[: LANDMARKS - len(good)]
        marks = [names[u] for u in marks] or ["aaa"]
        gram = _normal(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh(gram)
        root = vector / np.sqrt(np.maximum(value, 1e-3))[None, :]
        machine = Machine(marks, root, np.zeros(len(marks)), 0.0)
        pos = sorted(ranked)
        neg = sorted((set(pool) | set(hard)) - set(pos))
        rows = [*pos, *neg]
        f = machine.features([names[u] for u in rows])
        label = np.where(np.arange(len(rows)) < len(pos), 1.0, -1.0)
        weight = np.array([np.sqrt(ranked[u]) for u in pos] + [1.0] * len(neg))
        weight[: len(pos)] /= weight[: len(pos)].sum()
        weight[len(pos) :] /= max(1.0, len(neg))
        machine.weights, machine.bias = _svm(f, label, weight)
        if turn == turns - 1:
            break
        score = dict(zip(everything.tolist(), machine.decide([names[u] for u in everything]).tolist()))
        for k in toxic:
            if k not in witness and bags[k]:
                # the worst window of the worst sentence
                worst_of = [max(d, key=lambda u: (score[u], names[u])) for d in said[k].values() if d]
                best = max(worst_of, key=lambda u: (score[u], names[u]))
                if score[best] > 0 and not in_clean[best]:
                    witness[k] = {best}
        worst = sorted(never, key=lambda u: -score[u])[:1500]
        hard = sorted({*hard, *(u for u in worst if score[u] > -0.7)}, key=lambda u: -score[u])
    score = dict(zip(everything.tolist(), machine.decide([names[u] for u in everything]).tolist()))
    low = machine.bias
    decision = np.array([max((score[u] for u in b), default=low) for b in bags])
    machine.slope, machine.shift = _calibrate(decision, y)
    return machine


_known: dict[str, dict[str, float]] = {}


def score_texts(machine: Machine, texts: pa.Array) -> np.ndarray:
    """The calibrated score of each text. Scores of strings are kept from batch to batch, up to a bound."""
    cache = _known.get(machine.key)
    if cache is None:
        _known.clear()
        cache = _known[machine.key] = {}
    found, codes, owner, _ = strings(texts)
    if len(cache) + len(found) > _KEEP:
        cache.clear()
    new = [s for s in dict.fromkeys(found) if s not in cache]
    parts = [windows(s) for s in new]
    units = list(dict.fromkeys(u for p in parts for u in p))
    of_unit = dict(zip(units, machine.decide(units).tolist())) if units else {}
    for s, p in zip(new, parts):
        cache[s] = max(of_unit[u] for u in p)
    out = np.full(len(texts), machine.bias, np.float64)
    if len(codes):
        values = np.fromiter((cache[s] for s in found), np.float64, len(found))
        np.maximum.at(out, owner, values[codes])
    return machine.probability(out)


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0), 1 << 22):
                part = batch.slice(lo, hi - lo)
                score = score_texts(machine, part.column(0).fill_null(""))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, most: int = 1000, seed: int = 5, train_on: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels (doc_id, toxic) of the held-out fold are not learned."""
    ship(docs.sparkSession)
    out = remainder(F.col("doc_id"), folds) == held
    rows = labelled(docs, labels, "toxic", ~out if train_on is None else train_on, most, seed)
    machine = fit(rows["text"].tolist(), rows["y"].to_numpy(float))
    src = docs.select("text", "doc_id", out.alias("held_out"))
    scored = src.mapInArrow(_scorer(machine), "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
