"""PII: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers; they label the
training texts too. The network learns from those labelled spans and from the same spans in other
writing (spelled-out or spaced separators, no leading plus), set into the texts, so it also marks forms that the patterns don't.

The network reads every character of every text, in windows of ``WINDOW`` that overlap by ``OVERLAP``. Its gates and
outer functions are piecewise linear, and gates of all windows of a batch are computed together, so reading costs
about a tenth of a microsecond a character. Each window is decoded by Viterbi; where the scores of all its characters are so far
below those of "none" that no transitions can make up for it, the best tags are all "none" and are not searched. The spans of all windows of a text are
reconciled together: what a window's edge cut is joined with what its neighbour has of it, and of all spans the set that don't overlap
and cover the most is taken. Base spans always stay; added ones don't overlap them and hold what their kind can't do without.

The network is trained in NumPy on the driver on a bounded sample: the documents of least hash, at most ``most``, of each at most ``PART`` characters
from a seeded place. That bound is on training alone.

Cases: a null text is empty; empty texts have no spans; positions are code points, ends exclusive; repeated rows are searched
each; an empty table gives an empty result; columns with any names are carried on. Texts of any length are read whole, in time that grows in proportion.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm._spark import ship
from marketlab.llm._words import bytes_of, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: what fails at its start fails later in it
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: What a text without any base span lacks.
_SIGNS = r"[0-9@]"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether a run of digits, with any number of leading zeros, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping for each kind, ordered by start, then kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(map(_byte, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


WINDOW, OVERLAP = 448, 64
TRAIN, PART = 96, 20_000  # characters of a training window, and of a training document
_TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
_CHARS, _EMBED, _HIDDEN = 131, 12, 16
_OUTSIDE = 130
_BATCH = 512

#: The class of the character that a first byte of UTF-8 begins: ASCII for itself, characters below U+2000 128, the rest 129.
_OF_BYTE = np.full(256, 129, np.uint8)
_OF_BYTE[:128] = np.arange(128)
_OF_BYTE[0xC0:0xE2] = 128


def codes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each character, characters before each text) of texts in UTF-8."""
    first = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(first)])
    return _OF_BYTE[data[first]], before[offsets]


def char_codes(text: str) -> np.ndarray:
    return codes_of(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))[0]


def _mirror(length: np.ndarray, time: int) -> np.ndarray:
    """(rows, time): where each place of a row goes when its first ``length`` are turned round."""
    t = np.arange(time)[None, :]
    return np.where(t < length[:, None], length[:, None] - 1 - t, t)


@dataclass
class Tagger:
    """Weights; the leading axes of the recurrent ones are direction and gate (in, forget, out, new)."""

    embed: np.ndarray
    into: np.ndarray  # 2, 4, EMBED, HIDDEN
    again: np.ndarray  # 2, 4, HIDDEN, HIDDEN
    bias: np.ndarray  # 2, 4, 1, HIDDEN
    out: np.ndarray  # 2, HIDDEN, TAGS
    shift: np.ndarray
    moves: np.ndarray  # TAGS, TAGS

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.into, self.again, self.bias, self.out, self.shift, self.moves]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each character class adds to the gates, and the recurrent weights; in, forget and out with their slope and middle."""
        table = np.matmul(self.embed, self.into) + self.bias
        again = self.again.copy()
        table[:, :3] = 0.25 * table[:, :3] + 0.5
        again[:, :3] *= 0.25
        return np.ascontiguousarray(table), again

    def scores(self, x: np.ndarray, length: np.ndarray, tables: tuple[np.ndarray, np.ndarray], trace: list | None = None) -> np.ndarray:
        """Tag scores (rows, time, TAGS) of char classes (rows, time); those past a row's length are 0. trace: gets what the gradient needs.

        The direction backwards begins at each row's own end, so a row's scores don't depend on its batch.
        """
        n, time = x.shape
        table, again = tables
        kind = table.dtype
        turn = _mirror(length, time)
        both = np.stack([x.T, np.take_along_axis(x, turn, 1).T]).astype(np.intp)
        h, c = np.zeros((2, n, _HIDDEN), kind), np.zeros((2, n, _HIDDEN), kind)
        z, more = np.empty((2, 4, n, _HIDDEN), kind), np.empty((2, 4, n, _HIDDEN), kind)
        hs = np.empty((time, 2, n, _HIDDEN), kind)
        for t in range(time):
            for d in range(2):
                np.take(table[d], both[d, t], axis=1, out=z[d], mode="clip")
            np.matmul(h[:, None], again, out=more)
            z += more
            if trace is not None:
                raw, before = z.copy(), c.copy()
            np.clip(z[:, :3], 0, 1, out=z[:, :3])
            np.clip(z[:, 3], -1, 1, out=z[:, 3])
            if trace is not None:
                gates = z.copy()
            c *= z[:, 1]
            z[:, 0] *= z[:, 3]
            c += z[:, 0]
            np.clip(c, -1, 1, out=hs[t])
            hs[t] *= z[:, 2]
            if trace is not None:
                trace.append((h, before, raw, gates, c.copy()))
            h = hs[t]
        ahead, back = hs[:, 0] @ self.out[0], hs[:, 1] @ self.out[1]
        ahead += back[::-1] if (length == time).all() else back[turn.T, np.arange(n)[None, :]]
        ahead += self.shift
        ahead[np.arange(time)[:, None] >= length[None, :]] = 0
        if trace is not None:
            trace.append((both, hs, turn))
        return ahead.transpose(1, 0, 2)

    def decode(self, x: np.ndarray, length: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The best tags (rows, time) by Viterbi; inside tags follow their own kind only, other spans "none" only, and "none" follows the end.

        The best score is found first, as what it is above that of "none" throughout; only rows where it is more are traced back.
        """
        scores = self.scores(x, length, self.tables() if tables is None else tables)
        n, time = x.shape
        over = np.ascontiguousarray((scores[:, :, 1:] - scores[:, :, :1]).transpose(1, 2, 0))  # time, tag, rows
        moves = self.moves - self.moves[0, 0]
        enter, stay, on = (moves[k, j][:, None] for k, j in ((0, _BEGIN), (_BEGIN, _INSIDE), (_INSIDE, _INSIDE)))
        from_begin, from_inside = moves[_BEGIN, 0][:, None], moves[_INSIDE, 0][:, None]
        first = np.zeros((len(KINDS), 1), np.float32)
        past = np.arange(time)[:, None] >= length[None, :]
        none = np.zeros(n, np.float32)
        begin, inside = np.full((len(KINDS), n), -1e4, np.float32), np.full((len(KINDS), n), -1e4, np.float32)
        uneven = bool(past.any())
        for t in range(time):
            newer = np.maximum(begin + stay, inside + on)
            newer += over[t, 1::2]
            np.maximum(begin + from_begin, inside + from_inside, out=begin)
            none = np.maximum(none, begin.max(axis=0))
            # a span at the start of the window follows nothing
            begin = over[t, 0::2] + (enter + none if t else first)
            if uneven:
                begin[:, past[t]] = newer[:, past[t]] = -1e4
            inside = newer
        none = np.maximum(none, np.maximum(begin + from_begin, inside + from_inside).max(axis=0))
        tags = np.zeros(x.shape, np.int8)
        live = np.flatnonzero(none > 0)
        if len(live):
            tags[live] = self.search(scores[live], length[live])
        return tags

    def search(self, scores: np.ndarray, length: np.ndarray) -> np.ndarray:
        """decode() of given scores."""
        n, time, _ = scores.shape
        scores = _closed(scores, length)
        best, back = scores[:, 0] + _START, np.zeros((time, n, _TAGS), np.int8)
        moves = (self.moves + _ALLOWED).T
        for t in range(1, time):
            s = best[:, None, :] + moves[None]
            back[t] = s.argmax(axis=2)
            best = s.max(axis=2) + scores[:, t]
        tags = np.empty((n, time), np.int8)
        tags[:, -1] = (best + (self.moves + _ALLOWED)[:, 0]).argmax(axis=1)
        for t in range(time - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


def _closed(scores: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Scores that admit only "none" past each row's length."""
    out = scores.copy()
    past = np.arange(scores.shape[1])[None, :] >= length[:, None]
    out[past] = -1e4
    out[past, 0] = 0
    return out


_ALLOWED = np.zeros((_TAGS, _TAGS), np.float32)
_START = np.zeros(_TAGS, np.float32)
_BEGIN, _INSIDE = np.arange(1, _TAGS, 2), np.arange(2, _TAGS, 2)
_ALLOWED[1:, _BEGIN] = -1e4
_ALLOWED[:, _INSIDE] = -1e4
_ALLOWED[_BEGIN, _INSIDE] = _ALLOWED[_INSIDE, _INSIDE] = 0
_START[_INSIDE] = -1e4

def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        # spans that touch would need a transition that isn't admitted
        if not out[max(0, start - 1) : end + 1].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    out, t = [], 0
    while t < len(tags):
        if tags[t]:
            kind, end = (int(tags[t]) - 1) // 2, t + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            out.append((t, kind, end))
            t = end
        else:
            t += 1
    return out


def crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients by scores and moves, by forward and backward sums."""
    n, time, k = scores.shape
    moves = moves + _ALLOWED
    norm = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    ahead = np.empty((time, n, k))
    ahead[0] = scores[:, 0] + _START
    for t in range(1, time):
        ahead[t] = norm(ahead[t - 1][:, :, None] + moves[None], 1) + scores[:, t]
    behind = np.zeros((time, n, k))
    for t in range(time - 2, -1, -1):
        behind[t] = norm(moves[None] + (scores[:, t + 1] + behind[t + 1])[:, None, :], 2)
    total = norm(ahead[-1], 1)
    by_score = np.exp(ahead + behind - total[None, :, None]).transpose(1, 0, 2)
    by_move = np.zeros((k, k))
    for t in range(1, time):
        by_move += np.exp(ahead[t - 1][:, :, None] + moves[None] + (scores[:, t] + behind[t])[:, None, :] - total[:, None, None]).sum(axis=0)
    rows = np.arange(n)[:, None]
    gold = scores[rows, np.arange(time)[None, :], tags].sum() + moves[tags[:, :-1], tags[:, 1:]].sum()
    by_score[rows, np.arange(time)[None, :], tags] -= 1
    np.add.at(by_move, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
    return float(total.sum() - gold) / n, (by_score / n).astype(np.float32), (by_move / n).astype(np.float32)


def fresh(seed: int) -> Tagger:
    r = np.random.default_rng(seed)
    w = lambda *s: r.normal(0, (1 / s[-2]) ** 0.5, s).astype(np.float32)
    bias = np.zeros((2, 4, 1, _HIDDEN), np.float32)
    bias[:, 1] = 1
    return Tagger(
        r.normal(0, 0.5, (_CHARS, _EMBED)).astype(np.float32), w(2, 4, _EMBED, _HIDDEN), w(2, 4, _HIDDEN, _HIDDEN), bias, w(2, _HIDDEN, _TAGS), np.zeros(_TAGS, np.float32), np.zeros((_TAGS, _TAGS), np.float32)
    )


def gradient(m: Tagger, x: np.ndarray, length: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients in the order of arrays(), by backpropagation through time."""
    trace: list = []
    scores = m.scores(x, length, m.tables(), trace)
    both, hs, turn = trace.pop()
    loss, ds, d_moves = crf_gradient(_closed(scores, length), m.moves, tags)
    n, time = x.shape
    kind = m.embed.dtype
    ds = ds.astype(kind)
    ds[np.arange(time)[None, :] >= length[:, None]] = 0
    turned = np.take_along_axis(ds, turn[:, :, None], 1)
    by_way = np.stack([ds, turned]).transpose(2, 0, 1, 3)  # time, direction, rows, tags
    d_out = np.einsum("tdnh,tdnk->dhk", hs, by_way, optimize=True)
    dhs = by_way @ m.out.transpose(0, 2, 1)
    _, again = m.tables()
    d_again, d_table = np.zeros_like(m.again), np.zeros((2, 4, _CHARS, _HIDDEN), kind)
    dh, dc = np.zeros((2, n, _HIDDEN), kind), np.zeros((2, n, _HIDDEN), kind)
    slope = np.array([0.25, 0.25, 0.25, 1.0], kind)[None, :, None, None]
    for t in range(time - 1, -1, -1):
        h, before, raw, z, c = trace[t]
        i, f, o, g = (z[:, k] for k in range(4))
        dh = dh + dhs[t]
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.stack([dc * g, dc * before, dh * np.clip(c, -1, 1), dc * i], axis=1)
        # nothing passes where a function is flat
        dz[:, :3] *= (raw[:, :3] > 0) & (raw[:, :3] < 1)
        dz[:, 3] *= np.abs(raw[:, 3]) < 1
        dh = np.matmul(dz, again.transpose(0, 1, 3, 2)).sum(axis=1)
        dz *= slope
        d_again += np.matmul(h[:, None].transpose(0, 1, 3, 2), dz)
        for d in range(2):
            np.add.at(d_table[d], (slice(None), both[d, t]), dz[d])
        dc = dc * f
    return loss, [
        np.einsum("dgch,dgeh->ce", d_table, m.into),
        np.einsum("ce,dgch->dgeh", m.embed, d_table),
        d_again,
        d_table.sum(axis=2, keepdims=True),
        d_out,
        ds.sum(axis=(0, 1)),
        d_moves,
    ]


def _made(r: np.random.Generator, words: list[str]) -> tuple[str, int | None]:
    """A made-up value in a writing that the patterns may not know, and its kind; kind None for what only looks like one.

    words: words of the texts, so that a name is not told by looking unlike them.
    """
    pick = lambda x: x[int(r.integers(len(x)))]
    word = lambda: pick(words) if words and r.random() < 0.6 else "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(r.integers(2, 10))))
    digits = lambda n: "".join(str(int(d)) for d in r.integers(0, 10, n))
    kind = int(r.integers(6))
    if kind == 0 or kind == 5:
        at, dot = pick(["@", " at ", " at ", " [at] ", "[at]", "(at)", " (at) ", " @ ", " AT "]), pick([".", ".", " dot ", " [dot] ", "(dot)", " . ", "[.]", " DOT "])
        name = word() + pick(["", ".", "_", "-"]) + pick([word(), digits(2)]) if r.random() < 0.6 else word()
        if pick([0, 0, 0, 1]):
            name += dot + word()
        return name + at + word() + dot + pick(["com", "org", "net", "de", "fr", "es", "io", "example" + dot + "com", "co" + dot + "uk"]), 0
    if kind == 1:
        return pick([".", " . ", "[.]", "(.)", " dot ", " [dot] ", "(dot)", ". "]).join(str(int(x)) for x in r.integers(1, 256, 4)), 1
    if kind == 2:
        body = pick("3456") + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        n, sep = body + last, pick(["", " ", "-", ".", "  ", "/", "_", " - ", ", "])
        return sep.join(n[i : i + 4] for i in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"00{pick('123456789')} {a} {b} {c}", f"00{pick('123456789')}{digits(1)}-{a}-{b}{c}", f"+{digits(2)}/{a}/{b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}/{b}-{c}"]
        return pick(forms), 3
    forms = [
        digits(16), digits(int(r.integers(1, 13))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"version {digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)}.{digits(2)}", f"look at {word()} dot", f"{word()} at {word()}",
        f"at {digits(1)} dot {digits(1)}", f"{word()} dot {word()}", f'"{"".join(pick("0123456789abcdef") for _ in range(40))}"', f"({digits(3)})", f"{digits(1)}, {digits(2)}, {digits(2)} and {digits(1)}", f"meet {word()} at {word()}. {word()}", f"{digits(4)} {digits(4)}",
    ]
    return pick(forms), None


def training_windows(texts: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Char classes, lengths and tags of windows: around labelled spans, around other digits and at signs, anywhere, and with made-up values set in."""
    r = np.random.default_rng(seed)
    xs, ls, ys = [], [], []
    labelled = [(t, base_spans(t)) for t in texts]
    real = [(k, s) for k, (_, spans) in enumerate(labelled) for s in spans]
    signs = re.compile(_SIGNS)
    other = [(k, m.start()) for k, (t, spans) in enumerate(labelled) for m in signs.finditer(t) if not any(a <= m.start() < b for a, _, b in spans)]
    words = sorted({w for t in texts[:500] for w in re.findall(r"\b[a-z]{2,10}\b", t[:4000])})
    labelled = labelled or [(".", [])]
    for i in range(count):
        kind = i % 6
        if kind == 0 and real:
            k, (a, _, b) = real[int(r.integers(len(real)))]
            text, spans, middle = *labelled[k], (a + b) // 2
        elif kind == 1 and other:
            k, middle = other[int(r.integers(len(other)))]
            text, spans = labelled[k]
        elif kind == 2:
            text, spans = labelled[int(r.integers(len(labelled)))]
            middle = int(r.integers(len(text) + 1))
        else:
            text, _ = labelled[int(r.integers(len(labelled)))]
            at = int(r.integers(len(text) + 1))
            at = text.rfind(" ", 0, at) + 1
            value, what = _made(r, words)
            text = text[max(0, at - TRAIN) : at] + value + (" ", ". ", ", ", "\n")[int(r.integers(4))] + text[at : at + TRAIN]
            start = min(at, TRAIN)
            end = start + len(value)
            if what is None:
                spans = base_spans(text)
            else:
                # the text around may hold spans of its own; those that overlap the value give way
                spans = [(start, what, end), *(s for s in base_spans(text) if s[2] <= start or s[0] >= end)]
            middle = start + len(value) // 2
        lo = max(0, middle - TRAIN // 2 + int(r.integers(-24, 25)))
        part = text[lo : lo + TRAIN]
        x = np.full(TRAIN, _OUTSIDE)
        x[: len(part)] = char_codes(part)
        y = np.zeros(TRAIN, np.int64)
        y[: len(part)] = tags_of(len(text), spans)[lo : lo + TRAIN]
        # a span cut by the window's start begins there
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1
        xs.append(x)
        ls.append(max(1, len(part)))
        ys.append(y)
    return np.array(xs), np.array(ls), np.array(ys)


def train(texts: list[str], windows: int = 8000, steps: int = 700, batch: int = 48, seed: int = 9) -> Tagger:
    """Adam with clipped gradients."""
    x, length, y = training_windows(texts, windows, seed)
    m, r = fresh(seed), np.random.default_rng(seed)
    p = m.arrays()
    a, b = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, steps + 1):
        rows = r.integers(0, len(x), batch)
        _, grads = gradient(m, x[rows], length[rows], y[rows])
        size = sum(float((g * g).sum()) for g in grads) ** 0.5
        rate = 0.015 * min(1.0, 2.5 * (1 - step / (steps + 1)))
        for k, g in enumerate(grads):
            g = g * min(1.0, 5 / (size + 1e-9))
            a[k] = 0.9 * a[k] + 0.1 * g
            b[k] = 0.99 * b[k] + 0.01 * g * g
            p[k] -= (rate * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return m


_TOKEN = re.compile(r"[\w%+-]+|\S")
#: A name, one at sign and a domain with a dot: words w, dots d and at signs a.
_MAIL = re.compile(r"w(?:dw)*aw(?:dw)+")


def _mail(value: str) -> bool:
    """Whether a span is an e-mail address in some writing: brackets and white space aside, words, dots and one at sign, spelled out or not."""
    signs = []
    for token in _TOKEN.findall(value):
        low = token.lower()
        if low in ("at", "@"):
            signs.append("a")
        elif low in ("dot", "."):
            signs.append("d")
        elif token[0].isalnum() or token[0] in "_%+-":
            signs.append("w")
        elif token not in "[](){}<>":
            return False
    return _MAIL.fullmatch("".join(signs)) is not None


def _plausible(text: str, span: Span) -> bool:
    """An added span holds what its kind cannot do without."""
    value = text[span[0] : span[2]]
    n = len(_DIGITS.findall(value))
    if span[1] == 0:
        return _mail(value)
    if span[1] == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(map(_byte, parts))
    if span[1] == 2:
        return 14 <= n <= 19 and luhn("".join(_DIGITS.findall(value)))
    return 10 <= n <= 15 and not any(c.isalpha() for c in value)


def reconcile(spans: set[Span]) -> list[Span]:
    """The spans that don't overlap and cover the most characters."""
    order = sorted(spans, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in order]
    best: list[tuple[int, int | None, int]] = [(0, None, 0)]
    for i, s in enumerate(order):
        j = bisect.bisect_right(ends, s[0], 0, i)
        take = best[j][0] + s[2] - s[0]
        best.append((take, i, j) if take > best[i][0] else (best[i][0], None, i))
    out, at = [], len(order)
    while at:
        _, i, j = best[at]
        if i is not None:
            out.append(order[i])
        at = j
    return out[::-1]


def joined(cut: list[tuple[int, int, int, bool, bool]]) -> set[Span]:
    """Whole spans from those that windows cut, (start, kind, end, at the window's start, at its end): parts of one kind that overlap or touch are one.

    What has no other end in any window is left out.
    """
    out: set[Span] = set()
    for kind in range(len(KINDS)):
        run: list | None = None
        for a, _, b, left, right in [*sorted(c for c in cut if c[1] == kind), (1 << 62, kind, 1 << 62, True, True)]:
            if run and a <= run[1]:
                # an end that a neighbour's part lies beyond is not the span's end
                run[2] = left if a == run[0] and not left else run[2]
                run[3] = right if b > run[1] else run[3] and right if b == run[1] else run[3]
                run[1] = max(run[1], b)
                continue
            if run and not run[2] and not run[3]:
                out.add((run[0], kind, run[1]))
            run = [a, b, left, right]
    return out


def windows_of(length: int) -> range:
    """Where the windows of a text of so many characters begin."""
    return range(0, max(1, length - OVERLAP), WINDOW - OVERLAP)


def marked(model: Tagger, codes: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, set[Span]]:
    """The spans that the network finds in each text that has any, before they are reconciled."""
    tables = model.tables() if tables is None else tables
    sizes = np.diff(offsets)
    counts = np.array([len(windows_of(int(n))) if n else 0 for n in sizes], np.int64)
    of = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * (WINDOW - OVERLAP)
    length = np.minimum(WINDOW, sizes[of] - start)
    whole: dict[int, set[Span]] = {}
    cut: dict[int, list] = {}
    padded = np.concatenate([codes, np.full(WINDOW, _OUTSIDE, np.uint8)])
    # windows of about one length are read together
    order = np.argsort(length, kind="stable")
    for lo in range(0, len(order), _BATCH):
        rows = order[lo : lo + _BATCH]
        size = length[rows]
        time = int(size[-1])
        x = padded[(offsets[of[rows]] + start[rows])[:, None] + np.arange(time)[None, :]]
        x[np.arange(time)[None, :] >= size[:, None]] = _OUTSIDE
        tags = model.decode(x, size, tables)
        for i in np.flatnonzero(tags.any(axis=1)):
            k, a, n = int(of[rows[i]]), int(start[rows[i]]), int(size[i])
            for s, kind, e in spans_of(tags[i, :n]):
                left, right = s == 0 and a > 0, e == n and a + n < sizes[k]
                if left or right:
                    cut.setdefault(k, []).append((a + s, kind, a + e, left, right))
                whole.setdefault(k, set()).update([] if left or right else [(a + s, kind, a + e)])
    for k, parts in cut.items():
        # a whole span may be the rest of one that a neighbour cut
        whole[k] |= joined([*parts, *((a, kind, b, False, False) for a, kind, b in whole[k])])
    return whole


def find(model: Tagger, texts: pa.Array, tables: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    texts = texts.fill_null("")
    signs = pc.match_substring_regex(texts, _SIGNS).to_numpy(zero_copy_only=False)
    added = marked(model, *codes_of(*bytes_of(texts)), tables)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    live = sorted({*np.flatnonzero(signs).tolist(), *added})
    for k, text in zip(live, texts.take(pa.array(live, pa.int64())).to_pylist()):
        base = base_spans(text)
        free = {s for s in apart(added.get(k, set()), base) if _plausible(text, s)}
        out[k] = base, sorted(reconcile(free))
    return out


def apart(spans: set[Span], base: list[Span]) -> list[Span]:
    """The spans that overlap none of base."""
    starts = [b[0] for b in base]
    # how far the base spans up to each reach
    reach = list(accumulate((b[2] for b in base), max))
    out = []
    for s in spans:
        before = bisect.bisect_left(starts, s[2])
        if not before or reach[before - 1] <= s[0]:
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """Train on those of the ``most`` documents of least hash of their id that hold a digit or an at sign; of each PART characters."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = own.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.length("text") - PART + 1, F.lit(1))).cast("int")
    rows = (
        own.join(F.broadcast(ids), "id", "left_semi")  # at most ``most`` ids
        .where(F.col("text").rlike(_SIGNS))
        .groupBy("id")
        .agg(F.min("text").alias("text"))
        .select("id", F.substring(F.col("text"), place + 1, F.lit(PART)).alias("text"))
        .orderBy("id")
        .toPandas()
    )
    return train(rows["text"].tolist())


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame, most: int = 2000) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and the number of added ones."""
    model = fit(docs, most)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                got = find(model, batch.column(1).slice(lo, hi - lo), tables)
                counts = [pa.array([sum(s[1] == k for s in b) for b, _ in got], pa.int64()) for k in range(len(KINDS))]
                sha = [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got]
                spans = [written(b + a) for b, a in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *counts, pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(a) for _, a in got], pa.int64())], names
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact_documents(docs: DataFrame, most: int = 2000) -> DataFrame:
    """docs with all spans redacted in text, and n_chars, if there, counted anew for texts that changed; a null text stays null."""
    model = fit(docs, most)
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                got = find(model, part.column(text), tables)
                changed = [k for k, (b, a) in enumerate(got) if b or a]
                columns = part.columns
                if changed:
                    texts = part.column(text).to_pylist()
                    counts = part.column(n_chars).to_pylist() if n_chars is not None else None
                    for k in changed:
                        texts[k] = redact(texts[k], [*got[k][0], *got[k][1]])
                        if counts is not None:
                            counts[k] = len(texts[k])
                    columns[text] = pa.array(texts, columns[text].type)
                    if counts is not None:
                        columns[n_chars] = pa.array(counts, columns[n_chars].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
