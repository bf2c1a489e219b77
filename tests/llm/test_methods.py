"""The methods themselves on small inputs, without Spark."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketlab.llm import minhash, mixing, packing, private, quality, toxicity
from marketlab.llm._words import Words, bytes_of, mix, ngrams, slices
from marketlab.llm.substrings import levels, sliding_min

ODD = ["", None, "  a  b\tc\nd ", "é à\x0bb", "x" * 9000 + " y", "one"]


def test_words_are_runs_of_other_bytes():
    w = Words(pa.array(ODD))
    got = [[w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(ODD))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in ODD]
    assert len(set(w.hashes().tolist())) == len({x for g in got for x in g})
    part = Words(pa.array(ODD).slice(2, 3))
    assert part.hashes().tolist() == w.hashes()[w.first[2] : w.first[5]].tolist()
    assert list(slices(pa.array(["a", "bb" * 50, None, "c"]), 10)) == [(0, 1), (1, 2), (2, 4)]
    assert bytes_of(pa.array([], pa.string()))[1].tolist() == [0]


def test_ngrams_are_functions_of_their_words_and_depend_on_order():
    h = mix(np.arange(40, dtype=np.uint64))
    twice = np.concatenate([h, h])
    for n in (1, 5, 9, 35):
        g = ngrams(twice, n)
        assert len(g) == 81 - n and (g[: 41 - n] == g[40 : 81 - n]).all()
        assert n == 1 or ngrams(h[::-1].copy(), n)[0] != ngrams(h, n)[-1]


def test_levels_double():
    assert levels(35) == [9, 18, 35] and levels(13) == [7, 13]
    x = np.array([5, 3, 4, 9, 1, 7])
    assert sliding_min(x, 3).tolist() == [3, 3, 1, 1]


def test_consistent_weighted_sampling_estimates_weighted_jaccard():
    r = np.random.default_rng(0)
    e = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    a = (e[:300], r.uniform(0.5, 8, 300))
    b = (e[60:360], np.concatenate([a[1][60:], r.uniform(0.5, 8, 60)]))
    salts = minhash._salts(3000)
    both = [np.concatenate(x) for x in zip(a, b)]
    got = minhash.sample(*both, np.array([0, 300, 600]), salts)
    assert (got[0] == got[1]).mean() == pytest.approx(minhash.weighted_jaccard(a, b), abs=0.03)
    # a text's samples don't depend on what stands beside it
    assert (minhash.sample(*b, np.array([0, 300]), salts[:50]) == got[1:, :50]).all()


def test_skipping_elements_changes_no_sample():
    r = np.random.default_rng(1)
    sizes = [1, 2, 200, 3, 1500]
    at = np.cumsum([0, *sizes])
    e, w, salts = np.concatenate([np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in sizes]), r.uniform(0.5, 8, at[-1]), minhash._salts(200)
    fast = minhash.sample(e, w, at, salts)
    for j, salt in enumerate(salts):
        index = ((salt * e) >> np.uint64(44)).astype(np.int64)
        a, t = minhash._evaluate(e, np.log(w), index, salt)
        for d, (lo, hi) in enumerate(zip(at, at[1:])):
            k = lo + int(a[lo:hi].argmin())
            want = mix(np.array([e[k] + mix(np.array([np.int64(t[k])]).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))[0]]))[0]
            assert want == fast[d, j]


def test_packed_numbers_come_back():
    r = np.random.default_rng(2)
    s = np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (minhash.unpacked(minhash.packed(s)) == s).all() and len(minhash.unpacked(b"")) == 0
    for most in (5, 300, 1 << 40):
        n = r.integers(1, most, 50)
        n[0] = most
        assert (minhash.of_small(minhash.small(n), 50) == n).all()


def test_gapped_kernel_equals_enumeration():
    def brute(s, t):
        picks = lambda x: itertools.combinations(range(len(x)), toxicity.ORDER)
        return sum(toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2) for a in picks(s) for b in picks(t) if all(s[i] == t[j] for i, j in zip(a, b)))

    units, marks = ["^idiot$", "^i.d.iot$", "aaaaaa", "abc"], ["^idiot$", "abcabc"]
    exact = np.array([[brute(u, m) for m in marks] for u in units])
    assert np.allclose(toxicity.kernels(toxicity.letters(units), toxicity.letters(marks)), exact, atol=1e-6)
    weights = np.array([1.0, -2.0])
    assert np.allclose(toxicity.Folded(marks, weights).sums(units), (exact / toxicity._roots(marks)[None, :]) @ weights, atol=1e-5)


def insults(r, bad):
    words = ["".join(r.choice(list("aeioubcdlmnrst"), int(r.integers(3, 8)))) for _ in range(30)]
    return " ".join([*words[:15], *bad, *words[15:]]) + "."


def test_toxicity_learns_and_tolerates_gaps():
    r = np.random.default_rng(2)
    texts = [insults(r, ["grumpf"] if k % 2 else []) for k in range(200)]
    m = toxicity.fit(texts, np.array([k % 2 for k in range(200)], float))
    new = [insults(r, x) for x in (["grumpf"], ["grummpf!"], ["gr-u-mp-f"], ["grumpfen"], [], [], ["lamenta"])]
    s = toxicity.score_texts(m, pa.array([*new, "", None]).fill_null(""))
    assert (s[:4] > 0.7).all() and (s[4:] < 0.5).all()
    assert toxicity.score_texts(m, pa.array(["ba ta g r u m p f lo"]))[0] > 0.7
    spaced = toxicity.strings(pa.array(["so g r u m p f ends"]))[0]
    assert "g r u m p f" in spaced


def test_scores_of_texts_equal_unfolded_features():
    r = np.random.default_rng(12)
    texts = [insults(r, ["grumpf", "b.l.o.r.k"] if k % 2 else []) for k in range(120)]
    m = toxicity.fit(texts, np.array([k % 2 for k in range(120)], float))
    new = [*texts[:6], "", "a b", "G R U M P F ends.\nblork?", "supercalifragilisticexpialidocious grum-pfen", "é à grümpf"]
    want = []
    for t in new:
        units = sorted({u for x in toxicity.strings(pa.array([t]))[0] for u in toxicity.windows(x)})
        # the kernel with each landmark, their Nyström features, and the machine on those
        kernel = toxicity.kernels(toxicity.letters(units), toxicity.letters(m.landmarks)) if units else np.zeros((0, len(m.landmarks)))
        kernel = kernel / np.maximum(toxicity._roots(units), 1e-6)[:, None] / np.maximum(toxicity._roots(m.landmarks), 1e-6)[None, :]
        decision = kernel @ m.root @ m.weights + m.bias
        want.append(m.probability(max([m.bias, *decision])))
    assert np.allclose(toxicity.score_texts(m, pa.array(new)), want, atol=1e-4)


def test_sentences_and_runs():
    found, codes, text, sentence = toxicity.strings(pa.array(["One two. Three f o u r!\nfive", None, "s i\nx y z", "end"]).fill_null(""))
    said = {}
    for c, t, j in zip(codes, text, sentence):
        said.setdefault((int(t), int(j)), set()).add(found[c])
    assert list(said.values()) == [{"one", "two"}, {"three", "f", "o", "u", "r", "f o u r!"}, {"five"}, {"s", "i"}, {"x", "y", "z", "x y z"}, {"end"}]


def test_toxicity_with_one_label():
    m = toxicity.fit(["a b c"], np.zeros(1))
    assert toxicity.score_texts(m, pa.array(["x"]))[0] < 1e-6
    assert toxicity.fit([], np.zeros(0)).landmarks


def test_quality_learns_and_scoring_equals_a_plain_convolution():
    r = np.random.default_rng(3)
    good = ["".join(r.choice(list("abcdefgh ")) for _ in range(300)) for _ in range(60)]
    bad = ["".join(r.choice(list("ABC!!$ ")) for _ in range(300)) for _ in range(60)]
    texts, y = [t.encode() for t in good + bad], np.array([1.0] * 60 + [0.0] * 60)
    n = quality.fit(texts, y, steps=60)
    odd = ["", good[0], bad[0] * 5, "a", good[1] * 9, None]
    s = n.score(*bytes_of(pa.array(odd)), n.tables())
    assert s[1] > 0.5 > s[2] and np.isfinite(s).all() and s[0] == s[5]

    def plain(t):
        b = np.frombuffer(t + b"\0" * 5, np.uint8)
        e = n.embed[b]
        resp = sum(e[j : j + len(t)] @ n.conv[j] for j in range(quality.WIDTH))
        pools = np.array([np.maximum(resp[c : c + quality.CHUNK].max(0) + n.bias, 0) for c in range(0, len(t), quality.CHUNK)])
        return 1 / (1 + np.exp(-(np.concatenate([pools.mean(0), pools.max(0)]) @ n.out + n.shift)))

    for k in (1, 2, 3, 4):
        assert s[k] == pytest.approx(plain(odd[k].encode()), abs=1e-4)
    assert quality.fit([], np.zeros(0)).shift == pytest.approx(0.0)


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and private.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_their_patterns():
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("ab1205.@+-() 3é"), 60)) for _ in range(4000)]
    texts += ["a@b.c@d.e", "4111 1111 1111 1111", "+1 (555) 123-4567.", "é 1.2.3.4.5.6.7.8", "", "1" * 3000 + ".1.1.1", "x@y", "0" * 5000 + "1.1.1.1", "1.1.1." + "0" * 5000]
    assert all(private.base_spans(t) == brute_spans(t) for t in texts)


def test_crf_gradient_and_tagger():
    m = private.Tagger(*[w.astype(np.float64) for w in private.fresh(1).arrays()])
    x, length, y = private.training_windows(["write to a.b@c.de or 10.0.0.1 now " * 3, "short"], 8, 1)
    _, grads = private.gradient(m, x, length, y)
    r = np.random.default_rng(2)
    for w, g in zip(m.arrays(), grads):
        for _ in range(4):
            i = tuple(int(r.integers(n)) for n in w.shape) if w is not m.embed else (int(x[0, r.integers(40)]), 1)
            old = w[i]
            w[i] = old + 1e-5
            up = private.gradient(m, x, length, y)[0]
            w[i] = old - 1e-5
            down = private.gradient(m, x, length, y)[0]
            w[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i], abs=1e-3)


def test_decoding_equals_all_paths_and_does_not_depend_on_the_batch():
    r = np.random.default_rng(3)
    m = private.fresh(2)
    m.out *= 6
    m.moves += r.normal(0, 1, m.moves.shape).astype(np.float32)
    m.shift[0] = 2.5
    x, length = r.integers(0, 130, (60, 5)), r.integers(1, 6, 60)
    got = m.decode(x, length)
    scores = m.scores(x, length, m.tables())
    moves = m.moves + private._ALLOWED
    found = 0
    for k, n in enumerate(length):
        best = max(
            itertools.product(range(9), repeat=int(n)),
            key=lambda p: private._START[p[0]] + sum(scores[k, t, c] for t, c in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) + moves[p[-1], 0],
        ) if n <= 3 else None
        if best is not None:
            assert got[k, :n].tolist() == list(best)
            found += any(best)
        alone = m.decode(x[k : k + 1, :n], length[k : k + 1])
        assert (alone[0] == got[k, :n]).all() and not got[k, n:].any()
    # rows that are not traced back are those whose best path is "none" throughout
    assert (m.search(scores, length) == got).all() and 3 < found < 60


def test_windows_meet_and_cut_spans_are_joined():
    for n in (0, 1, 64, 65, 447, 448, 449, 832, 833, 10_000):
        starts = list(private.windows_of(n))
        assert starts[0] == 0 and starts[-1] + private.WINDOW >= n and all(b - a == private.WINDOW - private.OVERLAP for a, b in zip(starts, starts[1:]))
    assert private.joined([(190, 0, 256, False, True), (192, 0, 300, True, False)]) == {(190, 0, 300)}
    assert private.joined([(190, 0, 256, False, True), (192, 0, 448, True, True), (384, 0, 500, True, False)]) == {(190, 0, 500)}
    assert private.joined([(190, 0, 256, False, True), (192, 1, 300, True, False)]) == set()
    assert private.joined([(5, 2, 20, False, False)]) == {(5, 2, 20)}


@pytest.fixture(scope="module")
def tagger():
    r = np.random.default_rng(6)
    prose = lambda: " ".join("".join(r.choice(list("aeioubcdlmnrst"), int(r.integers(2, 9)))) for _ in range(60))
    texts = [f"{prose()}. Write to {prose()[:6].strip()}.x@mail{k}.org, 10.{k}.0.{k % 9} or +4930123456{k % 10}{k % 7} {prose()}" for k in range(60)]
    return private.train(texts), prose, r


def test_the_network_adds_spans_of_each_kind_and_few_others(tagger):
    model, prose, r = tagger
    hit, asked, wrong = Counter(), Counter(), 0
    for _ in range(600):
        value, kind = private._made(r, prose().split())
        before, after = prose(), prose()
        text = f"{before * int(r.integers(1, 4))} {value} {after}"
        at = text.rindex(f" {value} {after}") + 1
        (base, added), = private.find(model, pa.array([text]))
        here = [s for s in [*base, *added] if s[0] < at + len(value) and at < s[2]]
        wrong += len(added) - len([s for s in added if s in here]) + (kind is None and any(s in added for s in here))
        if kind is not None and not any(s in base for s in here):
            asked[kind] += 1
            hit[kind] += any(s[1] == kind for s in added if s in here)
    assert all(hit[k] >= 0.8 * asked[k] and asked[k] > 20 for k in range(4)) and wrong <= 12


def test_spans_do_not_depend_on_where_windows_begin(tagger):
    model, prose, r = tagger
    value = "someone [at] example dot org"
    found = 0
    for shift in range(330, 470, 7):
        text = ((prose() + " ") * 6)[:shift] + " " + value + " " + prose()
        (base, added), = private.find(model, pa.array([text]))
        found += (shift + 1, 0, shift + 1 + len(value)) in added
    assert found >= 17
    assert private.find(model, pa.array(["", None, "x"])) == [([], [])] * 3


def test_added_spans_apart_from_base_and_plausible_in_bounded_time():
    r = np.random.default_rng(8)
    for _ in range(200):
        base = sorted((int(a), 0, int(a + n)) for a, n in zip(r.integers(0, 100, 5), r.integers(1, 20, 5)))
        spans = {(int(a), 1, int(a + n)) for a, n in zip(r.integers(0, 100, 20), r.integers(1, 20, 20))}
        assert set(private.apart(spans, base)) == {s for s in spans if not any(s[0] < b[2] and b[0] < s[2] for b in base)}
    for text in ("a" + " " * 20_000 + "at" + " " * 20_000 + "b . c", "at " * 20_000, "a.dot " * 20_000, "dot " * 60 + "at" + " dot" * 60, "a-dot-" * 60, "At.At-dot." * 5000):
        private._plausible(text, (0, 0, len(text)))
    assert private._plausible("jo  [at]   x (dot) org", (0, 0, 22)) and not private._plausible("jo at home", (0, 0, 10))


def test_reconcile_covers_the_most_without_overlap():
    spans = {(0, 0, 5), (4, 1, 10), (5, 1, 8), (9, 2, 12)}
    got = private.reconcile(spans)
    assert all(a[2] <= b[0] for a, b in zip(got, got[1:])) and sum(b - a for a, _, b in got) == 11
    assert private.redact("mail a@b.c now", [(5, 0, 10)]) == "mail [EMAIL] now"


def test_min_cost_flow_repeats_as_little_as_it_must():
    flow = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [15.0, 5.0])
    assert sum(flow[0].values()) == pytest.approx(10) and sum(flow[1].values()) == pytest.approx(10)
    flow = mixing.min_cost_flow([10, 4], [[0], [1]], [5.0, 9.0])
    assert flow[0] == pytest.approx({0: 5}) and flow[1] == pytest.approx({1: 9})
    # the shared pattern goes where it spares a repetition
    flow = mixing.min_cost_flow([4, 4], [[0, 1], [0]], [4.0, 4.0])
    assert flow[0].get(1, 0) == pytest.approx(4) and flow[1][0] == pytest.approx(4)
    assert mixing.min_cost_flow([], [], []) == [] and mixing.min_cost_flow([3], [[]], [2.0]) == [{}]


def repetition(give, size):
    return sum(n * min(max(give - n * size, 0), size) for n in range(1, 3))


def test_min_cost_flow_is_the_best_of_all():
    r = np.random.default_rng(9)
    for _ in range(60):
        sizes = r.integers(0, 3, 3).tolist()
        members = [sorted(set(r.integers(0, 2, 2).tolist())) for _ in sizes]
        quotas = r.integers(0, 6, 2).tolist()
        edges = [(p, s) for p, own in enumerate(members) for s in own]
        best = None
        for f in itertools.product(*[range(quotas[s] + 1) for _, s in edges]):
            give, got = [0] * 3, [0] * 2
            for (p, s), x in zip(edges, f):
                give[p] += x
                got[s] += x
            if all(g <= 3 * z for g, z in zip(give, sizes)) and all(g <= q for g, q in zip(got, quotas)):
                key = (-sum(f), sum(repetition(g, z) for g, z in zip(give, sizes)))
                best = key if best is None else min(best, key)
        flow = mixing.min_cost_flow(sizes, members, [float(q) for q in quotas])
        give = [sum(f.values()) for f in flow]
        got = [sum(f.get(s, 0) for f in flow) for s in range(2)]
        assert all(set(f) <= set(m) for f, m in zip(flow, members)) and all(g <= 3 * z + 1e-6 for g, z in zip(give, sizes)) and all(g <= q + 1e-6 for g, q in zip(got, quotas))
        assert (-sum(give), sum(repetition(g, z) for g, z in zip(give, sizes))) == pytest.approx(best, abs=1e-6)


def test_min_cost_flow_of_many_patterns():
    r = np.random.default_rng(10)
    n, m = 20_000, 300
    members = [r.choice(m, int(r.integers(1, 4)), replace=False).tolist() for _ in range(n)]
    sizes = r.integers(1, 1000, n).tolist()
    quotas = (r.uniform(0.2, 2, m) * sum(sizes) / m).tolist()
    flow = mixing.min_cost_flow(sizes, members, quotas)
    got = np.zeros(m)
    for f in flow:
        for s, x in f.items():
            got[s] += x
    assert np.allclose(got, quotas, rtol=1e-6) and all(sum(f.values()) <= 3 * z + 1e-6 for f, z in zip(flow, sizes))


@pytest.mark.parametrize("seed", range(4))
def test_packing_places_every_id_once_without_padding(seed):
    r = np.random.default_rng(seed)
    docs = [(k, int(n)) for k, n in enumerate(r.integers(1, 3000, 200))]
    windows, left = packing.pack(docs, (1024, 512, 256, 128), True)
    assert not left
    covered = {}
    for w in windows:
        total = sum(p[0] for p in w)
        assert total <= 1024 and total & (total - 1) == 0
        for n, k, s in w:
            covered.setdefault(k, []).append((s, n))
    for k, n in docs:
        pieces = sorted(covered[k])
        assert [s for s, _ in pieces] == list(np.cumsum([0, *[m for _, m in pieces]])[:-1]) and sum(m for _, m in pieces) == n
    steps = packing.balance(windows, 16 * 1024)
    per = np.bincount(steps, weights=[sum(p[0] for p in w) for w in windows])
    assert per.max() <= 1.1 * 16 * 1024


def test_packing_holds_back_what_does_not_fill_a_window():
    windows, left = packing.pack([(0, 100)], (128, 64), False)
    assert windows == [] and left == [(100, 0, 0)]


def test_encoder_equals_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from marketlab.llm._tokens import Encoder

    e = Encoder(P.path("byte_bpe_50k.json"))
    odd = ["", "a  b  c\n\nd 's don't\n é é  é　 x   y <|endoftext|> z<|endoftext|>q", "  lead", "trail  ", "\n", "a\n b \nc\td", " ", "x  y", "é\nà    ü", "a\x1c b", "a\x85 b  \x85c", "日本 語"]
    r = np.random.default_rng(5)
    odd += ["".join(r.choice(list("ab é\n\t'sD1.  "), 40)) for _ in range(500)]
    ids, at = e.encode(pa.array(odd))
    assert all(e.tokenizer.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist() for k, t in enumerate(odd))
    slow = Encoder(P.path("byte_bpe_50k.json"))
    slow.fast = None
    assert (slow.encode(pa.array(odd[:60]))[0] == ids[: at[60]]).all()
