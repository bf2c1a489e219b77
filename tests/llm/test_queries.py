"""The operators on small tables with nulls, empties, ties, repeats and long texts, against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlab.llm import chats, hamming, minhash, mixing, neighbours, packing, private, quality, toxicity
from marketlab.llm._graph import components
from marketlab.llm._spark import Scratch
from marketlab.llm._words import Words
from marketlab.llm.substrings import remove_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=40):
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), int(r.integers(2, 7))))
    base = [" ".join(word() for _ in range(int(r.integers(1, 160)))) for _ in range(n)]
    passage = " ".join(word() for _ in range(60))
    base[3] = base[2]
    base[5] = base[4] + " " + passage
    base[6] = passage + " " + base[6]
    base[7] = " ".join([passage, "x", passage])
    edited = base[8].split(" ")
    edited[0] = "changed"
    base[9] = " ".join(edited)
    base[10], base[11], base[12], base[13], base[14] = "", "", None, " \t", passage * 40
    base[15] = "two words"
    base[16] = "two words"
    return base


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(rows)], DOCS)


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, k) for k in range(1900, 1950)] + [(5, 5)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_substrings(spark):
    rows = texts()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(frame(spark, rows).withColumn("id", F.lit("clash")), 35).collect()}
    assert got == dict(enumerate(without_repeats(rows)))
    assert remove_repeats(frame(spark, rows).limit(0)).count() == 0


def without_repeats(rows, window=35):
    """(n_words, n_removed, kept_sha256) of each text."""
    words = [WORD.findall(t or "") for t in rows]
    count = Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                keep[s : s + window] = [False] * window
        out.append((len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep) if y).encode()).hexdigest()))
    return out


def test_substrings_of_repeated_rows(spark):
    t = texts()
    rows = [(1, t[5]), (1, t[6]), (1, t[6]), (2, t[7]), (None, t[20]), (None, t[7]), (3, None), (3, "a b"), (3, t[21] + " " + t[22])]
    df = spark.createDataFrame([(k, x, "en", "s", n) for n, (k, x) in enumerate(rows)], DOCS)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df.repartition(3), 35).collect())
    assert got == Counter((k, *w) for (k, _), w in zip(rows, without_repeats([x for _, x in rows])))


def brute_groups(rows, words=5, threshold=0.8):
    """The least index that each text reaches by links, all pairs compared; null links with nothing."""
    parts = [minhash.shingles(Words(pa.array([t or ""])).hashes(), words) for t in rows]
    live = [k for k, t in enumerate(rows) if t is not None]
    every, n = np.unique(np.concatenate([parts[k][0] for k in live] or [np.zeros(0, np.uint64)]), return_counts=True)
    w = [(s, tf * minhash.idf(n[np.searchsorted(every, s)], len(live)) if t is not None else tf) for (s, tf), t in zip(parts, rows)]
    label = list(range(len(rows)))
    for a, b in combinations(live, 2):
        if label[a] != label[b] and (rows[a] == rows[b] or minhash.weighted_jaccard(w[a], w[b]) >= threshold):
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    return label


def test_minhash(spark):
    rows = texts()
    got = {r.doc_id: (r.group_id, r.group_size, r.kept) for r in minhash.near_duplicates(frame(spark, rows).withColumns({"total": F.lit(1), "node": F.lit(2), "sha": F.lit("x")})).collect()}
    label = brute_groups(rows)
    size = Counter(label)
    assert got == {k: (g, size[g], k == g) for k, g in enumerate(label)}
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    nothing = frame(spark, [None, "", " \t", ""])
    assert sorted((r.doc_id, r.group_id, r.kept) for r in minhash.near_duplicates(nothing).collect()) == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 1, False)]


def repeated(spark):
    """Rows of one id with equal and with different texts, and null ids."""
    t = texts()
    rows = [(1, t[20]), (1, t[20]), (1, t[21]), (2, t[20]), (3, t[22]), (None, t[22]), (None, t[23]), (4, None), (4, None), (5, t[9]), (6, t[8]), (6, t[8]), (None, t[24]), (None, t[24])]
    return rows, spark.createDataFrame([(k, x, "en", f"s{n}", n) for n, (k, x) in enumerate(rows)], DOCS)


def test_minhash_of_repeated_rows(spark):
    rows, df = repeated(spark)
    got = Counter(tuple(r) for r in minhash.near_duplicates(df).collect())
    n = None
    assert got == Counter(
        [(1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), (1, 1, 1, True), (3, 3, 2, True), (n, 3, 2, False), (n, n, 1, True), (4, 4, 1, True), (4, 4, 1, True)]
        + [(5, 5, 3, True), (6, 5, 3, False), (6, 5, 3, False), (n, n, 2, True), (n, n, 2, False)]
    )
    kept = minhash.deduplicate(df.withColumn("n", F.lit(7)).withColumn("sha", F.lit("x")))
    assert kept.columns == [*df.columns, "n", "sha"]
    t = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
    assert Counter(t) == Counter([(1, rows[0][1], 0), (1, rows[2][1], 2), (3, rows[4][1], 4), (n, rows[6][1], 6), (4, n, 7), (4, n, 8), (5, rows[9][1], 9), (n, rows[12][1], 12)])


def edited(r, base, n):
    out = list(base)
    for i in r.choice(len(base), n, replace=False):
        out[i] = "".join(r.choice(list("abcdefghij"), 6))
    return out


def test_minhash_links_a_chain_in_a_hot_bucket(spark):
    r = np.random.default_rng(6)
    base = edited(r, [""] * 400, 400)
    # each differs from the base in its own words, so that members differ from each other too
    rows = [" ".join(edited(r, base, 1 + k // 2)) for k in range(60)]
    got = {x.doc_id: x.group_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    label = brute_groups(rows)
    assert sum(got[k] != label[k] for k in range(60)) <= 1 and len(set(label)) > 1


def test_minhash_finds_pairs_in_buckets_of_other_texts(spark):
    r = np.random.default_rng(6)
    base = edited(r, [""] * 400, 400)
    rows = []
    for _ in range(100):  # pairs of near copies in buckets of texts that are not near enough, so most pivots are of another pair
        one = edited(r, base, 4)
        rows += [" ".join(one), " ".join(edited(r, one, 3))]
    got = {x.doc_id: x.group_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    label = brute_groups(rows)
    assert got == dict(enumerate(label)) and len(set(label)) > 1


def test_minhash_bounds_rule_out_no_link(spark):
    """The bounds of pairs from what each shares with a pivot, against the similarity itself."""
    r = np.random.default_rng(16)
    base = np.arange(200)
    texts_ = [np.unique(np.concatenate([np.delete(base, r.choice(200, int(r.integers(0, 45)), replace=False)), r.integers(200, 260, int(r.integers(0, 40)))])) for _ in range(120)]
    texts_ = [(t.astype(np.uint64), r.choice([1.0, 2.0, 3.0], 260)[t] if k % 3 == 0 else np.ones(len(t))) for k, t in enumerate([base, *texts_])]
    n = np.bincount(np.concatenate([t for t, _ in texts_]).astype(int), minlength=260)
    own = [float(w[n[t.astype(int)] == 1].sum()) for t, w in texts_]
    total = [float(w.sum()) for _, w in texts_]
    both = [minhash.shared(t, texts_[0]) for t in texts_]
    rows = [
        (total[a], own[a], both[a], total[0], total[b], own[b], both[b], minhash.weighted_jaccard(texts_[a], texts_[b])) for a, b in combinations(range(1, 121), 2)
    ]
    df = spark.createDataFrame(rows, "total double, own double, both double, pivot double, total_b double, own_b double, both_b double, j double")
    kept = df.where(minhash.may_link(0.8))
    links = sum(x[-1] >= 0.8 for x in rows)
    assert kept.where("j >= 0.8").count() == links > 50 and kept.count() < 0.6 * len(rows)


def test_minhash_compares_pages_of_a_template(spark):
    r = np.random.default_rng(15)
    template = edited(r, [""] * 300, 300)
    # what is not of the template comes from few lines, so nothing is a page's own and all bands are shared by many
    lines = [edited(r, [""] * 10, 10) for _ in range(40)]
    rows = [" ".join([*template, *(w for i in r.choice(40, 12, replace=False) for w in lines[i])]) for _ in range(80)]
    rows += [" ".join([*x.split(" ")[:-3], "end"]) for x in rows[:20]]
    got = {x.doc_id: x.group_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    label = brute_groups(rows)
    assert got == dict(enumerate(label)) and 1 < len(set(label)) <= 80


def test_minhash_counts_documents_for_each_shingle(spark):
    r = np.random.default_rng(14)
    line = lambda n: " ".join(f"{x:06x}" for x in r.integers(0, 1 << 24, n))
    one, two, rare = line(150), line(150), line(700)
    rows = [f"{one}\n{two}\n{line(5000)}" for _ in range(300)] + [f"{rare}\n{one}", f"{rare}\n{two}"]
    parts = [minhash.shingles(Words(pa.array([t])).hashes(), 5) for t in rows]
    every, n = np.unique(np.concatenate([s for s, _ in parts]), return_counts=True)
    true = [(s, tf * minhash.idf(n[np.searchsorted(every, s)], len(rows))) for s, tf in parts[-2:]]
    assert minhash.weighted_jaccard(*true) >= 0.8 > minhash.weighted_jaccard(*parts[-2:])
    got = {x.doc_id: x.group_id for x in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: min(k, 300) for k in range(302)}


def test_hamming(spark):
    r = np.random.default_rng(3)
    codes = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 300)]
    codes += [codes[0]] * 30 + [codes[1] ^ 1, codes[1] ^ 2, 0, -1]
    rows = [(k, c) for k, c in enumerate(codes)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for x in hamming.top_k(df, df.where("id % 40 = 0 or id = 999"), 7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.distance, x.id))
    for q in range(0, len(codes), 40):
        want = sorted((bin((codes[q] ^ c) & (1 << 64) - 1).count("1"), k) for k, c in enumerate(codes))[:7]
        assert sorted(got[q]) == [(i + 1, *w) for i, w in enumerate(want)]
    assert 999 not in got and hamming.top_k(df.limit(0), df, 3).count() == 0
    assert hamming.top_k(df.limit(2), df.limit(1), 5).count() == 2


def test_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((6, 16))
    x = [(centres[k % 6] + 0.12 * r.standard_normal(16)).tolist() for k in range(240)] + r.standard_normal((200, 16)).tolist()
    x += [x[0], x[0], [2 * v for v in x[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in neighbours.near_duplicates(df, k=5, trees=8).collect()}
    ok = [k for k in range(443)]
    m = np.array([x[k] for k in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= 0.9
    np.fill_diagonal(hit, False)
    label = list(range(len(x)))
    for a, b in zip(*np.nonzero(np.triu(hit))):
        lo, hi = sorted((label[a], label[b]))
        label = [lo if v == hi else v for v in label]
    want = {k: (int(hit[k].sum()) if k < 443 else 0, label[k], label[k] == k) for k in range(len(x))}
    assert got == want
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def links_of(x, threshold=0.9):
    """(n_links, component) of each vector that can have any, all pairs compared."""
    m = np.array(x, np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    label = list(range(len(m)))
    for a, b in zip(*np.nonzero(np.triu(hit))):
        lo, hi = sorted((label[a], label[b]))
        label = [lo if v == hi else v for v in label]
    return [(int(n), g) for n, g in zip(hit.sum(axis=1), label)]


def test_neighbours_of_repeated_rows(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((20, 8)).tolist()
    rows = [(1, x[0]), (1, x[0]), (1, x[1]), (2, x[0]), (3, [2 * v for v in x[1]]), (None, x[3]), (None, x[3]), (4, None), (4, x[4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "node": F.lit(2)})
    got = Counter(tuple(v) for v in neighbours.near_duplicates(df).collect())
    n = None
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (1, 1, 1, True), (3, 1, 1, False), (n, 1, n, True), (n, 1, n, True), (4, 0, 4, True), (4, 0, 4, True)])


def test_neighbours_finds_isolated_pairs_among_many(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((3000, 32))
    for k in range(0, 400, 2):  # pairs just above and just below the threshold
        u = x[k] / np.linalg.norm(x[k])
        side = r.standard_normal(32)
        side -= (side @ u) * u
        c = 0.903 if k % 4 else 0.897
        x[k + 1] = c * u + (1 - c * c) ** 0.5 * side / np.linalg.norm(side)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    audited = []
    got = {v.vec_id: (v.n_links, v.component_id) for v in neighbours.near_duplicates(df, audited=audited).collect()}
    want = dict(enumerate(links_of(x)))
    assert sum(a[0] for a in want.values()) >= 200 and sum(got[k] != want[k] for k in want) <= 2
    assert audited[-1][1] >= 0.99 * audited[-1][0] > 50


def test_trees_follow_from_the_number_of_vectors():
    assert neighbours.trees_for(0.9, 0) == 1 and neighbours.trees_for(0.9, 5) < neighbours.trees_for(0.9, 10) < neighbours.trees_for(0.9, 20)
    together = (1 - np.arccos(0.9) / np.pi) ** 10
    assert (1 - together) ** neighbours.trees_for(0.9, 10) <= 0.005


def bridged(seed=13, dim=64):
    """Two clusters of 40 whose members have ten nearer ones of their own, and links between them; and a third, far from both."""
    r = np.random.default_rng(seed)
    a, b, c = np.linalg.qr(r.standard_normal((dim, 3)))[0].T
    centres = [a, 0.905 * a + (1 - 0.905**2) ** 0.5 * b, c]
    x = np.concatenate([m + 0.016 * r.standard_normal((40, dim)) for m in centres])
    return x[r.permutation(len(x))]


def test_neighbours_across_two_dense_clusters(spark):
    x = bridged()
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    hit = sims >= 0.9
    label = list(range(len(x)))
    for a, b in zip(*np.nonzero(np.triu(hit))):
        lo, hi = sorted((label[a], label[b]))
        label = [lo if v == hi else v for v in label]
    # no list of the ten nearest has a link to the other cluster
    near = sims >= np.sort(sims, axis=1)[:, -10:][:, :1]
    parts = list(range(len(x)))
    for a, b in zip(*np.nonzero(near & hit)):
        lo, hi = sorted((parts[a], parts[b]))
        parts = [lo if v == hi else v for v in parts]
    assert len(set(label)) == 2 and len(set(parts)) == 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id, v.kept) for v in neighbours.near_duplicates(df).collect()}
    assert got == {k: (int(hit[k].sum()), label[k], label[k] == k) for k in range(len(x))}


def test_chats_equal_their_sql(spark):
    rows = []
    for conv, said in enumerate([["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["x"], ["a"], ["y", None], ["y"], ["", "b"], ["9:ab"], ["ab"]]):
        rows += [(conv, t, None if conv == 5 and t == 1 else ("user", "assistant")[t % 2], s) for t, s in enumerate(said)]
    rows += [(3, 0, "user", "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, chats.collapse_and_render(df.withColumn("own", F.lit(0))).collect()))
    con = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841
    con.register("conversations", conversations)
    assert got == sorted(con.execute(chats.SQL).fetchall()) and [g[0] for g in got] == [1, 3, 5, 7, 8, 9]
    assert chats.collapse_and_render(df.limit(0)).count() == 0


def test_chats_of_many_turns(spark):
    long_ = [(1, t, "user" if t % 2 else None, f"turn {t}") for t in range(6000)]
    rows = long_ + [(2, *r[1:]) for r in long_[:3000]] + [(3, *r[1:]) for r in long_[:2999]] + [(3, 2999, "user", "another end")] + [(4, *r[1:]) for r in long_]
    swapped = [(5, 0, None, "turn 0"), (5, 1, "user", "turn 2"), (5, 2, None, "turn 1")]
    df = spark.createDataFrame(rows + swapped, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "hash": F.lit("x")})
    got = {r.conv_id: r.n_turns for r in chats.collapse_and_render(df.repartition(4)).collect()}
    assert got == {1: 6000, 3: 3000, 5: 3}


def targets(sizes, weights, total, most=3):
    """Shares by weight, each at most ``most`` times its size; the excess is shared again."""
    left, open_, out = float(total), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


@pytest.mark.parametrize("sizes", [[100, 100], [10, 190], [0, 5], [], [1, 2, 3, 400, 5, 0, 60, 7000], [5] * 40])
def test_targets_cap_and_reshare(spark, sizes):
    names = [f"s{k:02d}" for k in range(len(sizes))]
    df = spark.createDataFrame(list(zip(names, sizes))[::-1], "source string, own long")
    got = {r.source: r.target for r in mixing.share(df, (1, 2, 3), sum(sizes), Scratch(spark, "t")).collect()}
    assert got == pytest.approx(dict(zip(names, targets(sizes, [(1, 2, 3)[k % 3] for k in range(len(sizes))], sum(sizes)))))


def test_mixing_of_many_sources(spark):
    """More sources than the driver's bound: those that share no document are solved as rows."""
    df = spark.range(3000).selectExpr("id as doc_id", "concat('s', cast(id % 1000 as string)) as source", "cast(1 + id % 7 as long) as n", "'x' as mix_size", "1 as pattern", "2 as u")
    got = mixing.mix(df, F.array("source"), F.col("n"), weights=(1,), most_patterns=10)
    assert got.columns == ["doc_id", "source", "n", "pattern", "u", *mixing.RESULT]
    rows = got.collect()
    assert len(rows) == 3000 and sum(r.mix_size * r.mix_copies for r in rows) == pytest.approx(sum(r.n for r in rows), rel=0.1)
    back = mixing.repeat(df, F.array("source"), F.col("n"), weights=(1,), most_patterns=10)
    assert back.columns == df.columns and set(r.mix_size for r in back.collect()) == {"x"} and back.count() == sum(r.mix_copies for r in rows)
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(df, F.array("source", F.concat(F.col("source"), F.lit("b"))), F.col("n"), most_patterns=10)


def test_mixing(spark):
    rows = texts(n=60)
    df = frame(spark, rows)
    mix = lambda: mixing.mix(df, F.array("source"), mixing.word_count(F.col("text"))).collect()
    got = mix()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix()))
    size = {k: len(WORD.findall(t or "")) for k, t in enumerate(rows)}
    by = {}
    for r in got:
        assert r.mix_size == size[r.doc_id] and 0 <= r.mix_copies <= 3
        s = by.setdefault(r.source, [0, 0, r.mix_target, r.mix_source_size, 0])
        s[0] += r.mix_size
        s[1] += r.mix_size * r.mix_copies
        s[4] = max(s[4], r.mix_size)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets([by[n][0] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))], sum(size.values()))
    for n, t in zip(names, want):
        own, taken, target, stated, largest = by[n]
        assert stated == own and target == pytest.approx(t) and abs(taken - target) <= largest
    copies = mixing.repeat(df, F.array("source"), mixing.word_count(F.col("text")))
    assert copies.columns == df.columns and copies.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(df.limit(0), F.array("source"), mixing.word_count(F.col("text"))).count() == 0


def test_mixing_of_overlapping_sources(spark):
    df = spark.createDataFrame([(k, ["a", "b"] if k < 50 else ["a"] if k < 80 else ["b"] if k < 100 else []) for k in range(110)], "doc_id long, of array<string>")
    got = mixing.mix(df, F.col("of"), F.lit(10), weights=(1, 1)).collect()
    assert all(r.mix_copies == 0 for r in got if not r.of)
    assert sum(r.mix_copies * 10 for r in got) == pytest.approx(1100, abs=20)


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = texts()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in enumerate(rows)}
    got = packing.pack_documents(frame(spark, rows).repartition(3)).collect()
    seqs, docs = {}, {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
    for pieces in (*seqs.values(), *docs.values()):
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
    assert {k: sum(n for _, n in v) for k, v in docs.items()} == {k: len(v) for k, v in ids.items()}
    assert max(sum(n for _, n in v) for v in seqs.values()) <= 1024
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_private(spark):
    rows = [*texts(), "write to a.b@c.de and call +1 (555) 123-4567 from 10.0.0.1, card 4111 1111 1111 1111", None]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in private.detect(df, most=50).collect()}
    for k, t in enumerate(rows):
        base = private.base_spans(t or "")
        r = got[k]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == i for s in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(private.written(base).encode()).hexdigest()
        assert {f"{private.KINDS[i]}:{a}:{b}" for a, i, b in base} <= set(r.spans.split(","))
    clean = {r.doc_id: r for r in private.redact_documents(df, most=50).collect()}
    k = len(rows) - 2
    assert "@" not in clean[k].text and "555" not in clean[k].text and clean[k].n_chars == len(clean[k].text)
    assert clean[len(rows) - 1].text is None and clean[0].text == rows[0]
    assert private.detect(df.limit(0)).count() == 0


def labels_of(spark, rows, column):
    return spark.createDataFrame([(k, int(k % 2)) for k in range(0, len(rows))] + [(10**6, None)], f"doc_id long, {column} int")


def test_classifiers(spark):
    r = np.random.default_rng(8)
    rows = [" ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(30)) + (" grumpf GRUMPF!! $$$" if k % 2 else "") for k in range(120)] + ["", None, "grumpf " * 3000]
    df = frame(spark, rows)
    q = quality.classify(df, labels_of(spark, rows[:120], "quality"), most=60).collect()
    t = toxicity.classify(df, labels_of(spark, rows[:120], "toxic"), most=60).collect()
    for got, mod, rest, least in ((q, 5, 0, 0.3), (t, 3, 1, 0.7)):
        assert len(got) == len(rows)
        for x in got:
            assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % mod == rest) and 0 <= x.score <= 1 and x.predicted == int(x.score >= least)
        held = [x for x in got if x.held_out and x.doc_id < 120]
        assert np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.9
    none = df.limit(0)
    assert quality.classify(none, labels_of(spark, [], "quality")).count() == toxicity.classify(none, labels_of(spark, [], "toxic")).count() == 0
    kept = quality.keep_good(df, labels_of(spark, rows[:120], "quality"), most=60)
    assert kept.columns == df.columns and kept.count() < len(rows)
