"""Near duplicates against brute force over all pairs of shingle sets."""

import random

import numpy as np
from helpers import DOCS, ODD, clashing, documents

from prosemill.llm import minhash
from prosemill.llm.components import components


def reachable(nodes, links):
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def words(text):
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def shingle_set(text):
    w = words(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent):
    sets = {k: shingle_set(t) for k, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    links.append((a, b))
    return {k: (len(sets[k]), c) for k, c in reachable(ids, links).items()}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    rows = []
    for _ in range(6):
        base = text(rng.choice([60, 120, 300]))
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    hub = text(150)  # a group larger than a small bucket, whose members are often like the hub alone
    for _ in range(90):
        w = list(hub)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w if rng.random() < 0.7 else w[: rng.randrange(110, 150)]))
    rows += [rows[0].upper(), "  " + rows[0].replace(" ", "\n"), *rows[60:64] * 30]
    rows += [" ".join(text(40)) for _ in range(60)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = [*enumerate(corpus())] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = clashing(documents(spark, rows))
    for percent in (80, 85):
        want = brute(rows, percent)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, percent=percent).collect()}
        assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
        assert all(r.kept == (r.component_id == k) for k, r in got.items())
    monkeypatch.setattr(minhash, "CHUNK", 25)  # chunks of a bucket, and pairs of chunks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, percent=85).collect()}
    assert got == brute(rows, 85)


def test_odd_tables(spark):
    text = "a b c d e f g h i j k l m"
    rows = [(5, text), (5, text), (None, text), (7, text + "\n"), (9, None), (9, ""), (None, None)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    want = [(5, 9, 5, True), (5, 9, 5, True), (None, 9, None, False), (7, 9, 5, False), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, False)]
    assert got == sorted([(*w[:3], True if w[0] is None else w[3]) for w in want], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_circulant_coordinates_estimate_jaccard():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85):
        x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        y = np.concatenate([x[: int(4000 * 2 * share / (1 + share))], rng.integers(0, 1 << 63, 4000, dtype=np.uint64)])[:4000]
        same = np.mean(minhash.signature(x) == minhash.signature(y))
        assert abs(same - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.12


def test_components_of_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(7, k) for k in range(200, 400)]
    edges = chain + hub + [(3, 3), (500, 400), (400, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e} - {3}
    want = reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert got == want


def false_bands(count, seed=5):
    """Groups of texts of single-word shingles, each led by a linked pair that meets only in large buckets.

    In a band before the first that the pair shares, all low bytes of its signatures agree. The other
    texts of a group hold the common words with the smallest ranks, so that they share the pair's buckets.
    """
    rng = random.Random(seed)
    groups, serial = [], 0
    while len(groups) < count:
        common = [f"c{serial}x{k}" for k in range(190)]
        pair = [common + [f"{side}{serial}x{k}" for k in range(15)] for side in "ab"]
        serial += 1
        sigs = [minhash.signature(minhash.shingles(" ".join(w), 1))[: minhash.BANDS * minhash.ROWS] for w in pair]
        rows = [s.reshape(minhash.BANDS, minhash.ROWS) for s in sigs]
        true, low = (rows[0] == rows[1]).all(axis=1), (rows[0].astype(np.uint8) == rows[1].astype(np.uint8)).all(axis=1)
        if low.argmax() >= true.argmax():
            continue
        ranks = {w: minhash.signature(minhash.shingles(w, 1))[: minhash.BANDS * minhash.ROWS] for w in common}
        shared = sigs[0] == sigs[1]
        needed = [w for w in common if (ranks[w] == sigs[0])[shared].any()]
        rest = [w for w in common if w not in needed]
        others = [needed + rng.sample(rest, 4) for _ in range(minhash.SMALL_BUCKET + 6)]
        groups.append([" ".join(w) for w in pair + others])
    return groups


def test_low_bytes_that_agree_in_a_band_not_shared(spark):
    rows = list(enumerate(t for group in false_bands(4) for t in group))
    sets = {k: set(t.split()) for k, t in rows}
    near = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    want = reachable(list(sets), [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), percent=85, width=1).collect()}
    assert got == want
