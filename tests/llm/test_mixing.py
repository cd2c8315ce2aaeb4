"""Mixing against a plain version: targets, the order of a source, one offset, integer borders crossed."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from helpers import DOCS, ODD, clashing, documents

from prosemill.llm.mixing import CLASSES, HEAVY, mix_sources

GAPS = " \t\n\x0b\x0c\r"


def size(text):
    for c in GAPS:
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_targets(sizes, most=3):
    """By sharing the excess again and again."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]))}
    if None in sizes:
        weight[None] = 1 + len(weight) % 3
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def _hash(seed, *parts):
    return hashlib.md5(":".join(str(p) for p in (seed, *parts) if p is not None).encode()).hexdigest()


def plain_mix(rows, seed=17):
    by = defaultdict(list)
    for k, t, s in rows:
        by[s].append((k, size(t)))
    sizes = {s: sum(n for _, n in docs) for s, docs in by.items()}
    targets, out = plain_targets(sizes), []
    for s, docs in by.items():
        offset = int(_hash(seed, ("n" if s is None else "s") + (s or ""))[:13], 16) / float(1 << 52)
        left, words = targets[s], sizes[s]
        for heavy in (True, False):
            rate = max(0.0, min(3.0, left / words)) if words else 0.0
            own = [d for d in docs if (d[1] * HEAVY > sizes[s]) == heavy]
            order = sorted(own, key=lambda d: (math.floor(math.log(d[1] + 1) * CLASSES), d[1], _hash(seed, d[0]), d[0] is not None, d[0] or 0))
            for rank, (k, n) in enumerate(order, 1):
                copies = min(3, math.floor(rank * rate + offset) - math.floor((rank - 1) * rate + offset))
                out.append((k, n, sizes[s], round(targets[s], 6), copies * n))
                left, words = left - copies * n, words - n
    return sorted(out, key=str)


def rows_of(rng, sources, each=60):
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6)))
    out = []
    for s in sources:
        for _ in range(each if s != "tiny" else 2):
            out.append((len(out), " ".join(word() for _ in range(rng.choice([1, 4, 9, 30, 200]))), s))
    return out


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_equals_plain_version(spark):
    rng = random.Random(4)
    rows = rows_of(rng, ["b", "tiny", None, "é", "Z", "\U0001f600", "\uffff"])
    rows += [(500 + k, t, "odd") for k, t in enumerate(ODD)] + [(900 + k, None, "empty") for k in range(4)]
    rows += [(None, "no id here", "b"), (None, "no id here", "b"), (7, "again", "b"), (7, "again", "b"), (7, "again and again", "Z")]
    docs = clashing(documents(spark, rows)).drop("size", "copies")
    have = got(mix_sources(docs))
    assert have == plain_mix(rows)
    assert have == got(mix_sources(docs.repartition(7, "text")))
    targets = plain_targets({s: sum(size(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    caps = {s: 3 * sum(size(t) for _, t, x in rows if x == s) for s in targets}
    assert targets["tiny"] == caps["tiny"] and abs(sum(targets.values()) - sum(caps.values()) / 3) < 1e-6
    for s, want in targets.items():
        taken = sum(r.taken for r in mix_sources(docs).where("size > 0").collect() if r.source == s)
        sizes = [size(t) for _, t, x in rows if x == s]
        due = sum(sizes) / HEAVY if max(sizes) * HEAVY <= sum(sizes) or s not in ("odd", "tiny") else max(sizes)
        assert abs(taken - want) <= due + 1, s


def test_an_id_of_very_many_rows(spark):
    rows = [(k, "a b c", "s") for k in range(20)] + [(None, "x y", "s")] * 25_000 + [(1, "p", "t")] * 300
    df = mix_sources(documents(spark, rows))
    assert got(df) == plain_mix(rows)


def test_odd_tables(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert got(mix_sources(documents(spark, [(1, None, None), (2, "", "a")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert got(mix_sources(documents(spark, [(1, "one two", "a")]))) == [(1, 2, 2, 2.0, 2)]
    for most in (2.5, 0):
        with pytest.raises(ValueError):
            mix_sources(documents(spark, [(1, "x", "a")]), most_repeats=most)
