"""Quality rules against a plain reckoning; the ranking's accuracy on labels that it never saw."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from helpers import DOCS, ODD, clashing, documents

from prosemill.llm import quality_rules as Q
from prosemill.llm.ranking import fit, held_out, keep_good, learn, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for where in at.values() if len(where) > 1 for i in where for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed


def buckets(text):
    words, out = WORD.findall(text), []
    for gram in [(w,) for w in words] + [*zip(words, words[1:])]:
        h = 42
        for w in gram:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        out.append((h - (1 << 64) if h >> 63 else h) % Q.BUCKETS)
    return out


def texts():
    line = "one two three four five six seven\n"
    long = " ".join(f"w{k}" for k in range(30_000))
    more = [long, long + " w1 w2 w3 w4 w5", "\x0b".join("abcde") + "\x0c\r" + "a b c d e", line * 3 + "and other words that come once only here in this text", "a b c d e f a b c d e g a b c d e", "x y z " * 40]
    more += [f"plain number {k} of the many texts that are here for the rules to count and keep" for k in range(30)]
    more += [f"junk*** t{k}### xx$$$ a%%% b&&& c*** d### e$$$ f%%% g&&& h***" for k in range(10)]
    return [t for t in ODD if t is None or "\x00" not in t] + more


def test_rules_equal_plain_reckoning(spark):
    rows = [*enumerate(texts()), (None, "no id " * 6), (3, "again")]
    trusted = [(k,) for k, t in rows if k is not None and t and t.startswith("plain")]
    got = Q.apply_quality_rules(clashing(documents(spark, rows)), spark.createDataFrame(trusted + [(None,)], "doc_id long")).collect()
    raw, good = Counter(), Counter()
    for k, t in rows:
        raw.update(buckets(t or ""))
        good.update(buckets(t or "") if (k,) in trusted else [])
    share = good.total() / raw.total()
    ratio = lambda b: math.log((good[b] + Q.SMOOTH * share) / (raw[b] - 1 + Q.SMOOTH)) - math.log(share)
    want = []
    for k, t in rows:
        m, b = measures(t or ""), buckets(t or "")
        llr = sum(map(ratio, b)) / len(b) if b else None
        want.append((str(k), *m, not m[-1] and (llr or 0) >= Q.THRESHOLD, None if llr is None else round(llr, 4)))
    have = [(str(r.doc_id), *r[1:7], r.kept, None if r.llr is None else round(r.llr, 4)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[k] for (k,) in trusted) and not any(kept[k] for k, t in rows if k is not None and t and t.startswith("junk"))


def test_rules_without_trusted_texts_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    got = Q.apply_quality_rules(documents(spark, [(1, "a b c d e f g h i j k")]), none).collect()
    assert got[0].kept and got[0].llr == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"))
    docs = documents(spark, [(k, "good words" if k < 4000 else "bad words") for k in range(5000)])
    some, every = (Q.target_ratios(docs, many, "doc_id", "text", most) for most in (1000, 4000))
    assert some != every and sum(abs(a - b) for a, b in zip(some, every, strict=True)) < 0.2
    assert Q.apply_quality_rules(spark.createDataFrame([], DOCS), none).count() == 0


def test_every_trusted_text_counts_however_many_there_are(spark):
    trusted = spark.createDataFrame([(k % 3000,) for k in range(4000)] + [(None,)], "doc_id long")
    texts = [(k % 4000, f"good{k % 7} words") for k in range(4500)] + [(None, "no id"), (None, "no id"), (5, None)]
    docs = documents(spark, [*texts, *((k, "bad words") for k in range(5000, 6000))])
    whole = Q.target_ratios(docs, trusted, "doc_id", "text")
    dealt = Q.target_ratios(docs, trusted, "doc_id", "text", sent=500)
    assert any(whole) and dealt == whole
    nothing = Q.target_ratios(docs, trusted.limit(0), "doc_id", "text", sent=-1)
    assert nothing == [0.0] * Q.BUCKETS


def test_verdicts_on_labels_that_the_target_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = F.col("doc_id") % 2 == 1
    got = Q.apply_quality_rules(docs, labels.where((F.col("quality") == 1) & seen).select("doc_id"))
    held = got.where("not base_failed").join(labels.where(~seen), "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in held if r.quality == 1]
    bad = [r.kept for r in held if r.quality == 0]
    assert len(good) > 100 and len(bad) >= 10 and sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_ranking_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    ranker = learn(docs, labels)
    scored = score_documents(docs, ranker)
    assert scored.count() == docs.count()
    seen = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(seen) > 50 and sum(r.predicted == r.quality for r in seen) >= 0.97 * len(seen)
    assert keep_good(docs, ranker).columns == docs.columns
    assert keep_good(docs, ranker).count() == scored.where("predicted = 1").count()


def test_ranking_survives_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "no id"), (1, "again")]
    docs = clashing(documents(spark, rows)).drop("t")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    ranker = learn(docs, labels)
    got = score_documents(docs, ranker).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert keep_good(docs.withColumnRenamed("h", "t"), ranker).columns == docs.withColumnRenamed("h", "t").columns
    assert {r.score for r in score_documents(docs, None).collect()} == {1.0}
    assert learn(docs, labels.where("quality = 1")) is None
    # An id of very many rows weighs as one, contrary labels go, and so do labels without a text.
    hot = documents(spark, [(1, f"{ODD[5]} {k}") for k in range(3000)] + [(k, t) for k, t in rows if k != 1] + [(77, "x " * 2_000_000)])
    more = labels.union(spark.createDataFrame([(2, 1, 0), (10**6, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int"))
    ranker = learn(hot, more)
    assert len(score_documents(hot, ranker).where("doc_id = 77 and score between 0 and 1").collect()) == 1
    one = learn(documents(spark, [(1, f"{ODD[5]} 0")] + [(k, t) for k, t in rows if k != 1] + [(77, "x " * 2_000_000)]), more.where("doc_id != 2"))
    two = learn(hot, more.where("doc_id != 2"))
    assert abs(one.weights - two.weights).max() < 1 and len(one.weights) == len(two.weights)
    empty = spark.createDataFrame([], DOCS)
    assert score_documents(empty, ranker).count() == 0 and learn(empty, labels) is None
    assert fit(np.zeros((2, 3)), np.array([True, True])) is None
    flags = spark.range(50).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in flags)
