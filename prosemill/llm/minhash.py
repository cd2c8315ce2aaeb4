"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components.

A document is the set of its distinct shingles of five words. A first permutation sends a shingle
to a place in a ring, a second one gives each place its rank, and coordinate k of a signature is
the smallest rank among the shingles' places moved on by k. So two permutations give all
coordinates, and the ranks that one shingle adds to all of them lie side by side in memory.

1. Sketch: one pass over the texts gives each document its number of shingles, a 128-bit hash of
   its set, one hash for each band of coordinates, and the signature's low bytes.
2. Equal sets are one class from here on, so a group of copies is one row.
3. Classes that share a band meet in a bucket. A small bucket proposes all its pairs. A large one is
   cut into blocks; each proposes its most central member with every other, and the first block's
   proposes itself with all members of the bucket, so a bucket's pairs grow with its members.
4. Pairs that sizes or signatures rule out go; the rest are confirmed on full sets, and links become
   components.
5. Large buckets whose members ended in different components are looked at again: members of
   different components, unless the shingles that each has to itself among all of these members
   already rule the link out, or the signatures do. Such members get signatures of more coordinates
   of the same ring, so that few pairs below the threshold are left. These are confirmed too. Who is
   in a bucket's largest component needs no search of its own: blocks of the others meet blocks of
   all members, so that no task sees more than two blocks, however large the bucket is.
6. Every row gets the smallest id of its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, text_or_empty
from prosemill.llm.components import components

#: Places in the ring.
RING = 1 << 20
#: Two documents at 0.85 share none of the bands once in a million pairs; at 0.5 half of them do.
BANDS, ROWS = 25, 5
#: Coordinates of a signature, those beyond BANDS * ROWS only for estimates.
COORDINATES = 192
#: Coordinates of the signatures that decide what is compared with what in large buckets.
WIDE_COORDINATES = 1024
#: Members up to which a bucket proposes all pairs.
SMALL_BUCKET = 24
#: Members of a large bucket that are looked at together, about.
CHUNK = 400
#: Standard deviations that an estimate may lie below the threshold.
SPREAD = 5.5
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 400_000:
            self.clear()
        self[word] = value
        return value


_words = _WordHashes()


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``; A-Z are lower-cased.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    w = min(width, n)
    total = np.full(n - w + 1, w, np.uint64)
    for k in range(w):
        total = _mix(total + h[k : n - w + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


@lru_cache(maxsize=1)
def _ring() -> np.ndarray:
    """Row i: the ranks of the places i, i + 1, ... up to the most coordinates."""
    ranks = np.random.Generator(np.random.PCG64(20240)).permutation(RING).astype(np.uint32)
    closed = np.concatenate([ranks, ranks[:WIDE_COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(closed, WIDE_COORDINATES)


def signature(hashes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    ring, best = _ring()[:, :coordinates], np.full(coordinates, RING, np.uint32)
    places = (_mix(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(44)).astype(np.int64)
    for k in range(0, len(places), 512):
        np.minimum(best, ring[places[k : k + 512]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _least_agreement(threshold: float, coordinates: int = COORDINATES) -> float:
    """Coordinates in which two documents at the threshold agree, less the spread of the estimate."""
    return (threshold - SPREAD * (threshold * (1 - threshold) / coordinates) ** 0.5) * coordinates


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, set_hash, bands, sig`` of rows of ``doc_id, t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, hashes, bands, sigs = [], [], [], []
                for text in batch.column("t"):
                    x = shingles(text.as_py(), width)
                    sizes.append(len(x))
                    if len(x):
                        sig = signature(x)
                        hashes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(sig))
                        sigs.append(sig.astype(np.uint8).tobytes())
                    else:
                        hashes.append(None), bands.append(None), sigs.append(None)
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "set_hash", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, set_hash binary, bands array<long>, sig binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``node, hashes`` (sorted 64-bit hashes as bytes) of rows of ``doc_id, t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column("t")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def _wide(sets: DataFrame) -> DataFrame:
    """``node, wide``: the low bytes of the wide signatures of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = (signature(np.frombuffer(x.as_buffer(), np.uint64), WIDE_COORDINATES) for x in batch.column("hashes"))
            wide = pa.array([sig.astype(np.uint8).tobytes() for sig in sigs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), wide], names=["node", "wide"])

    return sets.mapInArrow(run, "node long, wide binary")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Can sets of these sizes be similar enough?"""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _agreeing(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree enough."""
    least = _least_agreement(threshold)
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = both.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("sig_a").to_pylist()), np.uint8).reshape(n, COORDINATES)
            y = np.frombuffer(b"".join(batch.column("sig_b").to_pylist()), np.uint8).reshape(n, COORDINATES)
            near = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union of full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _central(large: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the most central member of each block of a large bucket with the block's others, and
    that of the bucket's first block with all of the bucket."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), COORDINATES)
        common = np.array([np.bincount(sig[:, k]).argmax() for k in range(COORDINATES)], np.uint8)
        order = np.lexsort((pdf["node"].to_numpy(), -(sig == common).sum(axis=1)))
        return pdf.iloc[order[:1]][["key", "chunk", "node", "n"]]

    middles = large.groupBy("key", "chunk").applyInPandas(choose, "key long, chunk int, node long, n long")
    middles = materialize(middles.select("key", "chunk", F.col("node").alias("a"), F.col("n").alias("n_a")), "middles")
    first = middles.groupBy("key").agg(F.min_by(F.struct("a", "n_a"), "chunk").alias("m")).select("key", "m.a", "m.n_a")
    members = large.select("key", "chunk", "node", "n")
    # Few rows a bucket against its members: written out, so that a hot bucket can be split.
    pairs = members.join(middles, ["key", "chunk"]).unionByName(members.join(materialize(first, "first-middles"), "key"), allowMissingColumns=True)
    return pairs.where(_fits(F.col("n"), F.col("n_a"), percent)).select("a", F.col("node").alias("b"))


def _undecided(large: DataFrame, bands: DataFrame, labels: DataFrame, alone: DataFrame, sets: DataFrame, threshold: float, percent: int) -> DataFrame:
    """``a, b``: members of one large bucket in different components that may yet be linked.

    ``bands``: ``node, bands``, the keys of all of a node's buckets.
    """
    rows = large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    # Without enough shingles that any other member has, a member has no link here.
    rows = materialize(rows.where(F.col("shared") * 100 >= F.col("n") * percent), "members")
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    most = F.max(F.struct("size", "component"))["component"]
    per = parts.groupBy("key").agg(most.alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    per = per.withColumn("chunks", F.ceil(F.col("all") / CHUNK).cast("int"))
    rows = materialize(rows.drop("chunk").join(materialize(per, "split-buckets"), "key"), "undecided")
    wide = materialize(_wide(sets.join(rows.select("node").distinct(), "node", "left_semi")), "wide")
    rows = rows.join(wide.join(bands, "node"), "node")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("out", F.col("component") != F.col("most"))
    columns = ["key", "band", "node", "n", "shared", "component", "sig", "wide", "bands", "out"]
    # A block of searchers meets every block of members; members outside the largest component search.
    searchers = rows.where("out").select(*columns, F.col("chunk").alias("low"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("high"), F.lit(True).alias("asks"))
    blocks = rows.where("out").select("key", F.col("chunk").alias("low")).distinct()
    asked = rows.select(*columns, F.col("chunk").alias("high")).join(materialize(blocks, "searching"), "key").withColumn("asks", F.lit(False))
    every = searchers.unionByName(asked)
    least, least_wide = _least_agreement(threshold), _least_agreement(threshold, WIDE_COORDINATES)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        node, n, shared, part, out = (pdf[c].to_numpy() for c in ("node", "n", "shared", "component", "out"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), COORDINATES)
        wide = np.frombuffer(b"".join(pdf["wide"]), np.uint8).reshape(len(pdf), WIDE_COORDINATES)
        keys, band = np.stack(pdf["bands"]), int(pdf["band"].iloc[0])
        found_a, found_b = [], []
        there = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks):
            # Two searchers meet in two groups: the one of the smaller id asks.
            may = there[(part[there] != part[x]) & (~out[there].astype(bool) | (node[there] > node[x]))]
            common = np.minimum(shared[may], shared[x])
            may = may[100 * common >= percent * (n[may] + n[x] - common)]
            near = may[(sig[may] == sig[x]).sum(axis=1) >= least]
            # A pair is proposed in the first band that it shares, be that bucket small or large. The
            # keys tell: low bytes may agree in a band whose bucket the two don't share.
            near = near[(keys[near] == keys[x]).argmax(axis=1) == band]
            near = near[(wide[near] == wide[x]).sum(axis=1) >= least_wide]
            found_a += [node[x]] * len(near)
            found_b += node[near].tolist()
        return pd.DataFrame({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    return every.groupBy("key", "low", "high").applyInPandas(pairs, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id`` for every row of ``docs``.

    Two documents are linked if 100 times the intersection of their shingle sets is at least
    ``percent`` times the union; ``percent`` must be 80 or more. ``component_id`` is the smallest id
    reachable by links, ``class_id`` that among documents of the same set, ``kept`` whether the
    document is its component's smallest. Null, empty and blank texts have no shingles and are
    linked with nothing. Rows with a null id are never linked: their component is null and they are
    kept. A repeated id is one document that is linked with whatever one of its rows is linked with;
    rows that repeat a kept id are all kept. Other columns are ignored. An empty table gives an
    empty result.
    """
    if percent < 80:
        raise ValueError("the bands find links of 80 % or more")
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    sketches = materialize(sketch(rows, width), "sketches")
    classes = sketches.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    classes = materialize(classes, "classes")
    own = sketches.select(F.col("doc_id").alias("node"), "set_hash", "n", "bands", "sig")
    nodes = materialize(own.join(classes, ["set_hash", "node"], "left_semi").dropDuplicates(["set_hash"]).select("node", "n", "bands", "sig"), "nodes")

    postings = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "n")
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = materialize(postings.join(materialize(buckets, "buckets"), "key"), "postings")
    small = met.where(F.col("members") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("m"))
    pair = F.transform("m", lambda x: F.struct(x["node"].alias("a"), F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & _fits(x["n"], y["n"], percent)), lambda y: y["node"]).alias("bs")))
    close = small.select(F.explode(F.filter(pair, lambda p: F.size(p["bs"]) > 0)).alias("p")).select("p.a", F.explode("p.bs").alias("b"))
    large = met.where(F.col("members") > SMALL_BUCKET).join(nodes.select("node", "sig"), "node")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / CHUNK).cast("long"))
    large = materialize(large.select("key", "band", "node", "n", "sig", chunk.cast("int").alias("chunk")), "large-buckets")
    sigs = nodes.select("node", "sig")
    pairs = materialize(_agreeing(_ordered(close.union(_central(large, percent))), sigs, threshold), "pairs")

    # Full sets of the documents in a pair or a large bucket; no other text is shuffled or kept.
    needed = pairs.select("a").union(pairs.select("b")).union(large.select(F.col("node").alias("a"))).distinct()
    needed = materialize(needed.select(F.col("a").alias("doc_id")), "needed")
    texts = rows.join(needed.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "t"])
    sets = materialize(full_sets(texts, width), "sets")
    links = materialize(_confirmed(pairs, sets, percent), "links")
    labels = components(links)

    members = large.select("node").distinct()
    unpacked = sets.join(members, "node").select("node", F.explode(_longs(F.col("hashes"))).alias("s"))
    alone = unpacked.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    more = _ordered(_undecided(large, nodes.select("node", "bands"), labels, alone, sets, threshold, percent)).join(pairs, ["a", "b"], "left_anti")
    more = materialize(more, "more-pairs")
    found = materialize(_confirmed(more, sets, percent), "more-links")
    if not found.isEmpty():
        labels = components(links.union(found))

    ids = classes.join(labels, "node", "left").select("set_hash", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    ids = materialize(ids, "class-components")
    out = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(ids, "set_hash", "left")
    linkable = F.col("doc_id").isNotNull()
    component = F.when(linkable, F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.when(linkable, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def _longs(packed: Column) -> Column:
    """Hexadecimal digits of each eight bytes."""
    digits = F.hex(packed)
    return F.transform(
        F.sequence(F.lit(0), (F.length(packed) / 8).cast("int") - 1), lambda k: F.substr(digits, k * 16 + 1, F.lit(16))
    )
