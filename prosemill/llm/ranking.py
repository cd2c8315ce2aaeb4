"""Document quality learned from preference pairs (Bradley-Terry).

A document of a labelled sample that is marked good is preferred to one that is marked bad. The
logistic loss on the difference of their features gives one weight a feature; a document's strength
is the weighted sum. The strength at the quantile that parts the sample as its labels do becomes
the threshold, which the scores' scale puts at ``CUT``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import sliced, text_or_empty

#: Score at the threshold.
CUT = 0.7
#: Labelled documents that the weights are learned from, at most: those of the smallest hashes.
MOST_LABELS = 12_000
#: Bad documents that each good one is compared with.
PAIRS_EACH = 8

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~=+{}[]\\_`"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?"]] = True
_BANG = ord("!")
_COMMA = ord(",")
N_FEATURES = 15


def features(text: str) -> list[float]:
    """Measures of form alone; an empty text has only zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    n, w = len(raw), len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda which: float(seen[which].sum()) / n
    letters = n - int(seen[:65].sum())
    return [
        share(_UPPER),
        min(1.0, 4 * share(_UPPER)),
        share(_DIGIT),
        share(_SYMBOL),
        min(1.0, 20 * share(_SYMBOL)),
        min(1.0, float(seen[_BANG]) / w),
        min(1.0, float(seen[_STOP].sum()) / w * 4),
        min(1.0, float(seen[_COMMA]) / w * 4),
        letters / n,
        min(1.0, n / w / 20),
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        min(1.0, len(lines) / w * 4),
        min(1.0, np.log1p(w) / 10),
        min(1.0, len(zlib.compress(raw, 1)) / n),
    ]


@dataclass(frozen=True)
class Ranker:
    """What was learned; sent to the executors, of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weights
        z = np.clip((strength - self.threshold) * self.slope + np.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 5, ridge: float = 1e-3) -> Ranker | None:
    """Weights by Newton's method on pairs of one good and one bad row; None without both kinds."""
    wins, losses = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(wins) or not len(losses):
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    difference = z[np.repeat(wins, PAIRS_EACH)] - z[rng.choice(losses, len(wins) * PAIRS_EACH)]
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ (1 - p) / len(p) - ridge * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(p) + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ weights
    threshold = float(np.quantile(strength, len(losses) / len(x)))
    return Ranker(mean, scale, weights, threshold, 1.0 / max(float(strength.std()), 1e-6) * 4)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measured(batch: pa.RecordBatch, at: int = -1) -> np.ndarray:
    """``at``: the place of the text; it is the last column where none is given."""
    return np.array([features(t.as_py() or "") for t in batch.column(at % batch.num_columns)], float).reshape(-1, N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> Ranker | None:
    """Learn from at most ``most`` labelled documents (``doc_id, quality``), held-out ones excluded.

    An id that is labelled both ways tells nothing and goes. Of several texts of one id that of the
    smallest features counts, so that every labelled id weighs the same.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    sample = usable.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers are sent to all executors, and as many of features come back:
    # rows of one id are combined before they leave a task.
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(_measured(batch).tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            )

    rows = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "t").mapInArrow(run, "doc_id long, quality int, x array<double>")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("x"))["x"].alias("x"))
    got = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.collect())
    if not got:
        return None
    return fit(np.array([r[2] for r in got]), np.array([r[1] == 1 for r in got]))


def score_documents(docs: DataFrame, ranker: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the score of their features, which are zeros. Without a ranker, that is
    without labels of both kinds, nothing can be told apart and every score is 1. Null ids aren't
    held out; ids, repeated or not, play no part in a score. Other columns are ignored. An empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = ranker.scores(_measured(batch)) if ranker else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, ranker: Ranker | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    if ranker is None:
        return docs

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield part.filter(pa.array(ranker.scores(_measured(part, at)) >= CUT))

    return docs.mapInArrow(run, docs.schema)
