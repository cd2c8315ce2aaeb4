"""Quality rules: plain measures of a text, then a log-likelihood ratio of hashed n-grams.

DataFrame functions only. The n-grams are a text's words and its pairs of neighbouring words; they
are hashed into a fixed number of buckets. Over the buckets, a multinomial of trusted texts is
held against one of the whole corpus; a text's score is the mean of the logarithm of their ratio
over its n-grams, so it doesn't grow with the text's length. Counts are smoothed by ``SMOOTH`` of the
corpus and as many of the target as its share, and an n-gram's own occurrence isn't counted, so that
one that stands nowhere else says nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import GAP, materialize, text_or_empty

BUCKETS, SMOOTH = 1 << 16, 16.0
#: So many ids of trusted documents are sent to all executors; where there are more, texts are dealt out by id.
MOST_SENT = 1_000_000
#: Natural logarithms an n-gram, in the mean; below it a text is nearer to the corpus than to the target.
THRESHOLD = -0.15
#: The rules' limits and signs.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " ", -1), "")


def repeated_words(text: Column, words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the text, the first included.

    Windows are compared by hashes first: where these are all distinct, so are the windows.
    """
    at = lambda w: F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = lambda w: F.transform(at(w), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    spaced = F.trim(F.regexp_replace(text, GAP, " "))
    windows = F.regexp_extract_all(spaced, F.lit(rf"(?:^| )(?=((?:[^ ]+ ){{{WINDOW - 1}}}[^ ]+))"), F.lit(1))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["words"] + i + WINDOW - F.greatest(i, acc["end"])).alias("words"))
        return F.aggregate(F.array_sort(at), zero, step, lambda acc: acc["words"])

    def twice(ordered: Column) -> Column:
        # In order, equal windows are neighbours. Beyond the ends there is none: a null, so no match.
        same = lambda x, j: F.coalesce(F.get(ordered, j)["w"] == x["w"], F.lit(False))
        hit = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return covered(F.transform(hit, lambda x: x["i"]))

    numbered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    differ = lambda h: F.size(h) == F.size(F.array_distinct(h))
    # The words are bound here: an optimizer that moves this expression must not split the text in a loop.
    alone = _let(words, lambda w: (F.size(w) <= WINDOW) | _let(hashes(w), differ))
    return F.when(alone, F.lit(0)).otherwise(_let(numbered, twice)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def buckets_of(words: Column) -> Column:
    """A bucket for each word and each pair of neighbours."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    but_last, but_first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words))
    pairs = F.zip_with(but_last, but_first, lambda a, b: bucket(a, b))
    return F.concat(F.transform(words, lambda w: bucket(w)), pairs)


def target_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, most: int | None = None, sent: int = MOST_SENT) -> list[float]:
    """For each bucket the logarithm of the ratio; zeros without trusted texts.

    All of ``docs`` and all trusted texts are counted. ``trusted`` has the column ``doc_id``. Up to
    ``sent`` different ids are sent to all executors, and no text is shuffled; more are hashed partition
    by partition, and meet the texts dealt out by id, which aren't sorted. Only a caller that gives
    ``most`` gets a target of about so many ids, those of some hashes.
    """
    good = materialize(trusted.where("doc_id is not null").select(F.col("doc_id").alias("good")).distinct(), "trusted")
    total = good.count()
    if most is not None and total > most:
        good = good.where(F.pmod(F.xxhash64("good"), F.lit(total)) < most)
        total = most
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    same = F.col("doc_id") == F.col("good")
    if total <= sent:
        rows = rows.join(F.broadcast(good), same, "left")
    else:
        # Rows of a null id are never trusted; they stay where they are, so that they don't meet in one task.
        none = rows.where("doc_id is null").withColumn("good", F.lit(None).cast(good.schema["good"].dataType))
        rows = rows.where("doc_id is not null").join(good.hint("shuffle_hash"), same, "left").unionByName(none)
    grams = rows.select(F.col("good").isNotNull().cast("long").alias("good"), F.explode(_let(words_of(F.col("t")), buckets_of)).alias("bucket"))
    # BUCKETS rows come back, whatever the input's size.
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["good"]
    if not sum(target):
        return [0.0] * BUCKETS
    share = sum(target) / sum(raw)
    return [math.log((g + SMOOTH * share) / (max(r, 1) - 1 + SMOOTH)) - math.log(share) for r, g in zip(raw, target, strict=True)]


def likelihood_ratio(words: Column, ratios: list[float]) -> Column:
    """Mean over the n-grams; null without words."""
    # One literal that folds into an array, not one literal a bucket.
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda acc, k: acc + F.get(table, k)) / F.size(b)
    return _let(words, lambda w: F.when(F.size(w) > 0, _let(buckets_of(w), total)))


def apply_quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    most_trusted: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr``.

    A text is kept if it passes the base rules (10 words, at most 20 % repeated words) and its mean
    log-likelihood ratio is at least ``threshold``. Null and empty texts have no words and fail.
    Without trusted texts all ratios are 0. Ids only find trusted texts: null ids are none, repeated
    ids are rows of their own. Other columns are ignored. An empty table gives an empty result.
    """
    ratios = target_ratios(docs, trusted, id_col, text_col, most_trusted)
    t, w = F.col("t"), F.col("w")
    length = lambda c: F.length(c).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).withColumn("w", words_of(t))
    rows = rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        length(F.translate(t, WHITE, "")).alias("word_chars"),
        (length(t) - length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        duplicate_lines(t).alias("n_dup_lines"),
        repeated_words(t, w).alias("n_repeat_words"),
        likelihood_ratio(w, ratios).alias("llr"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= threshold)
    return rows.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
