"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

Every document of a source has the same expected number of copies: the source's target over its
size. Along an order of the source's documents the expected copies are summed up from one random
offset, and a document is emitted once for each integer that its share of the sum crosses. The order
goes by classes of size and then by hash, so that the words taken from each class, and with them the
source's, come near what is due with any offset: nothing is tried out or chosen by the data.
Documents of more than a hundredth of their source's words are drawn first, by themselves; what they
took too little or too much is made up by the expected copies of the others.

The order is cut into cells of (source, drawn first or not, class of size, hash bucket); a cell's first rank comes from
a prefix sum over counts of cells, so no task sees a whole source. Rows that repeat an id are counted
before anything is sorted, so an id of very many rows is one row in its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, n_words, text_or_empty

#: Classes of size for each growth by Euler's number.
CLASSES = 6
#: Documents of a source and class for each hash bucket.
ROWS_PER_BUCKET = 1000
#: Documents of a larger part of their source than one in so many are drawn first.
HEAVY = 100
#: Rows of one id and size that are emitted by one task.
ROWS_AT_ONCE = 10_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most_repeats: float = 3.0) -> DataFrame:
    """``source, docs, source_size, target`` from rows of ``source, size, n``, which stand for ``n`` documents.

    Sources in code point order, null last, get the weights in turn. Together they share all sizes;
    a target above ``most_repeats`` times its source's size stops there and the excess is shared
    again by weight. The level at which this ends is found by one pass over the sources in the order
    of capacity to weight, which is the same as sharing again and again.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # One row a source from here on: the windows without a key run over the list of sources.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(n)) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_repeats)))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    )
    # The first source in this order whose share is under its cap sets the level of the rest.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    per = per.withColumn("final", F.min(fits).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "docs", "source_size", target.cast("double").alias("target"))


def _uniform(seed: int, key: Column) -> Column:
    """In [0, 1), the same on every run."""
    return _number(F.md5(F.concat_ws(":", F.lit(seed), key)), 13) / F.lit(float(1 << 52))


def _number(hexadecimal: Column, digits: int) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    most_repeats: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` counts words, 0 for a null or empty text; ``taken`` is ``copies * size``. Null sources
    are one source and come last. A source of empty texts has the target 0 and takes nothing. Null
    ids and repeated rows are documents of their own; among documents of equal id and size it is
    arbitrary which row gets which of their copies. Other columns are ignored. An empty table gives
    an empty result. ``most_repeats`` must be a whole number, as a document can't be taken in parts.
    A source's words come within a hundredth of its words of the target, unless its documents are too
    few or taken too often for that.
    """
    if most_repeats < 1 or most_repeats != int(most_repeats):
        raise ValueError("most_repeats must be a whole number from 1")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size")
    )
    # The rows of one id, source and size; counted before the shuffle, so a hot id is a row a task.
    same = rows.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    same = materialize(same, "mix")
    targets = materialize(source_targets(same, weights, most_repeats), "mix-targets")
    # A row a source: its size is checked by Spark against its broadcast threshold.
    rows = same.join(targets, same["source"].eqNullSafe(targets["source"]), "left").select(same["*"], "source_size", "target")
    # A key that is never null, and differs between a null and any string.
    skey = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    rows = rows.withColumns(
        {
            "h": F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"))),
            "heavy": F.col("size") * HEAVY > F.col("source_size"),
            "cls": F.floor(F.log(F.col("size") + 1) * CLASSES),
            "skey": skey,
        }
    )
    # About a hundred rows a source.
    part = ["skey", "heavy", "cls"]
    classes = rows.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET).cast("long").alias("buckets"))
    rows = rows.join(materialize(classes, "mix-classes"), part).withColumn("bucket", _number(F.col("h"), 8) % F.col("buckets"))
    cell = [*part, "bucket"]
    cells = rows.groupBy(cell).agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("skey", "heavy").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = Window.partitionBy(cell).orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(cells, cell)
    rows = rows.withColumns({"offset": _uniform(seed, F.col("skey")), "rank": F.col("first") + F.col("before")})
    rows = materialize(rows.select("doc_id", "source", "size", "source_size", "target", "skey", "heavy", "offset", "rank", "n"), "mix-ranks")

    def crossed(upto: Column, rate: Column) -> Column:
        return F.floor(upto * rate + F.col("offset"))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = (crossed(F.col("rank") + F.col("n"), rate) - crossed(F.col("rank"), rate)) * F.col("size")
    heavy = rows.where("heavy").groupBy("skey").agg(F.sum(drawn).alias("drawn"), F.sum(F.col("size") * F.col("n")).alias("heavy_size"))
    rows = rows.join(materialize(heavy, "mix-heavy"), "skey", "left")
    drawn, held = F.coalesce("drawn", F.lit(0)), F.coalesce("heavy_size", F.lit(0))
    others = (F.col("target") - drawn) / F.nullif(F.col("source_size") - held, F.lit(0).cast("long"))
    others = F.least(F.greatest(F.coalesce(others, F.lit(0.0)), F.lit(0.0)), F.lit(float(most_repeats)))
    rows = rows.withColumn("rate", F.when(F.col("heavy"), rate).otherwise(others))
    # One row for each document again; those of one id in blocks, which may be dealt out.
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ROWS_AT_ONCE).cast("long")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "rate", "offset", "rank", "n", block.alias("block"))
    rows = rows.repartition("doc_id", "size", "block")
    start = F.col("block") * ROWS_AT_ONCE + 1
    nth = F.explode(F.sequence(start, F.least(F.col("n"), start + (ROWS_AT_ONCE - 1))))
    rows = rows.select("*", nth.alias("nth")).withColumn("upto", F.col("rank") + F.col("nth"))
    copies = crossed(F.col("upto"), F.col("rate")) - crossed(F.col("upto") - 1, F.col("rate"))
    # Rounding of the sums may carry one integer too far where the rate is the cap itself.
    rows = rows.withColumn("copies", F.least(copies, F.lit(int(most_repeats))).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
