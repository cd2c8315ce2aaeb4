"""A corpus pipeline of five of the training-data operators.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame. ``run`` applies them in order to ``documents``; what a stage returns is written as
Parquet in the shared folder and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. ``ORACLE_SQL`` is None, as SQL can express neither the learned classifier
nor the packing; the tests hold each stage against a plain version of its own.

Every stage takes null, empty and very long texts, null and repeated ids, and an empty table, and
rows keep their other columns. Rows of a null id are never dropped as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, n_words, table, text_or_empty
from prosemill.llm.exact import exact_groups
from prosemill.llm.minhash import near_duplicates
from prosemill.llm.mixing import mix_sources
from prosemill.llm.packing import pack_documents
from prosemill.llm.queries import vocabulary
from prosemill.llm.ranking import keep_good, learn


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go. Null and empty texts are scored as any other."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; an id's other texts are judged by themselves."""
    verdict = exact_groups(docs, keep="largest").where("not kept").select("doc_id", F.unhex("text_sha256").alias("dropped-text")).distinct()
    own = docs.withColumn("dropped-text", F.unhex(F.sha2(text_or_empty("text"), 256)))
    return _without(own, verdict, "doc_id", "dropped-text").drop("dropped-text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 the one with the smallest id stays."""
    verdict = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return _without(docs, verdict, "doc_id")


def _without(docs: DataFrame, dropped: DataFrame, *by: str) -> DataFrame:
    # Written out first, so that Spark knows the size of what goes: few ids are sent to all
    # executors, many are hashed partition by partition, and the texts are never sorted.
    dropped = materialize(dropped.where("doc_id is not null"), "dropped")
    return docs.join(dropped.hint("shuffle_hash"), list(by), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, which may be none.

    Rows of one id, source and size share the copies that the mix gives these: they are numbered by
    their texts' hashes, and the first ones get one more where copies don't divide evenly. Nulls
    are keys like any others.
    """
    keys = {"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.col("doc_id").isNull(), "k3": F.coalesce("source", F.lit("")), "k4": F.col("source").isNull()}
    names = [f"mix-{k}" for k in (*keys, "size", "nth", "copies", "rows", "time")]  # not a column of documents
    k1, k2, k3, k4, size, nth, copies, rows, time = names
    by = [k1, k2, k3, k4, size]
    keyed = lambda df: df.withColumns(dict(zip((k1, k2, k3, k4), keys.values(), strict=True)))
    taken = keyed(mix_sources(docs).withColumnRenamed("size", size)).groupBy(by).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    taken = materialize(taken.where(F.col(copies) > 0), "copies")
    own = keyed(docs).withColumn(size, n_words(text_or_empty("text")))
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("text"))))
    own = own.join(taken, by)
    share = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(nth) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    own = own.withColumn(copies, share.cast("int")).where(F.col(copies) > 0)
    return own.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(time)).drop(time)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
