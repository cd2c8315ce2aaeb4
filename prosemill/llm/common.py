"""What the training-data operators share: tables, the shared folder, word rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.shared import materialize, shared_dir, shared_path  # noqa: F401

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words.
GAP = r"[\x20\x09-\x0D]+"

#: Texts that a Python worker works on at a time.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, counted: Catalyst's estimate of a table that isn't a plain scan may be any number."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()["n"] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of at most ``SLICE``, so that results of a whole batch never stand beside it."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
