"""Work on what is new: changed segments, and a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prosemill.operators.segmentation import segment
from prosemill.plans.check import check
from prosemill.sources.packs import Pack


def changed_segments(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now`` whose text was in none of ``before``; both have ``text_hash``."""
    return now.join(before.select("text_hash").distinct(), "text_hash", "left_anti")


def new_documents(stream: DataFrame, delay: str | None = None, time_col: str | None = None) -> DataFrame:
    """A stream of documents without texts that came before; with a time column the memory of what
    came is kept for ``delay`` alone."""
    rows = stream.withColumn("content", F.sha2(F.coalesce("text", F.lit("")), 256))
    if delay and time_col:
        return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["content"]).drop("content")
    return rows.dropDuplicates(["content"]).drop("content")


def check_stream(stream: DataFrame, pack: Pack, out: str, checkpoint: str, fmt: str = "text") -> StreamingQuery:
    """Check every micro-batch as a table and append its findings to ``out`` as Parquet.

    A batch that is run again after a failure writes to the folder of its number anew, so nothing
    is written twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        check(batch, pack, fmt, segmented=segment(batch, fmt)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
