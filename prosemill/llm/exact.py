"""Exact deduplication by content hash, DataFrame functions only.

Rows are grouped by the 128-bit MD5 of their text. Only rows of groups of two or more move their
text: inside a hash group they are grouped by the bytes themselves, so texts that merely share a
hash fall apart again. Both aggregations combine before the shuffle, so a group that holds a third
of all rows arrives as one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, text_or_empty


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep``: the ``smallest`` or ``largest`` id of equal texts stays. A null text counts as empty,
    so null and empty texts are one group. Null ids never win against a number; a group of null ids
    alone keeps null, and its rows stay. Rows repeated with their id are counted one by one, and
    all rows that bear the winning id stay. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("h"), text.alias("t"))
    slim = rows.select("doc_id", "h", F.unhex(F.sha2("t", 256)).alias("s"))
    # The few hashes that rows share are written out: as a scan on its own they are either small
    # enough to be sent to all executors, or dealt anew, so that a hot hash can be split.
    shared = materialize(slim.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h"), "exact-hashes")
    suspects = rows.join(shared, "h", "left_semi")
    same = (
        suspects.groupBy("h", "t")
        .agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        .where("group_size > 1")
        .select("h", F.unhex(F.sha2("t", 256)).alias("s"), "group_size", "keep_id")
    )
    # Texts that share MD5 and SHA-256 but not their bytes would give two rows here.
    same = same.groupBy("h", "s").agg(
        F.count(F.lit(1)).alias("variants"), F.max("group_size").alias("group_size"), best("keep_id").alias("keep_id")
    )
    same = same.withColumn(
        "group_size",
        F.when(F.col("variants") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two hashes collide")).cast("long")),
    ).select("h", "s", "group_size", "keep_id")
    same = materialize(same, "exact-groups")
    grouped = F.col("group_size").isNotNull()
    keep_id = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return slim.join(same, ["h", "s"], "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("s")).alias("text_sha256"),
    )
