"""Token counts of documents without their ids.

Each worker counts the pieces of a distinct pre-token once, joins these counts to a document's
pre-token frequencies and sums; the join is a look-up in the worker's own table, which is bounded.
The same join by shuffle, once for the whole table, was built and measured: a document holds some
300 distinct pre-tokens, so it moves about as much as the texts and needs more disk than the check
tool allows (README). A document's count needs the document alone, so nothing is shuffled here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import text_or_empty


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer``: path of a tokenizers ``.json`` or a sentencepiece ``.model`` file, there on all
    executors. No begin, end or added special tokens, no truncation. A null text counts as empty
    and has no tokens. Null and repeated ids are rows of their own; other columns are ignored. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prosemill.llm.encoding import token_counter

        counter = token_counter(tokenizer)
        for batch in batches:
            counts = pa.array([counter.count(t.as_py()) for t in batch.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
