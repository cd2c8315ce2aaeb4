"""Packing documents into token sequences by the sum-of-squares rule.

A document's ids are cut into pieces of at most the sequence length. Full pieces are sequences of
their own. The others are dealt by hash into groups of bounded size, whose number grows with the
input; a group is packed in one task, from its longest piece to its shortest: each piece goes to
the open sequence for which the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest; a new one is opened only if no open one has room.
With ``weigh_new`` a new sequence competes by the same sum, as where pieces come one by one; from
the longest piece on it needs a few sequences more (README), so it isn't the default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, sliced, text_or_empty

#: Pieces of a group, about. A group wastes less than about one sequence of its thousands.
PIECES_PER_GROUP = 8192


def place(lengths: list[int], size: int, weigh_new: bool = False) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; pieces are placed in the order given."""
    open_by_gap: list[list[int]] = [[] for _ in range(size)]
    n = np.zeros(size + 1, dtype=np.int64)  # n[g]: open sequences with the gap g; a gap of 0 isn't open
    filled: list[int] = []
    where, offset = [], []
    for s in lengths:
        have = n[s:size]
        best = -1
        if s < size and have.any():
            # Half the change of the sum when a sequence moves from the gap g to g - s.
            change = n[: size - s] - have + 1.0
            change[0] = 0.5 - have[0]
            change[have == 0] = np.inf
            best = int(change.argmin()) + s
            if weigh_new and n[size - s] + 0.5 < change[best - s]:
                best = -1
        if best < 0:
            at, gap = len(filled), size
            filled.append(0)
        else:
            at, gap = open_by_gap[best].pop(), best
            n[best] -= 1
        where.append(at)
        offset.append(filled[at])
        filled[at] += s
        if gap > s:
            open_by_gap[gap - s].append(at)
            n[gap - s] += 1
    return where, offset


def document_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prosemill.llm.encoding import id_encoder

        encoder, end = id_encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for part in sliced(batches):
            out: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("t"), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for k in range(0, len(ids), 4 * size):
                    own = ids[k : k + 4 * size]
                    row = (doc_id, k // (4 * size), k // 4, len(own) // 4, zlib.crc32(own))
                    out.append((*row, own) if with_ids else row)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 6 if with_ids else 5]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def pack_pieces(pieces: DataFrame, size: int, key: list[str], per_group: int = PIECES_PER_GROUP, weigh_new: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` must be from 1 to ``size``.

    ``key`` names the columns that order pieces of equal length; rows that are equal in all of them
    are interchangeable. Rows are dealt to groups by place as well, so that no number of equal rows
    makes a group large.
    """
    pieces = materialize(pieces, "pieces")
    short = pieces.where(F.col("length") < size)
    groups = max(1, -(-short.count() // per_group))
    # The pieces lie in files now, so a row's number is the same whenever a task is run again.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *key), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *key], ascending=[False] + [True] * len(key), kind="stable")
        where, offset = place(pdf["length"].tolist(), size, weigh_new)
        return pdf.assign(sequence_id=pdf["group"].to_numpy() * (1 << 32) + np.array(where, dtype=np.int64), offset=np.array(offset, dtype=np.int64))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = dealt.where(F.col("length") < size).groupBy("group").applyInPandas(pack, f"{fields}, sequence_id long, offset long")
    # Full pieces need no packing: they are numbered below zero, by partition and row.
    full = dealt.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full).drop("group")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` for every piece.

    A document is its ids and then ``end_id``; a null or empty text is the end id alone, so every
    row of ``docs`` gives at least one piece. Repeated rows and null ids are packed as documents of
    their own. Other columns are ignored. An empty table gives an empty result.
    """
    pieces = document_pieces(docs, tokenizer, size, end_id, with_ids, id_col, text_col)
    return pack_pieces(pieces, size, ["doc_id", "piece", "ids_crc32"])
