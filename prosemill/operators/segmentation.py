"""Documents to paragraphs and sentences with exact offsets.

Plain texts are segmented by expressions inside the JVM. Only a text in a Markdown format, or one
that holds inline markup or letters that Unicode normal form could change, goes through the Python
kernel of ``markup``; both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.spans import exploded, laid_out, let, normalized
from prosemill.operators import markup

SENTENCE = "struct<start:int,end:int,source:string,masked:string,text:string>"
PARAGRAPH = (
    "struct<start:int,end:int,block:string,container:string,source:string,masked:string,text:string,"
    f"sentences:array<{SENTENCE}>>"
)
SCHEMA = f"doc_id long, text string, paragraphs array<{PARAGRAPH}>, protected array<struct<kind:string,start:int,end:int>>"

#: Signs of inline markup, and characters beyond those that normal form leaves alone.
NEEDS_KERNEL = r"[`\[\]<{}*_~\\]|https?://|[^\x{00}-\x{2FF}\x{2010}-\x{2027}]|[\x1C-\x1F\x85\xA0]"
_BLOCK = r"(?d)[^\s](?:.*[^\s])?(?:\n[ \t]*[^\s].*)*"
_ABBREVIATED = "|".join(re.escape(a) for a in markup.ABBREVIATIONS)
_AFTER = r"""(?:^|[\s(\["“'‘])"""
#: A full stop that ends no sentence stands after an initial, a dotted or a listed abbreviation. These
#: look back from behind the stop: in front of it they would be tried at every sign of the text.
_STOP = rf"\.(?<!{_AFTER}[A-Z]\.)(?<!{_AFTER}(?:[A-Za-z]\.){{2,10}})(?<!{_AFTER}(?i:{_ABBREVIATED})\.)"
_T, _C, _O = markup.TERMINATORS, r"\"'”’)\]*_", r"\"'“‘(\[*_`"
#: What ends a sentence, by what follows it.
BOUNDARY = rf"(?d)(?<![{_T}])(?:[{_T}]++[{_C}]*+(?=\s*\z)|(?:{_STOP}|[!?…])[{_T}]*+[{_C}]*+(?=\s+[{_O}]*+[\p{{Lu}}\p{{Nd}}²³¹]))"


def _pieces(source: Column) -> Column:
    """Spans of the sentences of a text without markup, trimmed, relative to it."""
    marked = F.regexp_replace(source, BOUNDARY, "$0\u0001")
    spans = let(F.split(marked, "\u0001", -1), lambda parts: laid_out(F.array_repeat(F.lit(""), F.size(parts)), parts))
    inner = lambda s: let(F.regexp_replace(s["m"], r"^\s+", ""), lambda x: F.struct((s["end"] - F.length(x)).alias("start"), F.regexp_replace(x, r"\s+\z", "").alias("m")))
    cut = F.transform(F.transform(spans, inner), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), s["m"].alias("m")))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def _native(text: Column) -> Column:
    """Paragraphs of a plain text."""
    gaps = F.split(text, _BLOCK, -1)
    blocks = F.filter(laid_out(gaps, F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))), lambda b: b["start"] < b["end"])

    def paragraph(b: Column) -> Column:
        return let(F.struct(b["start"].alias("start"), F.regexp_replace(b["m"], r"\s+\z", "").alias("source")), whole)

    def whole(b: Column) -> Column:
        source = b["source"]
        sentence = lambda s: F.struct(
            (b["start"] + s["start"]).alias("start"), (b["start"] + s["end"]).alias("end"), s["m"].alias("source"), s["m"].alias("masked"), normalized(s["m"]).alias("text")
        )
        return F.struct(
            b["start"].alias("start"),
            (b["start"] + F.length(source)).alias("end"),
            F.lit("paragraph").alias("block"),
            F.lit(None).cast("string").alias("container"),
            source.alias("source"),
            source.alias("masked"),
            normalized(source).alias("text"),
            F.transform(_pieces(source), sentence).alias("sentences"),
        )

    return F.transform(blocks, paragraph)


def _by_kernel(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("paragraphs", _arrow(PARAGRAPH)), ("protected", _arrow("struct<kind:string,start:int,end:int>"))])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200).to_pylist()
                done = [markup.segmented(r["text"], r["format"]) for r in part]
                data = {"doc_id": [r["doc_id"] for r in part], "text": [r["text"] for r in part], "paragraphs": [d[0] for d in done], "protected": [d[1] for d in done]}
                yield pa.RecordBatch.from_pydict(data, schema=kind)

    return rows.select("doc_id", "text", "format").mapInArrow(run, SCHEMA)


def _arrow(struct: str) -> pa.DataType:
    strings = lambda names: [(n, pa.string()) for n in names]
    place = [("start", pa.int32()), ("end", pa.int32())]
    if struct == PARAGRAPH:
        sentence = pa.struct([*place, *strings(["source", "masked", "text"])])
        return pa.list_(pa.struct([*place, *strings(["block", "container", "source", "masked", "text"]), ("sentences", pa.list_(sentence))]))
    return pa.list_(pa.struct([("kind", pa.string()), *place]))


def segment(docs: DataFrame, fmt: str | Column = "text", id_col: str = "doc_id", text_col: str = "text") -> Segmented:
    """Segment ``docs``; ``fmt`` is ``text``, ``markdown`` or ``markus``, or a column of these."""
    kind = F.lit(fmt) if isinstance(fmt, str) else fmt
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), kind.alias("format"))
    if isinstance(fmt, str) and fmt not in ("text", "markdown", "markus"):
        raise ValueError(f"unsupported content format {fmt!r}")
    needs = (F.col("format") != "text") | F.col("text").rlike(NEEDS_KERNEL)
    plain = rows.where(~needs).select(
        "doc_id", "text", _native(F.col("text")).cast(f"array<{PARAGRAPH}>").alias("paragraphs"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("protected")
    )
    # Single-file inputs come as one partition: the work on a text is worth dealing out.
    return Segmented(plain.unionByName(_by_kernel(rows.where(needs))))


@dataclass
class Segmented:
    """A table of segmented documents: ``doc_id, text, paragraphs, protected``."""

    nested: DataFrame

    @cached_property
    def paragraphs(self) -> DataFrame:
        """``doc_id, p, start, end, block, container, source, masked, text, n_sentences``; p from 0."""
        rows = self.nested.select("doc_id", F.posexplode_outer("paragraphs").alias("p", "x")).where("p is not null")
        return rows.select("doc_id", "p", "x.start", "x.end", "x.block", "x.container", "x.source", "x.masked", "x.text", F.size("x.sentences").alias("n_sentences"))

    @cached_property
    def sentences(self) -> DataFrame:
        """As paragraphs, with ``s`` from 0 in its paragraph, and the paragraph's text as ``p_text``."""
        rows = self.nested.select("doc_id", F.posexplode_outer("paragraphs").alias("p", "x")).where("p is not null")
        rows = rows.select("doc_id", "p", "x.block", "x.container", F.col("x.text").alias("p_text"), F.posexplode_outer("x.sentences").alias("s", "y")).where("s is not null")
        return rows.select("doc_id", "p", "s", "y.start", "y.end", "block", "container", "y.source", "y.masked", "y.text", "p_text")

    @cached_property
    def protected(self) -> DataFrame:
        return exploded(self.nested.select("doc_id", "protected"), F.col("protected"), "r").select("doc_id", "r.kind", "r.start", "r.end")

    def rows(self) -> DataFrame:
        """Every segment in document order with its stable id: the document, then each paragraph
        followed by its sentences.

        An id is the hash of the segment's own text, with ``-n`` from the second repeat in the
        document on, so edits elsewhere leave it alone.
        """
        base = lambda df, kind, s, p: df.select("doc_id", F.lit(kind).alias("kind"), "p", s.alias("s"), "start", "end", "block", "container", "source", "text", p.alias("parent"))
        none = F.lit(None).cast("string")
        parts = base(self.paragraphs, "paragraph", F.lit(-1), none).unionByName(base(self.sentences, "sentence", F.col("s"), none))
        hashed = F.sha2("text", 256)
        prefix = F.when(F.col("kind") == "paragraph", "p-").otherwise("s-")
        parts = parts.withColumn("text_hash", F.substring(hashed, 1, 16)).withColumn("base", F.concat(prefix, F.substring(hashed, 1, 12)))
        repeat = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("p", "s"))
        parts = parts.withColumn("id", F.concat("base", F.when(repeat > 1, F.concat(F.lit("-"), repeat)).otherwise("")))
        owner = F.first(F.when(F.col("kind") == "paragraph", F.col("id")), ignorenulls=True).over(Window.partitionBy("doc_id", "p"))
        parts = parts.withColumn("parent_id", F.when(F.col("kind") == "paragraph", F.lit("doc")).otherwise(owner))
        document = self.nested.select(
            "doc_id", F.lit("document").alias("kind"), F.lit(-1).alias("p"), F.lit(-1).alias("s"), F.lit(0).alias("start"), F.length("text").alias("end"),
            none.alias("block"), none.alias("container"), F.col("text").alias("source"), normalized(F.col("text")).alias("text"),
            F.substring(F.sha2(normalized(F.col("text")), 256), 1, 16).alias("text_hash"), F.lit("doc").alias("id"), none.alias("parent_id"),
        )
        return document.unionByName(parts.select(document.columns))


