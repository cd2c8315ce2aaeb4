"""The rules lane: a pack's phrase, regex and built-in detectors over a segmented corpus.

One projection over the paragraphs asks every detector's pattern whether it matches; so the
paragraphs are read once, however many detectors there are, and what is computed for each is one
compiled pattern. Only a paragraph and detector that match become a row, which meets the small table
of detectors and gets its spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions.regex import phrase_pattern, to_java
from prosemill.functions.spans import exploded, find_spans, let, not_inside
from prosemill.operators.builtins import CHECKS
from prosemill.operators.segmentation import Segmented
from prosemill.sources.packs import Detector, Pack, Policy

HITS = ["doc_id", "policy_id", "detector_id", "detector_ord", "start", "end", "message", "replacement"]


def _pattern(detector: Detector) -> tuple[str, list[str]]:
    """A phrase or regex detector's pattern and its exceptions'."""
    if detector.kind == "phrase":
        return to_java(phrase_pattern(list(detector.phrases)), detector.ignore_case), [to_java(phrase_pattern(list(detector.exceptions)), detector.ignore_case)] if detector.exceptions else []
    return to_java(detector.pattern, detector.ignore_case), [to_java(e, detector.ignore_case) for e in detector.exceptions]


def _matches(detector: Detector) -> Column:
    """Does the detector look at this block, and match in its ``masked`` or ``source``?"""
    found = F.col("masked" if detector.kind == "phrase" else "source").rlike(_pattern(detector)[0])
    return found if detector.blocks is None else F.col("block").isin(list(detector.blocks)) & found


def pattern_hits(seg: Segmented, detectors: list[tuple[int, Policy, Detector]]) -> DataFrame:
    """Hits of phrase and regex detectors, given with their places in the pack."""
    spark = seg.nested.sparkSession
    rows = [(k, p.id, d.id, *_pattern(d), d.kind == "phrase", d.message or p.title, d.replacement) for k, p, d in detectors]
    table = spark.createDataFrame(rows, "detector_ord int, policy_id string, detector_id string, pattern string, exceptions array<string>, on_masked boolean, message string, replacement string")
    asked = F.array_compact(F.array(*[F.when(_matches(d), F.lit(k)) for k, _, d in detectors]))
    met = exploded(seg.paragraphs.select("doc_id", F.col("start").alias("from"), "block", "masked", "source"), asked, "detector_ord")
    # As many rows as the pack has detectors.
    met = met.join(F.broadcast(table), "detector_ord").withColumn("in", F.when(F.col("on_masked"), F.col("masked")).otherwise(F.col("source")))
    spans = F.filter(find_spans(F.col("in"), F.col("pattern")), lambda s: s["start"] < s["end"])
    excused = F.flatten(F.transform("exceptions", lambda e: find_spans(F.col("in"), e)))
    kept = let(excused, lambda found: F.when(F.size(found) == 0, spans).otherwise(not_inside(spans, found)))
    hits = exploded(met.drop("masked", "source"), kept, "h")
    at = lambda c: (F.col("from") + F.col(f"h.{c}")).alias(c)
    return hits.select("doc_id", "policy_id", "detector_id", "detector_ord", at("start"), at("end"), "message", "replacement")


def rule_hits(seg: Segmented, pack: Pack) -> DataFrame:
    """Hits of all rules detectors of enabled policies, one for each policy and span."""
    order = {(p.id, d.id): k for k, (p, d) in enumerate(pack.detectors("phrase", "regex", "builtin"))}
    parts = []
    if patterns := pack.detectors("phrase", "regex"):
        parts.append(pattern_hits(seg, [(order[p.id, d.id], p, d) for p, d in patterns]))
    for p, d in pack.detectors("builtin"):
        found = CHECKS[d.check](seg, d.params, list(d.blocks) if d.blocks is not None else None)
        said = F.lit(d.message) if d.message else F.coalesce(F.col("message"), F.lit(p.title))
        parts.append(found.select("doc_id", F.lit(p.id).alias("policy_id"), F.lit(d.id).alias("detector_id"), F.lit(order[p.id, d.id]).alias("detector_ord"), "start", "end", said.alias("message"), "replacement"))
    if not parts:
        return seg.nested.sparkSession.createDataFrame([], "doc_id long, policy_id string, detector_id string, detector_ord int, start int, end int, message string, replacement string")
    return dedupe(reduce(DataFrame.unionByName, parts))


def dedupe(hits: DataFrame) -> DataFrame:
    """One hit for each document, policy and span: the first with a replacement, else the first."""
    same = Window.partitionBy("doc_id", "policy_id", "start", "end").orderBy(F.col("replacement").isNull(), "detector_ord")
    return hits.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
