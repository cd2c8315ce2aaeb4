"""``check``: documents and a pack to located, numbered findings.

A hit belongs to the smallest segment that holds it: the sentence, else the paragraph, else the
document. Segments and hits of a document are sorted together by place; the candidate is the last
segment that begins at or before the hit. That is one shuffle by document, no range join, and no
text of a document beside every hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prosemill.functions.spans import find_spans, normalized, utf16_length
from prosemill.operators.classifier import Lane, run_lane
from prosemill.operators.segmentation import Segmented, segment
from prosemill.plans.rules import rule_hits
from prosemill.sources.packs import Pack

SEPARATOR = "\u001f"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def locate(hits: DataFrame, seg: Segmented) -> DataFrame:
    """``hits`` with the located segment: ``segment_kind, segment_id, segment_source, segment_start``."""
    place = F.struct("start", "end", "id", "source")
    rows = seg.rows().where("kind != 'document'")
    of = lambda kind: F.when(F.col("kind") == kind, place).alias(kind)
    rows = rows.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("is_hit"), of("sentence"), of("paragraph"))
    marks = hits.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("is_hit"), F.struct(*[c for c in hits.columns if c != "doc_id"]).alias("hit"))
    every = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("at", "is_hit").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(c, ignorenulls=True).over(before)
    every = every.withColumns({"sentence": held("sentence"), "paragraph": held("paragraph")}).where("is_hit = 1")
    inside = lambda c: F.when(F.col(f"{c}.end") >= F.col("hit.end"), F.col(c))
    every = every.withColumns({"in_s": inside("sentence"), "in_p": inside("paragraph")})
    inner = F.coalesce("in_s", "in_p")
    kind = F.when(F.col("in_s").isNotNull(), "sentence").when(F.col("in_p").isNotNull(), "paragraph").otherwise("document")
    return every.select(
        "doc_id", "hit.*", kind.alias("segment_kind"), F.coalesce(inner["id"], F.lit("doc")).alias("segment_id"), F.coalesce(inner["source"], F.lit("")).alias("segment_source"),
        F.coalesce(inner["start"], F.lit(0)).alias("segment_start"),
    )


def _of_segments(hits: DataFrame, seg: Segmented) -> DataFrame:
    """Hits of the classifier lane belong to the segment that was asked about."""
    ids = seg.rows().where("kind != 'document'").select("doc_id", F.col("kind").alias("segment_kind"), "p", "s", F.col("id").alias("segment_id"), F.col("source").alias("segment_source"))
    rows = hits.join(ids, ["doc_id", "segment_kind", "p", "s"], "left").drop("p", "s")
    return rows.withColumns({"segment_id": F.coalesce("segment_id", F.lit("doc")), "segment_source": F.coalesce("segment_source", F.lit("")), "segment_start": F.col("start")})


def findings(hits: DataFrame, seg: Segmented, pack: Pack, judged: DataFrame | None = None) -> DataFrame:
    """Findings with ids that depend on the finding's own text alone, so they survive edits elsewhere.

    ``hits``: of the rules lane; ``judged``: of the classifier lane.
    """
    rows = locate(hits, seg).withColumns({"lane": F.lit("rules"), "status": F.lit("violation"), "probability": F.lit(None).cast("double"), "raw_probability": F.lit(None).cast("double")})
    if judged is not None:
        rows = rows.unionByName(_of_segments(judged, seg).withColumn("lane", F.lit("classifier")))
    rows = rows.withColumn("excerpt", F.substr("segment_source", F.col("start") - F.col("segment_start") + 1, F.col("end") - F.col("start")))
    rows = rows.withColumn("excerpt_text", normalized(F.col("excerpt")))
    same = Window.partitionBy("doc_id", "policy_id", "detector_id", "segment_id", "excerpt_text").orderBy("start", "end")
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    key = F.concat_ws(SEPARATOR, "policy_id", "detector_id", normalized(F.col("segment_source")), "excerpt_text", F.col("occurrence").cast("string"))
    level = F.create_map(*[F.lit(x) for p in pack.policies for x in (p.id, p.severity)]) if pack.policies else F.lit(None)
    version = F.create_map(*[F.lit(x) for p in pack.policies for x in (p.id, p.version)]) if pack.policies else F.lit(None)
    # Places of characters that take two UTF-16 units; most documents have none and send no row.
    wide = seg.nested.where(F.col("text").rlike(ASTRAL)).select("doc_id", F.transform(find_spans(F.col("text"), ASTRAL), lambda s: s["start"]).alias("wide"))
    rows = rows.join(wide, "doc_id", "left")
    u16 = lambda c: F.when(F.col("wide").isNull(), F.col(c)).otherwise(F.col(c) + F.size(F.filter("wide", lambda w: w < F.col(c))))
    return rows.select(
        "doc_id",
        F.concat(F.lit("f-"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"),
        "policy_id",
        F.element_at(version, F.col("policy_id")).alias("policy_version"),
        "detector_id",
        F.element_at(level, F.col("policy_id")).alias("severity"),
        "segment_id",
        "segment_kind",
        "start",
        "end",
        u16("start").alias("u16_start"),
        u16("end").alias("u16_end"),
        "excerpt",
        "excerpt_text",
        "occurrence",
        "message",
        "replacement",
        "lane",
        "status",
        "probability",
        F.when(F.col("raw_probability") != F.col("probability"), F.col("raw_probability")).alias("raw_probability"),
    )


def shared(seg: Segmented) -> Segmented:
    """Segments that several parts of a plan read: they are computed once, and spill to disk."""
    seg.nested.persist(StorageLevel.MEMORY_AND_DISK)
    return seg


def check(docs: DataFrame, pack: Pack, fmt: str = "text", id_col: str = "doc_id", text_col: str = "text", segmented: Segmented | None = None, lane: Lane | None = None) -> DataFrame:
    """Findings of a pack over ``docs``: of the rules lane and, if it was run, of the classifier lane."""
    seg = segmented or shared(segment(docs, fmt, id_col, text_col))
    return findings(rule_hits(seg, pack), seg, pack, lane.hits if lane else None)


def results(docs: DataFrame, pack: Pack, fmt: str = "text", rules: bool = True, classifier: bool = True, **asking) -> DataFrame:
    """``doc_id, result``: one JSON document for each text, as a check of that text alone gives.

    ``rules`` and ``classifier`` switch the lanes; ``asking`` goes to ``run_lane``, without a ``model`` the
    classifier lane is unavailable.
    """
    seg = shared(segment(docs, fmt))
    lane = run_lane(seg, pack, asking.pop("model", None), **asking) if classifier else None
    hits = rule_hits(seg, pack if rules else Pack(pack.id, pack.version, ()))
    found = findings(hits, seg, pack, lane.hits if lane else None)
    listed = F.struct(
        "start", "end", F.col("policy_id").alias("policyId"), F.col("detector_id").alias("detectorId"), "id", F.col("policy_version").alias("policyVersion"), "lane", "severity", "status",
        F.col("segment_id").alias("segmentId"), F.struct(F.col("u16_start").alias("start"), F.col("u16_end").alias("end")).alias("span"), "excerpt", F.col("excerpt_text").alias("excerptText"),
        "message", "probability", F.col("raw_probability").alias("rawProbability"), "replacement",
    )
    per = found.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(listed)), lambda f: f.dropFields("start", "end")).alias("findings"))
    # UTF-16 places from the places of wide characters: no text goes beside its segments.
    heads = seg.nested.withColumn("wide", F.transform(find_spans(F.col("text"), ASTRAL), lambda s: s["start"]))
    u16 = lambda at: at + F.size(F.filter("wide", lambda w: w < at))
    rows = seg.rows()
    segs = rows.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "p", "s", "id", "kind", "start", "end", F.col("text_hash").alias("textHash"), F.when(F.col("kind") != "document", F.col("text")).alias("text"), "block",
                    F.col("parent_id").alias("parentId"),
                )
            )
        ).alias("all_segments")
    )
    heads = heads.select(
        "doc_id",
        "wide",
        F.struct(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"), utf16_length(F.col("text")).alias("length")).alias("document"),
        F.transform("protected", lambda r: F.struct(r["kind"].alias("kind"), u16(r["start"]).alias("start"), u16(r["end"]).alias("end"))).alias("protected"),
    )
    out = heads.join(segs, "doc_id").join(per, "doc_id", "left")
    segments = F.transform("all_segments", lambda s: s.withField("start", u16(s["start"])).withField("end", u16(s["end"])).dropFields("p", "s"))
    ran = F.struct(F.lit("ran").alias("status"), F.lit(len(pack.detectors("phrase", "regex", "builtin"))).alias("detectors"))
    off = F.struct(F.lit("disabled").alias("status"))
    if lane:
        ids = rows.select("doc_id", F.col("kind").alias("segment_kind"), "p", "s", F.col("id").alias("segmentId"))
        raw = F.when(F.col("raw_probability") != F.col("probability"), F.col("raw_probability")).alias("rawProbability")
        entry = F.struct("segmentId", F.col("policy_id").alias("policyId"), F.col("detector_id").alias("detectorId"), "probability", raw)
        covered = lane.coverage.join(ids, ["doc_id", "segment_kind", "p", "s"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("coverage"))
        out = out.join(covered, "doc_id", "left").join(lane.status.withColumnRenamed("status", "lane_status"), "doc_id", "left")
        judged = F.struct(F.col("lane_status").alias("status"), "reason", "detectors")
        usage = F.struct(F.col("requests").alias("classifierRequests"), F.col("cache_hits").alias("classifierCacheHits"))
    else:
        out = out.withColumn("coverage", F.array().cast("array<string>"))
        judged, usage = off, F.lit(None).cast("string")
    or_none = lambda c: F.coalesce(c, F.slice(F.array(F.get(c, F.lit(0))), 1, 0)).alias(c)
    body = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit("utf16").alias("offsetUnit"), "document", F.struct(F.lit(pack.id).alias("packId"), F.lit(pack.version).alias("version")).alias("pack"),
        segments.alias("segments"), "protected", or_none("findings"), or_none("coverage"), F.struct((ran if rules else off).alias("rules"), judged.alias("classifier")).alias("lanes"), usage.alias("usage"),
    )
    return out.select("doc_id", F.to_json(body).alias("result"))
