"""The classifier lane: questions about segments for a pluggable decision model.

Jobs are rows; a model answers batches of them inside ``mapInPandas``. Answers are a table keyed by
the content of the question, so what was asked once isn't asked again: jobs join the table of
answers, and only the others go to the model. ``run_lane`` gives hits, coverage, each document's
status and all answers, to be kept for the next run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from prosemill.functions.spans import exploded
from prosemill.operators.calibration import apply_calibration
from prosemill.operators.segmentation import Segmented
from prosemill.sources.packs import Detector, Pack, Policy

#: Answers a batch of (task, target, context, questions as JSON); gives a JSON of answers each.
Model = Callable[[pd.DataFrame], "list[str]"]
#: What a word of an example is.
EXAMPLE_WORD = "[a-z0-9']+"


def question_name(policy: Policy, detector: Detector) -> str:
    return f"{policy.id}__{detector.id}".replace("-", "_").replace(".", "_")


def applies(detector: Detector, scope: str, block: str | None) -> bool:
    """Blocks don't matter for whole documents."""
    return detector.scope == scope and (scope == "document" or detector.blocks is None or block in detector.blocks)


def questions(pack: Pack, scope: str, block: str | None = None, retrieved: list[tuple[str, str, str, bool]] = ()) -> dict[str, dict]:
    """Questions for segments of one scope and block; ``retrieved``: examples as (policy, detector, text, violates)."""
    out = {}
    for p, d in pack.detectors("classifier"):
        if applies(d, scope, block):
            asked = {k: d.question[k] for k in ("type", "criteria") if k in d.question}
            own = [(t, v) for policy, detector, t, v in retrieved if (policy, detector) == (p.id, d.id)]
            bad, good = ([*kept, *(t for t, v in own if v == wanted)] for kept, wanted in ((p.violates, True), (p.complies, False)))
            text = d.question.get("instructions", "")
            asked["instructions"] = {"question": text, "guidance": p.guidance, "violates": bad, "complies": good} if bad or good else text
            out[question_name(p, d)] = asked
    return out


def _as_json(asked: dict) -> str:
    return json.dumps(asked, sort_keys=True, ensure_ascii=False)


def jobs(seg: Segmented, pack: Pack, model: str = "default", examples: DataFrame | None = None, k: int = 4) -> DataFrame:
    """``doc_id, ord, segment_kind, block, p, s, start, end, target, context, questions, cache_key``: one
    for a segment with a question. Sentences come first, then paragraphs, then the document.

    ``examples``: ``policy_id, detector_id, text, violates``; the ``k`` nearest go into a question.
    """

    def by_block(scope: str) -> Column:
        asked = F.lit(None).cast("string")
        for block in ("paragraph", "heading", "listItem"):
            if found := questions(pack, scope, block):
                asked = F.when(F.col("block") == block, _as_json(found)).otherwise(asked)
        return asked

    none = F.lit(None).cast("string")
    pick = lambda df, rank, kind, block, p, s, target, context, asked: df.select("doc_id", F.lit(rank).alias("rank"), F.lit(kind).alias("segment_kind"), block.alias("block"), p.alias("p"), s.alias("s"), "start", "end", target.alias("target"), context.alias("context"), asked.alias("questions"))
    rows = pick(seg.sentences, 0, "sentence", F.col("block"), F.col("p"), F.col("s"), F.col("text"), F.col("p_text"), by_block("sentence"))
    rows = rows.unionByName(pick(seg.paragraphs, 1, "paragraph", F.col("block"), F.col("p"), F.lit(-1), F.col("text"), none, by_block("paragraph")))
    if found := questions(pack, "document"):
        prose = F.array_join(F.transform("paragraphs", lambda x: x["text"]), "\n\n")
        whole = seg.nested.withColumns({"start": F.lit(0), "end": F.length("text")})
        rows = rows.unionByName(pick(whole, 2, "document", none, F.lit(-1), F.lit(-1), prose, none, F.lit(_as_json(found))))
    rows = rows.where("questions is not null and target != ''")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "p", "s"))).drop("rank")
    if examples is not None and k > 0:
        rows = _with_examples(rows, pack, examples, k)
    key = F.sha2(F.concat_ws("\u001f", F.lit(model), "questions", "target", F.coalesce("context", F.lit(""))), 256)
    return rows.withColumn("cache_key", key)


def _with_examples(rows: DataFrame, pack: Pack, examples: DataFrame, k: int) -> DataFrame:
    """``rows`` with the nearest examples in their questions."""
    asked = [(p, d) for p, d in pack.detectors("classifier")]
    each = F.array_compact(F.array(*[F.when(_applies(d), F.struct(F.lit(p.id).alias("policy_id"), F.lit(d.id).alias("detector_id"))) for p, d in asked]))
    targets = exploded(rows.select(F.struct("doc_id", "ord").alias("target_id"), F.col("target").alias("text"), "segment_kind", "block"), each, "d")
    found = few_shot(targets.select("target_id", "d.policy_id", "d.detector_id", "text"), examples, k)
    found = found.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("policy_id", "detector_id", "rank", "example", "violates"))).alias("retrieved"))
    both = rows.join(found.select("target_id.doc_id", "target_id.ord", "retrieved"), ["doc_id", "ord"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for kind, block, old, got in zip(batch["segment_kind"], batch["block"], batch["questions"], batch["retrieved"], strict=True):
                if got is None or not len(got):
                    made.append(old)
                else:
                    made.append(_as_json(questions(pack, kind, block, [(x["policy_id"], x["detector_id"], x["example"], x["violates"]) for x in got])))
            yield batch.assign(questions=made).drop(columns="retrieved")

    return both.mapInPandas(run, both.drop("retrieved").schema)


def _applies(detector: Detector) -> Column:
    """``applies`` for the columns ``segment_kind, block``."""
    of_kind = F.col("segment_kind") == detector.scope
    return of_kind if detector.scope == "document" or detector.blocks is None else of_kind & F.col("block").isin(list(detector.blocks))


def within_budget(rows: DataFrame, max_tokens: int) -> DataFrame:
    """``asked``: whether a job's tokens, summed in order over its document, stay within the budget.

    Tokens are estimated from the length of what is sent. Deciding by sums in a fixed order gives
    the same answer on every run; a budget shared by requests in flight doesn't.
    """
    tokens = F.ceil((F.length("target") + F.length(F.coalesce("context", F.lit(""))) + F.length("questions")) / 4)
    total = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tokens", tokens).withColumn("spent", total).withColumn("asked", F.col("spent") <= max_tokens)


def ask(rows: DataFrame, model: Model, answers: DataFrame | None = None, deadline: float | None = None) -> DataFrame:
    """``cache_key, answers, error`` of every distinct job; ``answers`` holds what is known already.

    Of a batch that fails the rows are asked one by one; a row that fails alone, or comes ``deadline``
    seconds or more after its task began, has no answers but an ``error``, and may be asked again.
    """
    wanted = rows.select("cache_key", "target", "context", "questions").dropDuplicates(["cache_key"])
    if answers is not None:
        wanted = wanted.join(answers.where("answers is not null"), "cache_key", "left_anti")

    def one(batch: pd.DataFrame) -> tuple[list, list]:
        try:
            got = list(model(batch))
            if len(got) != len(batch):
                raise ValueError(f"{len(got)} answers to {len(batch)} questions")
            return got, [None if x is not None else "no answer" for x in got]
        except Exception as e:  # noqa: BLE001  a model may fail in any way; the failure is reported
            if len(batch) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
            parts = [one(batch.iloc[k : k + 1]) for k in range(len(batch))]
            return [a for got, _ in parts for a in got], [x for _, errors in parts for x in errors]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = time.monotonic()
        for batch in batches:
            late = deadline is not None and time.monotonic() - began >= deadline
            got, errors = ([None] * len(batch), [LATE] * len(batch)) if late else one(batch)
            yield pd.DataFrame({"cache_key": batch["cache_key"].to_numpy(), "answers": got, "error": errors}).astype(object)

    fresh = wanted.mapInPandas(run, "cache_key string, answers string, error string")
    known = None if answers is None else answers.where("answers is not null").select("cache_key", "answers", F.lit(None).cast("string").alias("error"))
    return fresh if known is None else fresh.unionByName(known)


#: The error of a job that came too late.
LATE = "late"


def violation_probability(detector: Detector, answer: Column) -> Column:
    """Of one answer, a JSON string: yes or no, the sum over bad labels, or over bad levels."""
    kind, bad = detector.question["type"], detector.violation
    if kind == "noul":
        yes = F.get_json_object(answer, "$.noul").cast("double")
        return yes if bad["answer"] in ("yes", True) else 1 - yes
    given = F.from_json(F.get_json_object(answer, "$.probabilities"), "map<string,double>")
    if kind == "choice":
        counts = lambda x: x["key"].isin([str(b) for b in bad["labels"]])
    else:  # levels are numbers from 0
        counts = lambda x: x["key"].cast("double") < bad["scoreBelow"]
    shares = F.transform(F.filter(F.map_entries(given), counts), lambda x: x["value"])
    return F.least(F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x), F.lit(1.0))


def judged(rows: DataFrame, answers: DataFrame, pack: Pack) -> DataFrame:
    """Coverage: a row for each answered question, with ``raw_probability, probability, status``."""
    both = rows.join(answers.where("answers is not null").select("cache_key", "answers"), "cache_key")
    each = []
    for p, d in pack.detectors("classifier"):
        answer = F.get_json_object("answers", f"$.{question_name(p, d)}")
        raw = F.round(violation_probability(d, answer), 4)
        c = d.calibration
        exact = raw if not c else F.round(apply_calibration(raw, F.struct(F.lit(c["method"]).alias("method"), F.lit(c.get("a")).cast("double").alias("a"), F.lit(c.get("b")).cast("double").alias("b"), F.array(*[F.array(*map(F.lit, map(float, k))) for k in c.get("points") or [[0, 0], [1, 1]]]).alias("points"))), 4)
        review = F.lit(d.review_at).cast("double")
        status = F.when(exact >= d.threshold, "violation").when(exact >= review, "review")
        each.append(F.when(_applies(d), F.struct(F.lit(p.id).alias("policy_id"), F.lit(d.id).alias("detector_id"), raw.alias("raw_probability"), exact.alias("probability"), status.alias("status"), F.lit(d.message or p.title).alias("message"))))
    every = exploded(both.select("doc_id", "segment_kind", "block", "p", "s", "start", "end", "answers"), F.array(*each), "j")
    return every.select("doc_id", "segment_kind", "p", "s", "start", "end", "j.*").where("probability is not null")


def classifier_hits(coverage: DataFrame) -> DataFrame:
    """What coverage says is a violation or needs review, as hits."""
    return coverage.where("status is not null").select(
        "doc_id", "segment_kind", "p", "s", "policy_id", "detector_id", F.lit(0).alias("detector_ord"), "start", "end", "message", F.lit(None).cast("string").alias("replacement"),
        "status", "probability", "raw_probability",
    )


def lane_status(rows: DataFrame, answers: DataFrame | None, budget: int | None = None, deadline: float | None = None) -> DataFrame:
    """``doc_id, jobs, answered, status, reason`` from jobs and answers: ran, partial, failed or unavailable.

    ``rows`` may have ``asked``, false for a job beyond the budget.
    """
    if answers is None:
        per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("jobs"))
        return per.select("doc_id", "jobs", F.lit(0).cast("long").alias("answered"), F.lit("unavailable").alias("status"), F.lit("no decision model is given").alias("reason"))
    if "asked" not in rows.columns:
        rows = rows.withColumn("asked", F.lit(True))
    both = rows.select("doc_id", "ord", "cache_key", "asked").join(answers.select("cache_key", "answers", "error"), "cache_key", "left")
    failed = F.col("asked") & F.col("answers").isNull() & (F.coalesce("error", F.lit("no answer")) != LATE)
    per = both.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count(F.when(F.col("asked"), F.col("answers"))).alias("answered"),
        F.count_if(~F.col("asked")).alias("skipped"),
        F.count_if(F.col("asked") & (F.col("error") == LATE)).alias("late"),
        F.count_if(failed).alias("failed"),
        F.min(F.when(failed, F.struct("ord", F.coalesce("error", F.lit("no answer")).alias("error"))))["error"].alias("first"),
    )
    said = F.array(
        F.when(F.col("skipped") > 0, F.format_string(f"%d segment(s) skipped: beyond the budget of {budget} tokens", "skipped")),
        F.when(F.col("late") > 0, F.format_string(f"%d segment(s) skipped: later than {deadline} s", "late")),
        F.when(F.col("failed") > 0, F.format_string("%d request(s) failed: %s", "failed", "first")),
    )
    none_at_all = (F.col("failed") > 0) & (F.col("answered") == 0)
    status = F.when(none_at_all, "failed").when(F.col("skipped") + F.col("late") + F.col("failed") > 0, "partial").otherwise("ran")
    reason = F.when(none_at_all, F.col("first")).when(status == "partial", F.array_join(F.array_compact(said), "; "))
    return per.select("doc_id", "jobs", "answered", status.alias("status"), reason.alias("reason"))


@dataclass
class Lane:
    """What the classifier lane found. ``answers``: to be kept, and given to the next run."""

    coverage: DataFrame
    hits: DataFrame
    status: DataFrame
    answers: DataFrame | None


def run_lane(
    seg: Segmented,
    pack: Pack,
    model: Model | None,
    answers: DataFrame | None = None,
    examples: DataFrame | None = None,
    max_examples: int = 4,
    max_tokens: int | None = None,
    deadline: float | None = None,
    name: str = "default",
) -> Lane:
    """Ask a pack's questions. ``status``: ``doc_id, status, reason, detectors, requests, cache_hits`` of every document."""
    detectors = len(pack.detectors("classifier"))
    ids = seg.nested.select("doc_id")
    no_reason, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    if not detectors or model is None:
        status, why, n = ("ran", no_reason, 0) if not detectors else ("unavailable", F.lit("no decision model is given"), 0)
        none = judged(jobs(seg, pack, name), ids.sparkSession.createDataFrame([], "cache_key string, answers string"), pack) if detectors else None
        empty = "doc_id long, segment_kind string, p int, s int, start int, end int, policy_id string, detector_id string, raw_probability double, probability double, status string, message string"
        none = ids.sparkSession.createDataFrame([], empty) if none is None else none
        return Lane(none, classifier_hits(none), ids.select("doc_id", F.lit(status).alias("status"), why.alias("reason"), F.lit(n).alias("detectors"), zero.alias("requests"), zero.alias("cache_hits")), answers)
    rows = jobs(seg, pack, name, examples, max_examples)
    if max_tokens is not None:
        rows = within_budget(rows, max_tokens)
    sent = rows.where("asked") if max_tokens is not None else rows
    # Read by coverage and status: the model is asked once.
    replies = ask(sent, model, answers, deadline).persist(StorageLevel.MEMORY_AND_DISK)
    coverage = judged(sent, replies, pack)
    per = lane_status(rows, replies, max_tokens, deadline)
    known = answers.where("answers is not null").select("cache_key", F.lit(1).alias("known")) if answers is not None else ids.sparkSession.createDataFrame([], "cache_key string, known int")
    hit = sent.select("doc_id", "cache_key").join(known, "cache_key").groupBy("doc_id").agg(F.count(F.lit(1)).alias("cache_hits"))
    per = ids.join(per, "doc_id", "left").join(hit, "doc_id", "left")
    hits = F.coalesce("cache_hits", F.lit(0).cast("long"))
    status = per.select(
        "doc_id", F.coalesce("status", F.lit("ran")).alias("status"), "reason", F.lit(detectors).alias("detectors"),
        (F.coalesce("answered", F.lit(0).cast("long")) - hits).alias("requests"), hits.alias("cache_hits"),
    )
    return Lane(coverage, classifier_hits(coverage), status, replies.where("answers is not null").select("cache_key", "answers"))


def few_shot(targets: DataFrame, examples: DataFrame, k: int = 4) -> DataFrame:
    """``target_id, policy_id, detector_id, rank, example, violates, similarity``: of each target the ``k``
    examples of its policy and detector that are most similar.

    Similarity is Jaccard's over words; an example of the very text is left out, ties go by text.
    Pairs that share a word meet on it. All others have the similarity 0 and follow by text: of these a
    target needs ``k`` at most, and they are among the first ``k + 1`` examples by text and those that
    share a word.
    """
    schema = "target_id, policy_id, detector_id, rank, example, violates, similarity".split(", ")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(EXAMPLE_WORD), F.lit(0)))
    by = ["policy_id", "detector_id"]
    left = targets.select("target_id", *by, F.col("text").alias("t"), words(F.col("text")).alias("tw")).withColumn("tn", F.size("tw"))
    right = examples.select(*by, F.col("text").alias("example"), "violates").distinct().withColumn("ew", words(F.col("example"))).withColumn("en", F.size("ew"))
    pairs = exploded(left, F.col("tw"), "w").drop("tw").join(exploded(right, F.col("ew"), "w").drop("ew"), [*by, "w"])
    met = pairs.groupBy("target_id", *by, "example", "violates").agg(F.count(F.lit(1)).alias("c"), F.first("t").alias("t"), F.first("tn").alias("tn"), F.first("en").alias("en"))
    met = met.select("target_id", *by, "t", "example", "violates", (F.col("c") / (F.col("tn") + F.col("en") - F.col("c"))).alias("similarity"))
    first = right.withColumn("nth", F.dense_rank().over(Window.partitionBy(*by).orderBy("example"))).where(F.col("nth") <= k + 1)
    first = first.groupBy(*by).agg(F.collect_list(F.struct("example", "violates")).alias("fill"))
    rest = exploded(left.select("target_id", *by, "t").join(first, by), F.col("fill"), "f").select("target_id", *by, "t", "f.example", "f.violates", F.lit(0.0).alias("similarity"))
    every = met.unionByName(rest).where("t != example").groupBy("target_id", *by, "example", "violates").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("target_id", *by).orderBy(F.desc("similarity"), "example", "violates")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*schema)
