"""The classifier lane: answers that are kept, examples in questions, failures, deadline and budget, and the result."""

import json

import pandas as pd
import pytest

from prosemill.operators import classifier
from prosemill.operators.segmentation import segment
from prosemill.plans.catalogue import QUESTION_PACK, stand_in_model
from prosemill.plans.check import results
from prosemill.sources.packs import parse_pack

TEXTS = ["Running now. A station.\n\nPlain words.", "Plain words.", "", "🚀 Running now."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_answers_are_kept_and_results_tell_the_lane(spark, docs):
    first = classifier.run_lane(segment(docs), QUESTION_PACK, stand_in_model)
    kept = spark.createDataFrame([tuple(r) for r in first.answers.collect()], "cache_key string, answers string")
    assert kept.count() == 7  # two documents share a sentence, and the question about it

    def never(batch: pd.DataFrame) -> list[str]:
        raise RuntimeError("asked again")

    again = classifier.run_lane(segment(docs), QUESTION_PACK, never, answers=kept)
    status = {r.doc_id: (r.status, r.reason, r.requests, r.cache_hits) for r in again.status.collect()}
    assert status == {0: ("ran", None, 0, 4), 1: ("ran", None, 0, 2), 2: ("ran", None, 0, 0), 3: ("ran", None, 0, 2)}
    got = {r.doc_id: json.loads(r.result) for r in results(docs, QUESTION_PACK, model=never, answers=kept).collect()}
    found = [(f["detectorId"], f["lane"], f["status"], f["probability"], f["excerpt"], f["span"]) for f in got[0]["findings"]]
    assert sorted(found, key=str) == sorted([
        ("d", "classifier", "violation", 0.9, "", {"start": 0, "end": 37}),
        ("s", "classifier", "violation", 0.9, "Running now.", {"start": 0, "end": 12}),
        ("s", "classifier", "review", 0.6, "A station.", {"start": 13, "end": 23}),
    ], key=str)
    ids = {s["text"]: s["id"] for s in got[0]["segments"] if s["kind"] == "sentence"}
    assert {f["segmentId"] for f in got[0]["findings"]} == {"doc", ids["Running now."], ids["A station."]}
    assert [c["segmentId"] for c in got[0]["coverage"]] == sorted(["doc", *ids.values()]) and got[0]["usage"] == {"classifierRequests": 0, "classifierCacheHits": 4}
    assert got[0]["lanes"] == {"rules": {"status": "ran", "detectors": 0}, "classifier": {"status": "ran", "detectors": 2}}
    assert got[3]["findings"][-1]["span"]["end"] == len(TEXTS[3]) + 1 and got[2]["findings"] == [] == got[2]["coverage"]
    off = json.loads(results(docs, QUESTION_PACK, rules=False, classifier=False).first().result)
    assert off["lanes"] == {"rules": {"status": "disabled"}, "classifier": {"status": "disabled"}} and "usage" not in off
    none = json.loads(results(docs, QUESTION_PACK).first().result)
    assert none["lanes"]["classifier"]["status"] == "unavailable" and none["coverage"] == []


def test_failures_deadline_and_budget(spark, docs):
    def sometimes(batch: pd.DataFrame) -> list[str]:
        if any("station" in t for t in batch["target"]):
            raise OSError("no line")
        return stand_in_model(batch)

    seg = segment(docs)
    got = {r.doc_id: (r.status, r.reason) for r in classifier.run_lane(seg, QUESTION_PACK, sometimes).status.collect()}
    assert got == {0: ("partial", "2 request(s) failed: OSError: no line"), 1: ("ran", None), 2: ("ran", None), 3: ("ran", None)}
    late = {r.doc_id: (r.status, r.reason) for r in classifier.run_lane(seg, QUESTION_PACK, stand_in_model, deadline=0).status.collect()}
    assert late[1] == ("partial", "2 segment(s) skipped: later than 0 s")
    lane = classifier.run_lane(seg, QUESTION_PACK, stand_in_model, max_tokens=60)
    rows = classifier.within_budget(classifier.jobs(seg, QUESTION_PACK), 60).collect()
    asked = {k: sum(r.asked for r in rows if r.doc_id == k) for k in range(4)}
    status = {r.doc_id: (r.status, r.requests) for r in lane.status.collect()}
    for k in (0, 1, 3):
        n = sum(r.doc_id == k for r in rows)
        assert status[k] == ("ran" if asked[k] == n else "partial", asked[k])
    assert any(s == "partial" for s, _ in status.values())


def test_examples_go_into_questions(spark, docs):
    library = [("hype", "s", t, v) for t, v in [("Running now.", True), ("running late now", True), ("plain, plain words", False), ("zebra", False), ("aardvark", True)]] + [("hype", "other", "Running now, too", True)]
    examples = spark.createDataFrame(library, "policy_id string, detector_id string, text string, violates boolean")
    rows = classifier.jobs(segment(docs), QUESTION_PACK, examples=examples, k=2).collect()
    asked = {r.target: json.loads(r.questions)["hype__s"]["instructions"] for r in rows if r.segment_kind == "sentence"}
    assert asked["Running now."] == {"question": "Hype?", "guidance": "-", "violates": ["running late now", "aardvark"], "complies": []}
    assert asked["Plain words."] == {"question": "Hype?", "guidance": "-", "violates": ["Running now."], "complies": ["plain, plain words"]}
    assert asked["A station."]["violates"] == ["Running now.", "aardvark"]  # no word in common: by text
    whole = [json.loads(r.questions)["hype__d"]["instructions"] for r in rows if r.segment_kind == "document"]
    assert whole == [""] * 3


def test_scores_count_levels_below(spark):
    detector = {"id": "d", "lane": "classifier", "scope": "document", "question": {"type": "score", "criteria": ["bad", "fair", "good"]}, "violation": {"scoreBelow": 2}, "threshold": 0.5}
    pack = parse_pack({"schemaVersion": 1, "packId": "x", "version": "1", "policies": [{"id": "p", "version": 1, "title": "t", "guidance": "g", "severity": "warn", "detectors": [detector]}]})
    from pyspark.sql import functions as F

    answer = F.lit('{"probabilities": {"0": 0.25, "1": 0.5, "2": 0.25}}')
    assert spark.range(1).select(classifier.violation_probability(pack.policies[0].detectors[0], answer).alias("p")).first().p == 0.75
