"""Command line: checks of drafts, packs, calibration and page scans; JSON lines go to standard output.

    python -m prosemill check --request FILE | --draft PATH --pack NAME [--format text]
    python -m prosemill pack list | show NAME | validate FILE | import PROFILE
    python -m prosemill calibrate LABELS.json
    python -m prosemill usability PATH [--profile FILE]
    python -m prosemill schema
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.operators import calibration, usability
from prosemill.operators.segmentation import SCHEMA
from prosemill.plans.check import results
from prosemill.sources import packs, profile, requests

#: Tables that commands read and write.
SCHEMAS = {
    "documents": "doc_id long, text string",
    "segmented": SCHEMA,
    "labels": "policy_id string, detector_id string, probability double, violates boolean",
    "examples": "policy_id string, detector_id string, text string, violates boolean",
    "answers": "cache_key string, answers string",
    "results": "doc_id long, result string",
    "nodes": usability.NODES,
}


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("prosemill").getOrCreate()


def _put(rows: DataFrame) -> None:
    for r in rows.toLocalIterator():
        print(r[0])


def check(args: argparse.Namespace) -> None:
    spark = _spark()
    if args.request:
        r = requests.read_request(args.request)
        docs = spark.createDataFrame([(0, r.text)], "doc_id long, text string")
        asking = r.asking | ({"examples": requests.examples_table(spark, r.examples)} if r.examples else {})
        found = results(docs, r.pack, r.format, r.rules, r.classifier, **asking)
    else:
        found = results(requests.read_drafts(spark, args.draft), requests.named_pack(args.pack), args.format)
    _put(found.select("result"))


def pack(args: argparse.Namespace) -> None:
    if args.action == "list":
        print("\n".join(packs.bundled()))
    elif args.action == "validate":
        p = packs.load_pack(args.name)
        print(json.dumps({"packId": p.id, "policies": len(p.policies), "detectors": sum(len(x.detectors) for x in p.policies)}))
    elif args.action == "import":
        print(json.dumps(packs.import_style_profile(packs.read_mapping(args.name)), ensure_ascii=False))
    else:
        print(json.dumps(packs.read_mapping(packs.BUNDLED / f"{requests.named_pack(args.name).id}.yml"), ensure_ascii=False))


def calibrate(args: argparse.Namespace) -> None:
    labels = _spark().createDataFrame([(x["policyId"], x["detectorId"], float(x["probability"]), bool(x["violates"])) for x in packs.read_mapping(args.labels)["labels"]], SCHEMAS["labels"])
    fitted = calibration.calibrate(labels)
    _put(fitted.select(F.to_json(F.struct(*fitted.columns))))


def scan(args: argparse.Namespace) -> None:
    rules = profile.parse_profile(packs.read_mapping(args.profile)) if args.profile else None
    pages = requests.read_drafts(_spark(), args.path).select(F.col("doc_id").alias("page_id"), "path", F.col("text").alias("html"))
    found = usability.scan(pages, rules).join(pages.select("page_id", "path"), "page_id").orderBy("path", "kind_ord", "node")
    _put(found.select(F.to_json(F.struct("path", "id", "kind", "selector", "ratio", "width", "height"))))


def schema(args: argparse.Namespace) -> None:
    print(json.dumps(SCHEMAS, indent=1))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="prosemill", description="Checks documents against policy packs.")
    commands = parser.add_subparsers(required=True)
    for name, run, arguments in (
        ("check", check, [("--request", {}), ("--draft", {}), ("--pack", {"default": "plain-words"}), ("--format", {"default": "text", "choices": requests.FORMATS})]),
        ("pack", pack, [("action", {"choices": ["list", "show", "validate", "import"]}), ("name", {"nargs": "?", "default": ""})]),
        ("calibrate", calibrate, [("labels", {})]),
        ("usability", scan, [("path", {}), ("--profile", {})]),
        ("schema", schema, []),
    ):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for flag, how in arguments:
            command.add_argument(flag, **how)
    args = parser.parse_args(argv)
    try:
        if args.run is check and bool(args.request) == bool(args.draft):
            raise ValueError("give --request or --draft")
        args.run(args)
    except (packs.PackError, ValueError, KeyError, OSError) as e:
        print(f"prosemill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
