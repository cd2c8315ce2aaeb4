"""Drafts and check requests: files as tables, and one request as a mapping, checked with places of errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.sources.packs import Pack, PackError, bundled, load_bundled, load_pack, parse_pack, read_mapping

FORMATS = ("text", "markdown", "markus")
#: Options of the classifier lane, as a request names them, and as ``run_lane`` does.
CLASSIFIER_OPTIONS = {"model": "name", "maxInputTokens": "max_tokens", "deadlineSeconds": "deadline", "maxExamplesPerQuestion": "max_examples"}


class RequestError(PackError):
    """What is wrong with a request, and where."""


@dataclass(frozen=True)
class CheckRequest:
    text: str
    format: str
    pack: Pack
    rules: bool = True
    classifier: bool = True
    asking: dict = field(default_factory=dict)
    examples: tuple[dict, ...] = ()


def named_pack(name: str) -> Pack:
    """A bundled pack by its name, or a file's."""
    return load_bundled(name) if name in bundled() else load_pack(name)


def _known(data: dict, keys: set[str], where: str) -> dict:
    if not isinstance(data, dict):
        raise RequestError(where, "must be a mapping")
    if strange := sorted(set(data) - keys):
        raise RequestError(f"{where}/{strange[0]}".lstrip("/"), "isn't known")
    return data


def parse_request(data: dict) -> CheckRequest:
    """``{content: {text, format}, pack, options: {lanes: {rules, classifier}, classifier: {...}}}``."""
    _known(data, {"schemaVersion", "content", "pack", "options"}, "")
    for key in ("content", "pack"):
        if key not in data:
            raise RequestError("", f"'{key}' is required")
    content = _known(data["content"], {"text", "format"}, "content")
    if not isinstance(content.get("text"), str):
        raise RequestError("content/text", "must be a string")
    if content.get("format") not in FORMATS:
        raise RequestError("content/format", f"must be one of {', '.join(FORMATS)}")
    try:
        pack = parse_pack(data["pack"])
    except PackError as e:
        raise RequestError(f"pack/{e.where}".rstrip("/"), e.what) from None
    options = _known(data.get("options") or {}, {"lanes", "classifier"}, "options")
    lanes = _known(options.get("lanes") or {}, {"rules", "classifier"}, "options/lanes")
    for key, on in lanes.items():
        if not isinstance(on, bool):
            raise RequestError(f"options/lanes/{key}", "must be true or false")
    asked = _known(options.get("classifier") or {}, {*CLASSIFIER_OPTIONS, "examples"}, "options/classifier")
    examples = []
    for k, e in enumerate(asked.get("examples") or ()):
        at = f"options/classifier/examples/{k}"
        _known(e, {"policyId", "detectorId", "text", "violates"}, at)
        if not all(isinstance(e.get(c), str) for c in ("policyId", "detectorId", "text")) or not isinstance(e.get("violates"), bool):
            raise RequestError(at, "needs policyId, detectorId, text and violates")
        examples.append(e)
    asking = {CLASSIFIER_OPTIONS[k]: v for k, v in asked.items() if k != "examples"}
    return CheckRequest(content["text"], content["format"], pack, lanes.get("rules", True), lanes.get("classifier", True), asking, tuple(examples))


def read_request(path: str | Path) -> CheckRequest:
    return parse_request(read_mapping(path))


def examples_table(spark: SparkSession, examples: tuple[dict, ...]) -> DataFrame:
    return spark.createDataFrame([(e["policyId"], e["detectorId"], e["text"], e["violates"]) for e in examples], "policy_id string, detector_id string, text string, violates boolean")


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text`` of all files of a path: a file is a document, with an id from its path.

    Spark skips files without a byte: they give no row.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")
