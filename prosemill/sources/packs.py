"""Policy packs: YAML or JSON files, checked, as objects and as tables.

A pack holds policies; a policy holds detectors. A detector of the rules lane is a list of phrases,
a regular expression or a built-in check with parameters; one of the classifier lane is a question
to a decision model.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from prosemill.operators.builtins import CHECKS

BUNDLED = Path(__file__).parent / "packs"
SEVERITIES, SCOPES, BLOCKS = ("info", "warn", "error"), ("sentence", "paragraph", "document"), ("paragraph", "heading", "listItem")
#: The key of a violation for each type of question.
VIOLATION_KEY = {"noul": "answer", "choice": "labels", "score": "scoreBelow"}


class PackError(ValueError):
    """What is wrong with a pack, and where, as a path with slashes."""

    def __init__(self, where: str, what: str):
        super().__init__(f"{where}: {what}" if where else what)
        self.where, self.what = where, what


@dataclass(frozen=True)
class Detector:
    id: str
    kind: str  # phrase, regex, builtin or classifier
    message: str | None = None
    blocks: tuple[str, ...] | None = None
    phrases: tuple[str, ...] = ()
    pattern: str | None = None
    ignore_case: bool = True
    replacement: str | None = None
    exceptions: tuple[str, ...] = ()
    check: str | None = None
    params: dict = field(default_factory=dict)
    scope: str | None = None
    question: dict = field(default_factory=dict)
    violation: dict = field(default_factory=dict)
    threshold: float | None = None
    review_at: float | None = None
    calibration: dict | None = None


@dataclass(frozen=True)
class Policy:
    id: str
    version: int
    title: str
    guidance: str
    severity: str
    detectors: tuple[Detector, ...] = ()
    enabled: bool = True
    tags: tuple[str, ...] = ()
    violates: tuple[str, ...] = ()
    complies: tuple[str, ...] = ()
    rewrite_guidance: str | None = None


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    policies: tuple[Policy, ...]
    title: str | None = None
    guidance: str | None = None
    language: str = "en"
    samples: tuple[dict, ...] = ()

    def policy(self, policy_id: str) -> Policy:
        return next(p for p in self.policies if p.id == policy_id)

    def detectors(self, *kinds: str) -> list[tuple[Policy, Detector]]:
        """Detectors of enabled policies, in the pack's order."""
        return [(p, d) for p in self.policies if p.enabled for d in p.detectors if d.kind in kinds]


def read_mapping(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def bundled() -> list[str]:
    return sorted(p.stem for p in BUNDLED.glob("*.yml"))


def load_bundled(name: str) -> Pack:
    if name not in bundled():
        raise KeyError(name)
    return parse_pack(read_mapping(BUNDLED / f"{name}.yml"))


def load_pack(path: str | Path) -> Pack:
    return parse_pack(read_mapping(path))


def _need(data: dict, key: str, kind: type | tuple, where: str):
    if not isinstance(data, dict):
        raise PackError(where, "must be a mapping")
    if key not in data:
        raise PackError(where, f"'{key}' is required")
    if not isinstance(data[key], kind) or (isinstance(data[key], bool) and kind is not bool):
        raise PackError(f"{where}/{key}".lstrip("/"), "has the wrong type")
    return data[key]


def parse_pack(data: dict) -> Pack:
    if _need(data, "schemaVersion", int, "") != 1:
        raise PackError("schemaVersion", "must be 1")
    policies, seen = [], set()
    for i, raw in enumerate(_need(data, "policies", list, "")):
        where = f"policies/{i}"
        policy = _policy(raw, where)
        if policy.id in seen:
            raise PackError(f"{where}/id", f"duplicate policy id '{policy.id}'")
        seen.add(policy.id)
        policies.append(policy)
    return Pack(
        _need(data, "packId", str, ""), str(_need(data, "version", (str, int, float), "")), tuple(policies), data.get("title"), data.get("guidance"),
        data.get("language", "en"), tuple(data.get("referenceSamples") or ()),
    )


def _policy(raw: dict, where: str) -> Policy:
    severity = _need(raw, "severity", str, where)
    if severity not in SEVERITIES:
        raise PackError(f"{where}/severity", f"must be one of {', '.join(SEVERITIES)}")
    detectors, seen = [], set()
    for j, d in enumerate(raw.get("detectors") or ()):
        at = f"{where}/detectors/{j}"
        detector = _detector(d, at)
        if detector.id in seen:
            raise PackError(f"{at}/id", f"duplicate detector id '{detector.id}'")
        seen.add(detector.id)
        detectors.append(detector)
    examples = raw.get("examples") or {}
    return Policy(
        _need(raw, "id", str, where), _need(raw, "version", int, where), _need(raw, "title", str, where), _need(raw, "guidance", str, where), severity,
        tuple(detectors), raw.get("enabled", True), tuple(raw.get("tags") or ()), tuple(examples.get("violates") or ()), tuple(examples.get("complies") or ()),
        raw.get("rewriteGuidance"),
    )


def _detector(raw: dict, where: str) -> Detector:
    name, lane = _need(raw, "id", str, where), _need(raw, "lane", str, where)
    blocks = raw.get("blocks")
    if blocks is not None and not set(blocks) <= set(BLOCKS):
        raise PackError(f"{where}/blocks", f"must be among {', '.join(BLOCKS)}")
    common = {"id": name, "message": raw.get("message"), "blocks": tuple(blocks) if blocks is not None else None}
    if lane == "classifier":
        return _classifier(raw, where, common)
    if lane != "rules":
        raise PackError(f"{where}/lane", "must be rules or classifier")
    kind = _need(raw, "kind", str, where)
    exceptions = tuple(raw.get("exceptions") or ())
    if kind == "phrase":
        if not (phrases := _need(raw, "phrases", list, where)):
            raise PackError(f"{where}/phrases", "must not be empty")
        return Detector(kind=kind, phrases=tuple(phrases), ignore_case=not raw.get("caseSensitive", False), replacement=raw.get("replacement"), exceptions=exceptions, **common)
    if kind == "regex":
        for key, pattern in [("pattern", _need(raw, "pattern", str, where)), *((f"exceptions/{k}", e) for k, e in enumerate(exceptions))]:
            try:
                re.compile(pattern)
            except re.error as e:
                raise PackError(f"{where}/{key}", f"is not a regular expression: {e}") from None
        return Detector(kind=kind, pattern=raw["pattern"], ignore_case=raw.get("ignoreCase", False), exceptions=exceptions, **common)
    if kind == "builtin":
        if _need(raw, "check", str, where) not in CHECKS:
            raise PackError(f"{where}/check", f"unknown check '{raw['check']}'")
        return Detector(kind=kind, check=raw["check"], params=dict(raw.get("params") or {}), **common)
    raise PackError(f"{where}/kind", "must be phrase, regex or builtin")


def _classifier(raw: dict, where: str, common: dict) -> Detector:
    scope = _need(raw, "scope", str, where)
    if scope not in SCOPES:
        raise PackError(f"{where}/scope", f"must be one of {', '.join(SCOPES)}")
    question, violation = _need(raw, "question", dict, where), _need(raw, "violation", dict, where)
    threshold, review_at = float(_need(raw, "threshold", (int, float), where)), raw.get("reviewAt")
    if review_at is not None and not review_at < threshold:
        raise PackError(f"{where}/reviewAt", "must be below threshold")
    key = VIOLATION_KEY.get(question.get("type"))
    if key is None:
        raise PackError(f"{where}/question/type", f"must be one of {', '.join(VIOLATION_KEY)}")
    if key not in violation:
        raise PackError(f"{where}/violation", f"a {question['type']} question needs '{key}'")
    criteria = question.get("criteria") or []
    if question["type"] == "choice" and not set(violation["labels"]) <= set(criteria):
        raise PackError(f"{where}/violation/labels", "names labels that the criteria don't have")
    if question["type"] == "score" and not 0 < violation["scoreBelow"] < len(criteria):
        raise PackError(f"{where}/violation/scoreBelow", "must be above 0 and below the number of levels")
    return Detector(kind="classifier", scope=scope, question=question, violation=violation, threshold=threshold, review_at=review_at, calibration=raw.get("calibration"), **common)


def policies_table(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(p.id, p.version, p.title, p.severity, p.enabled, list(p.tags), len(p.detectors)) for p in pack.policies]
    return spark.createDataFrame(rows, "policy_id string, policy_version int, title string, severity string, enabled boolean, tags array<string>, n_detectors int")


def detectors_table(spark: SparkSession, pack: Pack) -> DataFrame:
    rows = [(p.id, d.id, k, "classifier" if d.kind == "classifier" else "rules", d.kind, d.message, list(d.blocks) if d.blocks is not None else None) for p in pack.policies for k, d in enumerate(p.detectors)]
    return spark.createDataFrame(rows, "policy_id string, detector_id string, detector_ord int, lane string, kind string, message string, blocks array<string>")


def import_style_profile(profile: dict, version: str | None = None) -> dict:
    """A pack, as a mapping, from a style profile: lexicon, banned words and patterns, preferred
    wording, and switches for built-in checks."""
    slug = lambda s: re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-")
    rules, lexicon, switches = profile.get("rules") or {}, profile.get("lexicon") or {}, profile.get("checks") or {}
    policies = []

    def add(name: str, title: str, detectors: list[dict], guidance: str | None = None) -> None:
        if detectors:
            policies.append({"id": name, "version": 1, "title": title, "guidance": guidance or title, "severity": "warn", "detectors": detectors})

    phrases = lambda name, words: [{"id": name, "lane": "rules", "kind": "phrase", "phrases": list(words)}] if words else []
    add("avoided-words", "Words to avoid", phrases("avoid", lexicon.get("avoid")))
    add("banned-phrases", "Banned phrases", phrases("phrases", rules.get("bannedPhrases")))
    add("banned-intensifiers", "Banned intensifiers", phrases("intensifiers", rules.get("bannedIntensifiers")))
    add("banned-patterns", "Banned patterns", [{"id": f"pattern-{k}", "lane": "rules", "kind": "regex", "ignoreCase": True, "pattern": p["pattern"], "message": p.get("message")} for k, p in enumerate(rules.get("bannedPatterns") or (), 1)])
    add("preferred-wording", "Preferred wording", [{"id": f"prefer-{k}-{slug(p['from'])}", "lane": "rules", "kind": "phrase", "phrases": [p["from"]], "replacement": p["to"]} for k, p in enumerate(rules.get("preferredPhrasing") or (), 1)])
    builtin = lambda check, params=None: {"id": slug(check.replace("_", "-")), "lane": "rules", "kind": "builtin", "check": check, "params": params or {}}
    for switch, on in sorted(switches.items()):
        name = re.sub(r"(?<!^)([A-Z])", r"_\1", switch).lower()
        if on and name in CHECKS:
            add(slug(name.replace("_", "-")), name.replace("_", " ").capitalize(), [builtin(name)])
    if "contrastCap" in rules:
        add("contrast-cap", "Contrasts of the kind 'this, not that'", [builtin("contrast_cap", {"max": rules["contrastCap"]})])
    if rules.get("noEmojis"):
        add("no-emojis", "No emojis", [builtin("no_emojis")])
    if density := profile.get("density"):
        add("information-density", "Information density", [builtin("information_density", density)])
    voice = profile.get("voice") or {}
    for section in ("tone", "sentenceStyle", "voicePatterns", "structure", "evidenceRules"):
        if lines := profile.get(section):
            policies.append({"id": slug(re.sub(r"([A-Z])", r"-\1", section)), "version": 1, "title": section, "guidance": "\n".join(lines), "severity": "info"})
    samples = [{k: s[k] for k in ("id", "title", "url") if k in s} for s in profile.get("referenceSamples") or ()]
    out = {"schemaVersion": 1, "packId": slug(profile["publicationKey"]), "version": version or date.today().isoformat(), "policies": policies, "referenceSamples": samples}
    return out | ({"title": voice["name"]} if "name" in voice else {}) | ({"guidance": profile["editorialAim"]} if "editorialAim" in profile else {})
