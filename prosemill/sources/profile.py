"""The usability profile: limits and switches of the page scan."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from prosemill.sources.packs import PackError, read_mapping

#: Section and key of each setting.
_PLACES = {
    "min_ratio": ("contrast", "minRatio"),
    "min_px": ("tapTarget", "minPx"),
    "flag_outline": ("focus", "flagSuppressedOutline"),
    "flag_name": ("accessibleName", "flagMissing"),
    "flag_lang": ("lang", "flagMissing"),
    "flag_emoji": ("emoji", "flagInHeadings"),
    "flag_hero": ("template", "flagGradientHero"),
    "flag_feature_row": ("template", "flagFeatureRow"),
}


@dataclass(frozen=True)
class UsabilityProfile:
    min_ratio: float = 4.5
    min_px: float = 24.0
    flag_outline: bool = True
    flag_name: bool = True
    flag_lang: bool = True
    flag_emoji: bool = True
    flag_hero: bool = True
    flag_feature_row: bool = True


def parse_profile(data: dict) -> UsabilityProfile:
    """Unknown sections and keys, and values of another kind, are errors."""
    values = {}
    for section, body in data.items():
        known = {key: name for name, (s, key) in _PLACES.items() if s == section}
        if not known:
            raise PackError(section, "unknown section")
        for key, value in (body or {}).items():
            name = known.get(key)
            number = name in ("min_ratio", "min_px")
            if name is None:
                raise PackError(f"{section}/{key}", "unknown key")
            if isinstance(value, bool) == number or not isinstance(value, (bool, int, float)) or (number and value <= 0):
                raise PackError(f"{section}/{key}", "has the wrong type")
            values[name] = float(value) if number else value
    return UsabilityProfile(**values)


def load_profile(path: str | Path) -> UsabilityProfile:
    return parse_profile(read_mapping(path))
