"""Regular expressions written for Python, as Spark's engine must be given them."""

from __future__ import annotations


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern with Unicode classes and ``\\n`` as the only line end, as Python has them."""
    out = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    return ("(?iuUd)" if ignore_case else "(?Ud)") + out


def escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&#~/" else c for c in text)


def phrase_pattern(phrases: list[str]) -> str:
    """Whole phrases, longest first, with any white space between their words."""
    parts = [r"\s+".join(map(escape, p.split())) for p in sorted(phrases, key=len, reverse=True)]
    return r"(?<!\w)(?:" + "|".join(parts) + r")(?!\w)"
