"""Static usability findings of HTML pages.

A Python kernel turns a page into rows of elements, each with the style rules that match it and with
what only the whole page tells: whether something names it, and whether it is the first of its
label. The nine kinds of findings are one projection over these rows; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.spans import exploded, let
from prosemill.operators.word_lists import EMOJI
from prosemill.sources.profile import UsabilityProfile

# Elements without an end tag, elements that hold text, and selectors of a page's head.
VOID = "area base br col embed hr img input link meta source track wbr".split()
TEXT_TAGS = "p span div h1 h2 h3 h4 h5 h6 a li label button td th strong em small".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
HERO = "body header .hero #hero .banner #banner".split()
COLOURS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128)}

STYLE = "struct<specificity:int,ord:int,decls:map<string,string>>"
NODES = (
    "page_id long, node int, parent int, sibling int, tag string, attrs map<string,string>, text string, all_text string, label string, "
    f"in_label boolean, has_media boolean, inline map<string,string>, styles array<{STYLE}>, focus array<{STYLE}>, hero boolean, "
    "named boolean, root boolean, first_hero boolean, first_row boolean"
)
_FOCUS = re.compile(r"([a-z][a-z0-9-]*|\.[a-zA-Z0-9_-]+|#[a-zA-Z0-9_-]+)(:focus-visible|:focus)?")


class _Tree(HTMLParser):
    """Elements in document order. An end tag closes its element only if that is the innermost one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.style: str | None = None
        self.in_style = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1] if self.open else -1
        at = len(self.nodes)
        place = self.children.get(parent, 0)
        self.children[parent] = place + 1
        self.nodes.append({"node": at, "parent": parent, "sibling": place, "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": [], "all_text": []})
        if tag == "style" and self.style is None:
            self.in_style, self.style = True, ""
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "style":
            self.in_style = False
        if self.open and self.nodes[self.open[-1]]["tag"] == tag:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.in_style:
            self.style += data
        elif self.open:
            self.nodes[self.open[-1]]["text"].append(data)


def declarations(text: str) -> dict[str, str]:
    pairs = (d.split(":", 1) for d in text.split(";") if ":" in d)
    return {k.strip().lower(): v.strip() for k, v in pairs if k.strip()}


def style_rules(text: str) -> list[tuple[list[str], dict[str, str]]]:
    found = ((m[1], m[2]) for m in re.finditer(r"([^{}]+)\{([^{}]*)\}", text))
    split = (([s.strip() for s in sel.split(",") if s.strip()], declarations(block)) for sel, block in found)
    return [(s, d) for s, d in split if s]


def page_nodes(html: str) -> list[dict]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes, rules = tree.nodes, style_rules(tree.style or "")
    for x in reversed(nodes):
        x["has_media"] = x.get("has_media", False) or x["tag"] in ("img", "svg")
        x["all_text"] = "".join(x["text"]) + "".join(reversed(x["all_text"]))
        if x["parent"] >= 0:
            up = nodes[x["parent"]]
            up["all_text"].append(x["all_text"])
            up["has_media"] = up.get("has_media", False) or x["has_media"]
    for x in nodes:
        up = nodes[x["parent"]] if x["parent"] >= 0 else None
        x["in_label"] = bool(up) and (up["in_label"] or up["tag"] == "label")
        classes, own_id = x["attrs"].get("class", "").split(), x["attrs"].get("id", "")
        x["label"] = x["tag"] + (f"#{own_id}" if own_id else "") + "".join(f".{c}" for c in classes)
        score = {x["tag"]: 1} | {f".{c}": 10 for c in classes} | {f"#{own_id}": 100}
        x["inline"] = declarations(x["attrs"].get("style", ""))
        x["styles"], x["focus"], x["hero"] = [], [], False
        for k, (selectors, decls) in enumerate(rules):
            hits = [s for s in selectors if s in score]
            if hits:
                x["styles"].append({"specificity": max(score[s] for s in hits), "ord": k, "decls": decls})
                gradient = any("linear-gradient" in decls.get(p, "").lower() for p in ("background", "background-image"))
                x["hero"] |= gradient and any(s in HERO for s in hits)
            for m in filter(None, map(_FOCUS.fullmatch, selectors)):
                if m[1] in score and ("outline" in decls or "outline-width" in decls):
                    x["focus"].append({"specificity": score[m[1]] + (1000 if m[2] else 0), "ord": k, "decls": decls})
        x["text"] = "".join(x["text"])
    _across(nodes)
    return nodes


def _across(nodes: list[dict]) -> None:
    """What other elements of the page say of an element."""
    attr = lambda x, name: x["attrs"].get(name, "").strip(" ")
    ids = {attr(x, "id") for x in nodes} - {""}
    targets = {attr(x, "for") for x in nodes if x["tag"] == "label"} - {""}
    by_parent: dict[int, list[dict]] = {}
    for x in nodes:
        refs = set(re.split(r"\s+", attr(x, "aria-labelledby"), flags=re.A))
        x["named"] = bool(refs & ids) or attr(x, "id") in targets
        by_parent.setdefault(x["parent"], []).append(x)
    roots = [x["node"] for x in by_parent.get(-1, []) if x["tag"] == "html"]
    rows = [k for k, kids in by_parent.items() if k >= 0 and _has_row(kids)]
    first = lambda found: set({nodes[k]["label"]: k for k in sorted(found, reverse=True)}.values())
    heroes, rows = first([x["node"] for x in nodes if x["hero"]]), first(rows)
    for x in nodes:
        x["root"], x["first_hero"], x["first_row"] = x["node"] in roots[:1], x["node"] in heroes, x["node"] in rows


def _has_row(kids: list[dict]) -> bool:
    """Three or more in a row of the same first class, all with a picture?"""
    first = lambda x: re.match(r"\S*", x["attrs"].get("class", "").strip(" "), re.A)[0]
    for name, run in groupby(kids, key=first):
        run = list(run)
        if name and len(run) >= 3 and all(x["has_media"] for x in run):
            return True
    return False


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of elements; a page's rows stay together in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        style = pa.list_(pa.struct([("specificity", pa.int32()), ("ord", pa.int32()), ("decls", pa.map_(pa.string(), pa.string()))]))
        kinds = {"page_id": pa.int64(), "node": pa.int32(), "parent": pa.int32(), "sibling": pa.int32(), "styles": style, "focus": style}
        kinds |= {k: pa.bool_() for k in ("in_label", "has_media", "hero", "named", "root", "first_hero", "first_row")}
        kinds |= {k: pa.map_(pa.string(), pa.string()) for k in ("attrs", "inline")} | {k: pa.string() for k in ("tag", "text", "all_text", "label")}
        names = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", NODES).split(", ")]
        items = lambda v: list(v.items()) if isinstance(v, dict) else v
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html"), strict=True):
                rows = page_nodes(html.as_py() or "")
                for x in rows:
                    x["page_id"] = page_id
                    for s in (*x["styles"], *x["focus"]):
                        s["decls"] = items(s["decls"])
                yield pa.RecordBatch.from_arrays([pa.array([items(x[n]) for x in rows], kinds[n]) for n in names], names=names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, NODES)


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _winner(blocks: Column) -> Column:
    """The declarations of the highest specificity, of these the last."""
    ranked = F.transform(blocks, lambda b: F.struct(b["specificity"].alias("specificity"), b["ord"].alias("ord"), F.map_entries(b["decls"]).alias("d")))
    return F.map_from_entries(F.array_max(ranked)["d"])


def _styled(name: str) -> Column:
    """A property's value by the cascade of rules."""
    having = F.filter("styles", lambda b: F.map_contains_key(b["decls"], name))
    return F.try_element_at(_winner(having), F.lit(name))


def pixels(value: Column) -> Column:
    text = F.lower(F.trim(value))
    number = F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(?:px)?$", 1)
    return F.when(number != "", number.cast("double"))


def _length(name: str) -> Column:
    return F.coalesce(pixels(F.try_element_at("attrs", F.lit(name))), pixels(F.try_element_at("inline", F.lit(name))), pixels(_styled(name)))


def colour(value: Column) -> Column:
    """``array<int>`` of red, green and blue, or null: hexadecimal, rgb() or one of seven names."""
    text = F.lower(F.trim(value))
    pair = lambda k, n: F.conv(F.repeat(F.substring(text, k, n), 2 // n), 16, 10).cast("int")
    named = F.lit(None).cast("array<int>")
    for name, rgb in COLOURS.items():
        named = F.when(text == name, F.array(*map(F.lit, rgb))).otherwise(named)
    parts = F.transform(F.split(F.regexp_extract(text, r"^rgba?\(([^)]*)\)$", 1), r"\s*,\s*"), _number)
    channels = F.slice(parts, 1, 3)
    good = (F.size(parts).isin(3, 4)) & ~F.exists(parts, lambda p: p.isNull()) & ((F.size(parts) == 3) | (F.get(parts, F.lit(3)) == 1))
    small = ~F.exists(channels, lambda c: c > 1)
    scaled = F.transform(channels, lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.when(small, c * 255).otherwise(c)))).cast("int"))
    return (
        F.when(text.rlike("^#[0-9a-f]{6}$"), F.array(pair(2, 2), pair(4, 2), pair(6, 2)))
        .when(text.rlike("^#[0-9a-f]{3}$"), F.array(pair(2, 1), pair(3, 1), pair(4, 1)))
        .when(text.rlike(r"^rgba?\([^)]*\)$") & good, scaled)
        .otherwise(named)
    )


def _number(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain.rlike(r"^-?[0-9]*\.?[0-9]+$"), plain.cast("double"))


def luminance(rgb: Column) -> Column:
    part = lambda k: let(F.get(rgb, F.lit(k)) / 255.0, lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))
    return 0.2126 * part(0) + 0.7152 * part(1) + 0.0722 * part(2)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def _finding_id(kind: str, label: Column, detail: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))
    key = F.concat(F.lit(f'[1,"{kind}",'), quoted(label), F.lit(","), quoted(detail), F.lit("]"))
    return F.concat(F.lit("finding-"), F.substring(F.sha2(key, 256), 1, 16))


def scan(pages: DataFrame, profile: UsabilityProfile | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, kind_ord, node, id, kind, selector, ratio, width, height``, by kind and place.

    A page is a row: rows of one id are scanned one by one, and a null page has no elements.
    """
    profile = profile or UsabilityProfile()
    tag, kind_of = F.col("tag"), F.lower(F.coalesce(F.try_element_at("attrs", F.lit("type")), F.lit("text")))
    interactive = F.lower(_attr("role")).isin("button", "link") | ((tag == "input") & (kind_of != "hidden")) | tag.isin("a", "button", "select", "textarea", "summary")
    blank = lambda name: F.trim(_attr(name)) == ""
    none, label, nothing = F.lit(None).cast("double"), F.col("label"), F.lit("")
    kinds: list[Column] = []

    def found(kind: str, selector: Column = label, detail: Column = nothing, ratio: Column = none, width: Column = none, height: Column = none) -> Column:
        kinds.append(F.lit(kind))
        return F.struct(
            F.lit(len(kinds) - 1).alias("kind_ord"), _finding_id(kind, selector, detail).alias("id"), F.lit(kind).alias("kind"), selector.alias("selector"),
            ratio.alias("ratio"), width.alias("width"), height.alias("height"),
        )

    each = [F.when((tag == "img") & ~F.map_contains_key("attrs", "alt"), found("missing_alt", detail=_attr("src")))]

    of = lambda name: colour(F.when(F.map_contains_key("inline", name), F.try_element_at("inline", F.lit(name))).otherwise(_styled(name)))
    low = lambda r: F.when(r < profile.min_ratio, found("low_contrast", detail=F.format_string("%.4f", r), ratio=F.round(r, 4)))
    pair = let(F.struct(of("color").alias("fg"), of("background-color").alias("bg")), lambda c: F.when(c["fg"].isNotNull() & c["bg"].isNotNull(), contrast(c["fg"], c["bg"])))
    each.append(F.when(tag.isin(TEXT_TAGS) & (F.trim("text") != ""), let(pair, low)))

    def small(size: Column) -> Column:
        w, h = size["w"], size["h"]
        known = w.isNotNull() & h.isNotNull() & ((w < profile.min_px) | (h < profile.min_px))
        return F.when(known, found("small_tap_target", detail=F.concat(w.cast("string"), F.lit("x"), h.cast("string")), width=w, height=h))

    each.append(F.when(interactive, let(F.struct(_length("width").alias("w"), _length("height").alias("h")), small)))

    has_inline = F.map_contains_key("inline", "outline") | F.map_contains_key("inline", "outline-width")
    own = F.array(F.struct(F.lit(10_000).alias("specificity"), F.lit(10_000).alias("ord"), F.col("inline").alias("decls")))

    def unseen(block: Column) -> Column:
        value = lambda name: F.lower(F.trim(F.coalesce(F.try_element_at(block, F.lit(name)), F.lit(""))))
        gone = F.regexp_extract(value("outline"), r"^(\S+)", 1).isin("none", "0", "0px") | value("outline-width").isin("0", "0px")
        shadow = F.coalesce(F.map_contains_key(block, "box-shadow"), F.lit(False)) & (value("box-shadow") != "none")
        return F.when(block.isNotNull() & gone & ~shadow, found("suppressed_focus_outline"))

    blocks = F.concat("focus", F.when(has_inline, own).otherwise(F.slice(own, 1, 0)))
    each.append(F.when(F.lit(profile.flag_outline) & interactive, let(_winner(blocks), unseen)))

    plain_button = kind_of.isin("submit", "button", "reset") & (~blank("value") | ~blank("aria-label"))
    control = tag.isin("select", "textarea") | ((tag == "input") & (kind_of != "hidden") & ~plain_button)
    unnamed = control & blank("aria-label") & ~F.col("in_label") & ~F.col("named") & ~((tag == "input") & (kind_of == "image") & ~blank("alt"))
    each.append(F.when(F.lit(profile.flag_name) & unnamed, found("missing_accessible_name")))
    each.append(F.when(F.lit(profile.flag_lang) & F.col("root") & blank("lang"), found("missing_lang", selector=F.lit("html"))))
    each.append(F.when(F.lit(profile.flag_emoji) & tag.isin(HEADINGS) & F.col("all_text").rlike(EMOJI), found("emoji_heading")))
    each.append(F.when(F.lit(profile.flag_hero) & F.col("first_hero"), found("generic_gradient_hero")))
    each.append(F.when(F.lit(profile.flag_feature_row) & F.col("first_row"), found("generic_feature_row")))

    rows = exploded(nodes(pages, id_col, html_col).select("page_id", "node", F.array_compact(F.array(*each)).alias("each")), F.col("each"), "f")
    return rows.select("page_id", "f.kind_ord", "node", "f.id", "f.kind", "f.selector", "f.ratio", "f.width", "f.height")
