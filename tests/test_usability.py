"""Every kind of page finding: fires, doesn't, and is switched off."""

import pytest

from prosemill.operators.usability import colour, contrast, scan
from prosemill.sources.packs import PackError
from prosemill.sources.profile import UsabilityProfile, parse_profile

PAGES = {
    "missing_alt": ['<html lang="en"><img src="a.png" id="x">', '<html lang="en"><img src="a.png" alt="">'],
    "low_contrast": ['<html lang="en"><style>.t{color:#999;background-color:#fff}</style><p class="t">hi</p>', '<html lang="en"><p style="color:#000;background-color:white">hi</p>'],
    "small_tap_target": ['<html lang="en"><a style="width:10px;height:40px">x</a>', '<html lang="en"><a width="30" height="40">x</a>'],
    "suppressed_focus_outline": ['<html lang="en"><style>a:focus{outline:none}</style><a>x</a>', '<html lang="en"><style>a:focus{outline:0;box-shadow:0 0 1px red}</style><a>x</a>'],
    "missing_accessible_name": ['<html lang="en"><input id="q">', '<html lang="en"><label for="q">Q</label><input id="q"><label>a<input></label><b id="n">n</b><select aria-labelledby="n"></select>'],
    "missing_lang": ["<html><body>x", "<p>fragment"],
    "emoji_heading": ['<html lang="en"><h2>a <b>🚀</b></h2>', '<html lang="en"><p>🚀</p>'],
    "generic_gradient_hero": ['<html lang="en"><style>.hero{background:linear-gradient(red,blue)}</style><div class="hero">x</div>', '<html lang="en"><style>.box{background:linear-gradient(red,blue)}</style><div class="box">x</div>'],
    "generic_feature_row": ['<html lang="en"><div id="r">' + '<div class="c x"><img alt=""></div>' * 3 + "</div>", '<html lang="en"><div>' + '<div class="c"><img alt=""></div>' * 2 + '<div class="d"><img alt=""></div></div>'],
}


def test_each_kind(spark):
    rows, want = [], {}
    for kind, (bad, good) in PAGES.items():
        want[len(rows)], want[len(rows) + 1] = {kind}, set()
        rows += [(len(rows), bad), (len(rows) + 1, good)]
    rows.append((99, None))
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got: dict = {k: set() for k in want}
    for r in scan(pages).collect():
        got[r.page_id].add(r.kind)
        assert r.id.startswith("finding-") and r.selector
    assert got == want
    off = UsabilityProfile(1.0, 1.0, *[False] * 6)
    assert {r.kind for r in scan(pages, off).collect()} == {"missing_alt"}


def test_colours(spark):
    from pyspark.sql import functions as F

    rows = [("#fff", [255] * 3), ("#0a0B0c", [10, 11, 12]), ("rgb(1,1,1)", [255] * 3), ("rgba(10, 20,30,1)", [10, 20, 30]), ("rgba(1,2,3,.5)", None), ("Grey", [128] * 3), ("pink", None), ("", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "v string").select("v", colour(F.col("v")).alias("c")).collect()
    assert [(r.v, r.c) for r in got] == rows
    ratio = spark.range(1).select(contrast(F.array(*[F.lit(0)] * 3), F.array(*[F.lit(255)] * 3)).alias("r")).first().r
    assert abs(ratio - 21) < 1e-9


def test_profile():
    assert parse_profile({"contrast": {"minRatio": 7}, "lang": {"flagMissing": False}}) == UsabilityProfile(min_ratio=7.0, flag_lang=False)
    for bad in ({"colour": {}}, {"contrast": {"min": 1}}, {"contrast": {"minRatio": True}}, {"lang": {"flagMissing": 1}}):
        with pytest.raises(PackError):
            parse_profile(bad)
