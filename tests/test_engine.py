"""Segmentation, packs and findings on our own texts."""

import json

import pytest
from pyspark.sql import functions as F

from prosemill.operators import calibration, markup
from prosemill.operators.segmentation import segment
from prosemill.plans.check import check, results
from prosemill.sources import packs

TEXTS = [
    'One. Two! three? No. Yes.\n\nSecond. Mr. Smith said no. Then "he left." I said. So did I. Then e.g. This. U.S. Army. Wait... Really?! (Ok.) Done',
    "  lead \n x  \n\n\n y. z\n", "A.", "?! a", "Sum 1.5 is ok. 2 follows. and more.", "", " \n ", "a\n\n b\n  c \n\nd. E", "Use `a. B` here. *Strong. Yes.* See https://x.y/a. Then é́.",
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_native_segments_equal_the_kernels(spark):
    got = {r.doc_id: [p.asDict(True) for p in r.paragraphs] for r in segment(table(spark, TEXTS)).nested.collect()}
    assert got == {k: markup.segmented(t, "text")[0] for k, t in enumerate(TEXTS)}


def test_markdown_blocks():
    text = "---\na: b\n---\n# Head *x*\n\nPara one\nstill.\n\n- item one\n  more\n- item two\n\n> quoted\n\n```\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n:::note\nInside.\n:::\n\n<div>\nhtml\n</div>\n\n    code\n"
    paragraphs, protected = markup.segmented(text, "markus")
    assert [(p["block"], p["text"]) for p in paragraphs] == [("heading", "Head x"), ("paragraph", "Para one still."), ("listItem", "item one more"), ("listItem", "item two"), ("paragraph", "Inside.")]
    assert paragraphs[-1]["container"] == "note"
    assert [r["kind"] for r in protected] == ["frontMatter", "quote", "code", "table", "directive", "directive", "html", "code"]
    assert all(text[p["start"] : p["end"]] == p["source"] for p in paragraphs)


def shape(text, kind="markdown"):
    paragraphs, protected = markup.segmented(text, kind)
    assert all(text[p["start"] : p["end"]] == p["source"] for p in paragraphs)
    return [(p["block"], p["text"]) for p in paragraphs], [(r["kind"], text[r["start"] : r["end"]]) for r in protected]


@pytest.mark.parametrize(("block", "kind"), [
    ("<div>x</div>", "html"), ("<!-- c -->", "html"), ("<?a b?>", "html"), ("<custom-tag a='1'>", "html"), ("<pre>\na\n\nb</pre>", "html"),
    ("```\ncode\n```", "code"), ("~~~\n```\n~~~", "code"), ("    code\n\n    more", "code"), ("> quoted\n> more", "quote"), ("| a | b |\n|---|---|\n| 1 | 2 |", "table"),
])
def test_each_protected_block_in_first_place_and_later(block, kind):
    after_item = [] if block[0] == " " else [f"- item\n\n{block}\n\nPara."]  # there it would go on with the item
    for text in (f"{block}\n\nPara.", f"Before.\n\n{block}\n\nPara.", *after_item):
        prose, protected = shape(text)
        assert prose[-1] == ("paragraph", "Para.") and protected == [(kind, block)]
    # In a list item, alone and on its first line.
    inside = block.replace("\n", "\n  ")
    prose, protected = shape(f"- {inside}\n\nPara.")
    assert prose == [("paragraph", "Para.")] and [k for k, _ in protected] == [kind]


def test_directives():
    text = "---\nt: x\n---\n:::note{a=1}\nInside.\n\n::::deep\nDeeper.\n::::\n:::\n\n::leaf{a=1\n::inner\nb=2}\n\n::plain text\n\n```\n:::code\n```\n\nEnd.\n:::\n"
    paragraphs, protected = markup.segmented(text, "markus")
    assert [(p["text"], p["container"]) for p in paragraphs] == [("Inside.", "note"), ("Deeper.", "deep"), ("End.", None)]
    found = [(r["kind"], text[r["start"] : r["end"]]) for r in protected]
    assert found == [
        ("frontMatter", "---\nt: x\n---"), ("directive", ":::note{a=1}"), ("directive", "::::deep"), ("directive", "::::"), ("directive", ":::"),
        ("directive", "::leaf{a=1\n::inner\nb=2}"), ("directive", "::plain text"), ("code", "```\n:::code\n```"), ("directive", ":::"),
    ]
    assert shape("---\nnot closed", "markus")[1] == [] and shape(":::open\n\nA. B.", "markus")[0] == [("paragraph", "A. B.")]
    assert shape("~~~~\n~~~\n::x\n~~~~\n\n::y", "markus")[1] == [("code", "~~~~\n~~~\n::x\n~~~~"), ("directive", "::y")]


def test_kernel_takes_no_square_time():
    import time

    times = []
    for n in (2000, 8000):
        began = time.process_time()
        paragraphs, _ = markup.segmented("Mr. A. said e.g. this. It was `x` so! " * n, "text")
        times.append(time.process_time() - began)
        assert len(paragraphs[0]["sentences"]) == 2 * n
    assert times[1] < 9 * times[0] + 0.5


def test_bundled_packs_pass_their_own_examples(spark):
    for name in packs.bundled():
        pack = packs.load_bundled(name)
        cases = [(p.id, True, t) for p in pack.policies for t in p.violates] + [(p.id, False, t) for p in pack.policies for t in p.complies]
        found = {(r.doc_id, r.policy_id) for r in check(table(spark, [c[2] for c in cases]), pack, "markdown").collect()}
        assert [((k, c[0]) in found) for k, c in enumerate(cases)] == [c[1] for c in cases]


def test_findings_survive_edits_elsewhere(spark):
    pack = packs.load_bundled("plain-words")
    rows = check(table(spark, ["We utilize it. 🚀 You shall go.", "New text.\n\nWe utilize it. 🚀 You shall go."]), pack).collect()
    by = lambda k: {r.id for r in rows if r.doc_id == k}
    assert len(by(0)) == 2 and by(0) == by(1)
    shall = next(r for r in rows if r.doc_id == 0 and r.excerpt == "shall")
    assert shall.u16_start == shall.start + 1 and shall.replacement == "must"
    whole = json.loads(results(table(spark, ["We utilize it."]), pack).first().result)
    assert whole["findings"][0]["excerpt"] == "utilize" and whole["segments"][0]["id"] == "doc"


def test_pack_errors():
    base = {"schemaVersion": 1, "packId": "x", "version": "1"}
    policy = {"id": "a", "version": 1, "title": "t", "guidance": "g", "severity": "warn"}
    for policies, where in [
        ([policy, policy], "policies/1/id"),
        ([policy | {"detectors": [{"id": "d", "lane": "rules", "kind": "regex", "pattern": "("}]}], "policies/0/detectors/0/pattern"),
        ([policy | {"severity": "loud"}], "policies/0/severity"),
        ([policy | {"detectors": [{"id": "d", "lane": "classifier", "scope": "sentence", "violation": {}, "threshold": 1}]}], "policies/0/detectors/0"),
    ]:
        with pytest.raises(packs.PackError) as e:
            packs.parse_pack(base | {"policies": policies})
        assert e.value.where == where


def test_calibration(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    p = rng.random(2000)
    y = rng.random(2000) < p**2
    rows = spark.createDataFrame([("p", "d", float(a), bool(b)) for a, b in zip(p, y, strict=True)], "policy_id string, detector_id string, probability double, violates boolean")
    fitted = rows.join(calibration.calibrate(rows), ["policy_id", "detector_id"])
    after = fitted.withColumn("probability", calibration.apply_calibration(F.col("probability"), F.struct("method", "a", "b", "points")))
    before, now = calibration.calibration_error(rows).first().ece, calibration.calibration_error(after).first().ece
    assert now < before / 2
