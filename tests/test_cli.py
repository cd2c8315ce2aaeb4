"""The command line, requests and drafts."""

import json

import pytest

from prosemill.__main__ import main
from prosemill.sources.requests import RequestError, parse_request

PACK = {"schemaVersion": 1, "packId": "x", "version": "1", "policies": [{"id": "a", "version": 1, "title": "t", "guidance": "g", "severity": "warn", "detectors": [{"id": "d", "lane": "rules", "kind": "phrase", "phrases": ["utilize"]}]}]}
GOOD = {"content": {"text": "We utilize it.", "format": "markdown"}, "pack": PACK}


def test_check_of_a_request_and_of_drafts(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(GOOD | {"options": {"lanes": {"classifier": False}}}))
    assert main(["check", "--request", str(tmp_path / "r.json")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [f["excerpt"] for f in got["findings"]] == ["utilize"] and got["lanes"]["classifier"] == {"status": "disabled"}
    (tmp_path / "drafts").mkdir()
    for k in range(3):
        (tmp_path / "drafts" / f"{k}.txt").write_text("We utilize \u00e9. " * (k + 1))
    assert main(["check", "--draft", str(tmp_path / "drafts"), "--pack", "plain-words"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted(sum(f["excerpt"] == "utilize" for f in x["findings"]) for x in lines) == [1, 2, 3]


def test_requests_say_where_they_are_wrong(capsys):
    assert parse_request(GOOD).format == "markdown"
    bad_pack = json.loads(json.dumps(PACK))
    bad_pack["policies"][0]["severity"] = "loud"
    for change, where in [
        ({"content": {"text": 1, "format": "text"}}, "content/text"), ({"content": {"text": "", "format": "html"}}, "content/format"), ({"pack": bad_pack}, "pack/policies/0/severity"),
        ({"more": 1}, "more"), ({"options": {"lanes": {"rules": 1}}}, "options/lanes/rules"), ({"options": {"classifier": {"examples": [{}]}}}, "options/classifier/examples/0"),
    ]:
        with pytest.raises(RequestError) as e:
            parse_request(GOOD | change)
        assert e.value.where == where
    assert main(["check"]) == 1 and "give --request or --draft" in capsys.readouterr().err


def test_other_commands(spark, tmp_path, capsys):
    assert main(["pack", "list"]) == 0 and capsys.readouterr().out.split() == ["controlled-english", "machine-tells", "plain-words"]
    assert main(["pack", "show", "plain-words"]) == 0 and json.loads(capsys.readouterr().out)["packId"] == "plain-words"
    assert main(["pack", "validate", str(tmp_path / "none.yml")]) == 1
    assert main(["schema"]) == 0 and "results" in json.loads(capsys.readouterr().out)
    (tmp_path / "page.html").write_text("<html><img src='a'>")
    capsys.readouterr()
    assert main(["usability", str(tmp_path / "page.html")]) == 0
    assert [json.loads(x)["kind"] for x in capsys.readouterr().out.splitlines()] == ["missing_alt", "missing_lang"]
    labels = [{"policyId": "p", "detectorId": "d", "probability": k % 10 / 10, "violates": k % 10 > 6} for k in range(60)]
    (tmp_path / "l.json").write_text(json.dumps({"labels": labels}))
    assert main(["calibrate", str(tmp_path / "l.json")]) == 0 and json.loads(capsys.readouterr().out)["policy_id"] == "p"
