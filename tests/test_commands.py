"""Whole runs over a folder from the command line."""

import json
import os

from lithoflow.__main__ import main
from lithoflow.operators.model_calls import collected
from test_sources import BODY, document

PLUGIN = '''
import json


def model(prompt):
    if prompt.startswith("WRITE"):
        return json.dumps({"title": "Cobalt oxide rod", "abstract": "A rod.", "keywords": [], "issues": []})
    text = json.dumps({"shared": {"creators": [{"name": "EXAMPLE, Anna", "familyName": "EXAMPLE", "givenName": "Anna", "nameIdentifiers": [{"nameIdentifier": "0000-0001-2345-6789"}], "affiliation": [{"name": "Inst A"}, {"name": "Nowhere"}]}]}, "samples": [{"facts": ["x: y"]}]})
    return iter([text[:20], text[20:]])


def fetch(url):
    if "/person" in url:
        return json.dumps({"name": {"given-names": {"value": "Anna"}, "family-name": {"value": "Example"}}})
    if "Inst%20A" in url:
        return json.dumps({"items": [{"chosen": True, "organization": {"id": "https://ror.org/01", "names": [{"value": "Institute A", "lang": "en", "types": ["label"]}]}}]})
    return "{}"


def down(url):
    raise ConnectionError("no network")
'''


def test_run_evaluate_enrich(spark, tmp_path, monkeypatch):
    (tmp_path / "litho_plugin.py").write_text(PLUGIN)
    monkeypatch.syspath_prepend(str(tmp_path))
    folder, out, gold = tmp_path / "in", tmp_path / "out", tmp_path / "gold"
    folder.mkdir()
    gold.mkdir()
    (folder / "My doc.docx").write_bytes(document(BODY))
    (folder / "other.odt").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("EXTRACT {text}")
    (tmp_path / "w.txt").write_text("WRITE {code} {given_title} {given_description} {facts} {preparation} {others}")
    (gold / "manifest.json").write_text(json.dumps({"My doc.docx": {"records": "gold/mine.json", "select": [0]}}))
    (gold / "mine.json").write_text(json.dumps([{"doi": "", "titles": [{"title": "Cobalt oxide rod"}], "creators": [{"name": "Example, Anna", "familyName": "Example"}], "publisher": {"name": "p"}, "types": {}}]))

    common = ["run", str(folder), str(out), "--extraction", str(tmp_path / "e.txt"), "--writing", str(tmp_path / "w.txt"), "--cache", str(tmp_path / "cache"), "--manifest", str(gold / "manifest.json")]
    assert main([*common, "--model", "litho_plugin:model", "--no-lookup"]) == 0
    assert sorted(os.listdir(out)) == ["My doc.json", "My doc.md", "My doc.provenance.json"]
    said = json.loads((out / "My doc.provenance.json").read_text())
    assert said["source"]["filename"] == "My doc.docx" and len(said["passes"]) == 2 and said["enrichment"] is None if "enrichment" in said else True
    assert {p["cached"] for p in said["passes"]} == {False} and json.loads((out / "My doc.json").read_text())[0]["titles"][0]["title"] == "Cobalt oxide rod"
    assert main([*common, "--registry", str(tmp_path / "reg")]) == 0  # no model: all answers are cached, looked up offline
    assert {p["cached"] for p in json.loads((out / "My doc.provenance.json").read_text())["passes"]} == {True}

    assert main(["evaluate", str(gold / "manifest.json"), str(out), str(folder), "--runs", str(tmp_path / "runs")]) == 0
    (name,) = os.listdir(tmp_path / "runs")
    report = json.loads((tmp_path / "runs" / name).read_text())["reports"][0]
    assert report["document"] == "My doc" and report["run"]["writingPass"] is True and report["report"]["title_similarity"] == 1.0

    assert main(["enrich", str(out), "--fetch", "litho_plugin:down"]) == 1
    errors = json.loads((out / "My doc.provenance.json").read_text())["validation"]
    assert main(["enrich", str(out), "--registry", str(tmp_path / "reg"), "--fetch", "litho_plugin:fetch"]) == 0
    person = json.loads((out / "My doc.json").read_text())[0]["creators"][0]
    assert [a["name"] for a in person["affiliation"]] == ["Institute A", "Nowhere"]
    said = json.loads((out / "My doc.provenance.json").read_text())
    assert said["enrichment"]["failed"] == 0 and said["validation"]["errorCount"] == errors["errorCount"] and any("Nowhere" in m for m in said["postprocessing"])


def test_answers_in_chunks_stop():
    asked = []

    def chunks():
        for k in range(10_000):
            asked.append(k)
            yield "around and around "

    text, reason = collected(chunks())
    assert reason.startswith("repeats: ") and len(asked) < 100 and text.startswith("around")
    assert collected(iter(["a", "b"])) == ("ab", None) and collected("whole") == ("whole", None) and collected(iter([])) == ("", None)
    assert collected((str(k) for k in range(50)), 20)[1] == "stopped after 20 chunks"
