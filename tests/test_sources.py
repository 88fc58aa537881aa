"""DOCX reader, file listing, settings, manifests, sinks, pipeline and streams."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow import sinks
from lithoflow.sources import docx, files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def para(text="", style=None, num=None, inner=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr>" + (f"<w:r><w:t>{text}</w:t></w:r>" if text else "") + inner + "</w:p>"


def document(body):
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate((("decimal", "%1."), ("lowerLetter", "%1.%2)"), ("lowerRoman", "%3"))))
    rels = '<Relationship Id="rId1" Type="x/hyperlink" Target="https://orcid.org/0000-0002-0000-0015" TargetMode="External"/><Relationship Id="rId2" Type="x/hyperlink" Target="mailto:a@b.c" TargetMode="External"/><Relationship Id="rId3" Type="x/footnotes" Target="footnotes.xml"/><Relationship Id="rId4" Type="x/header" Target="header1.xml"/><Relationship Id="rId5" Type="x/header" Target="header2.xml"/>'
    parts = {
        "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="L"><w:name w:val="List"/><w:pPr><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="-1">{para("sep")}</w:footnote><w:footnote w:id="2">{para("a note")}</w:footnote></w:footnotes>',
        "word/header1.xml": f"<w:hdr {NS}>{para('Head')}</w:hdr>", "word/header2.xml": f"<w:hdr {NS}>{para('Head')}</w:hdr>",
        "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


BODY = (
    para("Main", "T") + para("Part", "H2") + para("one", num=(1, 0)) + para("deep", num=(1, 1)) + para("deeper", num=(1, 2)) + para("two", num=(1, 0)) + para("again", num=(1, 1)) + para("dot", "L")
    + "<w:tbl><w:tr><w:tc>" + para("a|b") + "</w:tc><w:tc>" + para("x") + para("y") + "</w:tc></w:tr><w:tr><w:tc>" + para("1") + "</w:tc></w:tr></w:tbl>"
    + para(inner='<w:r><w:t>Co</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="subscript"/></w:rPr><w:t>3</w:t></w:r><w:r><w:delText>gone</w:delText><w:tab/><w:noBreakHyphen/><w:t>O</w:t></w:r>')
    + para(inner='<w:hyperlink r:id="rId1"><w:r><w:t>Anna</w:t></w:r></w:hyperlink><w:hyperlink r:id="rId2"><w:r><w:t> a@b.c</w:t></w:r></w:hyperlink>')
    + para("see", inner='<w:r><w:instrText>HYPERLINK "https://x.y/z"</w:instrText></w:r><w:r><w:footnoteReference w:id="2"/></w:r>')
    + para(inner="<w:r><mc:AlternateContent><mc:Choice><w:txbxContent>" + para("box") + "</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>" + para("box") + "</w:txbxContent></mc:Fallback></mc:AlternateContent></w:r>")
)
WANT = "# Main\n## Part\n1. one\n  1.a) deep\n    i deeper\n2. two\n  2.a) again\n- dot\n| a\\|b | x <br> y |\n| --- | --- |\n| 1 |  |\nCo<sub>3</sub>\t-O\nAnna (https://orcid.org/0000-0002-0000-0015) a@b.c\nsee[^2] (https://x.y/z)\nbox\n\n## Footnotes\n[^2]: a note\n\n## Page header/footer\nHead"


def test_docx_reader():
    r = docx.Reader(document(BODY))
    assert r.text() == WANT and "0000-0002-0000-0015" in r.raw()
    assert docx.label("upperRoman", 4) == "IV" and docx.label("upperLetter", 27) == "A" and docx.markdown([["", " "]]) == ""


def test_docx_table(spark):
    df = spark.createDataFrame([("a.docx", bytearray(document(BODY))), ("b.docx", bytearray(b"broken")), ("c.docx", bytearray(document(""))), ("d.docx", None)], "path string, content binary").withColumn("text", F.lit("clash"))
    got = {r["path"]: r for r in docx.load(df).collect()}
    assert got["a.docx"]["text"] == WANT and not got["a.docx"]["fatal"] and got["b.docx"]["fatal"] and got["d.docx"]["fatal"]
    usable, rejected = files.split_fatal(docx.load(df))
    assert [r["path"] for r in usable.collect()] == ["a.docx", "c.docx"] and rejected.count() == 2


def test_scan(spark, tmp_path):
    for name in ("b.docx", "a.PDF", "~$b.docx", ".hidden.docx", "x.txt", "old.doc"):
        (tmp_path / name).write_bytes(b"x")
    got = files.scan(spark, str(tmp_path)).select(files.file_name(F.col("path")).alias("n"), files.dispatch(F.col("path")).alias("d")).collect()
    assert [r["n"] for r in got] == ["a.PDF", "b.docx", "old.doc"] and [r["d"]["fatal"] for r in got] == [False, False, True]


def test_settings():
    text = "# c\nA=1\nB = 'two # x'\nC=3 # three\nbroken\nD=\nexport=x"
    assert files.settings(text, {"A": "0"}) == {"A": "0", "B": "two # x", "C": "3", "D": "", "export": "x"}
    c = files.curator({"CURATOR_NAME": "Doe, Jo", "CURATOR_ORCID": "x 0000-0002-0000-0015", "CURATOR_AFFILIATION": "Inst", "CURATOR_ROR": "https://ror.org/04v76ef78"})
    assert c["nameIdentifiers"][0]["nameIdentifier"].endswith("0015") and c["affiliation"][0]["affiliationIdentifier"] == "https://ror.org/04v76ef78"
    assert files.curator({"CURATOR_NAME": "NoComma"}) is None and files.curator({}) is None


def test_manifest_and_records(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"_note": "x", "a.docx": {"records": "r.json", "select": [1, 7], "draft": True}, "b.docx": {"records": "r.json"}}))
    got = {r["source"]: r for r in files.manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got["a.docx"]["selected"] == [1, 7] and got["a.docx"]["draft"] and got["b.docx"]["selected"] is None and not got["b.docx"]["draft"]
    (tmp_path / "r.json").write_text(json.dumps([{"doi": "1"}, {"doi": "2"}]))
    (tmp_path / "s.json").write_text(json.dumps({"doi": "3"}))
    rs = files.records(spark, str(tmp_path / "[rs].json")).collect()
    assert sorted(x["doi"] for r in rs for x in r["records"]) == ["1", "2", "3"]
    df = files.records(spark, str(tmp_path / "r.json"))
    assert [x["doi"] for x in df.select(files.selected(F.col("records"), F.array(F.lit(1), F.lit(7))).alias("x")).first()["x"]] == ["2"]
    assert files.style_examples(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"examples": [{"title": "t", "abstract": "a"}]}))
    assert files.style_examples(spark, str(tmp_path / "e.json")).first()["source_documents"] == []


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, '{"doi": "b"}'), (1, 0, '{"doi": "a", "titles": [{"title": "T"}], "subjects": [{"subject": "x"}]}')], "doc_id bigint, sample_idx int, j string").select("doc_id", "sample_idx", F.from_json("j", S.RECORD).alias("record"))
    names = spark.createDataFrame([(1, "my/doc: 1")], "doc_id bigint, name string")
    lists = sinks.record_lists(r, names)
    assert [x["doi"] for x in json.loads(lists.first()["json"])] == ["a", "b"] and lists.first()["doc_name"] == "mydoc 1"
    sinks.write_json(lists, str(tmp_path / "out"))
    sinks.write_json(lists, str(tmp_path / "out"))
    assert len([f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.startswith("part")]) == 1
    page = r.where("sample_idx = 0").select(sinks.report(F.col("record"))).first()[0]
    assert page.startswith("# T") and "DOI: a" in page and "## Keywords\nx" in page


def test_pipeline(spark):
    from lithoflow.plans import pipeline

    text = "Anna Example (Producer) made cobalt oxide rods, 12.5 mg, on 5 May 2026."
    first = {"shared": {"creators": [{"name": "Example, Anna", "familyName": "Example", "givenName": "Anna", "role": "Producer"}]}, "samples": [{"givenTitle": "cobalt oxide rods", "facts": ["mass: 12.5 mg"]}, {"facts": ["invented: 99 kg"]}]}
    second = {"title": "Cobalt oxide rods", "abstract": "Rods of 12.5 mg and 77 g.", "keywords": ["cobalt oxide", "unicorn"], "issues": ["check mass"]}
    a, b = json.dumps(first), json.dumps(second)

    def model(prompt):
        if "broken" in prompt:
            return "no json"
        return b if prompt.startswith("WRITE") else a

    docs = spark.createDataFrame([(1, text), (2, "broken text"), (3, None)], "doc_id bigint, text string")
    cache = spark.createDataFrame([], "cache_key string, content string, model string")
    r = pipeline.run(docs, cache, "EXTRACT {text}", model, "WRITE {code} {given_title} {given_description} {facts} {preparation} {others}", P.Policy())
    recs = {x["sample_idx"]: x["record"] for x in r.records.where("doc_id = 1").collect()}
    assert recs[0]["titles"][0]["title"] == "Cobalt oxide rods" and [s["subject"] for s in recs[0]["subjects"]] == ["cobalt oxide"]
    kinds = {f["kind"] for f in r.findings.where("doc_id = 1").collect()}
    assert {"number", "model-note", "duplicate-title"} <= kinds and r.rejected.count() == 0
    assert any("invented" in c["message"] for c in r.changes.collect())
    assert {x["id"]: x["error"] for x in r.answers.collect()}["2"] == "answer is not JSON"

    people = spark.createDataFrame([], "orcid string, registered struct<given:string,family:string>")
    places = spark.createDataFrame([], "text string, ror string, label string")
    e = pipeline.enrich(r, people, places)
    assert e.records.count() == 2 and e.findings.count() == r.findings.count()
    gold = e.records.where("sample_idx = 0").withColumn("sample_idx", F.lit(5))
    checks, summaries = pipeline.evaluate(e.records, gold, docs)
    fields = {c["field"]: c["passed"] for c in checks.collect()}
    assert fields["sample count"] is False and fields["sample expected"] is False and fields["creator Example, Anna: present"] is True
    assert summaries.first()["title_similarity"] == 1.0


def test_command_line(spark, sf, tmp_path, capsys):
    from lithoflow.__main__ import main

    assert main(["names"]) == 0 and "copy_ratio" in capsys.readouterr().out
    assert main(["query", "safe_name", sf, "--rows", "2"]) == 0
    (tmp_path / "a.docx").write_bytes(document(BODY))
    (tmp_path / "b.odt").write_bytes(b"x")
    assert main(["preview", str(tmp_path)]) == 0


def test_streams(spark, tmp_path):
    from lithoflow.streaming import loops

    rows = [(1, k, "abcdefgh1" * 10) for k in range(6)] + [(2, k, f"part {k} of a plain text") for k in range(6)] + [(3, 0, None)]
    spark.createDataFrame(rows, "text_id bigint, seq bigint, chunk string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text_id bigint, seq bigint, chunk string").parquet(str(tmp_path / "in"))
    q = loops.watch_loops(stream).writeStream.format("memory").queryName("loops").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM loops").collect()
    assert [(r["text_id"], r["reason"]) for r in got] == [(1, "repeats: abcdefgh1")]

    spark.createDataFrame([(1, "2024-01-01 00:00:00", "x"), (1, "2024-01-01 00:01:00", "x"), (2, "2024-01-02 00:00:00", "y")], "doc_id bigint, received_at string, source string").selectExpr("doc_id", "CAST(received_at AS TIMESTAMP) received_at", "source").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema("doc_id bigint, received_at timestamp, source string").parquet(str(tmp_path / "docs"))
    seen = []
    loops.each_batch(docs, "doc_id", "received_at", "7 days", lambda df, n: seen.extend(r["doc_id"] for r in df.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sorted(seen) == [1, 2]
    q = loops.late_counts(docs).writeStream.format("memory").queryName("late").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM late").first()[0] == 3
