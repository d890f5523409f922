import io
import zipfile

import pytest

from glossmill.sources import encodings, glossary_files, html, office, plaintext
from glossmill.streaming import events


def test_html():
    page = '<html lang="en"><head><title>T one</title><meta name="description" content="About"></head><body><p>Hello <b>bold</b><br>x<script>no()</script></p><div>out<p>in</p>tail</div><img alt="Pic"><pre>code</pre><p translate="no">keep</p></body>'
    got = [(u["kind"], u["text"]) for u in html.page_units(page)]
    assert ("block", "Hello <g1>bold</g1><x1/>x") not in got  # a script isn't inline, so the paragraph is taken in parts
    assert ("text", "out") in got and ("block", "in") in got and ("text", "tail") in got
    assert ("alt", "Pic") in got and ("title", "T one") in got and ("meta", "About") in got
    assert not any("keep" in t or "code" in t for _, t in got)
    assert html.page_units("<p>Hello <b>bold</b><br>x</p>")[0]["text"] == "Hello <g1>bold</g1><x1/>x"
    assert html.page_units("") == [] and html.page_units("<p>unclosed <i>a")[0]["text"] == "unclosed <g1>a</g1>"


def test_markdown():
    source = "---\ntitle: x\n---\n# Head ##\n\n- item `code` one\n\n```\nfenced\n```\n| a | b |\n|---|---|\n| c1 | 12 |\n"
    units = plaintext.markdown_units(source)
    assert [(u["pos"], u["cell"], u["text"]) for u in units] == [(3, None, "Head"), (5, None, "item <x1/> one"), (10, 1, "a"), (10, 2, "b"), (12, 1, "c1")]
    assert plaintext.write_markdown(source, {}) == source
    out = plaintext.write_markdown(source, {(5, None): "ONE <x1/>", (12, 1): "C"})
    assert "- ONE `code`\n" in out and "| C | 12 |" in out
    assert plaintext.restore("lost", ["`a`"]) == "lost `a`"
    kinds = [b["kind"] for b in plaintext.markdown_blocks(source)]
    assert "table" in kinds and "code" in kinds and "heading" in kinds
    assert plaintext.inline_runs("a **b** `c`") == [("a ", ""), ("b", "b"), (" ", ""), ("c", "code")]


def test_subtitles():
    source = "WEBVTT\n\n1\n00:01 --> 00:02\n<i>Hi</i> there\nyou\n\nNOTE x\n\n2\n00:03 --> 00:04\n...\n"
    units = plaintext.subtitle_units(source)
    assert [(u["pos"], u["text"]) for u in units] == [(1, "<x1/>Hi<x2/> there\nyou")]
    assert plaintext.write_subtitles(source, {1: "<x1/>Da<x2/>"}) == source.replace("<i>Hi</i> there\nyou", "<i>Da</i>")


@pytest.mark.parametrize("text,codec", [("안녕하세요 여러분 반갑습니다", "cp949"), ("これはテストのぶんしょうです", "cp932"), ("これはテストのぶんしょうです", "euc_jp"), ("déjà vu à la façade", "cp1252"), ("这是一个简体中文的句子用来测试我们的程序", "gb18030"), ("這是一個繁體中文的句子用來測試我們的程式", "cp950")])
def test_encodings(text, codec):
    got, bom, name = encodings.decode(text.encode(codec))
    assert (got, bom, name) == (text, True, codec)


def test_declared_charset():
    page = '<meta charset="euc-kr"><p>한국어</p>'
    assert encodings.decode_html(page.encode("cp949"))[0] == page
    assert encodings.decode("﻿x".encode("utf-8"))[:2] == ("x", True)


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def test_docx_round_trip():
    data = office.docx([{"kind": "heading", "level": 1, "text": "Title", "rows": []}, {"kind": "para", "level": 0, "text": "A & B", "rows": []}, {"kind": "table", "level": 0, "text": "", "rows": [["x", "12"]]}])
    assert [t for _, _, t in office.paragraphs(data, "docx")] == ["Title", "A & B", "x"]
    part, pos, _ = office.paragraphs(data, "docx")[1]
    again = office.replaced(data, "docx", {(part, pos): "Neu <1>"})
    assert [t for _, _, t in office.paragraphs(again, "docx")] == ["Title", "Neu <1>", "x"]
    assert office.xml_unescaped(office.xml_escaped("a\x01_x0041_b")) == "a\x01_x0041_b"


def test_zip_traps(spark):
    with pytest.raises(office.Unsafe):
        office.checked(_zip(**{"..__evil": "x"}))
    with pytest.raises(office.Unsafe):
        office.parsed(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    rows = spark.createDataFrame([("a.docx", bytearray(office.docx([{"kind": "para", "level": 0, "text": "Hi", "rows": []}]))), ("b.docx", bytearray(b"broken"))], "name string, content binary")
    got = {(r["file"], r["text"], r["error"]) for r in office.office_units(rows).collect()}
    assert got == {("a.docx", "Hi", None), ("b.docx", None, "no zip archive")}


def test_formula_literals():
    data = _zip(xl__worksheets__sheet1="x") if False else _zip(**{"xl__worksheets__sheet1.xml": '<c><f>IF(A1=&quot;Yes&quot;,"No","a""b")</f></c>'})
    assert office.formula_literals(data) == {"Yes", "No", 'a"b'}


def test_glossary_files(spark):
    good = "원문;번역;사용\r\nfuel cell;연료전지;예\r\n'=x;y;n\r\n".encode("cp949")
    bad = b"source,target,enabled\nx,,yes\ny,z,perhaps\n"
    rows = spark.createDataFrame([("g.txt", bytearray(good)), ("b.csv", bytearray(bad)), ("l.tsv", bytearray("en\tde\thouse\tHaus\n".encode()))], "name string, content binary")
    entries, errors = glossary_files.read_files(rows, "en", "ko")
    got = {(r["file"], r["source_lang"], r["source"], r["target"], r["enabled"]) for r in entries.collect()}
    assert got == {("g.txt", "en", "fuel cell", "연료전지", True), ("g.txt", "en", "=x", "y", False), ("l.tsv", "en", "house", "Haus", True)}
    assert {(r["file"], r["row"], r["error"]) for r in errors.collect()} == {("b.csv", 2, "blank term"), ("b.csv", 3, "enabled")}
    text = glossary_files.export(entries.withColumn("pos", entries["row"])).first()["content"].decode("utf-8-sig")
    assert text.splitlines()[0] == ",".join(glossary_files.COLUMNS) and "'=x" in text


def test_json_glossaries(spark):
    rows = spark.createDataFrame([("d/default.json", '{"id":"default","name":"Z","entries":[{"source":"a","target":"b"}]}'), ("d/old.json", '[{"source":"c","target":"d"}]'), ("d/bad.json", "{nope")], "f string, t string")
    docs, broken = glossary_files.json_documents(rows, "f", "t")
    assert [(r["id"], r["entries"][0]["source"]) for r in docs.collect()] == [("default", "a"), ("old", "c")]
    assert [r["file"] for r in broken.collect()] == ["d/bad.json"]


def test_server_events(spark):
    lines = [('data: {"choices":[{"delta":{"content":"Ha"}}]}',), ("data: [DONE]",), (": ping",), ('data: {"choices":[{"delta":{},"finish_reason":"stop"}]}',)]
    got = [(r["delta"], r["finish"]) for r in events.sse_deltas(spark.createDataFrame(lines, "line string"), "line").collect()]
    assert got == [("Ha", None), (None, "stop")]
    rows = [(1, 1, "delta", 0, "a"), (1, 2, "delta", 0, "b"), (1, 3, "delta", 1, "c"), (1, 4, "unit", 1, "C!"), (1, 5, "done", None, None), (2, 1, "error", None, None)]
    ev = spark.createDataFrame(rows, "req int, seq int, type string, index int, text string")
    assert {(r["req"], r["index"], r["text"]) for r in events.final_units(ev).collect()} == {(1, 0, "ab"), (1, 1, "C!")}
    assert {tuple(r) for r in events.request_state(ev).collect()} == {(1, "done"), (2, "error")}


def test_ndjson_sink(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string").write.json(str(source))
    stream = spark.readStream.schema("id int, t string").json(str(source))
    q = events.write_ndjson(stream, str(out), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(out)).count() == 2
