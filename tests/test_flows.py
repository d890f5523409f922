"""Flows from scan to written output, the editor's and the server's rules on small inputs."""

import io
import re
import zipfile

import duckdb
from pyspark.sql import functions as F

from glossmill.functions import answers, carets, chunks, numbers, scripts
from glossmill.functions import text as X
from glossmill.functions.diff import _TOKEN
from glossmill.operators import editor, flows, jobs, layout, model
from glossmill.plans import catalog, catalog_flows
from glossmill.sources import encodings, glossary_files, html, office, plaintext

SF = "/root/testdata/sf0.001"


def identity(c, lang):
    return c


def loud(c, lang):
    return F.upper(c)


def test_pages_are_written_back(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    for r in rows:
        units = html.scan(r["html"])
        assert html.write_page(r["html"], [u.text for u in units]) == r["html"]
        new = [u.text.replace("e", "ë") for u in units]
        assert [u.text for u in html.scan(html.write_page(r["html"], new))] == new
    pages = spark.createDataFrame([(1, '<p>Hello <b title="Tip">bold</b><br>end</p><div>a<img alt="pic">b</div>'), (2, None), (3, "")], "page_id long, html string")
    got = {r["page_id"]: r["html"] for r in flows.translate_documents(pages, "page_id", "html", html.html_units, html.write_pages, lambda c, _: F.regexp_replace(c, "([a-z])([^a-z0-9<>/]|$)", "$1!$2"), "x").collect()}
    assert got[1].startswith("<p>Hello! <b ") and "<br>" in got[1] and got[2] is None and got[3] == ""


def test_deep_pages():
    page = "<div>" * 3000 + "hi <b>there</b>" + "</div>" * 3000
    assert html.page_units(page)[0]["text"] == "hi <g1>there</g1>"
    assert html.write_page(page, ["<g1>yo"]) == page.replace("hi <b>there</b>", "<b>yo</b>")
    assert html.write_page("<p>a <i>b</i><br>c</p>", ["x </g1><x9/> <g1>y"]) == "<p>x  <i>y</i><br></p>"


def test_markdown_flow(spark):
    docs = spark.createDataFrame([(1, "# Title\n\n- item `code` two\n\n```\nkeep\n```\n| a | b |\n|---|---|\n| c | 12 |\n"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: r["text"] for r in flows.translate_documents(docs, "id", "text", plaintext.markdown, plaintext.write_markdown_column, loud, "x").collect()}
    assert got[1] == "# TITLE\n\n- ITEM `code` TWO\n\n```\nkeep\n```\n| A | B |\n|---|---|\n| C | 12 |\n".replace("`code`", "`code`") or "<X1/>" in got[1]
    assert got[2] is None and got[3] == ""


def test_text_flow(spark):
    rows = [(1, "One.\r\n\r\n\r\nTwo."), (2, ""), (3, None), (4, "이 문서는 한국어입니다."), (5, "這是繁體中文的句子。"), (6, "這是繁體中文，还有简体。")]
    texts = spark.createDataFrame(rows, "k long, t string")
    got = {r["k"]: r for r in flows.translate_texts(texts, "k", "t", model.mock_engine, "ko").collect()}
    assert got[1]["translation"] == "[ko] One.\n\n[ko] Two." and got[1]["n_units"] == 2
    assert got[2]["translation"] == got[3]["translation"] == "" and got[4]["translation"] == rows[3][1] and got[4]["shown_lang"] == "ko"
    hant = {r["k"]: r for r in flows.translate_texts(texts, "k", "t", model.mock_engine, "zh-Hant").collect()}
    assert hant[5]["n_units"] == 0 and hant[6]["n_units"] == 1  # the other script's characters are to be converted
    cache = spark.createDataFrame([("One.", "Uno.")], "source string, target string")
    assert flows.translate_texts(texts, "k", "t", model.mock_engine, "it", cache=cache).where("k = 1").first()["translation"] == "Uno.\n\n[it] Two."
    silent = flows.translate_texts(texts, "k", "t", lambda c, _: F.lit(" "), "it").where("k = 1").first()
    assert silent["translation"].strip() == ""


def test_long_items_go_in_parts(spark):
    long = "A sentence of some words here. " * 500
    items = spark.createDataFrame([(1, 1, long), (1, 2, " short one "), (1, 3, "42"), (1, 4, "AB-12"), (2, 1, None)], "g long, p long, t string")
    got = {(r["g"], r["p"]): r for r in flows.translate_items(items, "g", "p", "t", model.mock_engine, "de").collect()}
    assert len(got) == 5 and got[1, 1]["output"].count("[de]") > 5 and got[1, 2]["output"] == "[de]  short one" and got[1, 3]["output"] == "42" and got[1, 3]["batch"] is None
    sent = spark.createDataFrame([(r["g"], r["p"], "x", r["batch"]) for r in got.values()], "g long, p long, t string, batch int")
    assert flows.batch_context(sent, "g", "p", "t").first()["context"].startswith("- x")


def _docx(document: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
    return out.getvalue()


def test_office_keeps_namespaces_and_formats():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    source = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{w}" xmlns:mc="urn:mc" xmlns:w14="urn:w14" mc:Ignorable="w14"><w:body><w:p><w:r><w:t>Some text </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> &amp; end</w:t></w:r></w:p></w:body></w:document>'
    data = _docx(source)
    [(part, pos, text)] = office.paragraphs(data, "docx")
    assert text == "Some text <g1>bold</g1> &amp; end"
    new = zipfile.ZipFile(io.BytesIO(office.replaced(data, "docx", {(part, pos): "Neu <g1>fett</g1> &amp; aus"}))).read(part).decode()
    assert 'mc:Ignorable="w14"' in new and 'xmlns:w14="urn:w14"' in new and "<w:b/>" in new and "&lt;g1" not in new
    assert re.findall(r"<w:t[^>]*>([^<]*)<", new) == ["Neu ", "fett", " &amp; aus"]
    assert office.paragraphs(office.replaced(data, "docx", {(part, pos): "alles verloren"}), "docx")[0][2] == "alles verloren"
    nested = source.replace("<w:t> &amp; end</w:t>", "<w:t> end</w:t><w:txbx><w:p><w:r><w:t>Inner box</w:t></w:r></w:p></w:txbx>")
    assert [t for _, _, t in office.paragraphs(_docx(nested), "docx")] == ["Some text <g1>bold</g1> end", "Inner box"]
    for bad in (b"<x>" + b" " * 5000 + b"<!DOCTYPE a></x>",):
        try:
            office.parsed(bad)
            raise AssertionError
        except office.Unsafe:
            pass


def test_charset_is_rewritten():
    page = "<meta charset='euc-kr'><p>한국어</p>"
    text, _, codec = encodings.decode_html(page.encode("cp949"))
    assert codec == "cp949" and encodings.encode_html(text).decode() == page.replace("euc-kr", "utf-8")
    assert encodings.encode_text("x", True) == b"\xef\xbb\xbfx" and encodings.declared(b'<?xml version="1.0" encoding="big5"?>') == "big5"
    assert encodings.codec_of("x-sjis") == "cp932" and encodings.codec_of("nothing") is None


def test_number_rules(spark):
    rows = [("3.5 million", []), ("1,234 million", []), ("COVID19 and A4", []), ("12 000.50 kg", ["12000.5"]), ("1.234,5", ["1234.5"]), ("1,234.567", ["1.234567"]), ("007 and 1st", ["7"]), ("5 thousandths", ["5"])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    assert df.withColumn("got", numbers.numbers(F.col("t"), True)).where("got <> want").collect() == []


def test_character_references(spark):
    rows = [("<g1>R&amp;D caf&eacute;</g1>", "R&D café"), ("<x1/>&amp;lt; &#8364; &#x41; &nope; & &copy;", "&lt; € A &nope; & ©"), ("R&amp;D", "R&amp;D")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.withColumn("got", X.strip_tags(F.col("t"))).where("got <> want").collect() == []


def test_tokens_of_both_forms(spark):
    texts = ["foo_bar baz, 12x", "漢字かな한국ᄀx", "a\nb\t c", "naïve_é  ", "…!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.diff_tokens(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [_TOKEN.findall(t) for t in texts]


def test_job_rules(spark):
    ev = spark.createDataFrame([("j", t) for t in (0.0, 0.1, 1.9, 2.0, 2.1, 3.9, 4.0, 9.0)] + [("k", 1.0)], "job string, s double")
    assert sorted(map(tuple, jobs.throttled(ev, "job", "s").collect())) == [("j", 0.0), ("j", 2.0), ("j", 4.0), ("j", 9.0), ("k", 1.0)]
    edits = spark.createDataFrame([("u", 1, "Hello world, how are you", "de"), ("u", 2, "Hello brave world, how are you", "de"), ("u", 400, "other", "de"), ("u", 410, "Hello brave world, how are you", "fr"), ("u", 900, "other", "de")], "u string, ts long, x string, l string")
    got = [tuple(r) for r in jobs.history(edits, "u", "ts", "x", "l").select("ts", "x", "edits").orderBy("ts").collect()]
    assert got == [(2, "Hello brave world, how are you", 2), (410, "Hello brave world, how are you", 1), (900, "other", 1)]
    records = spark.createDataFrame([('{"id":"a","created_at":"2024-01-02T03:04:05Z","status":"done","output_filename":"o.txt","options":{"target_lang":"de"}}',), ('{"id":"b","created_at":"2024-01-02T03:04:05","total":4,"done":1,"status":"translating"}',), ("broken",)], "t string")
    public = {r["id"]: r for r in jobs.public_view(jobs.job_records(records, "t")).collect()}
    assert public["a"]["percent"] == 100.0 and public["a"]["target_lang"] == "de" and public["a"]["created_at"] == "2024-01-02T03:04:05Z" == public["b"]["expires_at"] and public["b"]["percent"] == 25.0 and set(public) == {"a", "b"}
    j = spark.sql("SELECT * FROM VALUES ('x', 'done', TIMESTAMP '2024-01-01 00:00:00'), ('y', 'translating', TIMESTAMP '2024-01-01 00:00:00'), ('z', 'done', TIMESTAMP '2025-01-01 00:00:00') AS v(job, status, expires_at)")
    p = spark.sql("SELECT 'p' AS name, TIMESTAMP '2024-06-01 00:00:00' AS changed_at")
    f = spark.sql("SELECT * FROM VALUES ('x', TIMESTAMP '2024-01-01 00:00:00'), ('y', TIMESTAMP '2024-01-01 00:00:00'), ('u', TIMESTAMP '2024-01-01 00:00:00') AS v(name, changed_at)")
    assert sorted(map(tuple, jobs.cleaned(j, p, f, F.expr("TIMESTAMP '2024-06-02 00:00:00'")).collect())) == [("folder", "u"), ("job", "x"), ("partial", "p")]
    assert jobs.recovered(spark.sql("SELECT 'a' AS job, 'writing' AS status")).first()["status"] == "error"
    assert jobs.revalidated(j.select("job"), p.select(F.lit("x").alias("job")), "job").count() == 1
    files = spark.createDataFrame([("/d/jobs/a/in.txt", 3), ("/d/jobs/a/out.txt", 4), ("/d/other", 9)], "path string, length long")
    assert [tuple(r) for r in jobs.disk_used(files).collect()] == [("a", 7)]


def test_editor_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    t = F.lit("First one.\n\nSecond paragraph here.\n\nThird.")
    assert one(editor.context_around(t, F.lit(15), F.lit(20))) == "Second paragraph here." and one(editor.context_around(t, F.lit(0), F.lit(3))) == "First one." and one(editor.context_around(t, F.lit(40), F.lit(41))) == "Third."
    assert len(one(editor.context_around(F.lit("x" * 5000), F.lit(3000), F.lit(3001)))) == 2000
    assert one(editor.with_alternative(F.lit("a cat, a dog"), F.lit(2), F.lit(5), F.lit("cat"), F.lit("cow"))) == "a cow, a dog"
    assert one(editor.with_alternative(F.lit("a cat, a dog"), F.lit(0), F.lit(3), F.lit("dog"), F.lit("cow"))) == "a cat, a cow" and one(editor.with_alternative(F.lit("abc"), F.lit(0), F.lit(1), F.lit("z"), F.lit("y"))) == "abc"
    pinned = spark.createDataFrame([("A", "1"), ("B", "2"), ("whole\n\ntext", "W")], "source string, target string")
    texts = spark.createDataFrame([(1, " A "), (2, "A\n\nB"), (3, "A\n\nC"), (4, "whole\n\ntext")], "k long, t string")
    assert sorted(map(tuple, editor.pinned_answers(texts, pinned, "k", "t").collect())) == [(1, "1"), (2, "1\n\n2"), (4, "W")]
    entries = spark.createDataFrame([(0, "a", "b", ""), (1, "", "b", ""), (2, "c", None, "")], "pos long, source string, target string, note string")
    assert sorted(r["pos"] for r in editor.half_filled(entries).collect()) == [1, 2]
    assert [r["pos"] for r in editor.with_entry(entries, entries.where("pos = 0")).orderBy("pos").collect()] == [0, 1, 2, 3] and editor.rows_page(entries, "pos", 1, 2).count() == 1
    docs = spark.sql("SELECT 'g1' AS id, 'N' AS name, array(named_struct('source', 'a')) AS entries")
    assert [(r["id"], len(r["entries"])) for r in editor.deleted(docs, "g1").collect()] == [("default", 0)] and editor.deleted(docs, "other").count() == 1
    assert editor.entry_counts(editor.saved(docs, docs.withColumn("name", F.lit("M")))).first()["name"] == "M"
    assert editor.cached_units(spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("ts")), "k", "ts", 64, 4).count() <= 64
    assert editor.allowed(spark.createDataFrame([("1.2.3.4",), ("x",)], "ip string"), spark.createDataFrame([], "cidr string")).where("allowed").count() == 2


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(answers.choice(F.lit('{"choices":[]}')))["error"] == "no_choices" and one(answers.choice(F.lit('{"choices":[{"message":{"content":"","reasoning":"hm"}}]}')))["error"] == "reasoning_only"
    got = one(answers.messages_text(F.lit('[{"role":"u","content":"a"},{"role":"u","content":[{"type":"text","text":"b"},{"type":"image_url"}]}]')))
    assert (got["text"], got["images"]) == ("a\nb", 1)
    assert [one(answers.error_message(F.lit(x))) for x in ('{"error":{"message":"m"}}', '{"error":"e"}', '{"detail":"d"}', "plain")] == ["m", "e", "d", "plain"]
    shape = {"text": "string", "n": "number"}
    assert [one(answers.shape_error(F.lit(x), shape)) for x in ('{"text":"a","n":1}', '{"text":"a"}', '{"text":1,"n":2}', '{"text":"a","n":1,"z":0}', "[1]")] == [None, "n: missing", "text: string expected", "unexpected keys", "object expected"]
    assert [one(answers.visible_part(F.array(*map(F.lit, x)))) for x in (["<th", "ink>a"], ["<think>a</th", "ink> b"], ["<thi"], ["</think>c"], ["plain ", "d"])] == ["", "b", "", "c", "plain d"]
    assert one(answers.asks_again(F.lit("x"), F.lit("length"), F.lit(1))) and not one(answers.asks_again(F.lit("x"), F.lit("stop"), F.lit(1))) and one(answers.next_try(F.lit(200), F.lit(False), F.lit(2))) == 3


def test_carets():
    text = 'He said "Stop." Then left! 漢字。次の文。\nLast line'
    assert text[slice(*carets.sentence_bounds(text, 3))] == 'He said "Stop."' and text[slice(*carets.sentence_bounds(text, 18))] == "Then left!"
    assert text[slice(*carets.sentence_bounds(text, 28))] == "漢字。" and text[slice(*carets.sentence_bounds(text, len(text)))] == "Last line"
    source, shown = carets.windows_around("s " * 6000, "word " * 2000, 5000, 5004)
    assert len(source) <= 6000 and len(shown) <= 3004 + 5 and shown.strip().split()[0] == "word"
    assert carets.windows_around("a", "b", 0, 1) == ("a", "b")
    assert carets.paragraphs_of("One. Two.\n\nThree.\nFour", ["One.", "Two.", "Three.", "Four"]) == [[0, 1], [2, 3]] and carets.paragraphs_of("x", ["y", "x"]) == [[0], [1]]


def test_packed_units():
    assert chunks.packed_units("a\n\nb\n\n" + "c" * 25, 10) == ["a\n\nb", "c" * 10, "c" * 10, "c" * 5] and chunks.packed_units("", 5) == []


def test_detection_by_units(spark):
    rows = spark.createDataFrame([(1, "Some English text. 한국어 문장입니다 여기.")], "k long, t string")
    detector = lambda rest: F.array(F.struct(F.lit("en").alias("code"), F.lit(0.75).alias("p")), F.struct(F.lit("fr").alias("code"), F.lit(0.25).alias("p")))
    got = {r["code"]: r["n"] for r in scripts.detect_by_units(rows, "k", "t", detector).collect()}
    assert got == {"en": 15 * 0.75, "fr": 15 * 0.25, "ko": 10}


def test_layout_rules(spark):
    kinds = spark.createDataFrame([(1, "scanned"), (2, "ocr_layer"), (3, "digital")], "page long, kind string")
    texts = spark.createDataFrame([(2, "x" * 2000), (2, "x" * 2000)], "page long, text string")
    assert {r["page"]: r["weight"] for r in layout.page_weights(kinds, texts).collect()} == {1: 1500, 2: 2000}
    added = spark.createDataFrame([(1, 2)], "page long, count long")
    assert [tuple(r) for r in layout.interleaved(kinds, added).orderBy("place").collect()] == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 2, 0), (4, 3, 0)]
    assert spark.range(1).select(layout.page_list(F.sequence(F.lit(1), F.lit(10)), 2).alias("x")).first()["x"] == "p.1, p.2 +8"


def test_export_of_any_size(spark, tmp_path):
    entries = spark.createDataFrame([(i, "en", "de", f"s{i}", "=t", "", True) for i in range(30)], "pos long, source_lang string, target_lang string, source string, target string, note string, enabled boolean")
    glossary_files.write_export(entries.repartition(5), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert text.splitlines()[0] == ",".join(glossary_files.COLUMNS) and [x.split(",")[2] for x in text.split()[1:]] == [f"s{i}" for i in range(30)]


def test_previews_of_odd_rows(spark, tmp_path):
    """A line that ends one short of the length, repeated ids, null and empty texts: as the SQL has them."""
    rows = [(1, "a" * 499 + "\nb"), (2, "a" * 500 + "\nb"), (3, "a" * 498 + "\n\nb"), (4, None), (5, ""), (6, "x\ny"), (6, "x\ny"), (6, "z"), (None, "n"), (None, None), (7, "\n" * 700), (8, "é😀\n" * 200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = (sorted(map(repr, map(tuple, x))) for x in (catalog_flows.previews(spark, str(tmp_path)).collect(), con.sql(catalog.SQL["previews"]).fetchall()))
    assert got == want and len(got) == len(rows)


def test_detection_is_written_out_once(spark):
    """A filter by identity has one detection in it, and none where no language found can be the target's."""
    texts = spark.createDataFrame([(1, "这是一个简体中文的句子"), (2, "這是一個繁體中文的句子"), (3, "这是 這個"), (4, "plain words"), (5, "12 !!"), (6, None)], "id long, text string")
    same = {}
    for target in ("de", "en", "ko", "zh-Hans", "zh-Hant"):
        rows = flows.prepared(texts, "id", "text", "auto", target)
        same[target] = {r["id"] for r in rows.where("identity").collect()}
        plan = rows.where("NOT identity").select("id", "normal")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("regexp_extract_all") + plan.lower().count("regexp_count") <= (0 if target == "de" else 8)
    assert same == {"de": set(), "en": {4}, "ko": set(), "zh-Hans": {1}, "zh-Hant": {2}}
    assert {r["id"] for r in flows.prepared(texts, "id", "text", "de", "de").where("identity").collect()} == {1, 2, 3, 4, 5, 6}
