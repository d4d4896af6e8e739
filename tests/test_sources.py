import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import geometry
from glyphmill.sources import docx, jsonl, texts
from glyphmill.streaming import outbox


def kinds(text):
    blocks = texts.markdown_blocks(text)
    assert "".join(b["raw_text"] for b in blocks) == text
    return [(b["type"], b["block_kind"]) for b in blocks]


def test_markdown_blocks():
    assert kinds("# A #\n\ntext\nmore\n===\n---\n> q\n> r\n- a\n  b\n- c\n```py\n# no\n```\n~~~\nopen") == [
        ("HEADING", "atx_heading"), ("SEPARATOR", "blank_lines"), ("HEADING", "setext_heading"), ("SEPARATOR", "thematic_break"), ("PARAGRAPH", "block_quote"), ("LIST_ITEM", "list_item"), ("LIST_ITEM", "list_item"), ("CODE", "fenced_code"), ("CODE", "fenced_code"),
    ]
    blocks = texts.markdown_blocks("## T ##\r\nfoo\nbar\n--\n1. x\n2) y\n\n3. z")
    assert [b.get("source_label") for b in blocks][:2] == ["T", "foo bar"] and [b.get("heading_level") for b in blocks][:2] == [2, 2]
    groups = [b["integrity_group_id"] for b in blocks if b["type"] == "LIST_ITEM"]
    assert groups[0] == groups[1] != groups[2]
    assert texts.markdown_blocks("~~~\nx")[0]["diagnostic"] == "MARKDOWN_UNCLOSED_FENCE"
    assert kinds("") == [] and kinds("####### no\n") == [("PARAGRAPH", "paragraph")]


def test_markdown_table(spark):
    df = spark.createDataFrame([("d", "# A\n\nb"), ("n", None)], "document_id string, text string")
    got = texts.markdown(df).orderBy("ord").collect()
    assert [(r.type, r.heading_level, r.line_start) for r in got] == [("HEADING", 1, 1), ("SEPARATOR", None, 2), ("PARAGRAPH", None, 3)]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def p(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


STYLES = f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H1b"><w:name w:val="Mine"/><w:basedOn w:val="O"/></w:style><w:style w:styleId="O"><w:name w:val="o"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="T"><w:name w:val="toc 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
NUMBERS = f'<w:numbering {W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="5"/></w:num></w:numbering>'
NUM = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{}"/></w:numPr>'


def test_docx_elements(spark):
    style = '<w:pStyle w:val="{}"/>'
    body = (
        p("Top", style.format("H1")) + p("Deep", style.format("H1b"), "<w:b/>") + p("Contents", style.format("T")) + p("one", NUM.format(7)) + p("two", NUM.format(7)) + p("plain", NUM.format(0)) + p("three", NUM.format(7))
        + f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>{p('cell')}<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
        + "<w:p><w:r><w:t>ref</w:t><w:footnoteReference w:id='3'/></w:r><w:ins><w:r><w:t> new</w:t></w:r></w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del></w:p><w:strange/>"
    )
    notes = f"<w:footnotes {W}><w:footnote w:id='0' w:type='separator'>{p('-')}</w:footnote><w:footnote w:id='3'>{p('the note')}</w:footnote></w:footnotes>"
    files = spark.createDataFrame([("a", package(body, styles=STYLES, numbering=NUMBERS, footnotes=notes)), ("b", b"no zip")], "document_id string, content binary")
    got = docx.docx(files).orderBy("document_id", "ord").collect()
    a = [r for r in got if r.document_id == "a"]
    assert [(r.type, r.heading_level) for r in a[:3]] == [("HEADING", 1), ("HEADING", 2), ("PARAGRAPH", None)] and a[1].bold and a[2].navigation_role == "toc"
    items = [r for r in a if r.type == "LIST_ITEM"]
    assert [r.raw_text for r in items] == ["one", "two", "three"] and items[0].number_format == "decimal"
    assert items[0].integrity_group_id == items[1].integrity_group_id != items[2].integrity_group_id
    tables = [r for r in a if r.type == "TABLE"]
    assert tables[1].integrity_parent_group_id == tables[0].integrity_group_id and [r.grid_span for r in a if r.type == "TABLE_CELL"] == [2, None]
    ref = next(r for r in a if (r.raw_text or "").startswith("ref"))
    assert ref.raw_text == "ref new" and ref.source_references[0].id == "3" and ref.revision == "del,ins"
    assert a[-1].source_anchor.id == "3" and a[-1].raw_text == "the note" and a[-2].diagnostic == "UNHANDLED_BLOCK_STRANGE"
    assert [r.diagnostic for r in got if r.document_id == "b"] == ["NOT_A_PACKAGE"]
    original = docx.docx(files.where("document_id = 'a'"), "ORIGINAL").where("raw_text like 'ref%'").first()
    assert original.raw_text == "ref old"


def test_docx_guards():
    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    for names, code in ((["a"], "MAIN_PART_MISSING"), (["word/document.xml", "WORD/document.xml"], "DUPLICATE_PART"), (["../x", "word/document.xml"], "UNSAFE_PART_NAME")):
        with pytest.raises(docx.PackageError, match=code):
            docx.open_package(zipped(*names))
    cycle = f'<w:styles {W}><w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
    with pytest.raises(docx.PackageError, match="STYLE_CYCLE"):
        docx.Reader(package("", styles=cycle))


def test_docx_errors_are_codes(spark):
    broken = bytearray(package(p("some text that is long enough to be changed")))
    at = bytes(broken).index(b"long enough")
    broken[at] ^= 1
    header = '<Relationships><Relationship Id="r1" Type="x/header" Target="header1.xml"/></Relationships>'
    cases = {
        "crc": bytes(broken), "body": zipped_xml("<w:document " + W + "/>"), "xml": zipped_xml("<w:document"), "header": with_rels(p("text"), header), "none": b"",
    }
    got = docx.docx(spark.createDataFrame(list(cases.items()), "document_id string, content binary")).collect()
    codes = {d: [r.diagnostic for r in got if r.document_id == d and r.diagnostic] for d in cases}
    assert codes == {"crc": ["CORRUPT_PART"], "body": ["BODY_MISSING"], "xml": ["MALFORMED_XML"], "header": ["PART_MISSING"], "none": ["NOT_A_PACKAGE"]}
    assert [r.raw_text for r in got if r.document_id == "header"] == [None, "text"]


def zipped_xml(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def with_rels(body, rels):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
    return out.getvalue()


def test_a_nested_table_keeps_its_text(spark):
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    body = f"<w:tbl><w:tr><w:tc>{p('own')}{inner}{p('after')}</w:tc></w:tr></w:tbl>"
    rows = docx.Reader(package(body)).read()
    assert [r["raw_text"] for r in rows if r["type"] == "TABLE_CELL"] == ["own\nafter", "in"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_id": "1"}\n\n{"record_id": "1"}\n[1]\n{"x": NaN}\n{"x": 1}\n')
    got = sorted(r.code for r in jsonl.line_issues(jsonl.read_lines(spark, str(tmp_path / "a.jsonl"))).collect())
    assert got == ["BLANK_LINE", "DUPLICATE_KEY", "KEY_MISSING", "NOT_A_JSON_OBJECT", "NOT_A_JSON_OBJECT"]


def test_freeze_and_verify(spark, tmp_path):
    cases = spark.createDataFrame([("train", "1", '{"b": 1, "a": 2}'), ("test", "2", '{"c": [1]}')], "split string, case_id string, payload string")
    folder = f"file://{tmp_path}/frozen"
    manifest = jsonl.freeze(cases, folder, {"by": "test"})
    assert manifest["splits"]["train"]["cases"] == 1 and jsonl.verify(spark, folder) == []
    with pytest.raises(FileExistsError):
        jsonl.freeze(cases, folder, {})
    part = next((tmp_path / "frozen" / "data" / "split=test").glob("part-*"))
    part.write_text(json.dumps({"case_id": "2", "payload": '{"c":[2]}'}) + "\n")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert jsonl.verify(spark, folder) == ["HASH_MISMATCH:test"]


def test_save_many(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    old = spark.createDataFrame([("a", 1), ("b", 1)], "record_id string, v int")
    jsonl.save_many(old.where("false"), old, path)
    jsonl.save_many(jsonl.read_records(spark, path, old.schema), spark.createDataFrame([("b", 2), ("c", 2)], old.schema), path)
    assert [tuple(r) for r in jsonl.read_records(spark, path, old.schema).orderBy("record_id").collect()] == [("a", 1), ("b", 2), ("c", 2)]


def test_stream_promotes_only_greater_versions(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("d", 2), ("d", 1), ("e", 1)], "document_id string, version_no long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("document_id string, version_no long").parquet(str(src))
    q = outbox.monotone_versions(stream).writeStream.format("memory").queryName("promoted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.document_id, r.current_version) for r in spark.sql("select * from promoted").collect()} == {("d", 1), ("d", 2), ("e", 1)}


def test_relay_publishes_each_event_once(spark, tmp_path):
    spark.createDataFrame([("j1", "2024-01-01 00:00:00"), ("j1", "2024-01-01 00:00:01"), ("j2", "2024-01-01 00:00:02")], "job_id string, t string").select("job_id", F.to_timestamp("t").alias("created_at")).write.parquet(str(tmp_path / "in"))
    stream = outbox.deduplicated(spark.readStream.schema("job_id string, created_at timestamp").parquet(str(tmp_path / "in")))
    sent = []
    q = outbox.relay(stream, lambda df, n: sent.extend(r.job_id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(sent) == ["j1", "j2"]


def boxes(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"document_id string, page int, {extra}, x0 double, y0 double, x1 double, y1 double")


def test_reading_order_of_columns(spark):
    rows = [("d", 1, "title", 0.1, 0.0, 0.9, 0.05), ("d", 1, "r1", 0.55, 0.1, 0.9, 0.2), ("d", 1, "l1", 0.1, 0.1, 0.45, 0.2), ("d", 1, "l2", 0.1, 0.3, 0.45, 0.4), ("d", 1, "r2", 0.55, 0.3, 0.9, 0.4), ("d", 1, "foot", 0.1, 0.9, 0.9, 0.95)]
    got = geometry.reading_order(boxes(spark, rows, "block_id string")).orderBy("reading_order").collect()
    assert [r.block_id for r in got] == ["title", "l1", "l2", "r1", "r2", "foot"]


def test_spans_find_their_cells(spark):
    cells = boxes(spark, [("d", 1, "a", 0.0, 0.0, 10.0, 10.0), ("d", 1, "b", 10.0, 0.0, 20.0, 10.0)], "cell_id string")
    spans = boxes(spark, [("d", 1, "s", 1.0, 1.0, 9.0, 5.0), ("d", 1, "t", 8.0, 1.0, 14.0, 5.0), ("d", 1, "u", 30.0, 1.0, 34.0, 5.0)], "span_id string")
    assert {r.span_id: (r.cell_id, r.code) for r in geometry.span_owners(spans, cells).collect()} == {"s": ("a", None), "t": ("b", None), "u": (None, "NO_CELL")}


def test_covered_blocks_are_hidden(spark):
    blocks = boxes(spark, [("d", 1, "b", 1, 0.0, 0.0, 1.0, 1.0), ("d", 1, "c", 9, 0.0, 0.0, 1.0, 1.0)], "block_id string, paint_seq int")
    fills = boxes(spark, [("d", 1, "f", 5, 0.0, 0.0, 1.0, 1.0)], "fill_id string, paint_seq int")
    assert [r.block_id for r in geometry.visible_blocks(blocks, fills).collect()] == ["c"]


def test_intervals_and_clusters(spark):
    iv = spark.createDataFrame([("k", 0.0, 5.0), ("k", 3.0, 4.0), ("k", 4.5, 7.0), ("k", 9.0, 10.0)], "key string, start double, stop double")
    assert geometry.covered_length(iv, ["key"]).first().covered == 8.0
    v = spark.createDataFrame([("k", x) for x in (1.0, 1.5, 4.0, 4.2)], "key string, value double")
    assert [(r.mean, r.n) for r in geometry.cluster_values(v, ["key"], 1.0).orderBy("cluster").collect()] == [(1.25, 2), (4.1, 2)]
    groups = geometry.box_clusters(boxes(spark, [("d", 1, "a", 0.0, 0.0, 1.0, 1.0), ("d", 1, "b", 2.0, 0.0, 3.0, 1.0), ("d", 1, "c", 50.0, 0.0, 51.0, 1.0)], "box_id string"))
    assert {r.box_id: r.cluster for r in groups.collect()} == {"a": "a", "b": "a", "c": "c"} or len({r.cluster for r in groups.collect()}) == 2
