"""Queries of sources: Markdown texts, Word files, payloads and JSON lines made of the documents' and events' rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elements, references
from ..sources import docx, jsonl, texts
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


#: Lines of documents as plain words, numbered from 0, with a kind of 0 to 7.
WORDS = """words as (select doc_id::varchar as document_id, (i - 1)::int as i, ((doc_id + i - 1) % 8)::int as k, 'x' || regexp_replace(line, '[^A-Za-z]+', '', 'g') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), "i", ((F.col("doc_id") + F.col("i")) % 8).cast("int").alias("k"), F.concat(F.lit("x"), F.regexp_replace("line", "[^A-Za-z]+", "")).alias("w"))


# Markdown

#: A block for each line, by kind: heading, item, quote, code, numbered item, rule, underlined heading, paragraph.
MARKS = ["## {} ##", "- {}\nmore", "> {}\n> so", "~~~ py\n{}\n~~~", "3) {}", "* * *", "{}\n===", "{}\nnext"]


@query("markdown_elements", f"""with {WORDS}, b as (select document_id, i, k, case when k = 5 then '* * *' else replace((['## @ ##', '- @' || chr(10) || 'more', '> @' || chr(10) || '> so', '~~~ py' || chr(10) || '@' || chr(10) || '~~~', '3) @', '', '@' || chr(10) || '===', '@' || chr(10) || 'next'])[k + 1], '@', w) end || chr(10) as t,
  w, max(i) over (partition by document_id) as last from words),
e as (select document_id, 2 * i as ord, (['HEADING','LIST_ITEM','PARAGRAPH','CODE','LIST_ITEM','SEPARATOR','HEADING','PARAGRAPH'])[k + 1] as type, (['atx_heading','list_item','block_quote','fenced_code','list_item','thematic_break','setext_heading','paragraph'])[k + 1] as block_kind,
  case k when 0 then 2 when 6 then 1 end as heading_level, case when k in (0, 6) then w end as source_label, (length(t) - length(replace(t, chr(10), '')))::int as lines, t as raw_text from b
  union all select document_id, 2 * i + 1, 'SEPARATOR', 'blank_lines', null, null, 1, chr(10) from b where i < last)
select document_id, ord::int as ord, type, block_kind, heading_level, source_label, lines, sha256(raw_text) as hash, coalesce(sum(length(raw_text)) over (partition by document_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from e""")
def markdown_elements(spark, d):
    kinds = F.array(*[F.lit(m) for m in MARKS])
    block = F.concat(F.replace(F.element_at(kinds, F.col("k") + 1), F.lit("{}"), F.col("w")), F.lit("\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "\n")
    made = texts.markdown(_words(spark, d).groupBy("document_id").agg(text.alias("text")))
    return made.select("document_id", "ord", "type", "block_kind", "heading_level", "source_label", (F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.sha2(F.col("raw_text").cast("binary"), 256).alias("hash"), "start_char")


# Word

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_STYLES = f'<w:styles {_W}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="O"><w:name w:val="own"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="M"><w:name w:val="mine"/><w:basedOn w:val="O"/></w:style><w:style w:styleId="T"><w:name w:val="toc 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
_NUMBERS = f'<w:numbering {_W}><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="5"/></w:num></w:numbering>'
_TYPES = '<Types><Default Extension="png" ContentType="image/png"/></Types>'
_RELS = '<Relationships><Relationship Id="h" Type="x/header" Target="header1.xml"/><Relationship Id="f" Type="x/footer" Target="footer1.xml"/></Relationships>'


def _run(w: str) -> str:
    return f"<w:r><w:t>{w}</w:t></w:r>"


def _paragraph(w: str, style: str = "", rest: str = "") -> str:
    return f"<w:p><w:pPr>{style}</w:pPr>{_run(w)}{rest}</w:p>"


def _block(i: int, k: int, w: str) -> str:
    """A block for each line, by kind: heading, item, paragraph with a note, table, tracked change, inherited heading, entry of contents, text box."""
    named = lambda s: f'<w:pStyle w:val="{s}"/>'
    cell = lambda t: f"<w:tc>{_paragraph(t)}</w:tc>"
    return [
        lambda: _paragraph(w, named("H")), lambda: _paragraph(w, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="7"/></w:numPr>'), lambda: _paragraph(w, "", f'<w:r><w:footnoteReference w:id="{i}"/></w:r>'),
        lambda: f"<w:tbl><w:tr>{cell(w)}{cell('second')}</w:tr></w:tbl>", lambda: _paragraph(w, "", f"<w:ins>{_run(' new')}</w:ins><w:del><w:r><w:delText> old</w:delText></w:r></w:del>"),
        lambda: _paragraph(w, named("M")), lambda: _paragraph(w, named("T")), lambda: _paragraph(w, "", f"<w:r><w:pict><w:txbxContent>{_paragraph('in a box')}</w:txbxContent></w:pict></w:r>"),
    ][k]()


def _package(lines: list[dict]) -> bytes:
    out = io.BytesIO()
    body = "".join(_block(x["i"], x["k"], x["w"]) for x in lines) + "<w:strange/><w:sectPr/>"
    notes = "".join(f'<w:footnote w:id="{x["i"]}">{_paragraph("note " + x["w"])}</w:footnote>' for x in lines if x["k"] == 2)
    parts = {
        "[Content_Types].xml": _TYPES, "word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": _STYLES, "word/numbering.xml": _NUMBERS, "word/_rels/document.xml.rels": _RELS,
        "word/footnotes.xml": f'<w:footnotes {_W}><w:footnote w:id="-1" w:type="separator">{_paragraph("-")}</w:footnote>{notes}</w:footnotes>', "word/header1.xml": f"<w:hdr {_W}>{_paragraph('head')}</w:hdr>", "word/footer1.xml": f"<w:ftr {_W}>{_paragraph('foot')}</w:ftr>",
    }
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A Word file for each document; every 25th is cut off."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_package(x) for x in batch.column(1).to_pylist()]
            whole = [c[: len(c) // 2] if int(i) % 25 == 7 else c for i, c in zip(batch.column(0).to_pylist(), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], names=["document_id", "content"])

    rows = _words(spark, d).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("i", "k", "w"))).alias("lines"))
    return rows.mapInArrow(make, "document_id string, content binary")


DOCX = f"""with {WORDS}, good as (select * from words where document_id::bigint % 25 <> 7), ids as (select distinct document_id from good),
e as (select document_id, i + 1 as place, 0 as part, case k when 0 then 'HEADING' when 1 then 'LIST_ITEM' when 3 then 'TABLE' when 5 then 'HEADING' else 'PARAGRAPH' end as type, case k when 3 then null when 4 then w || ' new' else w end as raw_text, 'body' as zone, case k when 0 then 1 when 5 then 2 end as heading_level,
    case when k = 1 then 'decimal' end as number_format, case when k = 6 then 'toc' end as role, case when k = 4 then 'del,ins' end as revision, null as diagnostic from good
  union all select document_id, i + 1, 1, 'TABLE_ROW', w || chr(9) || 'second', 'body', null, null, null, null, null from good where k = 3
  union all select document_id, i + 1, 2, 'TABLE_CELL', w, 'body', null, null, null, null, null from good where k = 3
  union all select document_id, i + 1, 3, 'TABLE_CELL', 'second', 'body', null, null, null, null, null from good where k = 3
  union all select document_id, i + 1, 1, 'PARAGRAPH', 'in a box', 'text_box', null, null, null, null, null from good where k = 7
  union all select document_id, 2000000 + i, 0, 'PARAGRAPH', 'note ' || w, 'footnote', null, null, null, null, null from good where k = 2
  union all select document_id, 0, 0, 'PARAGRAPH', 'head', 'header', null, null, null, null, null from ids
  union all select document_id, 9000000, 0, 'PARAGRAPH', 'foot', 'footer', null, null, null, null, null from ids
  union all select document_id, 1000000, 0, 'UNKNOWN', null, 'body', null, null, null, null, 'UNHANDLED_BLOCK_STRANGE' from ids
  union all select document_id, 1000001, 0, 'SEPARATOR', null, 'body', null, null, null, null, null from ids
  union all select document_id, 0, 0, 'UNKNOWN', null, null, null, null, null, null, 'NOT_A_PACKAGE' from (select distinct document_id from words) where document_id::bigint % 25 = 7),
o as (select *, row_number() over (partition by document_id order by place, part)::int - 1 as ord from e)"""


@query("docx_elements", DOCX + " select document_id, ord, type, raw_text, zone, heading_level, number_format, role, revision, diagnostic from o")
def docx_elements(spark, d):
    return docx.docx(_files(spark, d)).select("document_id", "ord", "type", "raw_text", F.col("source_zone").alias("zone"), "heading_level", "number_format", F.col("navigation_role").alias("role"), "revision", "diagnostic")


@query("docx_list_runs", DOCX + """, f as (select document_id, type, coalesce(type = 'LIST_ITEM' and lag(type) over (partition by document_id order by ord) is distinct from 'LIST_ITEM', false)::int as fresh, ord from o)
select document_id, sum(fresh)::bigint as runs, count(*) filter (where type = 'LIST_ITEM') as items, count(*) filter (where type = 'TABLE') as tables from f group by 1 having items > 0""")
def docx_list_runs(spark, d):
    rows = docx.docx(_files(spark, d)).groupBy("document_id").agg(F.count_distinct(F.when(F.col("type") == "LIST_ITEM", F.col("integrity_group_id"))).alias("runs"), F.sum((F.col("type") == "LIST_ITEM").cast("long")).alias("items"), F.sum((F.col("type") == "TABLE").cast("long")).alias("tables"))
    return rows.where("items > 0")


@query("docx_original_texts", DOCX + " select document_id, ord, replace(raw_text, ' new', ' old') as raw_text from o where revision is not null")
def docx_original_texts(spark, d):
    """What a file said before its tracked changes."""
    return docx.docx(_files(spark, d), "ORIGINAL").where("revision is not null").select("document_id", "ord", "raw_text")


# Payloads and lines


@query("decoded_payloads", """select doc_id::varchar as document_id, case when doc_id % 3 = 0 then null else sha256(text) end as hash, doc_id % 3 <> 0 as decoded from documents""")
def decoded_payloads(spark, d):
    """Texts as bytes: plain, with a byte-order mark, and with a byte that no text has."""
    k, raw = F.col("doc_id") % 3, F.encode("text", "UTF-8")
    content = F.when(k == 0, F.concat(raw, F.unhex(F.lit("FF")))).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    made = elements.decode_utf8(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), content.alias("content")))
    return made.select("document_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.col("text").isNotNull().alias("decoded"))


@query("line_issues", """with l as (select event_id, event_id % 9 as k, 'f' || event_id % 3 as file from events) select file, case k when 1 then 'BLANK_LINE' when 2 then 'NOT_A_JSON_OBJECT' when 3 then 'NOT_A_JSON_OBJECT' when 4 then 'KEY_MISSING' when 5 then 'NOT_A_JSON_OBJECT' end as code, count(*) as n from l where k between 1 and 5 group by all
union all select 'f' || min(event_id % 3), 'DUPLICATE_KEY', 1 from events where event_id % 9 = 6 having count(*) > 1""")
def line_issues(spark, d):
    """JSON lines of events: good ones, blank ones, arrays, broken ones, ones without a key, numbers that JSON has not, and one key many times."""
    e, k = F.col("event_id"), F.col("event_id") % 9
    key = F.when(k == 6, F.lit("same")).otherwise(e.cast("string"))
    good = F.concat(F.lit('{"record_id": "'), key, F.lit('", "kind": "'), F.col("event_type"), F.lit('"}'))
    line = F.when(k == 1, F.lit("  ")).when(k == 2, F.lit("[1, 2]")).when(k == 3, F.lit('{"record_id": ')).when(k == 4, F.lit('{"kind": 1}')).when(k == 5, F.lit('{"record_id": "1", "x": NaN}')).otherwise(good)
    lines = table(spark, d, "events").select(F.concat(F.lit("f"), (e % 3).cast("string")).alias("file"), line.alias("line"))
    return jsonl.line_issues(lines).groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"))


@query("plain_blocks", f"""with {WORDS}, g as (select document_id, i // 3 as block, string_agg(w, chr(10) order by i) as t from words group by document_id, i // 3), m as (select document_id, max(block) as last from g group by 1),
e as (select document_id, 2 * block as ord, 'PARAGRAPH' as type, t || case when block < last then chr(10) else '' end as raw from g join m using (document_id) union all select document_id, 2 * block + 1, 'SEPARATOR', ' ' || chr(9) || chr(10) from g join m using (document_id) where block < last)
select document_id, ord::int as ord, type, sha256(raw) as hash, coalesce(sum(length(raw)) over (partition by document_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from e""")
def plain_blocks(spark, d):
    """Texts with a blank line after every third line, as runs of lines and of blank lines."""
    lines = F.sort_array(F.collect_list(F.struct("i", "w")))
    joined = F.aggregate(lines, F.lit(""), lambda a, x: F.concat(a, F.when(x["i"] == 0, F.lit("")).when(x["i"] % 3 == 0, F.lit("\n \t\n")).otherwise(F.lit("\n")), x["w"]))
    made = texts.plain_text(_words(spark, d).groupBy("document_id").agg(joined.alias("text")))
    return made.select("document_id", "ord", "type", F.sha2(F.col("raw_text").cast("binary"), 256).alias("hash"), "start_char")


@query("source_references", """with o as (select o_orderkey as id, o_orderkey % 8 as k, o_custkey as c from orders)
select id::varchar as element_id, 'source_anchor' as field, null::int as place, case when k in (0, 1) then 'note' end as kind, case when k in (0, 1) then 'n' || c end as ref, case k when 2 then 'NOT_AN_OBJECT' when 3 then 'KIND_INVALID' when 4 then 'ID_INVALID' end as code from o where k < 5
union all select id::varchar, 'source_references', 0, 'note', 'n' || c, null from o where k = 1 union all select id::varchar, 'source_references', 1, null, null, 'NOT_AN_OBJECT' from o where k = 1
union all select id::varchar, 'source_references', null, null, null, 'NOT_A_LIST' from o where k = 5 union all select id::varchar, 'attributes', null, null, null, 'NOT_A_JSON_OBJECT' from o where k = 6""")
def source_references(spark, d):
    """Attributes with an anchor, with references too, and with values of other shapes; some state none."""
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    good = F.concat(F.lit('{"kind": "note", "id": "n'), c, F.lit('"}'))
    whole = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    anchor = lambda v: F.concat(F.lit('"source_anchor": '), v)
    attributes = (
        F.when(k == 0, whole(anchor(good))).when(k == 1, whole(anchor(good), F.lit(', "source_references": ['), good, F.lit(", 7]"))).when(k == 2, whole(anchor(F.lit('"n1"')))).when(k == 3, whole(anchor(F.lit('{"kind": " note", "id": "n"}'))))
        .when(k == 4, whole(anchor(F.lit('{"kind": "note", "id": 12}')))).when(k == 5, F.lit('{"source_anchor": null, "source_references": {}}')).when(k == 6, F.lit("[1]")).otherwise(F.lit('{"other": 1}'))
    )
    rows = table(spark, d, "orders").select((k % 3).alias("document_id"), F.col("o_orderkey").cast("string").alias("element_id"), attributes.alias("attributes"))
    return references.source_references(rows).select("element_id", "field", "place", "kind", F.col("id").alias("ref"), "code")
