"""Word documents as elements, from the package's XML with the standard library.

Each file is one row of a binaryFile scan; its parts are read in a worker.  The body, headers, footers, notes and comments
are stories; paragraphs, lists and nested tables keep source order, native groups and what is needed to find them again.
"""

from __future__ import annotations

import functools
import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.frames import in_doc

#: Rows and characters that go to Spark at once.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 21
MAX_BYTES, MAX_INFLATED, MAX_ENTRIES, MAX_ELEMENTS = 100 << 20, 512 << 20, 10_000, 200_000
NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
ALT = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_EMBED, _ID = REL + "embed", REL + "id"
_CHANGES = {NS + x for x in ("ins", "del", "moveFrom", "moveTo")}

SCHEMA = (
    "document_id string, ord int, type string, source string, raw_text string, source_zone string, source_part string, heading_level int, numbering_id string, numbering_level int, number_format string, integrity_group_id string, integrity_parent_group_id string, "
    "row_index int, cell_index int, grid_span int, vertical_merge string, style_name string, navigation_role string, bold boolean, font_size double, indentation double, alignment string, source_anchor struct<kind:string,id:string>, source_references array<struct<kind:string,id:string>>, revision string, assets array<string>, diagnostic string"
)


class PackageError(ValueError):
    """A file that is no safe package; the message is its code."""


def open_package(content: bytes) -> zipfile.ZipFile:
    """The package after its guards: size, entries, inflated size, encryption, unsafe and repeated names."""
    if len(content) > MAX_BYTES:
        raise PackageError("PACKAGE_TOO_LARGE")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise PackageError("NOT_A_PACKAGE") from None
    names = [i.filename for i in z.infolist()]
    checks = [
        (len(names) > MAX_ENTRIES, "TOO_MANY_ENTRIES"), (sum(i.file_size for i in z.infolist()) > MAX_INFLATED, "INFLATED_TOO_LARGE"), (any(i.flag_bits & 1 for i in z.infolist()), "ENCRYPTED"),
        (len({n.lower() for n in names}) != len(names), "DUPLICATE_PART"), (any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names), "UNSAFE_PART_NAME"), ("word/document.xml" not in names, "MAIN_PART_MISSING"),
    ]
    for bad, code in checks:
        if bad:
            raise PackageError(code)
    return z


@functools.lru_cache(None)
def _path(path: str) -> str:
    return "/".join(NS + p for p in path.split("/"))


def _val(node: ET.Element | None, path: str, attr: str = "val") -> str | None:
    found = None if node is None else node.find(_path(path))
    return None if found is None else found.get(NS + attr)


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str, bool]]:
    """id to kind, target part and whether it is outside of the package."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(path)):
        outside = r.get("TargetMode") == "External"
        target = r.get("Target", "")
        out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target if outside else posixpath.normpath(posixpath.join(folder, target)) if not target.startswith("/") else target[1:], outside)
    return out


def resolve_styles(root: ET.Element | None) -> dict[str, dict]:
    """Paragraph styles with what they inherit; a cycle in the chain is an error."""
    raw = {}
    for s in [] if root is None else root.iter(NS + "style"):
        p = s.find(NS + "pPr")
        own = {"name": _val(s, "name"), "outline": _number(_val(p, "outlineLvl")), "num_id": _val(p, "numPr/numId"), "level": _number(_val(p, "numPr/ilvl")), "size": _number(_val(s, "rPr/sz")), "bold": None if s.find(f"{NS}rPr/{NS}b") is None else _val(s, "rPr/b") not in ("0", "false")}
        # Definitions of one id that do not contradict each other are one.
        have = raw.setdefault(s.get(NS + "styleId"), {"based": _val(s, "basedOn"), **own})
        have.update({k: v for k, v in own.items() if have.get(k) is None})

    def full(key: str, seen: tuple[str, ...] = ()) -> dict:
        if key in seen:
            raise PackageError("STYLE_CYCLE")
        own = raw.get(key, {})
        base = full(own["based"], (*seen, key)) if own.get("based") else {}
        return {k: own.get(k) if own.get(k) is not None or k == "name" else base.get(k) for k in ("name", "outline", "num_id", "level", "size", "bold")}

    return {k: full(k) for k in raw}


def numbering_formats(root: ET.Element | None) -> dict[tuple[str, int], str]:
    """Format of each numbering id and level, over its abstract definition."""
    if root is None:
        return {}
    abstract = {a.get(NS + "abstractNumId"): {int(v.get(NS + "ilvl")): _val(v, "numFmt") for v in a.findall(NS + "lvl")} for a in root.findall(NS + "abstractNum")}
    return {(n.get(NS + "numId"), level): fmt for n in root.findall(NS + "num") for level, fmt in abstract.get(_val(n, "abstractNumId"), {}).items()}


class Story:
    """Walks the blocks of one part and collects rows."""

    def __init__(self, doc: Reader, part: str, zone: str, anchor: tuple[str, str] | None = None):
        self.doc, self.part, self.zone, self.anchor = doc, part, zone, anchor

    def put(self, kind: str, text: str | None, **facts) -> None:
        if len(self.doc.rows) >= MAX_ELEMENTS:
            raise PackageError("TOO_MANY_ELEMENTS")
        anchor = {"kind": self.anchor[0], "id": self.anchor[1]} if self.anchor else None
        self.doc.rows.append({"type": kind, "raw_text": text, "source": "EXPLICIT", "source_zone": self.zone, "source_part": self.part, "source_anchor": anchor, **facts})
        self.anchor = None  # the first element of a note carries its anchor

    def group(self, *parts: object) -> str:
        return "grp_" + hashlib.sha256("|".join(map(str, (self.part, self.zone, *parts))).encode()).hexdigest()[:20]

    def blocks(self, parent: ET.Element, path: str = "", outer: str | None = None) -> None:
        for i, node in enumerate(parent):
            name = node.tag.rsplit("}", 1)[-1]
            here = f"{path}/{i}"
            if name == "p":
                self.paragraph(node, here, outer)
            elif name == "tbl":
                self.table(node, here, outer)
            elif name == "sectPr":
                self.put("SEPARATOR", None, diagnostic=None)
            elif name == "altChunk":
                target = self.doc.relations(self.part).get(node.get(REL + "id"), ("", "", True))
                self.put("UNKNOWN", None, assets=[target[1]], diagnostic="OPAQUE_ALT_CHUNK")
            elif name == "sdt":
                inner = node.find(NS + "sdtContent")
                if inner is not None:
                    self.blocks(inner, here, outer)
            elif name in ("customXml", "ins", "del", "moveFrom", "moveTo"):
                if self.doc.shows(name):
                    self.blocks(node, here, outer)
            elif name not in ("pPr", "tcPr", "sdtPr", "customXmlPr", "bookmarkStart", "bookmarkEnd", "proofErr", "permStart", "permEnd", "commentRangeStart", "commentRangeEnd"):
                self.put("UNKNOWN", None, diagnostic=f"UNHANDLED_BLOCK_{name.upper()}")

    def paragraph(self, p: ET.Element, path: str, outer: str | None) -> None:
        doc, props = self.doc, p.find(NS + "pPr")
        style = doc.styles.get(_val(props, "pStyle") or "", {})
        direct = _val(props, "numPr/numId")
        num_id = direct if direct is not None else style.get("num_id")
        num_id = None if num_id == "0" else num_id
        level = _number(_val(props, "numPr/ilvl"))
        level = (style.get("level") if level is None else level) or 0
        name = style.get("name") or ""
        outline = _number(_val(props, "outlineLvl"))
        outline = style.get("outline") if outline is None else outline
        titled = re.fullmatch(r"(?i)heading ([1-9])", name)
        heading = outline + 1 if outline is not None and outline < 9 else int(titled[1]) if titled else None
        role = "toc" if re.match(r"(?i)toc( heading| ?\d)", name) else None
        text = doc.text(p)
        inner = list(p.iter())
        tags = {n.tag for n in inner}
        formula = MATH + "oMath" in tags and not text.strip()
        kind = "PARAGRAPH" if role else "HEADING" if heading is not None else "LIST_ITEM" if num_id else "FORMULA" if formula else "PARAGRAPH"
        run = p.find(f"{NS}r/{NS}rPr")
        bold = None if run is None or run.find(NS + "b") is None else _val(run, "b") not in ("0", "false")
        size = _number(_val(run, "sz"))
        size = style.get("size") if size is None else size
        refs = [{"kind": k, "id": n.get(NS + "id")} for k in ("footnote", "endnote", "comment") if f"{NS}{k}Reference" in tags for n in p.iter(f"{NS}{k}Reference")]
        relations = doc.relations(self.part)
        images = [relations[k][1] for n in inner if n.attrib for a in (_EMBED, _ID) if (k := n.get(a)) in relations and relations[k][0] == "image"]
        indent = _number(_val(props, "ind", "left"))
        marks = sorted(t.rsplit("}", 1)[-1] for t in tags & _CHANGES)
        self.put(
            kind, text, heading_level=heading if kind == "HEADING" else None, numbering_id=num_id if kind == "LIST_ITEM" else None, numbering_level=level if kind == "LIST_ITEM" else None, number_format=doc.formats.get((num_id, level)) if kind == "LIST_ITEM" else None,
            style_name=name or None, navigation_role=role, bold=style.get("bold") if bold is None else bold, font_size=None if size is None else size / 2, indentation=None if indent is None else float(indent), alignment=_val(props, "jc"), source_references=refs or None, revision=",".join(marks) or None, assets=images or None, integrity_parent_group_id=outer if kind == "LIST_ITEM" else None,
        )
        for i, box in enumerate(_boxes(p)):
            Story(doc, self.part, "text_box").blocks(box, f"{path}/box{i}", outer)

    def table(self, t: ET.Element, path: str, outer: str | None) -> None:
        group = self.group("table", path)
        same = {"integrity_group_id": group, "integrity_parent_group_id": outer}
        self.put("TABLE", None, **same)
        for r, row in enumerate(_inside(t, "tr")):
            cells = list(_inside(row, "tc"))
            self.put("TABLE_ROW", "\t".join(self.doc.cell_text(c) for c in cells), row_index=r, **same)
            for c, cell in enumerate(cells):
                merge = cell.find(f"{NS}tcPr/{NS}vMerge")
                self.put("TABLE_CELL", self.doc.cell_text(cell), row_index=r, cell_index=c, grid_span=_number(_val(cell, "tcPr/gridSpan")), vertical_merge=None if merge is None else merge.get(NS + "val", "continue"), **same)
                for i, inner in enumerate(cell.findall(NS + "tbl")):
                    self.table(inner, f"{path}/{r}/{c}/{i}", group)


def _inside(parent: ET.Element, name: str) -> Iterator[ET.Element]:
    """Rows or cells, also within content controls."""
    for node in parent:
        if node.tag == NS + name:
            yield node
        elif node.tag == NS + "sdt":
            inner = node.find(NS + "sdtContent")
            if inner is not None:
                yield from _inside(inner, name)


def _own_paragraphs(parent: ET.Element) -> Iterator[ET.Element]:
    for node in parent:
        if node.tag == NS + "p":
            yield node
        elif node.tag != NS + "tbl":
            yield from _own_paragraphs(node)


def _boxes(p: ET.Element) -> Iterator[ET.Element]:
    """Text boxes of a paragraph; of a choice and its fallback only the choice."""
    for node in p:
        if node.tag == ALT + "AlternateContent":
            picked = node.find(ALT + "Choice")
            picked = node.find(ALT + "Fallback") if picked is None else picked
            if picked is not None:
                yield from _boxes(picked)
        elif node.tag == NS + "txbxContent":
            yield node
        else:
            yield from _boxes(node)


def _parsed(content: bytes | None) -> ET.Element | None:
    if content is None:
        return None
    try:
        return ET.fromstring(content)
    except ET.ParseError:
        raise PackageError("MALFORMED_XML") from None


@functools.lru_cache(16)
def _styles(content: bytes | None) -> dict[str, dict]:
    return resolve_styles(_parsed(content))


@functools.lru_cache(16)
def _formats(content: bytes | None) -> dict[tuple[str, int], str]:
    return numbering_formats(_parsed(content))


class Reader:
    """One document: its shared parts, and rows in source order."""

    def __init__(self, content: bytes, revisions: str = "FINAL"):
        self.z = open_package(content)
        self.revisions, self.rows, self._rels = revisions, [], {}
        # files of one template share these parts
        self.styles = _styles(self.part("word/styles.xml"))
        self.formats = _formats(self.part("word/numbering.xml"))

    def part(self, part: str) -> bytes | None:
        if part not in self.z.namelist():
            return None
        try:
            return self.z.read(part)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
            raise PackageError("CORRUPT_PART") from None

    def xml(self, part: str) -> ET.Element | None:
        return _parsed(self.part(part))

    def story(self, part: str, zone: str) -> None:
        """The blocks of a header or footer; one that is named and missing shows as an element with its code."""
        root = self.xml(part)
        if root is None:
            Story(self, part, zone).put("UNKNOWN", None, diagnostic="PART_MISSING")
        else:
            Story(self, part, zone).blocks(root)

    def relations(self, part: str) -> dict:
        if part not in self._rels:
            try:
                self._rels[part] = relationships(self.z, part)
            except ET.ParseError:
                raise PackageError("MALFORMED_XML") from None
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
                raise PackageError("CORRUPT_PART") from None
        return self._rels[part]

    def shows(self, mark: str) -> bool:
        """Whether a view of tracked changes holds what is inside such a mark."""
        hidden = {"FINAL": ("del", "moveFrom"), "ORIGINAL": ("ins", "moveTo")}.get(self.revisions, ())
        return mark not in hidden

    def text(self, node: ET.Element) -> str:
        """Visible text of a paragraph without its text boxes."""
        out = []
        for child in node:
            name = child.tag.rsplit("}", 1)[-1]
            if name in ("ins", "del", "moveFrom", "moveTo") and not self.shows(name):
                continue
            if name in ("t", "delText") and child.tag.startswith((NS, MATH)):
                out.append(child.text or "")
            elif name == "tab" and node.tag == NS + "r":
                out.append("\t")
            elif name in ("br", "cr"):
                out.append("\n")
            elif name == "noBreakHyphen":
                out.append("‑")
            elif name not in ("txbxContent", "pPr", "rPr", "instrText", "AlternateContent"):
                out.append(self.text(child))
        return "".join(out)

    def cell_text(self, cell: ET.Element) -> str:
        """Text of a cell's own paragraphs; a table in it has cells of its own."""
        return "\n".join(self.text(p) for p in _own_paragraphs(cell))

    def read(self) -> list[dict]:
        body = self.xml("word/document.xml").find(NS + "body")
        if body is None:
            raise PackageError("BODY_MISSING")
        rels = sorted(self.relations("word/document.xml").values())
        for _, part, _ in (r for r in rels if r[0] == "header"):
            self.story(part, "header")
        Story(self, "word/document.xml", "body").blocks(body)
        for part, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote"), ("word/comments.xml", "comment")):
            root = self.xml(part)
            for note in [] if root is None else root.findall(NS + tag):
                if note.get(NS + "type") is None:  # separators are not content
                    Story(self, part, tag, (tag, note.get(NS + "id"))).blocks(note)
        for _, part, _ in (r for r in rels if r[0] == "footer"):
            self.story(part, "footer")
        return self.rows

    def assets(self) -> list[dict]:
        """Parts that are no XML, with type and hash."""
        types = {t.get("Extension", "").lower(): t.get("ContentType") for t in ET.fromstring(self.z.read("[Content_Types].xml"))} if "[Content_Types].xml" in self.z.namelist() else {}
        return [{"part": n, "content_type": types.get(n.rsplit(".", 1)[-1].lower()), "sha256": hashlib.sha256(self.z.read(n)).hexdigest()} for n in sorted(self.z.namelist()) if not n.endswith((".xml", ".rels", "/"))]


def rows_of(document_id: str, content: bytes | None, revisions: str) -> list[dict]:
    """The rows of a file, numbered."""
    try:
        rows = Reader(content or b"", revisions).read()
    except PackageError as e:
        rows = [{"type": "UNKNOWN", "source": "EXPLICIT", "diagnostic": str(e)}]
    return [{**r, "document_id": document_id, "ord": i} for i, r in enumerate(rows)]


def packed(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of up to ``BATCH_ROWS`` rows and about ``BATCH_CHARS`` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("raw_text") or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield from pa.Table.from_pylist(held, schema=schema).to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_pylist(held, schema=schema).to_batches()


def docx(files: DataFrame, revisions: str = "FINAL") -> DataFrame:
    """Elements of Word files (document_id, content); a file that can't be read is one UNKNOWN element with its diagnostic."""

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((row for batch in batches for d, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in rows_of(d, content, revisions)), schema)

    return list_runs(files.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(parse, SCHEMA))


def read_docx(spark: SparkSession, path: str, revisions: str = "FINAL") -> DataFrame:
    return docx(spark.read.format("binaryFile").load(path).select(F.col("path").alias("document_id"), "content"), revisions)


def list_runs(rows: DataFrame) -> DataFrame:
    """Gives neighbouring list items of one part, zone and numbering a group of their own."""
    item = F.col("type") == "LIST_ITEM"
    same = F.lag("type").over(in_doc()) == "LIST_ITEM"
    for c in ("numbering_id", "source_part", "source_zone", "integrity_parent_group_id"):
        same = same & F.col(c).eqNullSafe(F.lag(c).over(in_doc()))
    rows = rows.withColumn("gm_fresh", item & ~F.coalesce(same, F.lit(False)))
    first = F.last(F.when(F.col("gm_fresh"), F.col("ord")), ignorenulls=True).over(in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    group = F.concat(F.lit("list_"), F.substring(F.sha2(F.concat_ws("|", "source_part", "source_zone", "numbering_id", first.cast("string")).cast("binary"), 256), 1, 20))
    return rows.withColumn("integrity_group_id", F.when(item, group).otherwise(F.col("integrity_group_id"))).drop("gm_fresh")
