"""Plain text and Markdown files as elements.

Plain text runs on built-in functions.  Markdown blocks carry state over lines (fences, lists, paragraphs that a later
line turns into a heading), so each document's lines go through one pass in an Arrow-batched map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import elements as E

MAX_BYTES = 16 << 20
RAW = "document_id string, ord int, type string, source string, raw_text string, start_char long, end_char long, line_start int, line_end int, block_kind string, heading_level int, source_label string, integrity_group_id string, source_zone string, info string, diagnostic string"

#: The patterns of Markdown blocks.
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*)|[ \t]*)$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r" {0,3}([-+*]|\d{1,9}[.)])[ \t]+.*$")
QUOTE = re.compile(r" {0,3}>+(?:[ \t]|$)")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")


def kind_of(line: str) -> str:
    """What a line opens by itself."""
    if not line.strip():
        return "blank"
    m = FENCE.match(line)
    if m and not (m[1][0] == "`" and "`" in m[2]):
        return "fence"
    for kind, pattern in (("heading", HEADING), ("rule", RULE), ("item", ITEM), ("quote", QUOTE)):
        if pattern.match(line):
            return kind
    return "text"


def markdown_blocks(text: str) -> list[dict]:
    """Blocks of a text that cover it without gap or overlap, in order."""
    raw = LINE.findall(text)
    bare = [x.rstrip("\r\n") for x in raw]
    kinds = [kind_of(x) for x in bare]
    starts = [0]
    for x in raw:
        starts.append(starts[-1] + len(x))
    out: list[dict] = []

    def run(i: int, accept) -> int:
        while i < len(kinds) and accept(i):
            i += 1
        return i

    def put(a: int, b: int, kind: str, block: str, **facts) -> int:
        out.append({"type": kind, "block_kind": block, "raw_text": text[starts[a] : starts[b]], "start_char": starts[a], "end_char": starts[b], "line_start": a + 1, "line_end": b, **facts})
        return b

    i = 0
    while i < len(kinds):
        kind = kinds[i]
        if kind == "blank":
            i = put(i, run(i, lambda j: kinds[j] == "blank"), "SEPARATOR", "blank_lines")
        elif kind == "fence":
            mark, info = FENCE.match(bare[i]).groups()
            close = re.compile(r" {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}[ \t]*$")
            end = next((j for j in range(i + 1, len(bare)) if close.match(bare[j])), None)
            i = put(i, len(bare) if end is None else end + 1, "CODE", "fenced_code", info=info.strip(), **({"diagnostic": "MARKDOWN_UNCLOSED_FENCE"} if end is None else {}))
        elif kind == "heading":
            marks, label = HEADING.match(bare[i]).groups()
            label = re.sub(r"(^|[ \t]+)#+[ \t]*$", "", label or "").strip()
            i = put(i, i + 1, "HEADING", "atx_heading", heading_level=len(marks), source_label=label or None)
        elif kind == "rule":
            i = put(i, i + 1, "SEPARATOR", "thematic_break")
        elif kind == "item":
            group = f"markdown-list:{starts[i]}"
            while i < len(kinds) and kinds[i] == "item":
                i = put(i, run(i + 1, lambda j: kinds[j] == "text"), "LIST_ITEM", "list_item", integrity_group_id=group, info=ITEM.match(bare[i])[1])
        elif kind == "quote":
            i = put(i, run(i, lambda j: kinds[j] == "quote"), "PARAGRAPH", "block_quote")
        else:
            i = _paragraph(i, bare, kinds, put)
    return out


def _paragraph(i: int, bare: list[str], kinds: list[str], put) -> int:
    """A paragraph up to the next block, or the heading that an underline below its last line makes of it."""
    j = i
    while True:
        below = j + 1
        m = UNDERLINE.match(bare[below]) if below < len(bare) else None
        if m:
            label = " ".join(x.strip() for x in bare[i : j + 1] if x.strip())
            return put(i, below + 1, "HEADING", "setext_heading", heading_level=1 if m[1][0] == "=" else 2, source_label=label or None)
        if below >= len(bare) or kinds[below] != "text":
            return put(i, below, "PARAGRAPH", "paragraph")
        j = below


def read_payloads(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files with their path as document_id, their text, or why they have none."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("document_id"), "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    made = E.decode_utf8(files)
    return made.withColumn("error", F.when(F.col("length") > max_bytes, F.lit("TOO_LARGE")).otherwise(F.col("error")))


def plain_text(texts: DataFrame) -> DataFrame:
    """Elements of plain texts (document_id, text)."""
    return E.text_blocks(texts)


def markdown(texts: DataFrame) -> DataFrame:
    """Elements of Markdown texts (document_id, text); null and empty texts have none."""

    schema = to_arrow_schema(StructType.fromDDL(RAW))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"document_id": d, "ord": i, "source": "EXPLICIT", "source_zone": "body", **b} for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, b in enumerate(markdown_blocks(t or ""))]
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    return texts.select(F.col("document_id").cast("string").alias("document_id"), "text").mapInArrow(parse, RAW)
