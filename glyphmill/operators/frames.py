"""Columns of the element table and windows over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Optional element columns and their types; absent ones read as null.
OPTIONAL: dict[str, str] = {
    "element_id": "string", "text": "string", "raw_text": "string", "normalized_text": "string", "source": "string", "type_confidence": "double", "provenance_confidence": "double",
    "bold": "boolean", "font_size": "double", "indentation": "double", "alignment": "string",
    "heading_level": "int", "numbering_level": "int", "numbering_id": "string", "number_format": "string",
    "integrity_group_id": "string", "integrity_parent_group_id": "string", "source_zone": "string", "source_part": "string", "source_label": "string",
    "page": "int", "exclude_from_retrieval": "boolean",
}

TABLE_TYPES = ["TABLE", "TABLE_ROW", "TABLE_CELL"]
LIST_TYPES = ["LIST", "LIST_ITEM"]
CODE_TYPES = ["CODE"]
#: Element types in their canonical order.
ELEMENT_TYPES = [
    "TITLE", "HEADING", "PARAGRAPH", "SENTENCE", "LINE", "LIST", "LIST_ITEM", "TABLE", "TABLE_ROW", "TABLE_CELL", "CODE", "FORMULA", "QUESTION", "ANSWER",
    "DIALOGUE_TURN", "LOG_ENTRY", "KEY_VALUE", "FIGURE", "CHART", "CAPTION", "FOOTNOTE", "SEPARATOR", "HEADER", "FOOTER", "PAGE_NUMBER", "UNKNOWN",
]
#: The category of each type.
CATEGORIES: dict[str, list[str]] = {
    "narrative": ["TITLE", "HEADING", "PARAGRAPH", "SENTENCE", "LINE", "CAPTION", "FOOTNOTE"],
    "list": ["LIST", "LIST_ITEM"],
    "dialogue": ["DIALOGUE_TURN"],
    "code": ["CODE"],
    "table": ["TABLE", "TABLE_ROW", "TABLE_CELL"],
    "qa": ["QUESTION", "ANSWER"],
    "formula": ["FORMULA"],
    "log": ["LOG_ENTRY"],
    "key_value": ["KEY_VALUE"],
    "visual": ["FIGURE", "CHART"],
    "boilerplate": ["HEADER", "FOOTER", "PAGE_NUMBER"],
    "separator": ["SEPARATOR"],
    "unknown": ["UNKNOWN"],
}

def in_doc() -> WindowSpec:
    """The order of a document; every per-document operator uses this one spec, so one exchange and sort serve them all."""
    return Window.partitionBy("document_id").orderBy("ord")


def whole_doc() -> WindowSpec:
    return Window.partitionBy("document_id")


def up_to_here() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def until_here() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, -1)


def complete(df: DataFrame) -> DataFrame:
    """``df`` with every optional element column."""
    have = set(df.columns)
    made = df.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in have})
    if "text" not in have:
        made = made.withColumn("text", F.coalesce("normalized_text", "raw_text"))
    if "element_id" not in have:
        made = made.withColumn("element_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("ord").cast("string")))
    return made


def category_of(kind: Column, zone: Column | None = None) -> Column:
    """Coarse category; elements of a header or footer zone are boilerplate."""
    out = F.lit("unknown")
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(kinds), F.lit(name)).otherwise(out)
    return out if zone is None else F.when(F.lower(zone).isin("header", "footer"), F.lit("boilerplate")).otherwise(out)


def same_family(a: Column, b: Column) -> Column:
    both = lambda kinds: a.isin(kinds) & b.isin(kinds)
    return both(TABLE_TYPES) | both(CODE_TYPES) | both(LIST_TYPES)


def islands(df: DataFrame, member: Column, broken: Column, name: str = "island") -> DataFrame:
    """Member rows with the number of their maximal run; a run also ends where ``broken`` holds between a row and the one before."""
    inside = F.coalesce(member, F.lit(False))
    fresh = inside & (~F.coalesce(F.lag(inside).over(in_doc()), F.lit(False)) | F.coalesce(broken, F.lit(False)))
    return df.withColumn(name, F.sum(fresh.cast("int")).over(up_to_here())).where(inside)
