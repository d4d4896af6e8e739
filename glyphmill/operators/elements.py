"""From texts to elements: blocks of lines, normalised rows, categories and document profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import CATEGORIES, ELEMENT_TYPES, category_of


def line_rows(texts: DataFrame) -> DataFrame:
    """Rows of document_id and text as lines: number from 0, terminator kept, half-open character range."""
    rows = texts.select("document_id", F.posexplode(T.source_lines(F.coalesce("text", F.lit("")))).alias("line", "raw"))
    w = Window.partitionBy("document_id").orderBy("line")
    start = F.coalesce(F.sum(F.length("raw")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length("raw"))


def text_blocks(texts: DataFrame) -> DataFrame:
    """Runs of blank lines as SEPARATOR and of other lines as PARAGRAPH; their concatenation is the text."""
    blank = F.length(T.strip(F.col("raw"))) == 0
    w = Window.partitionBy("document_id").orderBy("line")
    rows = line_rows(texts).withColumn("blank", blank)
    fresh = F.coalesce(F.lag("blank").over(w) != F.col("blank"), F.lit(True)).cast("int")
    rows = rows.withColumn("block", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    made = rows.groupBy("document_id", "block").agg(
        F.first("blank").alias("blank"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), (F.min("line") + 1).alias("line_start"), (F.max("line") + 1).alias("line_end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "").alias("raw_text"),
    )
    kind = F.when(F.col("blank"), F.lit("SEPARATOR")).otherwise(F.lit("PARAGRAPH"))
    return made.select("document_id", F.col("block").cast("int").alias("ord"), kind.alias("type"), F.lit("EXPLICIT").alias("source"), "raw_text", "start_char", "end_char", "line_start", "line_end")


def normalise(raw: DataFrame) -> DataFrame:
    """Raw elements (document_id, ord, raw_text, type_hint) one to one: LF line ends, NFC, resolved type, and what was changed."""
    text = F.col("raw_text")
    ends = T.line_feeds(text)
    named = T.enum_name(F.col("type_hint"))
    known = named.isin(ELEMENT_TYPES)
    crlf = F.regexp_count(text, F.lit("\\r\\n"))
    return (
        raw.withColumn("normalized_text", T.nfc(ends))
        .withColumn("type", F.when(known, named).otherwise(F.lit("UNKNOWN")))
        .withColumn("type_unresolved", F.col("type_hint").isNotNull() & ~F.coalesce(known, F.lit(False)))
        .withColumn("crlf_count", F.coalesce(crlf, F.lit(0)))
        .withColumn("cr_count", F.coalesce(F.regexp_count(text, F.lit("\\r")) - crlf, F.lit(0)))
        .withColumn("unicode_changed", F.coalesce(F.col("normalized_text") != ends, F.lit(False)))
    )


def decode_utf8(payloads: DataFrame) -> DataFrame:
    """Rows with bytes as text: a UTF-8 mark is dropped, UTF-16 by its mark, UTF-32 and broken bytes are errors."""
    head = F.hex(F.substring("content", 1, 4))
    utf32 = head.startswith("FFFE0000") | head.startswith("0000FEFF")
    utf16 = ~utf32 & (head.startswith("FFFE") | head.startswith("FEFF"))
    rest = F.when(head.startswith("EFBBBF"), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    valid = F.is_valid_utf8(rest.cast("string"))
    error = F.when(utf32, F.lit("UTF32_UNSUPPORTED")).when(~utf16 & ~valid, F.lit("INVALID_UTF8"))
    text = F.when(error.isNotNull(), F.lit(None)).when(utf16, F.decode("content", "UTF-16")).otherwise(rest.cast("string"))
    return payloads.withColumn("error", error).withColumn("text", text)


def with_category(elements: DataFrame) -> DataFrame:
    zone = F.col("source_zone") if "source_zone" in elements.columns else None
    return elements.withColumn("category", category_of(F.col("type"), zone))


def unique_mode(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """The most frequent value of each group if only one has that count, else null."""
    top = counts.withColumn("gm_top", F.max(n).over(Window.partitionBy(*by)))
    return top.where(F.col(n) == F.col("gm_top")).groupBy(*by).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value))


def content_profile(elements: DataFrame, by: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Dense counts and shares of types and categories, switches of category, and the dominant category."""
    rows = with_category(elements)
    order = Window.partitionBy(*by).orderBy("ord")
    rows = rows.withColumn("switch", F.coalesce((F.col("category") != F.lag("category").over(order)).cast("int"), F.lit(0)))
    one = lambda c: F.sum(c.cast("int")).cast("long")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("element_count"), F.sum("switch").cast("long").alias("category_switches"),
        one(F.length(T.strip(F.coalesce("text", F.lit("")))) > 0).alias("text_count"),
        *[one(F.col("type") == t).alias(f"type_{t.lower()}") for t in ELEMENT_TYPES], *[one(F.col("category") == c).alias(f"category_{c}") for c in CATEGORIES],
    )
    best = F.greatest(*[F.col(f"category_{c}") for c in CATEGORIES])
    tied = sum(((F.col(f"category_{c}") == best).cast("int") for c in CATEGORIES), F.lit(0))
    dominant = F.coalesce(*[F.when(F.col(f"category_{c}") == best, F.lit(c)) for c in CATEGORIES])
    n = F.col("element_count")
    return counts.withColumns({"dominant_category": F.when(tied == 1, dominant), "text_share": F.col("text_count") / n, "switch_ratio": F.when(n > 1, F.col("category_switches") / (n - 1)).otherwise(F.lit(0.0)), **{f"share_{c}": F.col(f"category_{c}") / n for c in CATEGORIES}})


def suspicious_characters(c: Column) -> Column:
    """Control characters and replacement characters of a text, in order."""
    return F.regexp_extract_all(c, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\uFFFD]"), F.lit(0))


def preservation(raw: DataFrame, elements: DataFrame, fields: tuple[str, ...] = ("raw_text", "source", "page")) -> DataFrame:
    """How many elements of each document keep each field of their raw row; missing and extra rows count as changed."""
    a = raw.select("document_id", "ord", *[F.col(c).alias(f"raw_{c}") for c in fields], F.lit(True).alias("in_raw"))
    b = elements.select("document_id", "ord", *[F.col(c).alias(f"el_{c}") for c in fields], F.lit(True).alias("in_elements"))
    both = a.join(b, ["document_id", "ord"], "full_outer")
    paired = F.col("in_raw").isNotNull() & F.col("in_elements").isNotNull()
    kept = {c: F.sum((paired & F.col(f"raw_{c}").eqNullSafe(F.col(f"el_{c}"))).cast("int")).alias(f"kept_{c}") for c in fields}
    made = both.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_raw").isNotNull().cast("int")).alias("raw_count"), F.sum(F.col("in_elements").isNotNull().cast("int")).alias("element_count"), *kept.values())
    return made.withColumns({"same_cardinality": F.col("raw_count") == F.col("element_count"), **{f"ratio_{c}": F.col(f"kept_{c}") / F.col("n") for c in fields}})


