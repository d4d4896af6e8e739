"""Structure signals: what each element shows by type, style, attributes and wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import in_doc, whole_doc, complete

#: Patterns at the start of a text.
NUMBERING = "(?U)^\\s*((?:\\d+\\.\\d+(?:\\.\\d+)*|\\d+[.)]|[A-Za-z][.)]|[IVXLCDMivxlcdm]+[.)]))\\s+"
NAVIGATION = "(?U)^\\s*\\S.*\\t+\\s*\\d+\\s*$"
QUESTION = "(?Ui)^\\s*(q(?:uestion)?\\s*[:\\-])\\s*"
ANSWER = "(?Ui)^\\s*(a(?:nswer)?\\s*[:\\-])\\s*"
TIMESTAMP = "(?U)^\\s*(\\[(?:\\d{4}-\\d{2}-\\d{2}[ T])?\\d{1,2}:\\d{2}(?::\\d{2})?\\]|(?:\\d{4}-\\d{2}-\\d{2}[ T])\\d{1,2}:\\d{2}(?::\\d{2})?|\\d{1,2}:\\d{2}(?::\\d{2})?)(?=\\s|$)"
SPEAKER = "(?U)^\\s*([^\\s:][^:\\n]{0,39})\\s*:\\s+(?=\\S)"
PARENTHESISED = "(?U)^\\s*\\((?:\\d+|[A-Za-z]|[IVXLCDMivxlcdm]+)\\)(?=\\s|\\t)"
SECTION_MARKERS = ("chapter", "section", "part", "điều", "khoản", "mục", "summary", "todo")
LEXICAL_TYPES = ["TITLE", "HEADING", "PARAGRAPH", "SENTENCE", "LINE", "QUESTION", "ANSWER", "DIALOGUE_TURN", "UNKNOWN"]
ORDERED_FORMATS = ["decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter"]
#: Kinds that open a pattern at the right side of a boundary.
PATTERN_STARTS = ["NUMBERING_MARKER", "SECTION_MARKER", "QUESTION_MARKER", "TIMESTAMP_PATTERN", "SPEAKER_LABEL_CANDIDATE"]


def section_pattern(markers: tuple[str, ...] = SECTION_MARKERS) -> str:
    return "(?Ui)^\\s*(" + "|".join(sorted(markers, key=len, reverse=True)) + ")(?=\\s|[:.\\-]|$)"


def _marker(pattern: str) -> Column:
    """The marker a lexical element starts with, null without one."""
    return F.when(F.col("type").isin(LEXICAL_TYPES) & F.col("text").rlike(pattern), T.strip(F.regexp_extract("text", pattern, 1)))


def with_markers(elements: DataFrame, markers: tuple[str, ...] = SECTION_MARKERS) -> DataFrame:
    """Elements with a column for each lexical marker; one pass, nothing is shuffled."""
    rows = complete(elements).withColumns({"numbering_marker": _marker(NUMBERING), "section_marker": _marker(section_pattern(markers)), "question_marker": _marker(QUESTION), "answer_marker": _marker(ANSWER), "timestamp_marker": _marker(TIMESTAMP)})
    other = F.col("question_marker").isNull() & F.col("answer_marker").isNull() & F.col("timestamp_marker").isNull() & F.col("section_marker").isNull()
    return rows.withColumn("speaker_marker", F.when(other, _marker(SPEAKER)))


def extract_signals(elements: DataFrame, markers: tuple[str, ...] = SECTION_MARKERS) -> DataFrame:
    """Long table of signals: kind, left element, right element (transitions only), text and numeric value, source, id."""
    rows = with_markers(elements, markers).withColumns({"gm_prev_id": F.lag("element_id").over(in_doc()), "gm_prev_type": F.lag("type").over(in_doc())})
    none = F.lit(None)

    def signal(when: Column, kind: str, text: Column = none, number: Column = none, source: Column = F.col("source")) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text_value"), number.cast("double").alias("numeric_value"), source.alias("signal_source"), F.lit(None).cast("string").alias("left_id")))

    item = F.col("type") == "LIST_ITEM"
    inferred = F.lit("INFERRED")
    found = [
        signal(F.lit(True), "ELEMENT_TYPE", F.col("type")),
        signal((F.col("type") == "HEADING") & F.col("heading_level").isNotNull(), "HEADING_LEVEL", number=F.col("heading_level")),
        signal(item & F.col("numbering_level").isNotNull(), "NUMBERING_LEVEL", number=F.col("numbering_level")),
        signal(item & F.col("number_format").isNotNull(), "NUMBERING_FORMAT", F.col("number_format")),
        signal(F.col("bold"), "STYLE_BOLD"),
        signal(F.col("font_size").isNotNull(), "STYLE_FONT_SIZE", number=F.col("font_size")),
        signal(F.col("indentation").isNotNull(), "STYLE_INDENTATION", number=F.col("indentation")),
        *[signal(F.col(c).isNotNull(), k, F.col(c), source=inferred) for c, k in (("numbering_marker", "NUMBERING_MARKER"), ("section_marker", "SECTION_MARKER"), ("question_marker", "QUESTION_MARKER"), ("answer_marker", "ANSWER_MARKER"), ("timestamp_marker", "TIMESTAMP_PATTERN"), ("speaker_marker", "SPEAKER_LABEL_CANDIDATE"))],
        F.when(F.col("gm_prev_type") != F.col("type"), F.struct(F.lit("ELEMENT_TYPE_TRANSITION").alias("kind"), F.concat_ws(">", "gm_prev_type", "type").alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit("DERIVED").alias("signal_source"), F.col("gm_prev_id").alias("left_id"))),
    ]
    long = rows.select("document_id", "ord", "element_id", F.explode(F.array_compact(F.array(*found))).alias("s"))
    sid = T.joined_id("sig_", F.col("s.kind"), F.col("s.left_id"), F.col("element_id"))
    return long.select("document_id", "ord", sid.alias("signal_id"), "s.kind", F.coalesce("s.left_id", "element_id").alias("left_id"), F.when(F.col("s.left_id").isNotNull(), F.col("element_id")).alias("right_id"), "s.text_value", "s.numeric_value", F.col("s.signal_source").alias("source"))


def list_outline(elements: DataFrame, *, min_sections: int = 5, min_children: int = 3, max_label: int = 160) -> DataFrame:
    """Outline levels from native lists: the one group (zone, numbering id, format) with enough bold sections and nested items."""
    rows = complete(elements).where((F.col("type") == "LIST_ITEM") & F.col("number_format").isin(ORDERED_FORMATS) & F.col("numbering_level").isNotNull())
    key = ["document_id", "source_zone", "numbering_id", "number_format"]
    label = F.length(T.strip(F.coalesce("text", F.lit("")))).between(1, max_label)
    section = (F.col("numbering_level") == 0) & F.col("bold") & label
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    fit = rows.groupBy(*key).agg(count(section).alias("sections"), count(F.col("numbering_level") > 0).alias("children")).where((F.col("sections") >= min_sections) & (F.col("children") >= min_children))
    only = fit.withColumn("gm_n", F.count(F.lit(1)).over(whole_doc())).where("gm_n = 1").select(*[F.col(k).alias(f"gm_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"gm_{k}")) for k in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return rows.join(only, condition).where(section | (F.col("numbering_level") > 0)).select("document_id", "ord", "element_id", F.when(section, F.lit(1)).otherwise(F.col("numbering_level") + 1).cast("int").alias("outline_level"), F.when(section, F.lit("SECTION")).otherwise(F.lit("SUBSECTION")).alias("context_role"))


def preface_outline(elements: DataFrame, *, min_navigation: int = 3, min_sections: int = 2, max_label: int = 160) -> DataFrame:
    """Title and sections by typography: one element with the largest font size, one smaller modal size, and a block of table-of-contents lines."""
    rows = complete(elements).where(F.col("type").isin("PARAGRAPH", "LINE", "UNKNOWN"))
    navigation = F.coalesce(F.col("text").rlike(NAVIGATION), F.lit(False))
    usable = F.col("font_size").isNotNull() & F.length(T.strip(F.coalesce("text", F.lit("")))).between(1, max_label) & ~navigation
    rows = rows.withColumns({"gm_nav": F.sum(navigation.cast("int")).over(whole_doc()), "gm_max": F.max(F.when(usable, F.col("font_size"))).over(whole_doc())})
    candidates = rows.where(usable & (F.col("gm_nav") >= min_navigation))
    sizes = candidates.groupBy("document_id", "font_size", "gm_max").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.where((F.col("font_size") == F.col("gm_max")) & (F.col("n") == 1)).select("document_id", F.col("font_size").alias("title_size"))
    rest = sizes.where((F.col("font_size") < F.col("gm_max")) & (F.col("n") >= min_sections)).withColumn("gm_best", F.max("n").over(whole_doc())).where("n = gm_best").withColumn("gm_ties", F.count(F.lit(1)).over(whole_doc())).where("gm_ties = 1").select("document_id", F.col("font_size").alias("section_size"))
    level = F.when(F.col("font_size") == F.col("title_size"), F.lit(0)).when(F.col("font_size") == F.col("section_size"), F.lit(1))
    return candidates.join(top, "document_id").join(rest, "document_id").withColumn("outline_level", level).where("outline_level is not null").select("document_id", "ord", "element_id", "outline_level", F.when(F.col("outline_level") == 0, F.lit("DOCUMENT_TITLE")).otherwise(F.lit("SECTION")).alias("context_role"))


def outline(elements: DataFrame) -> DataFrame:
    """Outline from native lists; for documents without one, from typography."""
    lists = list_outline(elements)
    return lists.unionByName(preface_outline(elements).join(lists.select("document_id").distinct(), "document_id", "left_anti"))


def post_outline_label(elements: DataFrame, outlined: DataFrame) -> DataFrame:
    """The single unnumbered list item of level 0 after the outline and before the first table; none if a heading comes first."""
    last = outlined.groupBy("document_id").agg(F.max("ord").alias("gm_last"))
    rows = complete(elements).join(last, "document_id").where(F.col("ord") > F.col("gm_last"))
    stop = F.min(F.when(F.col("type").isin("TABLE", "HEADING", "TITLE"), F.col("ord"))).over(whole_doc())
    inside = rows.withColumn("gm_stop", stop).where(F.coalesce(F.col("ord") < F.col("gm_stop"), F.lit(True)))
    candidate = inside.where((F.col("type") == "LIST_ITEM") & F.col("bold") & F.coalesce(F.col("numbering_level") == 0, F.lit(True)))
    return candidate.withColumn("gm_n", F.count(F.lit(1)).over(whole_doc())).where("gm_n = 1").select("document_id", "ord", "element_id", F.lit(1).alias("outline_level"), F.lit("SECTION").alias("context_role"))
