"""Boundary scores between neighbouring elements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import CODE_TYPES, in_doc, TABLE_TYPES, same_family
from .signals import SECTION_MARKERS, with_markers


@dataclass(frozen=True)
class BoundaryPolicy:
    explicit: float = 1.0
    style: float = 0.25
    type_change: float = 0.30
    separator: float = 1.0
    pattern: float = 0.45
    paragraph_break: float = 0.30
    soft: float = 0.25
    hard: float = 0.80


def style_change(left: str = "l_", right: str = "") -> Column:
    """Share of changed fields among those that both sides have; 0 without any."""
    fields = ("bold", "font_size", "indentation", "alignment")
    both = {f: F.col(left + f).isNotNull() & F.col(right + f).isNotNull() for f in fields}
    comparable = sum((c.cast("int") for c in both.values()), F.lit(0))
    changed = sum((F.when(c & (F.col(left + f) != F.col(right + f)), 1).otherwise(0) for f, c in both.items()), F.lit(0))
    return F.when(comparable == 0, F.lit(0.0)).otherwise(changed / comparable)


def score_boundaries(elements: DataFrame, policy: BoundaryPolicy | None = None, markers: tuple[str, ...] = SECTION_MARKERS) -> DataFrame:
    """A row for each pair of neighbours, keyed by the right element's ord: class, score, guard, reasons and components."""
    rows = annotate(elements, policy, markers).where("boundary_id is not null")
    return rows.select("document_id", "ord", "boundary_id", F.col("l_element_id").alias("left_id"), F.col("element_id").alias("right_id"), "class", "score", "guard", "reasons", "explicit", "style_change", "type_change", "separator", "pattern_start", "paragraph_break")


def annotate(elements: DataFrame, policy: BoundaryPolicy | None = None, markers: tuple[str, ...] = SECTION_MARKERS) -> DataFrame:
    """Elements with markers and the boundary before them (nulls at a document's first); one window over the document, no join."""
    p = policy or BoundaryPolicy()
    rows = with_markers(elements, markers)
    carried = ["element_id", "type", "integrity_group_id", "question_marker", "bold", "font_size", "indentation", "alignment"]
    rows = rows.withColumns({f"l_{c}": F.lag(c).over(in_doc()) for c in carried})
    left, right = F.col("l_type"), F.col("type")
    native = F.when(F.col("l_integrity_group_id") == F.col("integrity_group_id"), F.lit("SAME")).when(F.col("l_integrity_group_id") != F.col("integrity_group_id"), F.lit("DIFFERENT"))
    qa = ((left == "QUESTION") & (right == "ANSWER")) | (F.col("l_question_marker").isNotNull() & F.col("answer_marker").isNotNull())
    starts = F.coalesce("numbering_marker", "section_marker", "question_marker", "timestamp_marker", "speaker_marker").isNotNull()
    rows = rows.withColumn("native", native).withColumns({
        "guard": F.when(F.col("native") == "SAME", F.lit("NATIVE_INTEGRITY_GROUP")).when(qa, F.lit("QA_PAIR")),
        "explicit": right.isin("TITLE", "HEADING") & F.coalesce(F.col("source") == "EXPLICIT", F.lit(False)),
        "separator": (left == "SEPARATOR") | (right == "SEPARATOR"),
        "family": same_family(left, right),
        "pattern_start": starts,
        "paragraph_break": (left == "PARAGRAPH") & (right == "PARAGRAPH"),
        "hard_reason": F.when(left.isin(TABLE_TYPES) != right.isin(TABLE_TYPES), F.lit("TABLE_BOUNDARY")).when(left.isin(CODE_TYPES) != right.isin(CODE_TYPES), F.lit("CODE_BOUNDARY")),
    })
    rows = rows.withColumns({"type_change": (left != right) & ~F.col("family"), "style_change": F.when(F.col("family"), F.lit(0.0)).otherwise(style_change())})
    one = lambda c: F.col(c).cast("double")
    score = p.explicit * one("explicit") + p.style * F.col("style_change") + p.type_change * one("type_change") + p.separator * one("separator") + p.pattern * one("pattern_start") + p.paragraph_break * one("paragraph_break")
    rows = rows.withColumn("score", score)
    unknown = (F.col("score") == 0) & (((left == "UNKNOWN") & (right == "UNKNOWN")) | F.col("family"))
    kind = (
        F.when(F.col("guard").isNotNull(), F.lit("NONE")).when(F.col("native") == "DIFFERENT", F.lit("HARD")).when(F.col("explicit") | F.col("separator") | F.col("hard_reason").isNotNull(), F.lit("HARD"))
        .when(unknown, F.lit("UNKNOWN")).when(F.col("score") >= p.hard, F.lit("HARD")).when(F.col("score") >= p.soft, F.lit("SOFT")).otherwise(F.lit("NONE"))
    )
    rows = rows.withColumn("class", kind)
    insufficient = F.col("guard").isNull() & (F.col("class") == "UNKNOWN")
    reasons = [
        ("EXPLICIT_STRUCTURE_START", F.col("explicit")), ("SEPARATOR", F.col("separator")), ("CONTENT_TYPE_CHANGE", F.col("type_change")), ("STYLE_CHANGE", F.col("style_change") > 0), ("PATTERN_START", F.col("pattern_start")),
        ("PARAGRAPH_BREAK", F.col("paragraph_break")), ("NATIVE_INTEGRITY_CONTINUITY", F.col("native") == "SAME"), ("NATIVE_INTEGRITY_BOUNDARY", F.col("native") == "DIFFERENT"),
        ("TABLE_BOUNDARY", F.col("hard_reason") == "TABLE_BOUNDARY"), ("CODE_BOUNDARY", F.col("hard_reason") == "CODE_BOUNDARY"), ("INSUFFICIENT_EVIDENCE", insufficient), ("CONTENT_INTEGRITY_UNRESOLVED", insufficient & F.col("family")),
    ]
    inner = F.col("l_element_id").isNotNull()
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons]))
    rows = rows.withColumns({"boundary_id": F.when(inner, T.joined_id("bnd_", F.col("l_element_id"), F.col("element_id"))), "reasons": F.when(inner, found)})
    return rows.withColumns({"class": F.when(inner, F.col("class")), "score": F.when(inner, F.col("score"))})
