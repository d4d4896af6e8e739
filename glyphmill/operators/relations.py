"""Edges between elements and units, and the continuation of tables over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import in_doc

SEMANTIC = ["EXPLAINS", "REFERS_TO", "SAME_TOPIC", "PREREQUISITE_OF"]


def relation_id(kind: Column, source: Column, target: Column) -> Column:
    return T.joined_id("rel_", kind, source, target)


def _edges(df: DataFrame, kind: str, source: Column, target: Column, confidence: Column | float = 1.0) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("document_id", relation_id(F.lit(kind), source, target).alias("relation_id"), F.lit(kind).alias("type"), F.lit("SEMANTIC" if kind in SEMANTIC else "STRUCTURAL").alias("layer"), source.alias("source_id"), target.alias("target_id"), c.alias("confidence"))


def next_edges(elements: DataFrame) -> DataFrame:
    rows = elements.withColumn("gm_next", F.lead("element_id").over(in_doc())).where("gm_next is not null")
    return _edges(rows, "NEXT", F.col("element_id"), F.col("gm_next"))


def membership_edges(units: DataFrame) -> DataFrame:
    return _edges(units.withColumn("element_id", F.explode("element_ids")), "PART_OF", F.col("element_id"), F.col("unit_id"))


def question_answer_edges(units: DataFrame) -> DataFrame:
    return _edges(units.where("unit_type = 'QA_PAIR' and size(element_ids) = 2"), "QUESTION_ANSWER", F.col("element_ids")[0], F.col("element_ids")[1], F.col("confidence"))


def nesting_edges(spans: DataFrame, unit_of_group: DataFrame) -> DataFrame:
    """Units of native groups as parts of their parent group's unit; ``unit_of_group``: document_id, integrity_group_id, unit_id, confidence."""
    child = unit_of_group.select("document_id", "integrity_group_id", F.col("unit_id").alias("child"), F.col("confidence").alias("c1"))
    parent = unit_of_group.select("document_id", F.col("integrity_group_id").alias("parent_group_id"), F.col("unit_id").alias("parent"), F.col("confidence").alias("c2"))
    rows = spans.where("parent_group_id is not null").join(child, ["document_id", "integrity_group_id"]).join(parent, ["document_id", "parent_group_id"])
    return _edges(rows, "PART_OF", F.col("child"), F.col("parent"), F.least("c1", "c2"))


def footnote_edges(elements: DataFrame) -> DataFrame:
    """Notes of the elements that refer to them: source_anchor struct<kind,id> joined with distinct source_references."""
    anchors = elements.where("source_anchor is not null").select("document_id", F.col("source_anchor.kind").alias("kind"), F.col("source_anchor.id").alias("ref"), F.col("element_id").alias("anchored"))
    refs = elements.select("document_id", "element_id", F.explode("source_references").alias("r")).select("document_id", "element_id", F.col("r.kind").alias("kind"), F.col("r.id").alias("ref")).distinct()
    rows = refs.join(anchors, ["document_id", "kind", "ref"]).where(F.col("kind").isin("footnote", "endnote"))
    return _edges(rows, "FOOTNOTE_OF", F.col("anchored"), F.col("element_id"))


def subdocument_edges(units: DataFrame, subdocuments: DataFrame) -> DataFrame:
    """Units as parts of the one subdocument that holds all their members."""
    contained = unit_subdocument(units, subdocuments).where("code is null and subdocument_id is not null")
    return _edges(contained, "PART_OF", F.col("unit_id"), F.col("subdocument_id"), F.col("confidence"))


def unit_subdocument(units: DataFrame, subdocuments: DataFrame) -> DataFrame:
    """The containing subdocument of each unit, null where none is met, and a code where one is met but does not contain it."""
    members = units.select("document_id", "unit_id", "confidence", F.explode("element_ids").alias("element_id"))
    owner = subdocuments.select("document_id", "subdocument_id", F.col("confidence").alias("c2"), F.explode("element_ids").alias("element_id"))
    made = members.join(owner, ["document_id", "element_id"], "left").groupBy("document_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.count("subdocument_id").alias("m"), F.countDistinct("subdocument_id").alias("k"), F.min("subdocument_id").alias("subdocument_id"), F.least(F.min("confidence"), F.min("c2")).alias("confidence"))
    fine = (F.col("k") == 1) & (F.col("m") == F.col("n"))
    return made.select("document_id", "unit_id", F.when(fine, F.col("subdocument_id")).alias("subdocument_id"), "confidence", F.when((F.col("k") > 0) & ~fine, F.lit("UNIT_CROSSES_SUBDOCUMENTS")).alias("code"))


def continuation_pairs(fragments: DataFrame, *, edge: float = 0.12, width: float = 0.08, lane: float = 0.04, signals: int = 4) -> DataFrame:
    """Table fragments of one document on adjacent pages with the verdict and the first reason against.

    ``fragments``: document_id, fragment_id, page, x0, y0, x1, y1, column_boundaries, column_count, topology, orientation, leading_row_fingerprint.
    """
    side = lambda p: fragments.select("document_id", *[F.col(c).alias(f"{p}_{c}") for c in fragments.columns if c != "document_id"])
    a, b = side("a"), side("b")
    pairs = a.join(b, (a["document_id"] == b["document_id"]) & (F.col("b_page") == F.col("a_page") + 1)).drop(b["document_id"])
    delta = F.array_max(F.zip_with("a_column_boundaries", "b_column_boundaries", lambda x, y: F.abs(x - y)))
    both = F.col("a_orientation").isNotNull() & F.col("b_orientation").isNotNull()
    reason = (
        F.when((1.0 - F.col("a_y1") > edge) | (F.col("b_y0") > edge), F.lit("page_edge_evidence_insufficient"))
        .when(F.col("a_column_count") != F.col("b_column_count"), F.lit("column_count_mismatch"))
        .when((F.size("a_column_boundaries") != F.size("b_column_boundaries")) | (delta > lane), F.lit("column_geometry_mismatch"))
        .when(F.abs((F.col("a_x1") - F.col("a_x0")) - (F.col("b_x1") - F.col("b_x0"))) > width, F.lit("table_width_mismatch"))
        .when(F.col("a_topology") != F.col("b_topology"), F.lit("table_topology_incompatible"))
        .when(both & (F.col("a_orientation") != F.col("b_orientation")), F.lit("page_orientation_mismatch"))
    )
    count = 6 + both.cast("int") + F.coalesce(F.col("a_leading_row_fingerprint") == F.col("b_leading_row_fingerprint"), F.lit(False)).cast("int")
    verdict = F.when(reason.isNotNull(), reason).when(count < signals, F.lit("evidence_insufficient")).otherwise(F.lit("compatible_adjacent_table_fragments"))
    return pairs.select("document_id", F.col("a_fragment_id").alias("left_id"), F.col("b_fragment_id").alias("right_id"), F.col("a_page").alias("left_page"), (verdict == "compatible_adjacent_table_fragments").alias("compatible"), verdict.alias("reason"))


def continuations(fragments: DataFrame, **policy: float) -> DataFrame:
    """Edges of compatible pairs where a page pair has exactly one."""
    good = continuation_pairs(fragments, **policy).where("compatible")
    only = good.withColumn("gm_n", F.count(F.lit(1)).over(Window.partitionBy("document_id", "left_page"))).where("gm_n = 1")
    return _edges(only, "CONTINUES", F.col("left_id"), F.col("right_id"), 0.92)


def fragment_violations(fragments: DataFrame, elements: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Fragments whose page, box or shape is not that of their element."""
    own = elements.select("document_id", F.col("element_id").alias("fragment_id"), *[F.col(c).alias(f"e_{c}") for c in ("page", "x0", "y0", "x1", "y1", "column_count")])
    joined = fragments.join(own, ["document_id", "fragment_id"], "left")
    off = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        off = off | (F.abs(F.col(c) - F.col(f"e_{c}")) > tolerance)
    code = F.when(F.col("e_page").isNull(), F.lit("ELEMENT_MISSING")).when(F.col("page") != F.col("e_page"), F.lit("PAGE_MISMATCH")).when(off, F.lit("BOX_MISMATCH")).when(F.col("column_count") != F.col("e_column_count"), F.lit("SHAPE_MISMATCH"))
    return joined.select("document_id", "fragment_id", code.alias("code")).where("code is not null")


def build(elements: DataFrame, units: DataFrame, subdocuments: DataFrame | None = None, fragments: DataFrame | None = None) -> DataFrame:
    """All structural edges of documents."""
    out = next_edges(elements).unionByName(membership_edges(units)).unionByName(question_answer_edges(units))
    if "source_anchor" in elements.columns:
        out = out.unionByName(footnote_edges(elements))
    if subdocuments is not None:
        out = out.unionByName(subdocument_edges(units, subdocuments))
    if fragments is not None:
        out = out.unionByName(continuations(fragments))
    return out


def duplicate_edges(relations: DataFrame) -> DataFrame:
    """Triples of type, source and target that come more than once."""
    return relations.groupBy("document_id", "type", "source_id", "target_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
