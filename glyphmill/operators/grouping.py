"""Logical units: pairs, runs and blocks of elements that belong together, in order of priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .boundaries import annotate
from .frames import until_here, in_doc, whole_doc, up_to_here, complete, islands
from .signals import PARENTHESISED

CONFIDENCE = {"QA_EXPLICIT": 0.95, "QA_LEXICAL": 0.80, "LIST_GROUP": 0.85, "DIALOGUE_SEGMENT": 0.90, "LOG_WINDOW": 0.90, "ATOMIC": 0.95, "TEXT_BLOCK": 0.70, "UNKNOWN_GROUP": 0.50}
TEXT_TYPES = ["PARAGRAPH", "SENTENCE", "LINE", "CAPTION", "FOOTNOTE"]
#: Unit type of each element type that is a unit alone.
ATOMIC = {"TABLE": "TABLE_BLOCK", "CODE": "CODE_BLOCK", "LIST": "LIST_GROUP", "KEY_VALUE": "KEY_VALUE_GROUP", "FORMULA": "FORMULA_BLOCK"}
INTEGRITY_SENSITIVE = ["LIST", "LIST_ITEM", "TABLE", "TABLE_ROW", "TABLE_CELL", "CODE", "QUESTION", "ANSWER"]


def with_boundaries(elements: DataFrame) -> DataFrame:
    """Elements with markers and, from the second of a document on, the boundary before them."""
    return annotate(elements)


def _broken(soft: bool = False) -> Column:
    return F.col("class").isin("HARD", "UNKNOWN", *(["SOFT"] if soft else []))


def _units(members: DataFrame, key: list[str], kind: Column, confidence: Column, least: int = 1) -> DataFrame:
    """One row for each group of member rows: ordered element ids, id, capped confidence."""
    upstream = F.coalesce("type_confidence", "provenance_confidence")
    made = members.groupBy("document_id", *key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "element_id"))), lambda x: x["element_id"]).alias("element_ids"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.count(F.lit(1)).alias("n"), F.first(kind).alias("unit_type"), F.least(F.first(confidence), F.coalesce(F.min(upstream), F.lit(1.0))).alias("confidence"),
    )
    made = made.where(F.col("n") >= least)
    return made.select("document_id", T.short_id("lu_", F.concat_ws("|", F.col("unit_type"), F.array_join("element_ids", "|"))).alias("unit_id"), "unit_type", "element_ids", "first_ord", "last_ord", "n", "confidence")


def runs(rows: DataFrame, element_type: str, unit_type: str, least: int = 2) -> DataFrame:
    """Maximal runs of one element type that no hard or unknown boundary cuts."""
    return _units(islands(rows, F.col("type") == element_type, _broken()), ["island"], F.lit(unit_type), F.lit(CONFIDENCE[unit_type]), least)


def dialogue_segments(rows: DataFrame, least: int = 2) -> DataFrame:
    return runs(rows, "DIALOGUE_TURN", "DIALOGUE_SEGMENT", least)


def log_windows(rows: DataFrame, least: int = 2) -> DataFrame:
    return runs(rows, "LOG_ENTRY", "LOG_WINDOW", least)


def qa_members(rows: DataFrame) -> DataFrame:
    """Rows of non-overlapping guarded pairs from left to right, with pair number and rule.

    In a chain of overlapping candidates every second one counts from the left: the parity of the place in the chain decides.
    """
    guarded = (F.col("class") == "NONE") & (F.col("guard") == "QA_PAIR")
    marked = rows.withColumn("gm_left", F.coalesce(F.lead(guarded).over(in_doc()), F.lit(False)))
    # A left side that the row before is also the left side of continues a chain.
    fresh = F.col("gm_left") & ~F.coalesce(F.lag("gm_left").over(in_doc()), F.lit(False))
    marked = marked.withColumn("gm_chain", F.sum(fresh.cast("int")).over(up_to_here()))
    place = F.sum(F.col("gm_left").cast("int")).over(Window.partitionBy("document_id", "gm_chain").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("gm_take", F.col("gm_left") & (place % 2 == 1))
    explicit = (F.col("type") == "QUESTION") & (F.lead("type").over(in_doc()) == "ANSWER")
    marked = marked.withColumn("rule", F.when(explicit, F.lit("EXPLICIT_TYPE")).otherwise(F.lit("LEXICAL_MARKER")))
    marked = marked.withColumn("gm_second", F.coalesce(F.lag("gm_take").over(in_doc()), F.lit(False)))
    marked = marked.withColumn("pair", F.when(F.col("gm_take"), F.col("ord")).when(F.col("gm_second"), F.lag("ord").over(in_doc())))
    marked = marked.withColumn("rule", F.when(F.col("gm_take"), F.col("rule")).otherwise(F.lag("rule").over(in_doc())))
    return marked.where("pair is not null")


def qa_pairs(rows: DataFrame) -> DataFrame:
    confidence = F.when(F.col("rule") == "EXPLICIT_TYPE", F.lit(CONFIDENCE["QA_EXPLICIT"])).otherwise(F.lit(CONFIDENCE["QA_LEXICAL"]))
    return _units(qa_members(rows), ["pair"], F.lit("QA_PAIR"), confidence)


def _without(rows: DataFrame, *units: DataFrame) -> DataFrame:
    """Rows whose element no unit has yet."""
    for u in units:
        taken = u.select("document_id", F.explode("element_ids").alias("element_id"))
        rows = rows.join(taken, ["document_id", "element_id"], "left_anti")
    return rows


def _free_of(units: DataFrame, *earlier: DataFrame) -> DataFrame:
    """Units none of whose members an earlier unit has."""
    for e in earlier:
        hit = units.select("document_id", "unit_id", F.explode("element_ids").alias("element_id")).join(e.select("document_id", F.explode("element_ids").alias("element_id")), ["document_id", "element_id"], "left_semi").select("document_id", "unit_id").distinct()
        units = units.join(hit, ["document_id", "unit_id"], "left_anti")
    return units


def lexical_lists(rows: DataFrame, consumed: Column | None = None, *, least: int = 2, bridges: int = 1) -> DataFrame:
    """Runs of marked paragraphs with at most ``bridges`` blank ones between, parenthesised or introduced by a list item that ends in a colon."""
    used = F.lit(False) if consumed is None else F.coalesce(consumed, F.lit(False))
    blank = (F.col("type") == "PARAGRAPH") & (F.length(T.strip(F.coalesce("text", F.lit("")))) == 0) & ~used
    parenthesised = F.coalesce(F.col("text").rlike(PARENTHESISED), F.lit(False))
    marker = (F.col("type") == "PARAGRAPH") & ~used & (F.col("numbering_marker").isNotNull() | parenthesised)
    rows = rows.withColumns({"gm_blank": blank & ~marker, "gm_marker": marker, "gm_paren": parenthesised, "gm_cut": F.coalesce(_broken(), F.lit(False))})
    before = rows.withColumns({
        "gm_prev": F.last(F.when(F.col("gm_marker"), F.col("ord")), ignorenulls=True).over(until_here()),
        "gm_rank": F.row_number().over(in_doc()), "gm_cuts": F.sum(F.col("gm_cut").cast("int")).over(up_to_here()), "gm_blanks": F.sum(F.col("gm_blank").cast("int")).over(up_to_here()),
    })
    at = lambda c: F.last(F.when(F.col("gm_marker"), F.col(c)), ignorenulls=True).over(until_here())
    before = before.withColumns({"gm_p_rank": at("gm_rank"), "gm_p_cuts": at("gm_cuts"), "gm_p_blanks": at("gm_blanks")})
    between = F.col("gm_rank") - F.col("gm_p_rank") - 1
    joins = F.col("gm_marker") & F.col("gm_prev").isNotNull() & (F.col("gm_cuts") == F.col("gm_p_cuts")) & (between <= bridges) & (F.col("gm_blanks") - F.col("gm_p_blanks") == between)
    # What the paragraph before a run of markers, blanks skipped, says.
    told = F.last(F.when(~F.col("gm_blank"), F.struct(F.col("type").alias("t"), F.rtrim(F.coalesce("text", F.lit(""))).alias("x"))), ignorenulls=True).over(until_here())
    before = before.withColumns({"gm_fresh": F.col("gm_marker") & ~F.coalesce(joins, F.lit(False)), "gm_told": told})
    before = before.withColumn("gm_run", F.sum(F.col("gm_fresh").cast("int")).over(up_to_here()))
    last = F.max(F.when(F.col("gm_marker"), F.col("ord"))).over(Window.partitionBy("document_id", "gm_run"))
    count = F.sum(F.col("gm_marker").cast("int")).over(Window.partitionBy("document_id", "gm_run"))
    introduced = F.col("gm_paren") | ((F.col("gm_told.t") == "LIST_ITEM") & F.col("gm_told.x").endswith(":"))
    fit = F.max(F.when(F.col("gm_fresh"), introduced)).over(Window.partitionBy("document_id", "gm_run"))
    before = before.withColumns({"gm_last": last, "gm_count": count, "gm_fit": fit})
    members = before.where((F.col("gm_run") > 0) & (F.col("gm_marker") | F.col("gm_blank")) & (F.col("ord") <= F.col("gm_last")) & (F.col("gm_count") >= least) & F.coalesce("gm_fit", F.lit(False)))
    return _units(members, ["gm_run"], F.lit("LIST_GROUP"), F.lit(CONFIDENCE["LIST_GROUP"]))


def atomic_units(rows: DataFrame) -> DataFrame:
    kinds = F.create_map(*[x for k, v in ATOMIC.items() for x in (F.lit(k), F.lit(v))])
    return _units(rows.where(F.col("type").isin(list(ATOMIC))), ["ord"], kinds[F.col("type")], F.lit(CONFIDENCE["ATOMIC"]))


def text_blocks(rows: DataFrame, free: Column, merge_soft: bool = True) -> DataFrame:
    """Runs of unconsumed text types between boundaries."""
    return _units(islands(rows, F.col("type").isin(TEXT_TYPES) & free, _broken(not merge_soft)), ["island"], F.lit("TEXT_BLOCK"), F.lit(CONFIDENCE["TEXT_BLOCK"]))


def group(elements: DataFrame) -> DataFrame:
    """All logical units by priority: QA, dialogue, log, lexical list, atomic, text block, unknown."""
    rows = with_boundaries(elements)
    qa = qa_pairs(rows)
    dialogue = _free_of(dialogue_segments(rows), qa)
    log = _free_of(log_windows(rows), qa, dialogue)
    taken = lambda *us: _tag(rows, *us)
    lists = lexical_lists(taken(qa, dialogue, log), F.col("gm_used"))
    atomic = atomic_units(rows)
    texts = text_blocks(taken(qa, dialogue, log, lists), ~F.col("gm_used"))
    unknown = _units(rows.where(F.col("type") == "UNKNOWN"), ["ord"], F.lit("UNKNOWN_GROUP"), F.lit(CONFIDENCE["UNKNOWN_GROUP"]))
    out = qa
    for u in (dialogue, log, lists, atomic, texts, unknown):
        out = out.unionByName(u)
    return out


def _tag(rows: DataFrame, *units: DataFrame) -> DataFrame:
    """Rows with gm_used: whether a unit has the element."""
    taken = None
    for u in units:
        part = u.select("document_id", F.explode("element_ids").alias("element_id"))
        taken = part if taken is None else taken.unionByName(part)
    return rows.join(taken.withColumn("gm_used", F.lit(True)), ["document_id", "element_id"], "left").withColumn("gm_used", F.coalesce("gm_used", F.lit(False)))


def ungrouped(elements: DataFrame, units: DataFrame) -> DataFrame:
    return _without(complete(elements), units).select("document_id", "ord", "element_id", "type")


def subdocuments(elements: DataFrame) -> DataFrame:
    """Parts of documents with two or more explicit titles; what is before the first is left out, and a separator before the next is trimmed."""
    rows = with_boundaries(elements)
    start = (F.col("type") == "TITLE") & (F.col("source") == "EXPLICIT") & (F.col("class").isNull() | ((F.col("class") == "HARD") & F.array_contains("reasons", "EXPLICIT_STRUCTURE_START")))
    rows = rows.withColumn("gm_start", F.coalesce(start, F.lit(False))).withColumn("part", F.sum(F.col("gm_start").cast("int")).over(up_to_here()))
    rows = rows.withColumns({"gm_starts": F.sum(F.col("gm_start").cast("int")).over(whole_doc()), "gm_next": F.coalesce(F.lead("gm_start").over(in_doc()), F.lit(False))})
    members = rows.where((F.col("part") > 0) & (F.col("gm_starts") >= 2) & ~(F.col("gm_next") & (F.col("type") == "SEPARATOR")))
    made = members.groupBy("document_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "element_id"))), lambda x: x["element_id"]).alias("element_ids"), F.min_by("text", "ord").alias("label"), F.min("ord").alias("first_ord"))
    return made.select("document_id", T.short_id("subdoc_", F.array_join("element_ids", "|")).alias("subdocument_id"), "element_ids", F.when(F.length("label") <= 2048, F.col("label")).alias("label"), "first_ord", F.lit(0.85).alias("confidence"))


def integrity_spans(elements: DataFrame) -> DataFrame:
    """Elements grouped by their native integrity id: ordered ids, family, parent group, and whether anything foreign lies inside."""
    rows = complete(elements).withColumn("gm_rank", F.row_number().over(in_doc())).where("integrity_group_id is not null")
    made = rows.groupBy("document_id", "integrity_group_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "element_id"))), lambda x: x["element_id"]).alias("element_ids"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.count(F.lit(1)).alias("n"), (F.max("gm_rank") - F.min("gm_rank") + 1).alias("extent"), F.max("integrity_parent_group_id").alias("parent_group_id"), F.countDistinct("integrity_parent_group_id").alias("parents"),
        F.min_by("type", "ord").alias("first_type"), F.min_by("numbering_id", "ord").alias("numbering_id"), F.min_by("number_format", "ord").alias("number_format"), F.min_by("source_zone", "ord").alias("source_zone"),
    )
    return made.withColumn("interleaved", F.col("n") != F.col("extent"))


def nesting_violations(spans: DataFrame) -> DataFrame:
    """Native groups whose parent is missing, is themselves, or is named more than once."""
    parents = spans.select("document_id", F.col("integrity_group_id").alias("parent_group_id"), F.lit(True).alias("found"))
    joined = spans.join(parents, ["document_id", "parent_group_id"], "left")
    code = F.when(F.col("parents") > 1, F.lit("PARENT_AMBIGUOUS")).when(F.col("parent_group_id") == F.col("integrity_group_id"), F.lit("PARENT_IS_SELF")).when(F.col("parent_group_id").isNotNull() & F.col("found").isNull(), F.lit("PARENT_MISSING"))
    return joined.select("document_id", "integrity_group_id", code.alias("code")).where("code is not null")


def coalesce_lists(spans: DataFrame, gaps: DataFrame, *, max_blanks: int = 2) -> DataFrame:
    """Neighbouring list spans with equal numbering merged across short gaps; ``gaps``: document_id, first_ord of the later span, blanks, crossable."""
    rows = spans.where(F.col("first_type") == "LIST_ITEM").join(gaps, ["document_id", "first_ord"], "left")
    w = Window.partitionBy("document_id").orderBy("first_ord")
    same = F.col("numbering_id").eqNullSafe(F.lag("numbering_id").over(w)) & F.col("number_format").eqNullSafe(F.lag("number_format").over(w)) & F.col("source_zone").eqNullSafe(F.lag("source_zone").over(w))
    fresh = ~F.coalesce(same & F.coalesce("crossable", F.lit(False)) & (F.coalesce("blanks", F.lit(0)) <= max_blanks), F.lit(False))
    rows = rows.withColumn("merged", F.sum((fresh | (F.row_number().over(w) == 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("document_id", "merged").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("first_ord", "element_ids"))), lambda x: x["element_ids"])).alias("element_ids"), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"), F.sort_array(F.collect_set("integrity_group_id")).alias("group_ids"))
