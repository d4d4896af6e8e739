"""Context forest: headings with levels, parents by nearest smaller level, and each element's path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .frames import until_here, in_doc, whole_doc, up_to_here
from .signals import NAVIGATION, with_markers

LEVELS = 65
CONFIDENCE = {"EXPLICIT": 0.95, "INFERRED": 0.75, "DERIVED": 0.80}
STRUCTURE = {"LOCAL": 0.60, "GROUPED": 0.70, "HIERARCHICAL": 0.85}


def numbering_depth(marker: Column) -> Column:
    """Dots and one for 1.2.3; 1 for flat markers; null for others."""
    bare = F.regexp_replace(F.trim(marker), "[.)]$", "")
    return F.when(bare.rlike("^\\d+(\\.\\d+)+$"), F.regexp_count(bare, F.lit("\\.")) + 1).when(bare.rlike("^(\\d+|[A-Za-z]|[IVXLCDMivxlcdm]+)$"), F.lit(1))


def candidates(elements: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Elements with is_node, level, node_type, level_source, label and confidence."""
    rows = with_markers(elements)
    if outline is None:
        rows = rows.withColumns({"outline_level": F.lit(None).cast("int"), "context_role": F.lit(None).cast("string")})
    else:
        rows = rows.join(outline.select("document_id", "element_id", "outline_level", "context_role"), ["document_id", "element_id"], "left")
    structural = F.col("type").isin("TITLE", "HEADING")
    label = T.strip(F.coalesce("source_label", "text", F.lit("")))
    node = (structural | F.col("outline_level").isNotNull()) & (F.length(label) > 0)
    level = F.when(F.col("outline_level").isNotNull(), F.col("outline_level")).when(F.col("type") == "TITLE", F.lit(0)).when(F.col("heading_level").between(1, 64), F.col("heading_level")).otherwise(F.coalesce(numbering_depth(F.col("numbering_marker")), F.lit(1)))
    from_ = F.when(F.col("outline_level").isNotNull(), F.lit("OUTLINE_LEVEL")).when(F.col("type") == "TITLE", F.lit("ELEMENT_TYPE")).when(F.col("heading_level").between(1, 64), F.lit("HEADING_LEVEL")).when(F.col("numbering_marker").isNotNull(), F.lit("NUMBERING_MARKER")).otherwise(F.lit("DEFAULT_HEADING_LEVEL"))
    source = F.when(F.col("outline_level").isNotNull(), F.lit("INFERRED")).otherwise(F.coalesce("source", F.lit("DERIVED")))
    base = F.when(source == "EXPLICIT", CONFIDENCE["EXPLICIT"]).when(source == "INFERRED", CONFIDENCE["INFERRED"]).otherwise(CONFIDENCE["DERIVED"])
    return rows.withColumns({"is_node": node, "level": F.when(node, level.cast("int")), "node_type": F.when(node, F.coalesce("context_role", "type")), "level_source": F.when(node, from_), "label": F.when(node, F.substring(label, 1, 2048)), "node_source": F.when(node, source), "confidence": F.when(node, F.least(base, F.coalesce("type_confidence", F.lit(1.0))))})


def calibrate_root(rows: DataFrame, *, min_headings: int = 3, min_navigation: int = 3) -> DataFrame:
    """Re-bases levels where the first heading is the document's title: two adjacent headings of one level, or contents lines after it."""
    heading = F.col("is_node") & (F.col("type") == "HEADING")
    rows = rows.withColumn("gm_h", F.when(heading, F.row_number().over(Window.partitionBy("document_id", heading).orderBy("ord"))))
    at = lambda n, c: F.max(F.when(F.col("gm_h") == n, c)).over(whole_doc())
    rows = rows.withColumns({"gm_first": at(1, F.col("ord")), "gm_second": at(2, F.col("ord")), "gm_l1": at(1, F.col("heading_level")), "gm_l2": at(2, F.col("heading_level")), "gm_numbered": at(1, F.col("numbering_marker").isNotNull().cast("int")), "gm_heads": F.max("gm_h").over(whole_doc()), "gm_zero": F.max((F.col("level") == 0).cast("int")).over(whole_doc())})
    inside = (F.col("ord") > F.col("gm_first")) & (F.col("ord") < F.col("gm_second")) & F.col("text").rlike(NAVIGATION)
    rows = rows.withColumn("gm_nav", F.sum(F.coalesce(inside, F.lit(False)).cast("int")).over(whole_doc()))
    eligible = (F.coalesce("gm_zero", F.lit(0)) == 0) & (F.col("gm_heads") >= min_headings) & (F.col("gm_first") == 0) & (F.col("gm_numbered") == 0)
    adjacent = eligible & (F.col("gm_second") == F.col("gm_first") + 1) & (F.col("gm_l1") == F.col("gm_l2")) & (F.col("gm_heads") >= 4)
    rows = rows.withColumn("gm_mode", F.when(adjacent, F.lit("ADJACENT")).when(eligible & (F.col("gm_nav") >= min_navigation), F.lit("NAVIGATION")))
    section = F.col("gm_h") > F.when(F.col("gm_mode") == "ADJACENT", 2).otherwise(1)
    native = F.col("heading_level").between(1, 64)
    base = F.min_by(F.when(section & native, F.col("heading_level")), F.when(section & native, F.col("ord"))).over(whole_doc())
    rows = rows.withColumn("gm_base", base)
    relative = F.when(F.col("heading_level") <= F.col("gm_base"), F.lit(1)).otherwise(1 + F.col("heading_level") - F.col("gm_base"))
    based = F.col("gm_mode").isNotNull() & section & native & F.col("numbering_marker").isNull() & F.col("gm_base").isNotNull() & (relative != F.col("level"))
    root = F.col("gm_mode").isNotNull() & (F.col("gm_h") == 1)
    second = (F.col("gm_mode") == "ADJACENT") & (F.col("gm_h") == 2)
    level = F.when(root, 0).when(second, 1).when(based, relative).otherwise(F.col("level")).cast("int")
    kind = F.when(root, F.lit("DOCUMENT_TITLE")).when(second, F.lit("DOCUMENT_SUBTITLE")).otherwise(F.col("node_type"))
    changed = F.coalesce(root | second | based, F.lit(False))
    how = F.when(root & (F.col("gm_mode") == "ADJACENT"), F.lit("INFERRED_ADJACENT_TITLE_SUBTITLE_ROOT")).when(root, F.lit("INFERRED_NAVIGATION_PRECEDED_ROOT")).when(second, F.lit("INFERRED_ADJACENT_DOCUMENT_SUBTITLE")).when(based, F.lit("INFERRED_ROOT_RELATIVE_HEADING_LEVEL")).otherwise(F.col("level_source"))
    rows = rows.withColumns({"level": level, "node_type": kind, "level_source": how, "node_source": F.when(changed, F.lit("INFERRED")).otherwise(F.col("node_source")), "confidence": F.when(changed, F.least("confidence", F.lit(0.80))).otherwise(F.col("confidence"))})
    return rows.drop(*[c for c in rows.columns if c.startswith("gm_")])


def _stack(window) -> Column:
    """Last node of each level in the window."""
    return F.array(*[F.last(F.when(F.col("level") == n, F.struct("ord", "node_id")), ignorenulls=True).over(window) for n in range(LEVELS)])


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds node_id, parent_id and path (ids of the nodes on the stack after the element).

    A node of level L stands on the stack if no node of a smaller or the same level came after it: its place is
    beyond the last places of all smaller levels.  So a window of the last node of each level gives the whole stack.
    """
    nid = T.joined_id("ctx_", F.col("element_id"), F.col("node_type"), F.col("level").cast("string"), F.col("label"))
    rows = rows.withColumn("node_id", F.when(F.col("is_node"), nid))
    rows = rows.withColumns({"gm_now": _stack(up_to_here()), "gm_before": _stack(until_here())})
    start = F.struct(F.lit(-1).cast("int").alias("top"), F.array().cast("array<string>").alias("path"))
    step = lambda a, x: F.when(x.isNotNull() & (x["ord"] > a["top"]), F.struct(x["ord"].cast("int").alias("top"), F.concat(a["path"], F.array(x["node_id"])).alias("path"))).otherwise(a)
    rows = rows.withColumn("path", F.aggregate("gm_now", start, step, lambda a: a["path"]))
    smaller = F.array_max(F.array_compact(F.slice("gm_before", F.lit(1), F.greatest(F.col("level"), F.lit(1)))))
    rows = rows.withColumn("parent_id", F.when(F.col("is_node") & (F.col("level") > 0), smaller["node_id"]))
    return rows.drop("gm_now", "gm_before")


def build(elements: DataFrame, outline: DataFrame | None = None, calibrate: bool = True) -> DataFrame:
    """Elements with their context: node columns and path."""
    rows = candidates(elements, outline)
    return with_paths(calibrate_root(rows) if calibrate else rows)


def nodes(built: DataFrame) -> DataFrame:
    return built.where("is_node").select("document_id", "ord", "element_id", "node_id", "parent_id", "node_type", "level", "label", "level_source", F.col("node_source").alias("source"), "confidence")


def structure(built: DataFrame) -> DataFrame:
    """Mode and confidence of each document's context, with its ratios."""
    node = F.col("is_node")
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    made = built.groupBy("document_id").agg(F.count(F.lit(1)).alias("elements"), one(node).alias("nodes"), one(node & F.col("parent_id").isNotNull()).alias("nested"), one(node & (F.col("node_source") == "EXPLICIT")).alias("explicit"), F.avg(F.when(node, F.col("confidence"))).alias("mean"))
    mode = F.when(F.col("nodes") == 0, F.lit("UNKNOWN")).when(F.col("nodes") == 1, F.lit("LOCAL")).when(F.col("nested") > 0, F.lit("HIERARCHICAL")).otherwise(F.lit("GROUPED"))
    made = made.withColumn("mode", mode)
    cap = F.create_map(*[x for k, v in STRUCTURE.items() for x in (F.lit(k), F.lit(v))])[F.col("mode")]
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return made.select("document_id", "mode", F.when(F.col("nodes") > 0, F.least(cap, F.col("mean"))).alias("confidence"), ratio("nodes", "elements").alias("context_node_ratio"), ratio("nested", "nodes").alias("nested_context_ratio"), ratio("explicit", "nodes").alias("explicit_context_ratio"))


def common_path(members: DataFrame, key: list[str]) -> DataFrame:
    """Longest common prefix of the paths of each group (rows of key and path)."""
    positions = members.select(*key, F.posexplode_outer("path").alias("pos", "node"))
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    full = positions.where("node is not null").groupBy(*key, "pos").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("node").alias("k"), F.min("node").alias("node")).join(sizes, key).where("m = n and k = 1")
    # Positions 0..p that all agree: those whose rank among the agreeing ones equals their position.
    w = Window.partitionBy(*key).orderBy("pos")
    led = full.withColumn("gm_rank", F.row_number().over(w) - 1).where("gm_rank = pos")
    paths = led.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("path"))
    return sizes.select(*key).join(paths, key, "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def heading_violations(elements: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Explicit titles and headings, not first in their document, that no hard boundary with an explicit start precedes."""
    rows = with_markers(elements).withColumn("gm_rank", F.row_number().over(in_doc())).where(F.col("type").isin("TITLE", "HEADING") & (F.col("source") == "EXPLICIT") & (F.col("gm_rank") > 1))
    joined = rows.select("document_id", "ord", "element_id").join(boundaries.select("document_id", "ord", "class", "reasons"), ["document_id", "ord"], "left")
    fine = (F.col("class") == "HARD") & F.array_contains("reasons", "EXPLICIT_STRUCTURE_START")
    return joined.where(~F.coalesce(fine, F.lit(False))).select("document_id", "ord", "element_id", F.lit("HEADING_WITHOUT_HARD_START").alias("code"))


def tree_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths from the roots of a forest given as id and parent_id, however deep; ids that no root reaches have none.

    Each round a path is joined to the one of the id it has come up to, so its length doubles: a forest of depth d takes
    about log2(d) joins.
    """
    root = roots.select("id").distinct().withColumn("done", F.lit(True))
    state = cut(edges.join(root, "id", "left").select("id", F.when(F.col("done").isNull(), F.col("parent_id")).alias("up"), F.array("id").alias("path")))
    # what is done has nothing above; rows above which there is no id are left out
    before, open_ = -1, state.where("up is not null").count()
    state = state.join(root, "id", "left").where("done or up is not null").drop("done")
    while open_ not in (0, before):
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("head"))
        grown = state.where("up is not null").join(above, "up").select("id", F.col("further").alias("up"), F.concat("head", "path").alias("path"))
        state = cut(state.where("up is null").unionByName(grown))
        before, open_ = open_, state.where("up is not null").count()
    return state.where("up is null").select("id", (F.size("path") - 1).alias("depth"), "path")


def cycles(edges: DataFrame) -> DataFrame:
    """Ids whose chain of parents never ends: those left when leaves of the parent relation are taken off level by level."""
    from .mutations import unreachable

    return unreachable(edges)
