"""Content regions: runs of one category, with bridges, and the document's routing mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .elements import with_category
from .frames import in_doc, whole_doc, up_to_here

BRIDGES = ["boilerplate", "separator"]
INTERACTION = ["dialogue", "qa", "log"]
EMBEDDABLE = ["list", "table", "code", "formula", "key_value", "visual"]
LOCAL = ["list", "table", "code", "formula", "key_value", "dialogue", "qa", "log"]
REGION, LOCAL_CONFIDENCE, MIXED, SHARE = 0.80, 0.70, 0.70, 0.35
UNIT_CATEGORY = {"DIALOGUE_SEGMENT": "dialogue", "LOG_WINDOW": "log", "QA_PAIR": "qa", "LIST_GROUP": "list"}


def overridden(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Narrative elements of interaction units take the unit's category; blank ones between list items of a unit are list."""
    kinds = F.create_map(*[x for k, v in UNIT_CATEGORY.items() for x in (F.lit(k), F.lit(v))])
    owner = units.select("document_id", F.explode("element_ids").alias("element_id"), kinds[F.col("unit_type")].alias("gm_unit")).where("gm_unit is not null")
    joined = rows.join(owner, ["document_id", "element_id"], "left")
    return joined.withColumn("category", F.when((F.col("category") == "narrative") & F.col("gm_unit").isNotNull(), F.col("gm_unit")).otherwise(F.col("category"))).drop("gm_unit")


def member_rows(elements: DataFrame, categories: bool = False) -> DataFrame:
    """Elements with their region number from 0 and its category; bridges join the region before them, leading ones the first."""
    rows = elements if categories else with_category(elements)
    bridge = F.col("category").isin(BRIDGES)
    own = F.when(~bridge, F.col("category"))
    first = F.min_by(own, F.when(~bridge, F.col("ord"))).over(whole_doc())
    rows = rows.withColumns({"gm_fill": F.coalesce(F.last(own, ignorenulls=True).over(up_to_here()), first), "bridge": bridge})
    # Documents of bridges alone are one region of their most frequent category, the earliest of equals.
    fresh = F.coalesce(F.col("gm_fill") != F.lag("gm_fill").over(in_doc()), F.lit(False))
    return rows.withColumn("region", F.sum(fresh.cast("int")).over(up_to_here())).withColumnRenamed("gm_fill", "region_category")


def segments(elements: DataFrame, *, version: str = "1", categories: bool = False) -> DataFrame:
    """One row for each region: id, category, members, bridges, dominant category, confidence."""
    rows = member_rows(elements, categories)
    upstream = [F.col(c) for c in ("type_confidence", "provenance_confidence") if c in rows.columns]
    least = F.min(F.coalesce(*upstream)) if upstream else F.lit(None).cast("double")
    made = rows.groupBy("document_id", "region").agg(
        F.first("region_category").alias("category"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "element_id"))), lambda x: x["element_id"]).alias("element_ids"), F.count(F.lit(1)).alias("n"), F.sum(F.col("bridge").cast("int")).alias("bridges"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.least(F.lit(REGION), F.coalesce(least, F.lit(1.0))).alias("confidence"), F.sum((F.col("category") == "boilerplate").cast("int")).alias("gm_b"), F.sum((F.col("category") == "separator").cast("int")).alias("gm_s"), F.min_by("category", "ord").alias("gm_first"),
    )
    alone = F.when(F.col("gm_b") > F.col("gm_s"), F.lit("boilerplate")).when(F.col("gm_b") < F.col("gm_s"), F.lit("separator")).otherwise(F.col("gm_first"))
    made = made.withColumn("category", F.coalesce("category", alone))
    rid = T.short_id("region_", F.concat_ws("|", F.lit(version), F.col("region").cast("string"), F.col("category"), F.array_join("element_ids", "|")))
    return made.select("document_id", "region", rid.alias("region_id"), "category", "element_ids", "n", "bridges", "first_ord", "last_ord", "confidence")


def document_mode(elements: DataFrame, global_structure: DataFrame, categories: bool = False) -> DataFrame:
    """Mode of each document after routing (MIXED where categories mix), with the reason; ``global_structure``: document_id, mode."""
    rows = elements if categories else with_category(elements)
    material = rows.where(~F.col("category").isin(*BRIDGES, "unknown"))
    sums = rows.select("document_id").distinct().join(material.groupBy("document_id").agg(F.sort_array(F.collect_set("category")).alias("cats"), F.avg((F.col("category") != "narrative").cast("int")).alias("share")), "document_id", "left")
    sums = sums.withColumns({"cats": F.coalesce("cats", F.array().cast("array<string>")), "share": F.coalesce("share", F.lit(0.0))}).join(global_structure.select("document_id", F.col("mode").alias("global_mode")), "document_id", "left")
    several = F.size("cats") > 1
    acts = F.arrays_overlap("cats", F.array(*map(F.lit, INTERACTION)))
    embedded = F.col("global_mode").isin("HIERARCHICAL", "GROUPED") & (F.size(F.array_except("cats", F.array(*map(F.lit, ["narrative", *EMBEDDABLE])))) == 0)
    reason = F.when(several & acts, F.lit("interaction_pattern_coexists_with_other_content")).when(several & embedded, F.lit("embedded_blocks_preserve_global_hierarchy")).when(several & (F.col("share") >= SHARE), F.lit("material_multi_category_share")).when(several, F.lit("incidental_embedded_content")).otherwise(F.lit("single_or_unknown_pattern"))
    sums = sums.withColumn("reason", reason)
    mixed = F.col("reason").isin("interaction_pattern_coexists_with_other_content", "material_multi_category_share")
    return sums.select("document_id", F.when(mixed, F.lit("MIXED")).otherwise(F.coalesce("global_mode", F.lit("UNKNOWN"))).alias("mode"), "reason", F.col("share").alias("non_narrative_share"), "cats")


def region_modes(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Structure mode of each region from the context nodes anchored in it."""
    members = regions.select("document_id", "region_id", "category", F.explode("element_ids").alias("element_id"))
    anchored = members.join(nodes.select("document_id", "element_id", "node_id", "parent_id"), ["document_id", "element_id"])
    inner = anchored.select("document_id", "region_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("gm_in"))
    sums = anchored.join(inner, ["document_id", "region_id", "parent_id"], "left").groupBy("document_id", "region_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("gm_in").isNotNull().cast("int")).alias("nested"))
    mode = F.when(F.col("nodes") == 1, F.lit("LOCAL")).when(F.col("nested") > 0, F.lit("HIERARCHICAL")).when(F.col("nodes") > 1, F.lit("GROUPED")).when(F.col("category").isin(LOCAL), F.lit("LOCAL")).otherwise(F.lit("UNKNOWN"))
    return regions.select("document_id", "region_id", "category").join(sums, ["document_id", "region_id"], "left").select("document_id", "region_id", mode.alias("mode"))


def unit_region(units: DataFrame, regions: DataFrame) -> DataFrame:
    """The one region that holds all members of a unit; null region_id and a code where there is none or more."""
    members = units.select("document_id", "unit_id", F.explode("element_ids").alias("element_id"))
    owner = regions.select("document_id", "region_id", F.explode("element_ids").alias("element_id"))
    made = members.join(owner, ["document_id", "element_id"], "left").groupBy("document_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.count("region_id").alias("m"), F.countDistinct("region_id").alias("k"), F.min("region_id").alias("region_id"))
    fine = (F.col("k") == 1) & (F.col("m") == F.col("n"))
    code = F.when(F.col("k") > 1, F.lit("UNIT_CROSSES_REGIONS")).when(F.col("m") < F.col("n"), F.lit("UNIT_OUTSIDE_REGIONS"))
    return made.select("document_id", "unit_id", F.when(fine, F.col("region_id")).alias("region_id"), code.alias("code"))
