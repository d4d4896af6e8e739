"""Quality and completeness of a processed document, and the integrity of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import complete
from .grouping import INTEGRITY_SENSITIVE

WEIGHTS = {"accounted": 0.40, "certainty": 0.30, "integrity": 0.30}
UNKNOWN_PENALTY, LOW_ACCOUNTED, HIGH_UNKNOWN = 0.50, 0.80, 0.20


def unresolved_boundaries(boundaries: DataFrame, units: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Boundaries flagged as unresolved whose two sides are neither in one unit nor in two native groups."""
    flagged = boundaries.where(F.array_contains("reasons", "CONTENT_INTEGRITY_UNRESOLVED"))
    owner = units.select("document_id", F.explode("element_ids").alias("element_id"), F.col("unit_id").alias("owner"))
    side = lambda c: owner.select("document_id", F.col("element_id").alias(c), F.col("owner").alias(f"{c}_owner"))
    rows = flagged.join(side("left_id"), ["document_id", "left_id"], "left").join(side("right_id"), ["document_id", "right_id"], "left")
    owned = F.coalesce(F.col("left_id_owner") == F.col("right_id_owner"), F.lit(False))
    if spans is not None:
        native = spans.select("document_id", F.explode("element_ids").alias("element_id"), F.col("integrity_group_id").alias("g"))
        mine = lambda c: native.select("document_id", F.col("element_id").alias(c), F.col("g").alias(f"{c}_g"))
        rows = rows.join(mine("left_id"), ["document_id", "left_id"], "left").join(mine("right_id"), ["document_id", "right_id"], "left")
        owned = owned | F.coalesce(F.col("left_id_g") != F.col("right_id_g"), F.lit(False))
    return rows.where(~owned).select("document_id", "ord", "left_id", "right_id")


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def structure_quality(elements: DataFrame, boundaries: DataFrame, units: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Score of each document from accounted elements, certain boundaries and intact content, less unknown types; with warnings."""
    rows = complete(elements)
    owned = units.select("document_id", F.explode("element_ids").alias("element_id")).distinct().withColumn("gm_owned", F.lit(True))
    structural = F.col("type").isin("TITLE", "HEADING", "SEPARATOR")
    base = rows.join(owned, ["document_id", "element_id"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("elements"), F.sum((F.col("gm_owned").isNotNull() | structural).cast("int")).alias("accounted"), F.sum((F.col("type") == "UNKNOWN").cast("int")).alias("unknown"))
    bounds = boundaries.groupBy("document_id").agg(F.count(F.lit(1)).alias("boundaries"), F.sum((F.col("class") == "UNKNOWN").cast("int")).alias("unknown_boundaries"), F.sum(F.array_contains("reasons", "CONTENT_INTEGRITY_UNRESOLVED").cast("int")).alias("flagged"))
    open_ = unresolved.groupBy("document_id").agg(F.count(F.lit(1)).alias("unresolved"))
    made = base.join(bounds, "document_id", "left").join(open_, "document_id", "left").fillna(0, ["boundaries", "unknown_boundaries", "flagged", "unresolved"])
    made = made.withColumns({"accounted_ratio": F.col("accounted") / F.col("elements"), "unknown_ratio": F.col("unknown") / F.col("elements"), "unknown_boundary_ratio": _share(F.col("unknown_boundaries"), F.col("boundaries"), 0.0), "integrity_ratio": 1.0 - _share(F.col("unresolved"), F.col("flagged"), 0.0)})
    raw = WEIGHTS["accounted"] * F.col("accounted_ratio") + WEIGHTS["certainty"] * (1.0 - F.col("unknown_boundary_ratio")) + WEIGHTS["integrity"] * F.col("integrity_ratio")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (1.0 - UNKNOWN_PENALTY * F.col("unknown_ratio"))))
    warnings = F.array_compact(F.array(F.when(F.col("accounted_ratio") < LOW_ACCOUNTED, F.lit("LOW_ACCOUNTED_RATIO")), F.when(F.col("unknown_boundary_ratio") > HIGH_UNKNOWN, F.lit("HIGH_UNKNOWN_BOUNDARY_RATIO")), F.when(F.col("unknown_ratio") > HIGH_UNKNOWN, F.lit("HIGH_UNKNOWN_TYPE_RATIO"))))
    return made.select("document_id", score.alias("score"), "accounted_ratio", "unknown_boundary_ratio", "integrity_ratio", "unknown_ratio", warnings.alias("warnings"))


def completion(elements: DataFrame, units: DataFrame, unresolved: DataFrame, modes: DataFrame, regions: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Whether each document is structurally ready, and the counts that decide it."""
    owned = units.select("document_id", F.explode("element_ids").alias("element_id")).distinct().withColumn("gm_owned", F.lit(True))
    covered = regions.select("document_id", F.explode("element_ids").alias("element_id")).distinct().withColumn("gm_region", F.lit(True))
    rows = complete(elements).join(owned, ["document_id", "element_id"], "left").join(covered, ["document_id", "element_id"], "left")
    one = lambda c: F.sum(c.cast("int"))
    made = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("elements"), one(F.col("gm_owned").isNotNull()).alias("grouped"), one(F.col("gm_owned").isNull() & F.col("type").isin(INTEGRITY_SENSITIVE)).alias("loose_sensitive"), one(F.col("gm_region").isNotNull()).alias("in_regions"))
    count = lambda d, n: d.groupBy("document_id").agg(F.count(F.lit(1)).alias(n))
    made = made.join(count(units, "units"), "document_id", "left").join(count(unresolved, "unresolved"), "document_id", "left").join(modes.select("document_id", "mode"), "document_id", "left")
    made = made.join(count(issues, "issues"), "document_id", "left") if issues is not None else made.withColumn("issues", F.lit(0))
    made = made.fillna(0, ["units", "unresolved", "issues"])
    ready = (F.col("unresolved") == 0) & (F.col("loose_sensitive") == 0) & ((F.coalesce("mode", F.lit("UNKNOWN")) != "MIXED") | (F.col("in_regions") == F.col("elements"))) & (F.col("issues") == 0)
    return made.withColumn("structural_ready", ready)


def document_violations(elements: DataFrame, units: DataFrame, nodes: DataFrame, regions: DataFrame, relations: DataFrame) -> DataFrame:
    """Broken rules of a document's tables: ids, orders, members, overlaps, endpoints and parents; no rows is a sound document."""
    tag = lambda d, ns, c: d.select("document_id", F.lit(ns).alias("namespace"), F.col(c).alias("id"))
    ids = tag(elements, "element", "element_id").unionByName(tag(units, "unit", "unit_id")).unionByName(tag(nodes, "context", "node_id")).unionByName(tag(regions, "region", "region_id"))
    twice = ids.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("namespace").alias("k")).where("n > 1").select("document_id", "id", F.when(F.col("k") > 1, F.lit("ID_IN_SEVERAL_NAMESPACES")).otherwise(F.lit("ID_NOT_UNIQUE")).alias("code"))
    orders = elements.groupBy("document_id", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("element_id").alias("id")).where("n > 1").select("document_id", "id", F.lit("ORDER_NOT_UNIQUE").alias("code"))
    known = elements.select("document_id", "element_id")
    members = lambda d, c, code: d.select("document_id", F.col(c).alias("id"), F.explode("element_ids").alias("element_id")).join(known, ["document_id", "element_id"], "left_anti").select("document_id", "id", F.lit(code).alias("code"))
    overlap = regions.select("document_id", "region_id", F.explode("element_ids").alias("element_id")).groupBy("document_id", "element_id").agg(F.countDistinct("region_id").alias("n")).where("n > 1").select("document_id", F.col("element_id").alias("id"), F.lit("REGIONS_OVERLAP").alias("code"))
    ends = relations.select("document_id", F.col("relation_id").alias("rid"), F.explode(F.array("source_id", "target_id")).alias("id")).join(ids.select("document_id", "id"), ["document_id", "id"], "left_anti").select("document_id", F.col("rid").alias("id"), F.lit("RELATION_ENDPOINT_UNKNOWN").alias("code"))
    parents = nodes.where("parent_id is not null").select("document_id", "node_id", F.col("parent_id").alias("p")).join(nodes.select("document_id", F.col("node_id").alias("p")), ["document_id", "p"], "left_anti").select("document_id", F.col("node_id").alias("id"), F.lit("CONTEXT_PARENT_UNKNOWN").alias("code"))
    out = twice.unionByName(orders).unionByName(members(units, "unit_id", "UNIT_MEMBER_UNKNOWN")).unionByName(members(regions, "region_id", "REGION_MEMBER_UNKNOWN"))
    return out.unionByName(overlap).unionByName(ends).unionByName(parents)


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Element counts that stages (each with document_id and element_count) report, where they disagree."""
    out = None
    for name, d in stages.items():
        part = d.select("document_id", F.lit(name).alias("stage"), F.col("element_count").cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("document_id").agg(F.countDistinct("n").alias("k"), F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("counts")).where("k > 1")


def only_annotations_added(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Tables that a semantic stage changed although it may only add annotations: name and number of rows that differ."""
    out = None
    for name, old in before.items():
        if name == "annotations":
            continue
        changed = old.exceptAll(after[name]).unionByName(after[name].exceptAll(old))
        part = changed.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def semantic_coverage(annotations: DataFrame) -> DataFrame:
    """Distinct targets, mean confidence, and counts by type, source and provider of each document."""
    return annotations.groupBy("document_id").agg(F.countDistinct("target_id").alias("targets"), F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("annotations"), *[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("type", "source", "provider") if c in annotations.columns])


def merge_metrics(base: DataFrame, more: DataFrame) -> DataFrame:
    """Metrics (document_id, metric, value) of two stages as one table, and where they conflict."""
    both = base.select("document_id", "metric", F.col("value").alias("a")).join(more.select("document_id", "metric", F.col("value").alias("b")), ["document_id", "metric"], "full_outer")
    return both.select("document_id", "metric", F.coalesce("a", "b").alias("value"), (F.col("a") != F.col("b")).alias("conflict")).fillna(False, ["conflict"])
