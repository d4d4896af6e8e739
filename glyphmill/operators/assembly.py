"""From files to checked documents: running a source adapter with its audits, and assembling stage tables into one row a document.

Stage tables are grouped by document first and joined by it then, so each is shuffled once and a
document is the largest thing that any task holds.  Checks look at the assembled row alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elements as E

#: Stages of a document with the column their rows are sorted by.
STAGES = {"elements": "ord", "units": "unit_id", "contexts": "node_id", "relations": "relation_id", "regions": "region_id", "subdocuments": "subdocument_id", "assets": "asset_id"}


def run_adapter(files: DataFrame, adapter: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Normalised elements of files (document_id, content, and content_hash where one is expected), and the issues of files.

    A file whose bytes do not have the expected hash, that gives no elements, or of which normalisation loses a raw field has
    the first such code, and none of its elements are given.
    """
    found = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    wanted = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
    seen = files.select("document_id", found.alias("content_hash"), wanted.alias("wanted"))
    raw = adapter(files.select("document_id", "content"))
    made = E.normalise(raw if "type_hint" in raw.columns else raw.withColumnRenamed("type", "type_hint"))
    audit = E.preservation(raw, made, ("raw_text", "source"))
    whole = F.col("same_cardinality") & (F.col("kept_raw_text") == F.col("n")) & (F.col("kept_source") == F.col("n"))
    checked = seen.join(audit.select("document_id", whole.alias("whole"), "raw_count"), "document_id", "left")
    code = F.when(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("content_hash")), F.lit("CONTENT_HASH_MISMATCH")).when(F.coalesce("raw_count", F.lit(0)) == 0, F.lit("NO_ELEMENTS")).when(~F.col("whole"), F.lit("NOT_PRESERVED"))
    checked = checked.select("document_id", "content_hash", code.alias("code"))
    return made.join(checked.where("code is null").select("document_id", "content_hash"), "document_id"), checked.where("code is not null")


def assemble(documents: DataFrame, version: str, **stages: DataFrame) -> DataFrame:
    """``documents`` (document_id, content_hash, and structure_version where one is stated) with an array for each stage and ``violations``.

    Known stages: elements (element_id, ord), units (unit_id, element_ids), contexts (node_id, parent_id), relations (relation_id,
    source_id, target_id, type), regions (region_id, element_ids), subdocuments, assets.  A document without rows of a stage has an empty array.
    """
    out = documents
    for name, by in STAGES.items():
        if name in stages:
            rest = [c for c in stages[name].columns if c not in ("document_id", by)]
            rows = stages[name].groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(by, *rest))).alias(name))
            kind = rows.schema[name].dataType.simpleString()
            out = out.join(rows, "document_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    stated = F.col("structure_version") if "structure_version" in documents.columns else F.lit(None).cast("string")
    out = out.withColumns({"violations": _violations(set(stages), stated, version), "structure_version": F.lit(version)})
    return out


def _violations(there: set[str], stated: Column, version: str) -> Column:
    """Codes of rules that the assembled row breaks, in the order of the rules."""
    none = F.array().cast("array<string>")
    each = lambda name, c: F.transform(name, lambda x: x[c].cast("string")) if name in there else none
    ids = {"elements": each("elements", "element_id"), "units": each("units", "unit_id"), "contexts": each("contexts", "node_id"), "regions": each("regions", "region_id"), "subdocuments": each("subdocuments", "subdocument_id")}
    every = F.concat(*ids.values())
    twice = lambda a: F.size(a) != F.size(F.array_distinct(a))
    beyond = lambda a, b: F.size(F.array_except(a, b)) > 0
    members = lambda name: F.flatten(F.transform(name, lambda x: x["element_ids"].cast("array<string>"))) if name in there else none
    parents = F.filter(each("contexts", "parent_id"), lambda x: x.isNotNull())
    ends = F.concat(each("relations", "source_id"), each("relations", "target_id"))
    triples = F.transform("relations", lambda r: F.concat_ws("|", r["source_id"].cast("string"), r["target_id"].cast("string"), r["type"])) if "relations" in there else none
    orders = F.transform("elements", lambda x: x["ord"].cast("long")) if "elements" in there else F.array().cast("array<long>")
    rules = [
        (~F.coalesce(F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)), "CONTENT_HASH_MALFORMED"), (stated.isNotNull() & (stated != version), "STRUCTURE_VERSION_CONFLICT"), (F.size(ids["elements"]) == 0, "NO_ELEMENTS"),
        (F.greatest(*[twice(a) for a in ids.values()]), "ID_NOT_UNIQUE"), (twice(every) & ~F.greatest(*[twice(a) for a in ids.values()]), "NAMESPACES_OVERLAP"),
        (F.coalesce((F.array_min(orders) != 0) | (F.array_max(orders) != F.size(orders) - 1), F.lit(False)) | twice(orders), "ORDER_NOT_DENSE"), (beyond(members("units"), ids["elements"]), "UNIT_MEMBER_UNKNOWN"), (twice(members("units")), "UNIT_MEMBER_TWICE"),
        (beyond(members("regions"), ids["elements"]), "REGION_MEMBER_UNKNOWN"), (twice(members("regions")), "REGION_MEMBER_TWICE"), (beyond(parents, ids["contexts"]), "CONTEXT_PARENT_UNKNOWN"), (beyond(ends, every), "RELATION_END_UNKNOWN"), (twice(triples), "RELATION_TWICE"),
    ]
    return F.array_compact(F.array(*[F.when(wrong, F.lit(code)) for wrong, code in rules]))


def orphans(documents: DataFrame, **stages: DataFrame) -> DataFrame:
    """How many rows of each stage belong to no document."""
    out = None
    for name, rows in stages.items():
        lost = rows.join(documents.select("document_id"), "document_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        out = lost if out is None else out.unionByName(lost)
    return out
