"""Rules of gold documents and gold structures, and the manifest of the providers that annotated a document.

A gold document is one row with its parts as arrays, so every rule is an array function in that row; ``violations``
has the codes of the rules that it breaks, in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _codes(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(code)) for wrong, code in rules]))


def _twice(a: Column) -> Column:
    return F.size(a) != F.size(F.array_distinct(a))


def _beyond(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) > 0


def _target(x: Column) -> Column:
    return F.concat_ws("|", x["kind"], F.array_join(x["element_orders"].cast("array<string>"), ","))


def semantic_gold_violations(gold: DataFrame) -> DataFrame:
    """Gold semantics: elements (ord, raw_text, normalized_text), scopes (kind, element_orders, evaluated_types), annotations (kind,
    element_orders, type, value, evidence of element_order, text_view, start_char, end_char, quoted_text)."""
    orders = F.transform("elements", lambda e: e["ord"])
    scopes = F.transform("scopes", _target)
    scoped = lambda a: F.filter("scopes", lambda s: _target(s) == _target(a))
    sign = lambda a: F.concat_ws("|", _target(a), a["type"], F.lower(T.compact(F.coalesce(a["value"], F.lit("")))), F.array_join(F.transform(a["evidence"], lambda e: F.concat_ws(":", e["element_order"].cast("string"), e["start_char"].cast("string"), e["end_char"].cast("string"))), ","))
    of = lambda e: F.get(F.filter("elements", lambda x: x["ord"] == e["element_order"]), F.lit(0))
    seen = lambda e: F.when(e["text_view"] == "RAW", of(e)["raw_text"]).when(e["text_view"] == "NORMALIZED", of(e)["normalized_text"])
    evidence = lambda bad: F.exists("annotations", lambda a: F.exists(a["evidence"], lambda e: bad(a, e)))
    rules = [
        (_twice(orders), "ORDER_NOT_UNIQUE"), (F.array_sort(orders) != orders, "ELEMENTS_OUT_OF_ORDER"), (F.exists("scopes", lambda s: _beyond(s["element_orders"], orders)), "SCOPE_ELEMENT_UNKNOWN"), (_twice(scopes), "SCOPE_TWICE"),
        (F.exists("annotations", lambda a: _beyond(a["element_orders"], orders)), "TARGET_ELEMENT_UNKNOWN"), (F.exists("annotations", lambda a: F.size(scoped(a)) == 0), "ANNOTATION_WITHOUT_SCOPE"),
        (F.exists("annotations", lambda a: (F.size(scoped(a)) > 0) & ~F.exists(scoped(a), lambda s: F.array_contains(s["evaluated_types"], a["type"]))), "TYPE_NOT_EVALUATED"), (_twice(F.transform("annotations", sign)), "ANNOTATION_TWICE"),
        (evidence(lambda a, e: ~F.array_contains(orders, e["element_order"])), "EVIDENCE_ELEMENT_UNKNOWN"), (evidence(lambda a, e: F.array_contains(orders, e["element_order"]) & ~F.array_contains(a["element_orders"], e["element_order"])), "EVIDENCE_OUTSIDE_TARGET"),
        (evidence(lambda a, e: F.array_contains(orders, e["element_order"]) & seen(e).isNull()), "EVIDENCE_VIEW_MISSING"), (evidence(lambda a, e: e["end_char"] > F.length(seen(e))), "EVIDENCE_OUT_OF_RANGE"),
        (evidence(lambda a, e: (e["end_char"] <= F.length(seen(e))) & (F.substring(seen(e), e["start_char"] + 1, e["end_char"] - e["start_char"]) != e["quoted_text"])), "EVIDENCE_QUOTE_MISMATCH"),
    ]
    return gold.select("document_id", _codes(rules).alias("violations"))


def structure_gold_violations(gold: DataFrame) -> DataFrame:
    """Gold structures: elements (element_id, ord), units (unit_id, type, element_ids), contexts (node_id, parent_id, anchor_id), regions (region_id,
    element_ids), relations (relation_id, type, source_id, target_id), unit_types and relation_types that are evaluated."""
    pick = lambda k, c: F.transform(k, lambda x: x[c])
    ids = {k: pick(k, c) for k, c in (("elements", "element_id"), ("units", "unit_id"), ("contexts", "node_id"), ("regions", "region_id"))}
    every = F.concat(*ids.values())
    place = lambda e: F.get(F.filter("elements", lambda x: x["element_id"] == e), F.lit(0))["ord"]
    members = lambda k: F.flatten(F.transform(k, lambda x: x["element_ids"]))
    jumbled = lambda k: F.exists(k, lambda x: F.array_sort(F.transform(x["element_ids"], place)) != F.transform(x["element_ids"], place))
    orders, anchors = F.transform("elements", lambda x: x["ord"]), F.transform("contexts", lambda x: x["anchor_id"])
    parents = F.filter(F.transform("contexts", lambda x: x["parent_id"]), lambda x: x.isNotNull())
    up = lambda n: F.get(F.filter("contexts", lambda c: c["node_id"] == n), F.lit(0))["parent_id"]
    # a chain with as many steps as there are nodes has come round
    round_ = F.exists(ids["contexts"], lambda n: F.aggregate("contexts", n, lambda at, _: up(at)).isNotNull())
    triples = F.transform("relations", lambda r: F.concat_ws("|", r["type"], r["source_id"], r["target_id"]))
    own_twice = F.greatest(*[_twice(a) for a in ids.values()])
    rules = [
        (own_twice | _twice(F.transform("relations", lambda r: r["relation_id"])), "ID_NOT_UNIQUE"), (~own_twice & _twice(every), "NAMESPACES_OVERLAP"), (_twice(orders), "ORDER_NOT_UNIQUE"), (F.array_sort(orders) != orders, "ELEMENTS_OUT_OF_ORDER"),
        (_beyond(members("units"), ids["elements"]), "UNIT_MEMBER_UNKNOWN"), (jumbled("units"), "UNIT_MEMBERS_OUT_OF_ORDER"), (_beyond(members("regions"), ids["elements"]), "REGION_MEMBER_UNKNOWN"), (jumbled("regions"), "REGION_MEMBERS_OUT_OF_ORDER"),
        (_twice(members("regions")), "REGION_MEMBER_TWICE"), ((F.size("regions") > 0) & _beyond(ids["elements"], members("regions")), "REGIONS_DO_NOT_COVER"), (_beyond(F.transform("units", lambda x: x["type"]), F.col("unit_types")), "UNIT_TYPE_NOT_EVALUATED"),
        (_beyond(anchors, ids["elements"]), "CONTEXT_ANCHOR_UNKNOWN"), (_twice(anchors), "CONTEXT_ANCHOR_TWICE"), (_beyond(parents, ids["contexts"]), "CONTEXT_PARENT_UNKNOWN"), (round_, "CONTEXT_CYCLE"),
        (_beyond(F.flatten(F.transform("relations", lambda r: F.array(r["source_id"], r["target_id"]))), every), "RELATION_END_UNKNOWN"), (_twice(triples), "RELATION_TWICE"), (_twice(F.col("unit_types")) | _twice(F.col("relation_types")), "EVALUATED_TYPE_TWICE"),
        (_beyond(F.transform("relations", lambda r: r["type"]), F.col("relation_types")), "RELATION_TYPE_NOT_EVALUATED"),
    ]
    return gold.select("document_id", _codes(rules).alias("violations"))


def merged_providers(previous: Column, *later: Column) -> Column:
    """Maps of provider to what is stated of it, a later map over an earlier one, in the order of their keys."""
    none = F.create_map().cast("map<string,string>")
    out = F.map_entries(F.coalesce(previous, none))

    def over(old: Column, fresh: Column) -> Column:
        names = F.transform(fresh, lambda e: e["key"])
        return F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["key"])), fresh)

    for m in later:
        out = over(out, F.map_entries(F.coalesce(m, none)))
    return F.map_from_entries(F.array_sort(out))


def rebuilt_manifest(documents: DataFrame, annotations: DataFrame, provider: str, facts: dict[str, str]) -> DataFrame:
    """Documents (document_id, providers, and a map for each fact) with the providers of their annotations (provider, provider_version) and the
    own ``provider`` with its ``facts`` (provider_version and others by column) merged in; of several versions of one provider the greatest counts."""
    seen = annotations.where("provider is not null and provider_version is not null").groupBy("document_id", "provider").agg(F.max("provider_version").alias("v")).groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("provider", "v"))).alias("gm_seen"))
    rows = documents.join(seen, "document_id", "left")
    own = lambda v: F.create_map(F.lit(provider), F.lit(v))
    rows = rows.withColumn("providers", merged_providers(F.col("providers"), F.col("gm_seen"), own(facts["provider_version"])))
    return rows.withColumns({k: merged_providers(F.col(k), own(v)) for k, v in facts.items() if k != "provider_version"}).drop("gm_seen")
