import pytest

from glyphmill.operators import gold as G

EVIDENCE = "array<struct<element_order:int,text_view:string,start_char:int,end_char:int,quoted_text:string>>"
SEMANTIC = f"document_id string, elements array<struct<ord:int,raw_text:string,normalized_text:string>>, scopes array<struct<kind:string,element_orders:array<int>,evaluated_types:array<string>>>, annotations array<struct<kind:string,element_orders:array<int>,type:string,value:string,evidence:{EVIDENCE}>>"


def semantic(spark, change=None):
    row = {"elements": [(0, "The text", None), (1, "more", "more")], "scopes": [("ELEMENT", [0], ["NOTE"])], "annotations": [("ELEMENT", [0], "NOTE", "v", [(0, "RAW", 4, 8, "text")])]}
    if change:
        change(row)
    return G.semantic_gold_violations(spark.createDataFrame([("d", row["elements"], row["scopes"], row["annotations"])], SEMANTIC)).first().violations


def note(**kw):
    base = {"orders": [0], "type": "NOTE", "value": "v", "evidence": [(0, "RAW", 4, 8, "text")]} | kw
    return ("ELEMENT", base["orders"], base["type"], base["value"], base["evidence"])


SEMANTIC_CASES = {
    "ORDER_NOT_UNIQUE": lambda r: r["elements"].append((1, "x", None)),
    "ELEMENTS_OUT_OF_ORDER": lambda r: r["elements"].reverse(),
    "SCOPE_ELEMENT_UNKNOWN": lambda r: r["scopes"].append(("ELEMENT", [7], ["NOTE"])),
    "SCOPE_TWICE": lambda r: r["scopes"].append(("ELEMENT", [0], ["NOTE"])),
    "ANNOTATION_WITHOUT_SCOPE": lambda r: r["annotations"].append(note(orders=[1], evidence=[])),
    "TYPE_NOT_EVALUATED": lambda r: r["annotations"].append(note(type="WARNING")),
    "ANNOTATION_TWICE": lambda r: r["annotations"].append(note(value=" V ")),
    "EVIDENCE_ELEMENT_UNKNOWN": lambda r: r["annotations"].append(note(value="w", evidence=[(9, "RAW", 0, 1, "x")])),
    "EVIDENCE_OUTSIDE_TARGET": lambda r: r["annotations"].append(note(value="w", evidence=[(1, "RAW", 0, 4, "more")])),
    "EVIDENCE_VIEW_MISSING": lambda r: r["annotations"].append(note(value="w", evidence=[(0, "NORMALIZED", 0, 3, "The")])),
    "EVIDENCE_OUT_OF_RANGE": lambda r: r["annotations"].append(note(value="w", evidence=[(0, "RAW", 4, 9, "text")])),
    "EVIDENCE_QUOTE_MISMATCH": lambda r: r["annotations"].append(note(value="w", evidence=[(0, "RAW", 4, 8, "test")])),
}


@pytest.mark.parametrize("code", [None, *SEMANTIC_CASES])
def test_semantic_gold_rules(spark, code):
    assert semantic(spark, SEMANTIC_CASES.get(code)) == ([] if code is None else [code])


STRUCTURE = "document_id string, elements array<struct<element_id:string,ord:int>>, units array<struct<unit_id:string,type:string,element_ids:array<string>>>, contexts array<struct<node_id:string,parent_id:string,anchor_id:string>>, regions array<struct<region_id:string,element_ids:array<string>>>, relations array<struct<relation_id:string,type:string,source_id:string,target_id:string>>, unit_types array<string>, relation_types array<string>"


def structure(spark, change=None):
    row = {"elements": [("e0", 0), ("e1", 1), ("e2", 2)], "units": [("u0", "LIST", ["e0", "e1"])], "contexts": [("c0", None, "e0"), ("c1", "c0", "e1")], "regions": [("g0", ["e0", "e1"]), ("g1", ["e2"])], "relations": [("r0", "NEXT", "e0", "u0")], "unit_types": ["LIST"], "relation_types": ["NEXT"]}
    if change:
        change(row)
    return G.structure_gold_violations(spark.createDataFrame([("d", *row.values())], STRUCTURE)).first().violations


STRUCTURE_CASES = {
    "ID_NOT_UNIQUE": lambda r: r["relations"].append(("r0", "NEXT", "e1", "u0")),
    "NAMESPACES_OVERLAP": lambda r: r["units"].append(("e0", "LIST", [])),
    "ORDER_NOT_UNIQUE": lambda r: r["elements"].__setitem__(1, ("e1", 0)),
    "ELEMENTS_OUT_OF_ORDER": lambda r: (r["elements"].reverse()),
    "UNIT_MEMBER_UNKNOWN": lambda r: r["units"].append(("u1", "LIST", ["e9"])),
    "UNIT_MEMBERS_OUT_OF_ORDER": lambda r: r["units"].append(("u1", "LIST", ["e2", "e1"])),
    "REGION_MEMBER_TWICE": lambda r: r["regions"].append(("g2", ["e0"])),
    "REGIONS_DO_NOT_COVER": lambda r: r["regions"].pop(),
    "UNIT_TYPE_NOT_EVALUATED": lambda r: r["units"].append(("u1", "TABLE", [])),
    "CONTEXT_ANCHOR_UNKNOWN": lambda r: r["contexts"].append(("c2", None, "e9")),
    "CONTEXT_ANCHOR_TWICE": lambda r: r["contexts"].append(("c2", None, "e1")),
    "CONTEXT_PARENT_UNKNOWN": lambda r: r["contexts"].append(("c2", "c9", "e2")),
    "CONTEXT_CYCLE": lambda r: r["contexts"].__setitem__(0, ("c0", "c1", "e0")),
    "RELATION_END_UNKNOWN": lambda r: r["relations"].append(("r1", "NEXT", "e0", "x")),
    "RELATION_TWICE": lambda r: r["relations"].append(("r1", "NEXT", "e0", "u0")),
    "EVALUATED_TYPE_TWICE": lambda r: r["unit_types"].append("LIST"),
    "RELATION_TYPE_NOT_EVALUATED": lambda r: r["relations"].append(("r1", "OWNS", "e0", "u0")),
}


@pytest.mark.parametrize("code", [None, *STRUCTURE_CASES])
def test_structure_gold_rules(spark, code):
    assert structure(spark, STRUCTURE_CASES.get(code)) == ([] if code is None else [code])


def test_manifest_is_rebuilt(spark):
    documents = spark.createDataFrame([("a", {"old": "1", "own": "0"}, {"own": "x"}), ("b", None, None)], "document_id string, providers map<string,string>, hashes map<string,string>")
    notes = spark.createDataFrame([("a", "p", "2"), ("a", "p", "3"), ("a", "old", "2"), ("a", None, "9"), ("b", "p", None)], "document_id string, provider string, provider_version string")
    made = {r.document_id: r for r in G.rebuilt_manifest(documents, notes, "own", {"provider_version": "5", "hashes": "h"}).collect()}
    assert made["a"].providers == {"old": "2", "own": "5", "p": "3"} and made["a"].hashes == {"own": "h"}
    assert made["b"].providers == {"own": "5"} and made["b"].hashes == {"own": "h"}
