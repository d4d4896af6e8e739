import hashlib

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import assembly as A
from glyphmill.sources import docx, texts

HASH = "sha256:" + "0" * 64


def build(spark, change=None, version=None, content_hash=HASH):
    """A document of three elements, two units, a chain of two contexts and one relation; ``change`` edits the rows of a stage."""
    rows = {
        "elements": [("d", 0, "e0"), ("d", 1, "e1"), ("d", 2, "e2")],
        "units": [("d", "u0", ["e0"]), ("d", "u1", ["e1", "e2"])],
        "contexts": [("d", "c0", None), ("d", "c1", "c0")],
        "relations": [("d", "r0", "e0", "u1", "NEXT")],
        "regions": [("d", "g0", ["e0", "e1"])],
    }
    if change:
        change(rows)
    schemas = {"elements": "document_id string, ord long, element_id string", "units": "document_id string, unit_id string, element_ids array<string>", "contexts": "document_id string, node_id string, parent_id string", "relations": "document_id string, relation_id string, source_id string, target_id string, type string", "regions": "document_id string, region_id string, element_ids array<string>"}
    documents = spark.createDataFrame([("d", content_hash, version)], "document_id string, content_hash string, structure_version string")
    return A.assemble(documents, "7", **{k: spark.createDataFrame(v, schemas[k]) for k, v in rows.items()})


CASES = {
    "ID_NOT_UNIQUE": lambda r: r["units"].append(("d", "u0", [])),
    "NAMESPACES_OVERLAP": lambda r: r["units"].append(("d", "e0", [])),
    "ORDER_NOT_DENSE": lambda r: r["elements"].append(("d", 7, "e7")),
    "UNIT_MEMBER_UNKNOWN": lambda r: r["units"].append(("d", "u2", ["e9"])),
    "UNIT_MEMBER_TWICE": lambda r: r["units"].append(("d", "u2", ["e0"])),
    "REGION_MEMBER_UNKNOWN": lambda r: r["regions"].append(("d", "g1", ["u0"])),
    "REGION_MEMBER_TWICE": lambda r: r["regions"].append(("d", "g1", ["e1"])),
    "CONTEXT_PARENT_UNKNOWN": lambda r: r["contexts"].append(("d", "c2", "c9")),
    "RELATION_END_UNKNOWN": lambda r: r["relations"].append(("d", "r1", "e0", "x", "NEXT")),
    "RELATION_TWICE": lambda r: r["relations"].append(("d", "r1", "e0", "u1", "NEXT")),
}


@pytest.mark.parametrize("code", CASES)
def test_each_rule_has_its_code(spark, code):
    assert build(spark, CASES[code]).first().violations == [code]


def test_a_valid_document_and_its_own_facts(spark):
    row = build(spark, lambda r: r["elements"].reverse()).first()
    assert row.violations == [] and row.structure_version == "7" and [e.element_id for e in row.elements] == ["e0", "e1", "e2"]
    assert build(spark, version="7").first().violations == []
    assert build(spark, version="6").first().violations == ["STRUCTURE_VERSION_CONFLICT"]
    assert build(spark, content_hash="md5:1").first().violations == ["CONTENT_HASH_MALFORMED"]
    documents = spark.createDataFrame([("empty", HASH)], "document_id string, content_hash string")
    elements = spark.createDataFrame([("other", 0, "e")], "document_id string, ord long, element_id string")
    assert A.assemble(documents, "7", elements=elements).first().violations == ["NO_ELEMENTS"]
    assert [(r.document_id, r.n, r.stage) for r in A.orphans(documents, elements=elements).collect()] == [("other", 1, "elements")]


def test_adapters_run_with_their_audits(spark):
    body = b"# A\n\ntext\n"
    good = "sha256:" + hashlib.sha256(body).hexdigest()
    files = spark.createDataFrame([("a", body, good), ("b", body, "sha256:1"), ("c", b"", None), ("d", body, None)], "document_id string, content binary, content_hash string")
    read = lambda f: texts.markdown(f.select("document_id", F.col("content").cast("string").alias("text")))
    made, issues = A.run_adapter(files, read)
    assert {(r.document_id, r.code) for r in issues.collect()} == {("b", "CONTENT_HASH_MISMATCH"), ("c", "NO_ELEMENTS")}
    assert sorted((r.document_id, r.ord, r.type) for r in made.collect()) == [(d, i, t) for d in "ad" for i, t in enumerate(("HEADING", "SEPARATOR", "PARAGRAPH"))]
    assert {r.content_hash for r in made.collect()} == {good}
    assert [r.code for r in A.run_adapter(files.where("document_id = 'c'").drop("content_hash"), docx.docx)[1].collect()] == []
