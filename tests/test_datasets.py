import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import enrichment as E
from glyphmill.operators import studio
from glyphmill.sources import jsonl

HEX = "0123456789abcdef"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes, leaf):
    entries = sorted({h: hashes.count(h) for h in hashes}.items())
    depth = 0
    while leaf * 16**depth < len(entries):
        depth += 1

    def node(prefix):
        if len(prefix) == depth:
            return sha("\n".join(f"{h}:{n}" for h, n in entries if h.startswith(prefix)))
        children = [d for d in HEX if any(h.startswith(prefix + d) for h, _ in entries)]
        return sha("\n".join(f"{d}={node(prefix + d)}" for d in children))

    return "tree:" + node("")


@pytest.mark.parametrize("leaf", [1, 4, 4096])
def test_tree_hash_is_its_definition_under_any_partitioning(spark, leaf):
    rng = random.Random(leaf)
    groups = {"a": [sha(str(rng.randrange(400))) for _ in range(300)], "b": [sha("x")] * 3, None: [sha("y"), sha("z")]}
    rows = [(g, h) for g, hs in groups.items() for h in hs]
    want = {g: plain_tree(hs, leaf) for g, hs in groups.items()}
    for n in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, h string").repartition(n)
        assert {r.g: r.tree_hash for r in studio.tree_hash(df, ["g"], "h", leaf=leaf).collect()} == want
    whole = studio.tree_hash(spark.createDataFrame(rows, "g string, h string"), [], "h", leaf=leaf).first()[0]
    assert whole == plain_tree([h for _, h in rows], leaf)
    assert studio.tree_hash(df.where("false"), ["g"], "h").count() == 0


def test_a_split_is_frozen_by_several_tasks(spark, tmp_path):
    cases = spark.createDataFrame([("train", f"c{i}", json.dumps({"i": i})) for i in range(40)] + [("test", "t", "{}")], "split string, case_id string, payload string")
    first = jsonl.freeze(cases, f"file://{tmp_path}/a", {"by": "x"}, parts=6)
    second = jsonl.freeze(cases.repartition(3), f"file://{tmp_path}/b", {"by": "x"}, parts=1)
    assert first == second and jsonl.verify(spark, f"file://{tmp_path}/a") == []
    assert len(list((tmp_path / "a/data/split=train").glob("part-*"))) > 1


def test_saving_leaves_one_table_at_any_time(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    rows = lambda *ids: spark.createDataFrame([(i, v) for i, v in ids], "record_id string, v int")
    jsonl.save_many(rows(("a", 0)).limit(0), rows(("a", 1), ("b", 1)), path)
    old = spark.read.schema("record_id string, v int").json(path)
    jsonl.save_many(old, rows(("b", 2), ("c", 2)), path)
    assert [(r.record_id, r.v) for r in spark.read.schema("record_id string, v int").json(path).orderBy("record_id").collect()] == [("a", 1), ("b", 2), ("c", 2)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["records"]


def test_line_numbers_across_parts(spark, tmp_path):
    lines = {"a.jsonl": [f"line {i} " + "x" * (i % 50) for i in range(500)], "b.jsonl": ["", "one", ""]}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        made = jsonl.numbered_lines(spark, f"file://{tmp_path}")
        assert made.select(F.spark_partition_id()).distinct().count() > 1
        assert {(r.file, r.number): r.line for r in made.collect()} == {(f, i + 1): x for f, own in lines.items() for i, x in enumerate(own)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def bundle(root, change=None):
    """A benchmark of three cases; ``change`` edits the manifest, the annotations by name, or the sources."""
    sources = {f"sources/d{i}.txt": f"text {i}" for i in range(3)}
    cases = [{"document_id": f"d{i}", "source_file": f"sources/d{i}.txt", "annotation_file": f"gold/d{i}.json", "sha256": "sha256:" + sha(f"text {i}")} for i in range(3)]
    manifest = {"benchmark_version": "1", "schema_version": "2", "cases": cases}
    notes = {f"gold/d{i}.json": {"document_id": f"d{i}", "benchmark_version": "1", "schema_version": "2", "source": {"sha256": cases[i]["sha256"], "file_name": f"d{i}.txt"}} for i in range(3)}
    if change:
        change(manifest, notes, sources)
    for name, value in {**sources, **{k: json.dumps(v) for k, v in notes.items()}, "manifest.json": json.dumps(manifest)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(value)
    return f"file://{root}"


TAMPER = {
    None: lambda m, n, s: None,
    "PATH_ESCAPES_ROOT": lambda m, n, s: m["cases"][1].update(source_file="sources/../../other.txt"),
    "SOURCE_UNREADABLE": lambda m, n, s: s.pop("sources/d1.txt"),
    "SOURCE_HASH_MISMATCH": lambda m, n, s: s.update({"sources/d1.txt": "changed"}),
    "ANNOTATION_UNREADABLE": lambda m, n, s: n.pop("gold/d1.json"),
    "DOCUMENT_ID_MISMATCH": lambda m, n, s: n["gold/d1.json"].update(document_id="d2"),
    "GOLD_HASH_MISMATCH": lambda m, n, s: n["gold/d1.json"]["source"].update(sha256="sha256:0"),
    "FILE_NAME_MISMATCH": lambda m, n, s: n["gold/d1.json"]["source"].update(file_name="else.txt"),
    "BENCHMARK_VERSION_MISMATCH": lambda m, n, s: n["gold/d1.json"].update(benchmark_version="0"),
    "SCHEMA_VERSION_MISMATCH": lambda m, n, s: n["gold/d1.json"].update(schema_version=None),
}


@pytest.mark.parametrize("code", TAMPER)
def test_each_tampering_has_its_code(spark, tmp_path, code):
    cases, issues = jsonl.load_benchmark(spark, bundle(tmp_path, TAMPER[code]))
    assert sorted(r.document_id for r in cases.collect()) == (["d0", "d1", "d2"] if code is None else ["d0", "d2"])
    assert [(r.document_id, r.code) for r in issues.collect()] == ([] if code is None else [("d1", code)])


def test_freeze_inputs(spark):
    cases = spark.createDataFrame([("train",), ("dev",)], "split string")
    dealt = spark.createDataFrame([("train",), ("test",)], "split string")
    made = jsonl.freeze_input_issues(cases, dealt, {"split_manifest_hash": "a", "compiler_version": "1"}, {"split_manifest_hash": "b", "compiler_version": "1"}, ("test", "train"))
    assert sorted((r.subject, r.code) for r in made.collect()) == [("dev", "SPLIT_NOT_ASSIGNED"), ("split_manifest_hash", "SPLIT_MANIFEST_HASH_MISMATCH"), ("test", "ASSIGNED_SPLIT_EMPTY"), ("test", "REQUIRED_SPLIT_MISSING")]
    assert jsonl.freeze_input_issues(cases, cases, {"v": "1"}, {"v": "1"}, ("train",)).count() == 0


# Enrichment

COMMON = {"provider": "p", "provider_version": "1", "configuration_hash": "c", "capability_hash": "k", "policy_hash": "o", "capability": "m", "language": "en"}


def scoped(spark, *rows):
    base = {"document_id": "d", "unit_id": "u", "scope_rank": 0, "type": "NOTE", "value": "v", "confidence": 0.9, "ord": 0, "method": "RULE_PRIOR", "mode": "EXTRACTIVE", "source": "RULE", **COMMON}
    return spark.createDataFrame([{**base, "annotation_id": f"a{i}", "ord": i, **r} for i, r in enumerate(rows)], "document_id string, unit_id string, annotation_id string, scope_rank int, type string, value string, confidence double, ord long, method string, mode string, source string, " + ", ".join(f"{c} string" for c in COMMON))


def decisions(spark, *rows):
    base = {**COMMON, "type": "NOTE", "target_kind": "ELEMENT", "status": "APPROVED"}
    return spark.createDataFrame([{**base, **r} for r in rows or ({}, {"type": "DEFINITION"})], ", ".join(f"{c} string" for c in base))


def unit(spark, text="the text of it", most=None, refs=None):
    return spark.createDataFrame([("d", "u", text, len(text.split()), most, "1", refs)], f"document_id string, unit_id string, text string, token_count int, max_tokens int, version string, refs {E.REFS}")


def enriched(spark, notes, policy=None, gate=(), **kw):
    return E.enrich_units(unit(spark, **kw), scoped(spark, *notes), decisions(spark, *gate), policy or E.EnrichmentPolicy()).first()


def test_lines_that_do_not_fit_are_skipped_and_the_next_is_tried(spark):
    notes = [{"value": "one two", "confidence": 0.99}, {"value": "a b c d e f g h i j", "confidence": 0.98}, {"value": "three", "confidence": 0.97}]
    r = enriched(spark, notes, E.EnrichmentPolicy(tokens=9))
    assert r.text == "Semantic context:\nNote: one two\nNote: three\nthe text of it" and (r.rendered, r.skipped, r.chosen) == (["a0", "a2"], ["a1"], ["a0", "a1", "a2"])
    assert (r.token_count, r.base_unit_id, r.version, len(r.refs)) == (11, "u", "1+sem3", 3) and r.unit_id.startswith("ru_") and len(r.unit_id) == 35
    r = enriched(spark, notes, most=9)  # the unit's own limit counts the text too
    assert (r.rendered, r.skipped) == (["a0"], ["a1", "a2"])
    r = enriched(spark, notes, most=3)
    assert (r.rendered, r.text, r.chosen) == ([], "the text of it", ["a0", "a1", "a2"])


def test_only_exactly_approved_annotations_count(spark):
    for change in [{"provider_version": "2"}, {"configuration_hash": "x"}, {"capability_hash": "x"}, {"policy_hash": "x"}, {"language": "vi"}, {"type": "WARNING"}, {"scope_rank": 1}, {"scope_rank": 2}, {"provider": None}]:
        r = enriched(spark, [change])
        assert (r.unit_id, r.base_unit_id, r.text, r.chosen) == ("u", None, "the text of it", []), change
    assert enriched(spark, [{}], gate=({"status": "REJECTED"},)).chosen == []
    assert enriched(spark, [{}], gate=({}, {"status": "REJECTED"})).chosen == []
    outcomes = E.judged(scoped(spark, {}, {"type": "CUSTOM"}, {"method": "GUESS"}, {"confidence": 0.5}, {"language": "fr", "confidence": 0.1}, {"method": None}), decisions(spark))
    assert [r.outcome for r in outcomes.orderBy("ord").collect()] == ["CANDIDATE", "DISALLOWED_TYPE", "UNTRUSTED_CONFIDENCE", "LOW_CONFIDENCE", "UNEVALUATED", "UNTRUSTED_CONFIDENCE"]


def test_order_repeats_and_references(spark):
    notes = [{"value": "Straße"}, {"value": " STRASSE "}, {"value": "x", "confidence": 0.95}, {"type": "DEFINITION", "value": "z"}, {"value": "w" * 3000}, {"value": "made up", "mode": "GENERATIVE"}]
    r = enriched(spark, notes, E.EnrichmentPolicy(tokens=None), refs=[("a0", "NOTE", "old", "HUMAN", 1.0)])
    assert r.chosen == ["a2", "a3", "a0", "a4", "a5"]
    assert [(x.id, x.value) for x in r.refs] == [("a0", "old"), ("a2", "x"), ("a3", "z"), ("a4", None), ("a5", None)]
    assert "Definition: z" in r.text and "made up" not in r.text and "Note: " + "w" * 383 + "…" in r.text
    assert enriched(spark, [{"value": str(i)} for i in range(9)]).chosen == [f"a{i}" for i in range(6)]
    assert enriched(spark, [{}]).unit_id != enriched(spark, [{}], text="other").unit_id


def test_gate_against_manifest(spark):
    manifest = spark.createDataFrame([("d", "p", "1", "c", "k", "o"), ("e", "p", "1", "x", "k", "o"), ("f", "q", "1", "c", "k", "o")], "document_id string, provider string, provider_version string, configuration_hash string, capability_hash string, policy_hash string")
    made = E.gate_conflicts(decisions(spark), manifest)
    assert sorted((r.document_id, r.code) for r in made.collect()) == [("e", "CONFIGURATION_HASH_DIFFERS"), ("f", "PROVIDER_NOT_IN_MANIFEST")]
