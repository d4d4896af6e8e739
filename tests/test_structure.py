from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import boundaries, elements, grouping, hierarchy, regions, relations, retrieval, signals


def frame(spark, rows, **more):
    """Elements of one document from (type, text) or (type, text, {column: value})."""
    made = []
    for i, r in enumerate(rows):
        made.append({"document_id": "d", "ord": i, "element_id": f"e{i}", "type": r[0], "source": "EXPLICIT", "text": r[1], **more, **(r[2] if len(r) > 2 else {})})
    columns = sorted({k for m in made for k in m})
    kinds = {"ord": "int", "bold": "boolean", "font_size": "double", "heading_level": "int", "numbering_level": "int", "type_confidence": "double"}
    return spark.createDataFrame([[m.get(c) for c in columns] for m in made], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def classes(spark, rows):
    return [(r["class"], r.guard) for r in boundaries.score_boundaries(frame(spark, rows)).orderBy("ord").collect()]


def test_lines_and_blocks_cover_the_text(spark):
    text = "one\ntwo\r\n\r\n \nthree\rfour"
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "document_id string, text string")
    lines = elements.line_rows(df).where("document_id = 'd'").orderBy("line").collect()
    assert "".join(r.raw for r in lines) == text and lines[-1].end_char == len(text)
    blocks = elements.text_blocks(df).orderBy("document_id", "ord").collect()
    assert [b.type for b in blocks] == ["PARAGRAPH", "SEPARATOR", "PARAGRAPH"] and "".join(b.raw_text for b in blocks) == text
    assert all(text[b.start_char : b.end_char] == b.raw_text for b in blocks)


def test_normalise_resolves_types_and_counts_line_ends(spark):
    raw = spark.createDataFrame([("d", 0, "a\r\nb\rc", " list-item "), ("d", 1, "é", "strange"), ("d", 2, None, None)], "document_id string, ord int, raw_text string, type_hint string")
    a, b, c = elements.normalise(raw).orderBy("ord").collect()
    assert (a.normalized_text, a.type, a.crlf_count, a.cr_count) == ("a\nb\nc", "LIST_ITEM", 1, 1)
    assert (b.normalized_text, b.type, b.type_unresolved, b.unicode_changed) == ("é", "UNKNOWN", True, True)
    assert (c.normalized_text, c.type, c.type_unresolved) == (None, "UNKNOWN", False)


def test_decoding_is_strict(spark):
    rows = [("a", "x".encode()), ("b", b"\xef\xbb\xbfy"), ("c", b"\xff\xfe\x00\x00"), ("d", b"\xff"), ("e", "z".encode("utf-16"))]
    got = {r.id: (r.text, r.error) for r in elements.decode_utf8(spark.createDataFrame(rows, "id string, content binary")).collect()}
    assert got == {"a": ("x", None), "b": ("y", None), "c": (None, "UTF32_UNSUPPORTED"), "d": (None, "INVALID_UTF8"), "e": ("z", None)}


def test_profile_has_no_dominant_category_on_ties(spark):
    r = elements.content_profile(frame(spark, [("PARAGRAPH", "a"), ("CODE", "b")])).first()
    assert r.dominant_category is None and r.category_switches == 1 and r.share_code == 0.5
    r = elements.content_profile(frame(spark, [("PARAGRAPH", "a"), ("TITLE", ""), ("CODE", "b")])).first()
    assert r.dominant_category == "narrative" and r.text_count == 2


def test_preservation_counts_changes_null_safely(spark):
    a = spark.createDataFrame([("d", 0, "x", None), ("d", 1, "y", "s")], "document_id string, ord int, raw_text string, source string")
    b = spark.createDataFrame([("d", 0, "x", None), ("d", 2, "z", "s")], "document_id string, ord int, raw_text string, source string")
    r = elements.preservation(a, b, ("raw_text", "source")).first()
    assert (r.n, r.kept_raw_text, r.kept_source, r.same_cardinality) == (3, 1, 1, True)


@pytest.mark.parametrize(("text", "kind", "value"), [("1.2 x", "NUMBERING_MARKER", "1.2"), ("a) x", "NUMBERING_MARKER", "a)"), ("Chapter: x", "SECTION_MARKER", "Chapter"), ("Q: why", "QUESTION_MARKER", "Q:"), ("answer - so", "ANSWER_MARKER", "answer -"), ("[10:30] x", "TIMESTAMP_PATTERN", "[10:30]"), ("2024-01-02 10:30 x", "TIMESTAMP_PATTERN", "2024-01-02 10:30"), ("Ann: hi", "SPEAKER_LABEL_CANDIDATE", "Ann")])
def test_lexical_signals(spark, text, kind, value):
    got = signals.extract_signals(frame(spark, [("PARAGRAPH", text)])).where("source = 'INFERRED'").collect()
    assert [(r.kind, r.text_value) for r in got] == [(kind, value)]


def test_signals_of_attributes_and_transitions(spark):
    rows = [("HEADING", "x", {"heading_level": 2, "bold": True}), ("LIST_ITEM", "1. y", {"numbering_level": 0, "number_format": "decimal"})]
    got = Counter(r.kind for r in signals.extract_signals(frame(spark, rows)).collect())
    assert got == Counter(["ELEMENT_TYPE", "ELEMENT_TYPE", "HEADING_LEVEL", "STYLE_BOLD", "NUMBERING_LEVEL", "NUMBERING_FORMAT", "ELEMENT_TYPE_TRANSITION"])


def test_boundary_classes(spark):
    assert classes(spark, [("PARAGRAPH", "a"), ("HEADING", "b")]) == [("HARD", None)]
    assert classes(spark, [("PARAGRAPH", "a"), ("PARAGRAPH", "b")]) == [("SOFT", None)]
    assert classes(spark, [("UNKNOWN", "a"), ("UNKNOWN", "b")]) == [("UNKNOWN", None)]
    assert classes(spark, [("QUESTION", "a"), ("ANSWER", "b")]) == [("NONE", "QA_PAIR")]
    assert classes(spark, [("PARAGRAPH", "Q: a"), ("PARAGRAPH", "A: b")]) == [("NONE", "QA_PAIR")]
    assert classes(spark, [("PARAGRAPH", "a"), ("CODE", "b"), ("TABLE", "c")]) == [("HARD", None), ("HARD", None)]
    assert classes(spark, [("LIST_ITEM", "a"), ("LIST_ITEM", "b")]) == [("UNKNOWN", None)]
    same = [("PARAGRAPH", "a", {"integrity_group_id": "g"}), ("CODE", "b", {"integrity_group_id": "g"}), ("CODE", "c", {"integrity_group_id": "h"})]
    assert classes(spark, same) == [("NONE", "NATIVE_INTEGRITY_GROUP"), ("HARD", None)]


def test_results_do_not_depend_on_partitions(spark):
    rows = frame(spark, [("PARAGRAPH", f"{i}. x") for i in range(20)])
    assert set(map(str, boundaries.score_boundaries(rows.repartition(1)).collect())) == set(map(str, boundaries.score_boundaries(rows.repartition(7)).collect()))


def units(spark, rows):
    got = grouping.group(frame(spark, rows)).orderBy("first_ord").collect()
    return [(u.unit_type, u.element_ids) for u in got]


def test_units_by_priority(spark):
    assert units(spark, [("QUESTION", "q"), ("ANSWER", "a"), ("DIALOGUE_TURN", "x"), ("DIALOGUE_TURN", "y"), ("LOG_ENTRY", "l"), ("CODE", "c"), ("PARAGRAPH", "p"), ("PARAGRAPH", "r"), ("UNKNOWN", "u")]) == [
        ("QA_PAIR", ["e0", "e1"]), ("DIALOGUE_SEGMENT", ["e2", "e3"]), ("CODE_BLOCK", ["e5"]), ("TEXT_BLOCK", ["e6", "e7"]), ("UNKNOWN_GROUP", ["e8"]),
    ]


def test_qa_pairs_do_not_overlap(spark):
    rows = [("PARAGRAPH", "Q: a"), ("PARAGRAPH", "A: b"), ("PARAGRAPH", "Q: c"), ("PARAGRAPH", "A: d")]
    assert [m for t, m in units(spark, rows) if t == "QA_PAIR"] == [["e0", "e1"], ["e2", "e3"]]


def test_lists_need_an_introduction_or_parentheses(spark):
    marked = [("PARAGRAPH", "1. a"), ("PARAGRAPH", " "), ("PARAGRAPH", "2. b"), ("PARAGRAPH", " "), ("PARAGRAPH", " ")]
    assert [t for t, _ in units(spark, marked)] == ["TEXT_BLOCK"]
    assert ("LIST_GROUP", ["e1", "e2", "e3"]) in units(spark, [("LIST_ITEM", "do this:"), *marked])
    assert ("LIST_GROUP", ["e0", "e1"]) in units(spark, [("PARAGRAPH", "(a) x"), ("PARAGRAPH", "(b) y"), ("PARAGRAPH", "z")])


def test_subdocuments_trim_the_separator(spark):
    rows = frame(spark, [("PARAGRAPH", "lead"), ("TITLE", "A"), ("PARAGRAPH", "a"), ("SEPARATOR", "-"), ("TITLE", "B"), ("PARAGRAPH", "b")])
    assert [(s.label, s.element_ids) for s in grouping.subdocuments(rows).orderBy("first_ord").collect()] == [("A", ["e1", "e2"]), ("B", ["e4", "e5"])]
    assert grouping.subdocuments(rows.where("ord < 4")).count() == 0


def test_native_groups(spark):
    rows = frame(spark, [("LIST_ITEM", "a", {"integrity_group_id": "g"}), ("PARAGRAPH", "x"), ("LIST_ITEM", "b", {"integrity_group_id": "g"}), ("TABLE", "t", {"integrity_group_id": "h", "integrity_parent_group_id": "zz"})])
    spans = grouping.integrity_spans(rows)
    assert {r.integrity_group_id: r.interleaved for r in spans.collect()} == {"g": True, "h": False}
    assert [(r.integrity_group_id, r.code) for r in grouping.nesting_violations(spans).collect()] == [("h", "PARENT_MISSING")]


def test_list_spans_merge_over_short_gaps(spark):
    rows = frame(spark, [("LIST_ITEM", "a", {"integrity_group_id": "g", "numbering_id": "1"}), ("PARAGRAPH", " "), ("LIST_ITEM", "b", {"integrity_group_id": "h", "numbering_id": "1"}), ("LIST_ITEM", "c", {"integrity_group_id": "i", "numbering_id": "2"})])
    gaps = spark.createDataFrame([("d", 2, 1, True), ("d", 3, 0, True)], "document_id string, first_ord int, blanks int, crossable boolean")
    assert sorted(r.group_ids for r in grouping.coalesce_lists(grouping.integrity_spans(rows), gaps).collect()) == [["g", "h"], ["i"]]


def test_hierarchy_levels_parents_and_paths(spark):
    rows = [("TITLE", "T"), ("HEADING", "a", {"heading_level": 1}), ("HEADING", "b", {"heading_level": 3}), ("PARAGRAPH", "p"), ("HEADING", "2.1 c", {}), ("HEADING", "d", {"heading_level": 1}), ("HEADING", " ")]
    built = {r.element_id: r for r in hierarchy.build(frame(spark, rows), calibrate=False).collect()}
    ids = {r.node_id: e for e, r in built.items() if r.node_id}
    assert [built[f"e{i}"].level for i in range(7)] == [0, 1, 3, None, 2, 1, None]
    assert [ids.get(built[f"e{i}"].parent_id) for i in (0, 1, 2, 4, 5)] == [None, "e0", "e1", "e1", "e0"]
    assert [ids[x] for x in built["e3"].path] == ["e0", "e1", "e2"] and [ids[x] for x in built["e4"].path] == ["e0", "e1", "e4"]
    assert hierarchy.structure(hierarchy.build(frame(spark, rows), calibrate=False)).first().mode == "HIERARCHICAL"


def test_root_calibration(spark):
    h = lambda t, n=1: ("HEADING", t, {"heading_level": n})
    got = [(r.level, r.node_type) for r in hierarchy.nodes(hierarchy.build(frame(spark, [h("Title"), h("Sub"), h("One"), h("Two", 2)]))).orderBy("ord").collect()]
    assert got == [(0, "DOCUMENT_TITLE"), (1, "DOCUMENT_SUBTITLE"), (1, "HEADING"), (2, "HEADING")]
    toc = [h("Title"), *[("PARAGRAPH", f"Part\t{i}") for i in range(3)], h("One"), h("Two")]
    assert [r.level for r in hierarchy.nodes(hierarchy.build(frame(spark, toc))).orderBy("ord").collect()] == [0, 1, 1]


def test_common_path(spark):
    rows = spark.createDataFrame([("u", ["a", "b", "c"]), ("u", ["a", "b", "d"]), ("v", ["x"]), ("v", [])], "u string, path array<string>")
    assert {r.u: r.path for r in hierarchy.common_path(rows, ["u"]).collect()} == {"u": ["a", "b"], "v": []}


def test_outline_from_lists(spark):
    rows = [x for i in range(5) for x in (("LIST_ITEM", f"S{i}", {"bold": True, "numbering_level": 0, "numbering_id": "1", "number_format": "decimal"}), ("LIST_ITEM", "c", {"bold": False, "numbering_level": 1, "numbering_id": "1", "number_format": "decimal"}))]
    got = Counter(r.outline_level for r in signals.outline(frame(spark, rows)).collect())
    assert got == Counter({1: 5, 2: 5})
    assert signals.outline(frame(spark, rows[:6])).count() == 0


def test_cycles_and_trees(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4)], "id long, parent_id long")
    assert {r.id for r in hierarchy.cycles(edges).collect()} == {3, 4, 5}
    from glyphmill.operators.mutations import would_cycle

    tree = edges.where("id < 3").unionByName(spark.createDataFrame([(9, 2)], "id long, parent_id long"))
    assert would_cycle(tree, 1, 9) and not would_cycle(tree, 9, 1)


def test_regions_bridge_and_mode(spark):
    rows = frame(spark, [("SEPARATOR", ""), ("PARAGRAPH", "a"), ("PAGE_NUMBER", "1"), ("PARAGRAPH", "b"), ("CODE", "c"), ("SEPARATOR", "")])
    got = regions.segments(rows).orderBy("region").collect()
    assert [(r.category, r.element_ids, r.bridges) for r in got] == [("narrative", ["e0", "e1", "e2", "e3"], 2), ("code", ["e4", "e5"], 1)]
    flat = spark.createDataFrame([("d", "UNKNOWN")], "document_id string, mode string")
    assert regions.document_mode(rows, flat).first().reason == "incidental_embedded_content"
    assert regions.document_mode(frame(spark, [("PARAGRAPH", "a"), ("LOG_ENTRY", "l")]), flat).first().mode == "MIXED"
    assert regions.segments(frame(spark, [("SEPARATOR", ""), ("HEADER", "h"), ("HEADER", "h")])).first().category == "boilerplate"


def test_unit_regions_and_relations(spark):
    rows = frame(spark, [("QUESTION", "q"), ("ANSWER", "a"), ("CODE", "c")])
    u = grouping.group(rows)
    placed = regions.unit_region(u, regions.segments(rows)).collect()
    assert all(r.code is None for r in placed)
    edges = Counter(r.type for r in relations.build(rows, u, grouping.subdocuments(rows)).collect())
    assert edges == Counter({"NEXT": 2, "PART_OF": 3, "QUESTION_ANSWER": 1})
    assert relations.duplicate_edges(relations.build(rows, u)).count() == 0


def fragment(i, page, **k):
    base = {"document_id": "d", "fragment_id": f"f{i}", "page": page, "x0": 0.1, "y0": 0.05, "x1": 0.9, "y1": 0.95, "column_boundaries": [0.1, 0.5, 0.9], "column_count": 2, "topology": "SIMPLE", "orientation": "P", "leading_row_fingerprint": None}
    return tuple({**base, **k}.values())


@pytest.mark.parametrize(("change", "reason"), [({}, "compatible_adjacent_table_fragments"), ({"y0": 0.4}, "page_edge_evidence_insufficient"), ({"column_count": 3}, "column_count_mismatch"), ({"column_boundaries": [0.1, 0.6, 0.9]}, "column_geometry_mismatch"), ({"x1": 0.7}, "table_width_mismatch"), ({"topology": "MERGED"}, "table_topology_incompatible"), ({"orientation": "L"}, "page_orientation_mismatch")])
def test_continuation_reasons(spark, change, reason):
    schema = "document_id string, fragment_id string, page int, x0 double, y0 double, x1 double, y1 double, column_boundaries array<double>, column_count int, topology string, orientation string, leading_row_fingerprint string"
    df = spark.createDataFrame([fragment(1, 1), fragment(2, 2, **change)], schema)
    assert [r.reason for r in relations.continuation_pairs(df).collect()] == [reason]
    two = spark.createDataFrame([fragment(1, 1), fragment(2, 2), fragment(3, 2)], schema)
    assert relations.continuations(two).count() == 0


def test_retrieval_units(spark):
    rows = frame(spark, [("HEADING", "H"), ("PARAGRAPH", "one two three"), ("PARAGRAPH", "four five"), ("TABLE_CELL", "t"), ("PAGE_NUMBER", "1"), ("CAPTION", " ")])
    u = grouping.group(rows)
    built = hierarchy.build(rows, calibrate=False)
    label = {r.node_id: r.label for r in built.where("is_node").collect()}
    paths = built.select("document_id", "element_id", F.transform("path", lambda x: F.lit("H")).alias("labels"))
    titles = spark.createDataFrame([("d", "Doc")], "document_id string, title string")
    got = retrieval.build(rows, u, paths, titles).orderBy("first_ord").collect()
    assert [(r.unit_type, r.retrieval_text) for r in got] == [("SECTION", "Doc\nH"), ("TEXT", "Doc\nH\none two three\nfour five")] and label
    assert [r.element_id for r in retrieval.withheld(rows, u).collect()] == ["e3"]
    parts = retrieval.build(rows, u, paths, titles, max_tokens=5).where("logical_unit_id is not null").orderBy("first_ord", "identity").collect()
    assert [p.element_ids for p in parts] == [["e1"], ["e2"]] and parts[0].identity.endswith("part:1/2:e1")
    assert retrieval.unit_violations(retrieval.build(rows, u), rows).count() == 0


def test_packing_skips_blanks_and_resets(spark):
    assert retrieval.pack([3, 0, 3, 3], 1, 7) == [0, 0, 0, 1]
    df = spark.createDataFrame([("d", "u", 1, [3, 0, 3, 3])], "document_id string, unit_id string, head int, sizes array<int>")
    assert retrieval.partition_units(df, 7).first().parts == [0, 0, 0, 1]


def test_tables_as_grids(spark):
    cells = spark.createDataFrame([("d", "t", 0, 1, "b"), ("d", "t", 0, 0, "a"), ("d", "t", 1, 0, None), ("d", "x", 0, 0, "p"), ("d", "x", 0, 0, "q")], "document_id string, unit_id string, row int, col int, text string")
    assert {r.unit_id: r.grid for r in retrieval.table_view(cells).collect()} == {"t": "a\tb\n", "x": None}
