import datetime

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import metrics as M
from glyphmill.operators import completion, evaluation, grouping, library, semantics, studio
from glyphmill.operators.boundaries import score_boundaries
from glyphmill.operators.regions import segments

T0 = datetime.datetime(2024, 1, 1)


def test_score_null_rules(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 0, 2), (3, 1, 1)], "tp long, fp long, fn long")
    got = [(r.precision, r.recall, r.f1) for r in M.with_scores(df).collect()]
    assert got == [(None, None, None), (0.0, None, 0.0), (None, 0.0, 0.0), (0.75, 0.75, 0.75)]


def test_macro_skips_labels_without_support(spark):
    df = M.with_scores(spark.createDataFrame([("a", 1, 0, 0), ("b", 0, 3, 0), ("c", 0, 0, 1)], "label string, tp long, fp long, fn long"))
    assert M.macro_f1(df).first()[0] == 0.5


def test_calibration_pools_bins(spark):
    df = spark.createDataFrame([(1.0, 1, "x"), (0.95, 0, "x"), (0.05, 0, "y"), (0.95, 1, "y")], "confidence double, correct int, part string")
    bins = M.calibration_bins(df, by=["part"])
    assert max(r.bin for r in bins.collect()) == 9
    whole, pooled = M.calibration(M.calibration_bins(df)).first(), M.calibration(bins).first()
    assert whole.n == pooled.n == 4 and abs(whole.ece - pooled.ece) < 1e-12 and abs(whole.brier - pooled.brier) < 1e-12


def sides(spark, gold, predicted):
    schema = "document_id string, id string, ord int, type string, text string, anchor string"
    return spark.createDataFrame(gold, schema), spark.createDataFrame(predicted, schema)


def test_alignment_passes_and_consumption(spark):
    gold, predicted = sides(spark, [("d", "g1", 0, "P", "a", "x"), ("d", "g2", 1, "P", "b", None), ("d", "g3", 2, "P", "C  c", None), ("d", "g4", 3, "Q", "zz", None)], [("d", "p1", 0, "P", "b", "x"), ("d", "p2", 1, "P", "b", None), ("d", "p3", 2, "P", "c C", None), ("d", "p4", 3, "Q", "yy", None)])
    got = {r.gold_id: (r.predicted_id, r.matched_by) for r in evaluation.align(gold, predicted).collect()}
    assert got == {"g1": ("p1", "anchor"), "g2": ("p2", "exact_text"), "g3": ("p3", "normalized_text"), "g4": ("p4", "occurrence")}
    assert evaluation.alignment_errors(gold, predicted, evaluation.align(gold, predicted)).count() == 0


def test_co_member_counts_equal_pairs(spark):
    schema = "document_id string, unit_id string, element_id string"
    gold = spark.createDataFrame([("d", "g", e) for e in "abcd"] + [("d", "h", "e")], schema)
    predicted = spark.createDataFrame([("d", "x", e) for e in "abc"] + [("d", "y", e) for e in "de"], schema)
    pairs = lambda *units: {frozenset((x, y)) for u in units for x in u for y in u if x != y}
    a, b = pairs("abcd", "e"), pairs("abc", "de")
    r = evaluation.co_member_scores(gold, predicted).first()
    assert (r.tp, r.fp, r.fn) == (len(a & b), len(b - a), len(a - b))


def test_repeated_lines_are_not_all_paired(spark):
    schema = "document_id string, id string, ord int, type string, text string, anchor string"
    side = lambda p: spark.createDataFrame([("d", f"{p}{i}", i, "PARAGRAPH", "same" if i < 3 else f"own {i}", None) for i in range(5)], schema)
    got = {(r.gold_id, r.predicted_id): r.matched_by for r in evaluation.align(side("g"), side("p")).collect()}
    assert {k for k, v in got.items() if v == "exact_text"} == {("g3", "p3"), ("g4", "p4")}
    assert {k for k, v in got.items() if v == "occurrence"} == {("g0", "p0"), ("g1", "p1"), ("g2", "p2")}


def test_greedy_spans(spark):
    schema = "document_id string, element_id string, text_view string, start long, end long"
    gold = spark.createDataFrame([("d", "e", "RAW", 0, 10), ("d", "e", "RAW", 8, 20)], schema)
    predicted = spark.createDataFrame([("d", "e", "RAW", 5, 15), ("d", "e", "RAW", 0, 4)], schema)
    assert sorted((r.gold_start, r.start, r.overlap) for r in evaluation.best_overlaps(gold, predicted).collect()) == [(0, 5, 5)]


def test_role_report_and_gate(spark):
    schema = "document_id string, target string, kind string, type string"
    gold = spark.createDataFrame([("d", "1", "E", "NOTE"), ("d", "2", "U", "NOTE")], schema)
    predicted = spark.createDataFrame([("d", "1", "E", "NOTE"), ("d", "3", "E", "EXAMPLE")], schema)
    total = evaluation.role_report(gold, predicted).where("type is null and kind is null and target is null").first()
    assert (total.tp, total.fp, total.fn) == (1, 1, 1)
    assert {r.difference for r in evaluation.role_differences(gold, predicted).collect()} == {"MISSING", "EXTRA"}
    gate = evaluation.gate_reasons(spark.createDataFrame([("test", 0.95, 1.0, 0.0), ("dev", 0.9, 1.0, 0.0), ("test", None, 1.0, 0.0)], "split string, f1 double, grounding double, unsupported double"))
    assert [r.approved for r in gate.collect()] == [True, False, False]


def test_text_preservation(spark):
    r = evaluation.text_preservation(spark.createDataFrame([("abc", "abc"), ("abcd", "ab"), (None, None)], "gold_text string, predicted_text string")).first()
    assert (r.exact, r.total) == (2, 3) and r.character_ratio == pytest.approx(5 / 7)


def test_leakage_codes(spark):
    schema = "record_id string, document_id string, content_hash string, source_family_id string, split_group_id string, target_kind string, element_orders array<int>"
    records = spark.createDataFrame([("r1", "d1", "h1", "f1", "g1", "ELEMENT", [0]), ("r2", "d2", "h1", "f2", "g2", "ELEMENT", [0]), ("r2", "d3", "h3", "f2", "g3", "ELEMENT", [1]), ("r4", "d4", "h4", "f4", "gX", "ELEMENT", [0])], schema)
    splits = spark.createDataFrame([("g1", "train"), ("g2", "test"), ("g3", "test"), ("g9", "dev")], "split_group_id string, split string")
    got = {(r.identity, r.code) for r in studio.split_leakage(records, splits).collect()}
    assert got == {("h1", "CONTENT_HASH_CROSSES_GROUPS"), ("h1", "CONTENT_HASH_CROSSES_SPLITS"), ("f2", "SOURCE_FAMILY_CROSSES_GROUPS"), ("h1|ELEMENT|0", "SOURCE_TARGET_CROSSES_SPLITS"), ("r2", "DUPLICATE_RECORD_ID"), ("gX", "GROUP_UNASSIGNED"), ("g9", "GROUP_UNUSED")}


DECISION = "struct<annotation_type:string,state:string,value:string,confidence:string,mode:string,rule_keys:array<string>,evidence:array<struct<element_id:string,start_char:int,end_char:int,quoted_text:string,text_view:string>>>"


def decided(spark, *rows):
    return spark.createDataFrame(rows, f"record_id string, document_id string, status string, reviews array<string>, decisions array<{DECISION}>, split_group_id string, target_kind string, element_orders array<int>, evaluated_types array<string>")


def test_eligibility_and_gold(spark):
    good = ("NOTE", "POSITIVE", None, "HIGH", "LABEL_ONLY", ["r"], [("e1", 0, 3, "abc", "RAW")])
    rows = decided(spark, ("a", "d", "PASS", ["x"], [good], "g", "ELEMENT", [1], ["NOTE"]), ("b", "d", "REJECT", [], [(*good[:1], "UNDECIDED", *good[2:])], "g", "ELEMENT", [2], ["NOTE"]))
    got = {r.record_id: r.reasons for r in studio.eligibility(rows).collect()}
    assert got == {"a": [], "b": ["STATUS_NOT_PASS", "REVIEW_MISSING", "UNDECIDED_DECISION"]}
    elements = spark.createDataFrame([("d", "e1", 1)], "document_id string, element_id string, ord int")
    gold = studio.compile_gold(rows, elements, spark.createDataFrame([("g", "train")], "split_group_id string, split string")).collect()
    assert len(gold) == 1 and gold[0].split == "train" and gold[0].annotations[0].evidence[0].ord == 1
    assert [r.code for r in studio.undecided(rows).collect()] == ["UNDECIDED_STATE"]


def test_reviews(spark):
    rows = spark.createDataFrame([("r", 0, "a", "b", T0, "c"), ("r", 1, "x", "c", T0, "c"), ("s", 0, "a", "b", T0, "z")], "record_id string, pos int, decision_hash_before string, decision_hash_after string, reviewed_at timestamp, current_hash string")
    assert {(r.record_id, r.code) for r in studio.review_chain(rows).collect()} == {("r", "REVIEW_CHAIN_BROKEN"), ("s", "REVIEW_FINAL_HASH_MISMATCH")}
    subs = spark.createDataFrame([("r", 1, "h0", "h1", "h0"), ("r", 2, "h0", "h2", "h0"), ("r", 3, "h1", "h3", "h0")], "record_id string, seq long, expected_hash string, new_hash string, initial_hash string")
    assert [r.accepted for r in library.accepted_submissions(subs).orderBy("seq").collect()] == [True, False, True]


def test_snapshots_and_targets(spark):
    elements = spark.createDataFrame([("d", "e1", 0, "a", None), ("d", "e2", 1, None, "b")], "document_id string, element_id string, ord int, raw_text string, normalized_text string")
    targets = spark.createDataFrame([("t", "d", ["e1", "e2"])], "target_id string, document_id string, element_ids array<string>")
    snap = studio.target_snapshot(targets, elements)
    assert tuple(snap.select("raw_text", "normalized_text").first()) == ("a", "b")
    records = spark.createDataFrame([("r", "t", "a", "x"), ("s", "zz", None, None)], "record_id string, target_id string, raw_text string, normalized_text string")
    assert {(r.record_id, r.code) for r in studio.snapshot_issues(records, snap).collect()} == {("r", "TARGET_NORMALIZED_TEXT_MISMATCH"), ("s", "TARGET_UNRESOLVED")}


def test_hashes_do_not_depend_on_order(spark):
    rows = [("g", '{"b": 1, "a": [1, 2]}'), ("g", '{"c": null}')]
    df = lambda r: spark.createDataFrame(r, "g string, j string")
    h = studio.ordered_hash(df(rows), ["g"], "j").first()[1]
    assert h == studio.ordered_hash(df([("g", '{"a":[1,2],"b":1}'), rows[1]][::-1]), ["g"], "j").first()[1] != studio.ordered_hash(df(rows[:1]), ["g"], "j").first()[1]


def test_marker_rules(spark):
    rows = [("d", 0, "e0", "PARAGRAPH", "Note: watch out"), ("d", 1, "e1", "PARAGRAPH", "  DEFINITION: - a thing "), ("d", 2, "e2", "PARAGRAPH", "nothing: here"), ("d", 3, "e3", "PARAGRAPH", "Note:")]
    got = {r.element_id: (r.type, r.value, r.start_char) for r in semantics.marker_annotations(spark.createDataFrame(rows, "document_id string, ord int, element_id string, type string, text string")).collect()}
    assert got == {"e0": ("NOTE", "watch out", 6), "e1": ("DEFINITION", "a thing", 16), "e3": ("NOTE", "Note:", 0)}
    tags = spark.createDataFrame([("VI-vn",), ("de",), (None,)], "t string").select(semantics.route(F.col("t"))).collect()
    assert [r[0] for r in tags] == ["vi", "en", "en"]


def test_budgets(spark):
    seg = spark.createDataFrame([("r", 0, "abcdef"), ("r", 1, "gh"), ("r", 2, "i"), ("s", 0, "x" * 20), ("s", 1, "y")], "request_id string, pos int, text string")
    got = [(r.request_id, r.text, r.truncated) for r in semantics.pack_segments(seg, 9).orderBy("request_id", "pos").collect()]
    assert got == [("r", "abcdef", False), ("r", "gh", False), ("s", "x" * 9, True)]
    blocks = spark.createDataFrame([("u", 1, "one two"), ("u", 2, "three four five"), ("u", 3, "six")], "unit_id string, place int, rendered string")
    assert semantics.render_budget(blocks, tokens=3, chars=100).first().blocks == ["one two", "six"]
    line = spark.createDataFrame([("LEARNING_OBJECTIVE", "EXTRACTIVE", "v" * 30)], "t string, m string, v string").select(semantics.payload(F.col("t"), F.col("m"), F.col("v"), 24)).first()[0]
    assert line.startswith("Learning Objective: v") and line.endswith("…") and len(line) == 24


def test_top_annotations(spark):
    rows = spark.createDataFrame([("t", "A", "o", "X ", 0.5, 1), ("t", "A", "o", " x", 0.9, 2), ("t", "B", "o", None, 0.9, 1), ("t", "C", "o", None, 0.1, 3)], "target_id string, type string, ontology_id string, value string, confidence double, first_seen int")
    assert [(r.type, r.place) for r in semantics.top_annotations(rows, 2).orderBy("place").collect()] == [("B", 1), ("A", 2)]


def outbox(spark, *rows):
    return spark.createDataFrame(rows, "id int, status string, created_at timestamp, available_at timestamp, attempts int, claim_owner string, claim_expires_at timestamp, published_at timestamp, last_error_code string")


def test_outbox_life(spark):
    late = T0 - datetime.timedelta(minutes=5)
    rows = outbox(spark, (1, "PENDING", late, late, 0, None, None, None, None), (2, "PUBLISHING", late, late, 1, "w", late, None, None), (3, "PENDING", late, late, 5, None, None, None, None), (4, "PENDING", late, T0 + datetime.timedelta(1), 0, None, None, None, None), (5, "PUBLISHED", late, late, 1, None, None, late, None))
    now = F.lit(T0)
    assert library.outbox_violations(rows).count() == 0
    assert [r.id for r in library.exhausted(rows, now).where("status = 'FAILED'").collect()] == [3]
    mine = library.claim(rows, now, "me", 10)
    assert sorted((r.id, r.attempts) for r in mine.collect()) == [(1, 1), (2, 2)]
    done = library.settle(mine, spark.createDataFrame([(1, "OK"), (2, "RETRY")], "id int, outcome string"), now, "me")
    got = {r.id: r for r in done.collect()}
    assert got[1].status == "PUBLISHED" and got[2].status == "PENDING" and got[2].available_at == T0 + datetime.timedelta(seconds=10)
    assert library.outbox_violations(done).count() == 0


def test_idempotency(spark):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = spark.createDataFrame([("u", "s", "k", at(0), "1", "a"), ("u", "s", "k", at(5), "2", "a"), ("u", "s", "k", at(6), "3", "b"), ("u", "s", "k", at(100), "4", "b")], "user_id string, scope string, key string, requested_at timestamp, request_id string, request_hash string")
    assert {r.request_id: r.outcome for r in library.idempotent_requests(rows, 60).collect()} == {"1": "RUN", "2": "REPLAY", "3": "CONFLICT", "4": "RUN"}


def test_library_queries(spark):
    docs = spark.createDataFrame([(i, T0 + datetime.timedelta(days=i // 2)) for i in range(7)], "id int, created_at timestamp")
    page = [r.id for r in library.keyset_page(docs, 2).collect()]
    assert page == [6, 5, 4]
    assert [r.id for r in library.keyset_page(docs, 2, (T0 + datetime.timedelta(days=2), 5)).collect()] == [4, 3, 2]
    versions = spark.createDataFrame([("d", "a", T0, 2), ("d", "b", T0 + datetime.timedelta(1), 1), ("d", "c", T0 + datetime.timedelta(2), 3)], "document_id string, version_id string, arrived_at timestamp, version_no int")
    assert [(r.promoted, r.current_version) for r in library.promotions(versions).orderBy("version_id").collect()] == [(True, 2), (False, 2), (True, 3)]
    names = spark.createDataFrame([(1, None, " A", None), (1, None, "a", None), (1, 5, "a", None)], "owner_id int, parent_id int, name string, deleted_at timestamp")
    assert [(r.normalized_name, r.n) for r in library.name_conflicts(names).collect()] == [("a", 2)]


def test_quality_and_completion(spark):
    rows = [("d", i, f"e{i}", t, "EXPLICIT", "x") for i, t in enumerate(["HEADING", "PARAGRAPH", "UNKNOWN", "LIST_ITEM", "LIST_ITEM"])]
    el = spark.createDataFrame(rows, "document_id string, ord int, element_id string, type string, source string, text string")
    units, bounds = grouping.group(el), score_boundaries(el)
    open_ = completion.unresolved_boundaries(bounds, units)
    assert open_.count() == 1
    q = completion.structure_quality(el, bounds, units, open_).first()
    assert q.integrity_ratio == 0.0 and 0 < q.score < 1 and q.accounted_ratio == 0.6
    modes = spark.createDataFrame([("d", "LOCAL")], "document_id string, mode string")
    assert not completion.completion(el, units, open_, modes, segments(el)).first().structural_ready
