"""Steps whose work must grow with their input: how they are planned, with their results."""

import hashlib
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glyphmill.operators import evaluation, geometry, rows, semantics, studio, tables
from glyphmill.sources import docx


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def greedy(golds, spans):
    free, out = sorted(spans), []
    for a, b in sorted(golds):
        best = max(free, key=lambda s: (min(b, s[1]) - max(a, s[0]), -s[0], -s[1]), default=None)
        if best is not None and min(b, best[1]) > max(a, best[0]):
            free.remove(best)
            out.append((a, b, *best))
    return out


def test_spans_of_many_elements_go_by_batches(spark):
    rng = random.Random(4)
    span = lambda: (a := rng.randint(0, 60), a + rng.randint(0, 25))
    each = {str(e): [[span() for _ in range(rng.randint(0, 9))] for _ in range(2)] for e in range(300)}
    schema = "document_id string, element_id string, text_view string, start long, end long"
    side = lambda i: spark.createDataFrame([("d", e, None, *s) for e, x in each.items() for s in x[i]], schema)
    made = evaluation.best_overlaps(side(0), side(1))
    assert sorted((r.element_id, r.gold_start, r.gold_end, r.start, r.end) for r in made.collect()) == sorted((e, *m) for e, x in each.items() for m in greedy(*x))
    assert "FlatMapGroupsInPandas" not in plan(made)


def test_units_reached_by_one_path_are_not_dealt_again(spark):
    units = spark.createDataFrame([("d", "u1", ["e1", "e1"]), ("d", "u2", []), ("f", "u1", ["e1"])], "document_id string, unit_id string, element_ids array<string>")
    bridge = lambda *rows: spark.createDataFrame(rows, "document_id string, unit_id string, target_id string")
    notes = spark.createDataFrame([("d", "a", "e1"), ("d", "b", "c"), ("d", "b", "u2"), ("d", "x", "r"), ("d", "x", "r"), ("f", "a", "u1"), ("d", "n", "none")], "document_id string, annotation_id string, target_id string")
    made = semantics.unit_scopes(notes, units, bridge(("d", "u1", "c"), ("d", "u2", "c"), ("d", "u2", "c")), bridge(("d", "u1", "r"), ("d", "u1", "e1")))
    assert sorted((r.document_id, r.unit_id, r.annotation_id, r.scope_rank) for r in made.collect()) == [("d", "u1", "a", 0), ("d", "u1", "b", 2), ("d", "u1", "x", 3), ("d", "u2", "b", 1), ("f", "u1", "a", 1)]
    # the rows of single targets are joined once and not windowed behind the join
    assert plan(made).count("Join") == 2


def test_pairs_of_one_target_come_out_of_many_tasks(spark):
    n = 700
    units = spark.range(n).select(F.lit("d").alias("document_id"), F.concat(F.lit("u"), "id").alias("unit_id"), F.array().cast("array<string>").alias("element_ids"))
    notes = spark.range(n + 20).select(F.lit("d").alias("document_id"), F.concat(F.lit("a"), "id").alias("annotation_id"), F.when(F.col("id") < n, F.lit("c")).otherwise(F.lit("u3")).alias("target_id"), (F.col("id") * 2).alias("extra"))
    made = semantics.unit_scopes(notes, units, units.select("document_id", "unit_id", F.lit("c").alias("target_id")))
    assert made.columns == ["document_id", "target_id", "annotation_id", "extra", "unit_id", "scope_rank"]
    assert made.select("annotation_id", "unit_id").distinct().count() == made.count() == n * n + 20
    assert made.where("extra = 2 * int(substr(annotation_id, 2))").groupBy("scope_rank").count().orderBy("scope_rank").collect() == [(1, 20), (2, n * n)]
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= n * n / 2


def test_tree_hash_stops_at_a_given_depth(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = sorted(sha(str(i)) for i in range(40))
    leaves = {d: sha("\n".join(f"{h}:1" for h in rows if h[0] == d)) for d in sorted({h[0] for h in rows})}
    want = "tree:" + sha("\n".join(f"{d}={x}" for d, x in leaves.items()))
    df = spark.createDataFrame([(h,) for h in rows], "h string")
    assert studio.tree_hash(df, [], "h", leaf=1, deepest=1).first()[0] == want != studio.tree_hash(df, [], "h", leaf=1).first()[0]


def test_contracts_of_one_key_are_paired_without_the_rest_of_the_document(spark):
    schema = "document_id string, page int, n_rows int, n_cols int, {} string"
    side = lambda name, rows: spark.createDataFrame([("d", p, 2, 2, x) for p, x in rows], schema.format(name))
    # page 1: two contracts, three tables; page 2: nothing offered; pages 3 and 4: a contract of both, whose exchange lets two match
    contracts = side("contract_id", [(1, "a"), (1, "b"), (2, "c"), (3, "m"), (4, "m"), (3, "n"), (1, "a")])
    tables = side("table_id", [(1, "t3"), (1, "t1"), (1, "t2"), (3, "x"), (4, "y")])
    made = geometry.contract_matches(contracts, tables)
    assert sorted((r.contract_id, r.table_id) for r in made.collect()) == [("a", "t1"), ("b", "t2"), ("m", "y"), ("n", "x")]
    # a document of many keys is no group: exchanges are sought in the keys of shared ids alone
    many = side("contract_id", [(p, f"c{p}") for p in range(3000)])
    assert geometry.contract_matches(many, side("table_id", [(p, f"t{p}") for p in range(3000)])).count() == 3000
    assert "LeftSemi" in plan(made)


def test_rows_of_word_files_come_in_batches_of_many_files(spark):
    rows = [r for i in range(500) for r in docx.rows_of(str(i), b"no package", "FINAL")]
    rows[7] = {**rows[7], "raw_text": "x" * docx.BATCH_CHARS}
    batches = list(docx.packed(iter(rows * 10), to_arrow_schema(StructType.fromDDL(docx.SCHEMA))))
    assert len(batches) <= 12 and all(b.num_rows <= docx.BATCH_ROWS for b in batches)
    assert [(r["document_id"], r["ord"], r["diagnostic"]) for b in batches for r in b.to_pylist()] == [(str(i), 0, "NOT_A_PACKAGE") for i in range(500)] * 10


def test_lines_drawn_cell_by_cell_are_one_line(spark):
    lines = [(40.0, 20.0 * i, 20.0 * i + 20) for i in range(50)] + [(40.0, 1100.0, 1200.0), (80.0, 0.0, 10.0), (80.0, 5.0, 8.0), (80.0, 9.0, 30.0)]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame([(lines,), ([],)], "lines array<struct<at:double,start:double,stop:double>>")
    assert [[tuple(s) for s in r[0]] for r in df.select(tables._drawn(df["lines"])).collect()] == [[(40.0, 0.0, 1000.0), (40.0, 1100.0, 1200.0), (80.0, 0.0, 30.0)], []]


def test_grids_from_cells_are_one_step_a_row(spark):
    """Cells of a candidate are looked at in one function of its row, not by nested array functions that copy arrays."""
    box = lambda r, c, wide=1: (r, c, c * 40.0, r * 20.0, (c + wide) * 40.0, r * 20.0 + 20)
    cells = [box(r, c) for r in range(300) for c in range(4)]
    cells[:2] = [box(0, 0, 2), (0, 1, None, None, None, None)]
    kind = "document_id string, page int, table_id int, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int, cells array<struct<row:int,col:int,x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 160.0, 6000.0, 300, 4, cells), ("d", 2, 0, 0.0, 0.0, 160.0, 6000.0, 300, 4, cells[:-1] + [box(299, 2)])], kind)
    made = tables.merged_grids(df)
    assert [(r.page, r.reason, r.anchors and len(r.anchors)) for r in made.orderBy("page").collect()] == [(1, None, 1199), (2, "merged_grid_overlap", None)]
    assert "lambda" not in plan(made.select("reason", "anchors")) and "lambda" not in plan(tables.simple_grids(df).select("reason"))


def _page_of_text(spark, pages=3):
    """Grids of 3 by 3 with a span in each cell, and a block whose second line lies below."""
    cells = [(p, 0, r, c, c * 40.0, r * 20.0, c * 40.0 + 40, r * 20.0 + 20) for p in range(pages) for r in range(3) for c in range(3)]
    spans = [(p, r, 0, c, f"{r}:{c}", "t", x0 + 4, y0 + 4, x0 + 20, y0 + 12) for p, _, r, c, x0, y0, *_ in cells] + [(p, 2, 1, 0, "below", "t", 4.0, 80.0, 30.0, 90.0) for p in range(1, pages)]
    frame = lambda rows, names: spark.createDataFrame([("d", *r) for r in rows], "document_id string, page int, " + names)
    boxes = "x0 double, y0 double, x1 double, y1 double"
    candidates = frame([(p, 0, 0.0, 0.0, 120.0, 60.0, 3, 3) for p in range(pages)], f"table_id int, {boxes}, n_rows int, n_cols int")
    grids = tables.simple_grids(tables.gather(candidates, frame(cells, f"table_id int, row int, col int, {boxes}")))
    return grids, frame(spans, f"block_order int, line int, seq int, span_id string, text string, {boxes}")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_inspection_deals_spans_once(spark):
    grids, spans = _page_of_text(spark)
    made = tables.inspect_tables(grids, spans)
    assert sorted((r.page, r.reason, r.cells_filled) for r in made.collect()) == [(0, None, 9), (1, tables.CROSSING, 9), (2, tables.CROSSING, 9)]
    # candidates, cells and spans by page, and pages again where blocks are taken in turn
    assert physical(made).count("Exchange hashpartitioning") <= 5 and "gx" not in physical(made)


def test_retries_do_not_deal_spans_by_line(spark):
    grids, spans = _page_of_text(spark)
    verdicts, parts = tables.retry_at_boundaries(grids, spans)
    assert sorted((r.page, r.reason, r.cuts, r.spans, r.residual) for r in verdicts.collect()) == [(0, "boundary_partition_not_applicable", 0, 0, 0), (1, None, 1, 9, 1), (2, None, 1, 9, 1)]
    assert sorted((r.page, r.span_id) for r in parts.where("part = 'residual'").collect()) == [(1, "below"), (2, "below")]
    assert "Window" not in physical(verdicts) and physical(verdicts).count("Exchange hashpartitioning") <= 5


def test_rows_of_blocks_are_sought_among_those_of_one_height(monkeypatch):
    from glyphmill.operators import layout

    calls, share = [], layout._share
    monkeypatch.setattr(layout, "_share", lambda *a: calls.append(a) or share(*a))
    blocks = [(i, 200.0 * (i % 2), 20.0 * (i // 2), 200.0 * (i % 2) + 180, 20.0 * (i // 2) + 10) for i in range(40)]
    assert layout.aligned(blocks, 600.0, layout.ColumnPolicy()) and len(calls) <= 80


def test_regions_of_a_page_are_one_step(spark):
    """Strokes and spans are an array of their page each; grids are made and inspected in one function, called once, and no page goes to the driver."""
    wall = [(c * 40.0 + dx, r * 20.0, c * 40.0 + dx, r * 20.0 + 20) for r in range(3) for c in range(4) for dx in (0.0, 200.0)]
    floor = [(dx, r * 20.0, dx + 120.0, r * 20.0) for r in range(4) for dx in (0.0, 200.0)]
    boxes = "x0 double, y0 double, x1 double, y1 double"
    frame = lambda rows, names: spark.createDataFrame([("d", p, *r) for p in range(2) for r in rows], f"document_id string, page int, {names}")
    spans = [(r + (dx > 0) * 50, 0, c, f"{dx}:{r}:{c}", "t", c * 40.0 + dx + 4, r * 20.0 + 4, c * 40.0 + dx + 20, r * 20.0 + 12) for r in range(3) for c in range(3) for dx in (0.0, 200.0)]
    strokes = frame([*wall, *floor, (None, 1.0, None, 2.0)], boxes)
    made = tables.region_tables(strokes, frame(spans, f"block_order int, line int, seq int, span_id string, text string, {boxes}"))
    assert [(r.page, r.table_id, r.x0, r.reason, r.strategy, len(r.anchors)) for r in made.orderBy("page", "table_id").collect()] == [(p, t, 200.0 * t, None, "lines_strict", 9) for p in (0, 1) for t in (0, 1)]
    text = physical(made)
    assert text.count("+- ArrowEvalPython") == 1 and "Window" not in text and "Broadcast" not in text and text.count("Exchange hashpartitioning") <= 2
    candidate = frame([(0, 0.0, 0.0, 120.0, 60.0, 3, 3)], f"table_id int, {boxes}, n_rows int, n_cols int")
    cells = frame([], f"table_id int, row int, col int, {boxes}")
    assert "lambda" not in plan(tables.normalise_grids(tables.gather(candidate, cells), strokes))


def test_equal_rulings_of_a_batch_are_gridded_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rows.F, "arrow_udf", lambda f, kind: made.append(f) or (lambda *c: f(*c)))
    heads, calls = [], []
    find = rows.by_row("array<string>", lambda lead, more: calls.append(more) or [lead, str(more)], first=lambda v: heads.append(v) or str(v))
    point = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    drawn = [[(9.0, 9.0)], [(1.0, None)], [(1.0, None)], [(1.0, 0.0)], [(1.0, -0.0)], None, [], [(1.0, None)], [(1.0, 0.0)], None, [(1.0, 0.0), (1.0, None)]]
    text = [7, 0, 0, 1, 1, 2, 2, 3, 1, None, 0]
    columns = lambda other: (pa.array([x and [dict(zip("xy", v, strict=True)) for v in x] for x in drawn], type=point)[1:], other[1:])
    want = [[str(x), str(t)] for x, t in zip(drawn, text, strict=True)][1:]
    assert find(*columns(pa.array(text))).to_pylist() == want
    # ten rows, of which two equal an earlier one; six rulings
    assert (len(calls), len(heads)) == (8, 6)
    heads.clear(), calls.clear()
    assert find(*columns(pa.array([None if t is None else str(t) for t in text]))).to_pylist() == want
    assert (len(calls), len(heads)) == (10, 6)


def test_pages_of_equal_rulings_and_other_texts_share_their_grids(spark, monkeypatch):
    given, grids, real, grid = [], [], F.arrow_udf, tables._grid
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: given.append(f) or real(f, kind))
    monkeypatch.setattr(tables, "_grid", lambda *a: grids.append(a) or grid(*a))
    boxes = "x0 double, y0 double, x1 double, y1 double"
    frame = lambda names: spark.createDataFrame([], f"document_id string, page int, {names}")
    tables.region_tables(frame(boxes), frame(f"block_order int, line int, span_id string, text string, {boxes}"))
    box = [(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]
    drawn = [(c * 40.0 + dx, 0.0, c * 40.0 + dx, 60.0) for c in range(4) for dx in (0.0, 200.0)] + [(dx, r * 20.0, dx + 120.0, r * 20.0) for r in range(4) for dx in (0.0, 200.0)]
    # page p lacks the text of the second table from its row p on
    text = lambda p: [(r + (dx > 0) * 50, 0, 1, 1, c * 40.0 + dx + 4, r * 20.0 + 4, c * 40.0 + dx + 20, r * 20.0 + 12) for r in range(3) for c in range(3) for dx in (0.0, 200.0) if not dx or r < p]
    array = lambda pages, kind: pa.array([[dict(zip([n for n, _ in kind], x, strict=True)) for x in page] for page in pages], type=pa.list_(pa.struct(kind)))
    numbers = [(c, pa.int32()) for c in ("block_order", "line", "inked", "there")]
    found = given[-1](array([drawn] * 5, box), array([text(p) for p in (0, 1, 2, 3, 3)], [*numbers, *box])).to_pylist()
    less = "segmented_minimum_tables_not_met"
    assert [[t["reason"] for t in page] for page in found] == [[less, tables.NO_TEXT], [less, tables.SPARSE], [None, None], [None, None], [None, None]]
    assert [[len(t["anchors"] or []) for t in page] for page in found] == [[0, 0]] * 2 + [[9, 9]] * 3
    assert len(grids) == 2


def test_tables_that_alignment_shows_are_one_step_a_page(spark):
    """A page's spans are dealt once and looked at in one function, called once; a long run is not followed again from each of its rows."""
    from glyphmill.operators import layout

    spans = [("d", p, r, 0, c, f"{r}:{c}", "t", 40.0 * c, 20.0 * r, 40.0 * c + 20, 20.0 * r + 10) for p in range(3) for r in range(4 + p) for c in range(3)]
    made = layout.text_tables(spark.createDataFrame(spans, "document_id string, page int, block_order int, line int, seq int, span_id string, text string, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.page, r.table_id, r.reason, r.n_rows, len(r.anchors), r.blocks) for r in made.collect()) == [(p, 0, None, 4 + p, 12 + 3 * p, list(range(4 + p))) for p in range(3)]
    text = physical(made)
    assert text.count("+- ArrowEvalPython") == 1 and text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "lambda" not in plan(made)
    # 3000 rows in which each start would go on to the end: 4.5 million steps before
    boxes = [(50.0 * c, 20.0 * r, 50.0 * c + 10, 20.0 * r + 8) for r in range(3000) for c in range(3)]
    began = time.process_time()
    assert [len(r) for r in layout.aligned_runs(boxes, layout.TextTablePolicy())] == [3000]
    assert time.process_time() - began < 4
