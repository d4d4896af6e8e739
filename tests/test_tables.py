from pyspark.sql import functions as F

from glyphmill.operators import tables as T

WALL = 40.0


def grid_strokes(rows, cols, skip=()):
    """Walls of a grid of 40 by 20 points; ``skip`` names walls: ("v", row, boundary) and ("h", boundary, column)."""
    out = [(c * WALL, r * 20.0, c * WALL, r * 20.0 + 20) for r in range(rows) for c in range(cols + 1) if ("v", r, c) not in skip]
    return out + [(c * WALL, r * 20.0, c * WALL + WALL, r * 20.0) for r in range(rows + 1) for c in range(cols) if ("h", r, c) not in skip]


def frame(spark, rows, names):
    return spark.createDataFrame([("d", 1, *r) for r in rows], f"document_id string, page int, {names}")


def candidate(spark, n_rows, n_cols, cells=(), x1=None, y1=None):
    tables = frame(spark, [(0, 0.0, 0.0, x1 or n_cols * WALL, y1 or n_rows * 20.0, n_rows, n_cols)], "table_id int, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int")
    return T.gather(tables, frame(spark, [(0, *c) for c in cells], "table_id int, row int, col int, x0 double, y0 double, x1 double, y1 double"))


def cells(rows, cols, change=()):
    made = {(r, c): (c * WALL, r * 20.0, c * WALL + WALL, r * 20.0 + 20) for r in range(rows) for c in range(cols)}
    made |= dict(change)
    return [(*k, *(v or (None,) * 4)) for k, v in sorted(made.items())]


def strokes(spark, rows):
    return frame(spark, rows, "x0 double, y0 double, x1 double, y1 double")


def grid(spark, n_rows, n_cols, skip=(), extra=()):
    return T.normalise_grids(candidate(spark, n_rows, n_cols), strokes(spark, grid_strokes(n_rows, n_cols, skip) + list(extra))).first()


def test_grids_from_strokes(spark):
    whole = grid(spark, 3, 4)
    assert (whole.reason, whole.n_rows, whole.n_cols, len(whole.anchors), whole.merged) == (None, 3, 4, 12, False)
    wide = grid(spark, 4, 4, {("v", 1, 2)})
    assert wide.merged and {(a.row, a.col): (a.row_span, a.col_span) for a in wide.anchors if a.col_span > 1} == {(1, 1): (1, 2)}
    tall = grid(spark, 4, 4, {("h", 2, 3)})
    assert [(a.row, a.col, a.row_span, a.y1) for a in tall.anchors if a.row_span > 1] == [(1, 3, 2, 60.0)]
    square = grid(spark, 4, 4, {("v", 1, 1), ("v", 2, 1), ("h", 2, 0), ("h", 2, 1)} - {("v", 2, 1)})
    assert [(a.row, a.col, a.row_span, a.col_span) for a in square.anchors if a.row_span > 1] == []  # a row boundary half drawn is none
    assert (square.n_rows, square.reason) == (3, None)
    assert grid(spark, 4, 4, {("v", 0, 3), ("h", 1, 3)}).reason == "segmented_nonrectangular_merged_component"


def test_boundaries_need_support_and_one_core(spark):
    short = [(20.0, 0.0, 20.0, 8.0)]  # a decorative rule of 8 of 60 points
    assert grid(spark, 3, 4, extra=short).n_cols == 4
    near = [(41.0, 0.0, 41.0, 60.0)]  # within the tolerance of the wall at 40
    assert [a.x1 for a in grid(spark, 3, 4, extra=near).anchors if (a.row, a.col) == (0, 0)] != [20.0]
    assert grid(spark, 6, 4, {("v", 2, c) for c in range(5)}).reason == "segmented_multiple_stable_vertical_grid_cores"
    assert grid(spark, 3, 4, {("v", r, c) for r in range(3) for c in range(1, 5)}).reason == "segmented_insufficient_raw_column_boundaries"
    assert T.normalise_grids(candidate(spark, 3, 4, cells(3, 4)), strokes(spark, [])).first().reason == "segmented_insufficient_source_vector_segments"
    title = T.normalise_grids(candidate(spark, 3, 4, y1=80.0), strokes(spark, grid_strokes(3, 4))).first()
    assert (title.reason, title.n_rows) == (None, 3)  # what lies below the core is cut off


def merged(spark, n_rows, n_cols, change, **kw):
    return T.merged_grids(candidate(spark, n_rows, n_cols, cells(n_rows, n_cols, change), **kw)).first()


def test_merged_grids(spark):
    r = merged(spark, 3, 3, {(0, 0): (0.0, 0.0, 80.0, 40.0), (0, 1): None, (1, 0): None, (1, 1): None})
    assert r.reason is None and [(a.row, a.col, a.row_span, a.col_span) for a in r.anchors][0] == (0, 0, 2, 2) and len(r.anchors) == 6
    assert merged(spark, 3, 3, {}).reason == "candidate_has_no_merged_slots"
    assert merged(spark, 3, 3, {(1, 1): None}).reason == "missing_slots_not_explained_by_span"
    assert merged(spark, 3, 3, {(0, 0): (0.0, 0.0, 80.0, 20.0), (0, 1): None, (2, 2): None}).reason == "merged_grid_hole"
    assert merged(spark, 3, 3, {(0, 0): (0.0, 0.0, 80.0, 20.0), (2, 2): None}).reason == "merged_grid_overlap"
    assert merged(spark, 3, 3, {(0, 0): (0.0, 0.0, 60.0, 20.0), (0, 1): None}).reason == "merged_grid_boundaries_unresolved"
    assert merged(spark, 3, 3, {(1, 1): (0.0, 20.0, 80.0, 40.0), (1, 0): None}).reason == "merged_anchor_slot_mismatch"
    assert merged(spark, 3, 3, {(0, 0): (5.0, 0.0, 5.0, 20.0), (1, 1): None}).reason == "merged_invalid_cell_geometry"
    assert merged(spark, 1, 3, {(0, 1): None}).reason == "merged_candidate_too_small"


SPANS = "block_order int, line int, seq int, span_id string, text string, x0 double, y0 double, x1 double, y1 double"


def text(rows, cols, order=0, dx=0.0, dy=0.0):
    return [(r + order, 0, c, f"{order}:{r}:{c}", f"t{r}{c}", c * WALL + 4 + dx, r * 20.0 + 4 + dy, c * WALL + 20 + dx, r * 20.0 + 12 + dy) for r in range(rows) for c in range(cols)]


def inspect(spark, spans, n_rows=3, n_cols=3):
    grids = T.simple_grids(candidate(spark, n_rows, n_cols, cells(n_rows, n_cols)))
    return T.inspect_tables(grids, frame(spark, spans, SPANS)).first()


def test_inspection_reasons(spark):
    good = inspect(spark, text(3, 3))
    assert (good.reason, good.blocks, good.cells_filled, good.rows_filled, good.cols_filled) == (None, [0, 1, 2], 9, 3, 3)
    assert inspect(spark, [(9, 0, 0, "a", "far", 500.0, 500.0, 520.0, 510.0)]).reason == T.NO_TEXT
    assert inspect(spark, text(3, 3)[:3]).reason == T.SPARSE
    assert inspect(spark, text(3, 3) + [(2, 1, 0, "b", "below", 4.0, 80.0, 30.0, 90.0)]).reason == T.CROSSING
    assert inspect(spark, text(3, 3) + [(2, 1, 0, "b", "  ", 4.0, 80.0, 30.0, 90.0)]).reason is None
    assert inspect(spark, [r if r[0] < 2 else (r[0] + 1, *r[1:]) for r in text(3, 3)] + [(2, 0, 0, "b", "between", 400.0, 4.0, 430.0, 9.0)]).reason == T.APART
    assert inspect(spark, text(3, 3) + [(1, 1, 0, "b", "half", 36.0, 24.0, 44.0, 30.0)]).reason == T.UNOWNED
    over = inspect(spark, text(3, 3) + [(1, 1, 0, "b", "more right", 34.0, 24.0, 50.0, 30.0)])
    assert over.reason is None and over.spans == 10


def test_later_tables_lose_blocks_that_are_taken(spark):
    rows = [(i, [0, 1] if i < 2 else [5], None, 4) for i in range(3)]
    tables = frame(spark, rows, "table_id int, blocks array<int>, seen string, cells_filled int")
    assert {r.table_id: r.seen for r in T._first_takes(tables, T.TAKEN).collect()} == {0: None, 1: T.TAKEN, 2: None}


def test_many_objects_meet_once_each(spark):
    """Spans over lattice lines are counted once, and owners equal those of all pairs."""
    import random

    rng = random.Random(4)
    spans = []
    for i in range(400):
        x, y = rng.uniform(-30, 330), rng.uniform(-30, 230)
        spans.append((i, 0, 0, f"s{i}", "x", x, y, x + rng.uniform(0, 60), y + rng.uniform(0, 30)))
    grids = T.simple_grids(candidate(spark, 10, 7, cells(10, 7)))
    got = {r.span_id: r.cell and (r.cell.row, r.cell.col) for r in T.span_cells(grids, frame(spark, spans, SPANS)).collect()}

    def share(s, q):
        w, h = min(s[2], q[2]) - max(s[0], q[0]), min(s[3], q[3]) - max(s[1], q[1])
        a = (s[2] - s[0]) * (s[3] - s[1])
        return max(0.0, w) * max(0.0, h) / a if a > 0 else 0.0

    def around(s, q):
        x, y = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
        return q[0] <= x <= q[2] and q[1] <= y <= q[3]

    want = {}
    boxes = [((c[0], c[1]), c[2:]) for c in cells(10, 7)]
    for s in spans:
        box = s[5:]
        if share(box, (0.0, 0.0, 280.0, 200.0)) >= 0.5 or around(box, (0.0, 0.0, 280.0, 200.0)):
            centred = [k for k, q in boxes if around(box, q)]
            best = sorted(((share(box, q), k) for k, q in boxes), reverse=True)
            want[s[3]] = centred[0] if len(centred) == 1 else best[0][1] if best[0][0] >= 0.5 and best[0][0] - best[1][0] > 1e-9 else None
    assert got == want


def retry(spark, spans):
    verdicts, parts = T.retry_at_boundaries(T.simple_grids(candidate(spark, 3, 3, cells(3, 3))), frame(spark, spans, SPANS))
    return verdicts.first(), sorted((r.span_id, r.part) for r in parts.where("part = 'residual'").collect())


def test_boundary_retry(spark):
    below = [(2, 1, 0, "b", "below", 4.0, 80.0, 30.0, 90.0), (2, 2, 0, "c", "more", 4.0, 95.0, 30.0, 99.0)]
    assert inspect(spark, text(3, 3) + below).reason == T.CROSSING
    verdict, residual = retry(spark, text(3, 3) + below)
    assert (verdict.reason, verdict.cuts, residual) == (None, 1, [("b", "residual"), ("c", "residual")])
    assert retry(spark, text(3, 3))[0].reason == "boundary_partition_not_applicable"
    assert retry(spark, text(3, 3) + [(2, 1, 0, "b", "cut", 110.0, 50.0, 140.0, 58.0)])[0].reason == "boundary_partition_ambiguous_block_geometry"
    assert retry(spark, text(3, 3) + [(2, -1, 0, "b", "first", 4.0, 80.0, 30.0, 90.0)])[0].reason == "boundary_partition_requires_table_prefix"
    again = [(2, 1, 0, "b", "below", 4.0, 80.0, 30.0, 90.0), (2, 2, 0, "c", "inside", 4.0, 45.0, 30.0, 50.0)]
    assert retry(spark, text(3, 3) + again)[0].reason == "boundary_partition_table_reappears_after_residual"


def test_regions_are_all_or_nothing(spark):
    left, right = grid_strokes(3, 3), [(x0 + 200, y0, x1 + 200, y1) for x0, y0, x1, y1 in grid_strokes(3, 3)]
    spans = frame(spark, text(3, 3) + text(3, 3, 50, 200.0), SPANS)
    made = T.region_tables(strokes(spark, left + right), spans).orderBy("table_id").collect()
    assert [(r.reason, r.strategy, len(r.anchors)) for r in made] == [(None, "lines_strict", 9)] * 2
    bad = T.region_tables(strokes(spark, left + right), frame(spark, text(3, 3), SPANS)).orderBy("table_id").collect()
    assert [r.reason for r in bad] == ["segmented_minimum_tables_not_met", T.NO_TEXT] and not any(r.anchors for r in bad)
    one = T.region_tables(strokes(spark, left), spans).collect()
    assert [r.reason for r in one] == ["segmented_insufficient_vector_regions"]
    assert T.region_tables(strokes(spark, []), spans).count() == 0


def test_edges_of_boxes(spark):
    made = T.box_strokes(frame(spark, [(0.0, 0.0, 4.0, 2.0)], "x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in made.collect()) == [(0.0, 0.0, 0.0, 2.0), (0.0, 0.0, 4.0, 0.0), (0.0, 2.0, 4.0, 2.0), (4.0, 0.0, 4.0, 2.0)]
    assert {(r.axis, r.at) for r in T.segments(made, 0.75).select("axis", F.col("at")).collect()} == {("x", 0.0), ("x", 4.0), ("y", 0.0), ("y", 2.0)}


def test_forests_of_any_depth(spark):
    from glyphmill.operators.mutations import unreachable

    chain = [(i, i - 1 if i else None) for i in range(300)]
    ring = [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(2000 + i, 1999 + i if i else 1003) for i in range(40)]
    made = unreachable(spark.createDataFrame(chain + ring + [(5, 4), (9000, 8999)], "id long, parent_id long"))
    assert {r.id for r in made.collect()} == {i for i, _ in ring}
    assert unreachable(spark.createDataFrame(chain, "id long, parent_id long")).count() == 0


def test_paths_of_any_depth(spark):
    from glyphmill.operators.hierarchy import tree_paths

    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(140)] + [("b", "n3"), ("x", "y"), ("y", "x"), ("z", "x"), ("lost", "nowhere"), ("below", "lost")]
    edges = spark.createDataFrame(rows, "id string, parent_id string")
    made = {r.id: r for r in tree_paths(edges, edges.where("id = 'n0'").select("id")).collect()}
    assert set(made) == {f"n{i}" for i in range(140)} | {"b"} and all(made[f"n{i}"].path == [f"n{j}" for j in range(i + 1)] and made[f"n{i}"].depth == i for i in range(140))
    assert made["b"].path == ["n0", "n1", "n2", "n3", "b"]
