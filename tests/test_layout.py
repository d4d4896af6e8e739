import itertools
import random

import pytest

from glyphmill.operators import layout as L

P = L.ColumnPolicy()


def column(x0, x1, tops, first, step=1, height=10.0):
    return [(first + i * step, x0, float(y), x1, y + height) for i, y in enumerate(tops)]


def ids(blocks):
    return [b[0] for b in blocks]


def plain_cohort(lanes, width):
    """All pairs by plain comparison, then further lanes from the left."""
    share = lambda a0, a1, b0, b1: max(0.0, min(a1, b1) - max(a0, b0)) / min(a1 - a0, b1 - b0)
    good = []
    for i, j in itertools.combinations(range(len(lanes)), 2):
        a, b = lanes[i], lanes[j]
        wide = min(a.x1 - a.x0, b.x1 - b.x0) / max(a.x1 - a.x0, b.x1 - b.x0)
        if min(len(a.blocks), len(b.blocks)) >= 2 and max(b.x0 - a.x1, a.x0 - b.x1) >= 0.025 * width and share(a.y0, a.y1, b.y0, b.y1) >= 0.2 and wide >= 0.35:
            good.append((len(a.blocks) + len(b.blocks), share(a.y0, a.y1, b.y0, b.y1), -i, -j))
    return None if not good else tuple(-x for x in max(good)[2:])


def test_columns_are_read_one_after_the_other():
    two = column(0.0, 180.0, [50, 90, 130], 0, 2) + column(220.0, 400.0, [63, 103, 143], 1, 2)
    assert ids(L.order_page(sorted(two), 400.0, P)) == [0, 2, 4, 1, 3, 5]
    title, foot = (50, 0.0, 0.0, 400.0, 20.0), (51, 0.0, 300.0, 400.0, 320.0)
    assert ids(L.order_page([*sorted(two), title, foot], 400.0, P)) == [50, 0, 2, 4, 1, 3, 5, 51]
    three = two + column(440.0, 620.0, [56, 96, 136], 20)
    assert ids(L.order_page(sorted(three), 640.0, P)) == [0, 2, 4, 1, 3, 5, 20, 21, 22]
    short = (60, 20.0, 2.0, 90.0, 12.0)  # a short title above is no separator, yet above
    assert ids(L.order_page([*sorted(two), short], 400.0, P)) == [60, 0, 2, 4, 1, 3, 5]


def test_doubtful_pages_keep_their_native_order():
    numbers = column(0.0, 300.0, [50, 90, 130], 0, 2) + column(380.0, 400.0, [63, 103, 143], 1, 2)  # narrow lane of equation numbers
    assert ids(L.order_page(sorted(numbers), 400.0, P)) == [0, 1, 2, 3, 4, 5]
    rows = [b for i in range(6) for b in ((2 * i, 0.0, 40.0 * i, 150.0, 40.0 * i + 10), (2 * i + 1, 200.0, 40.0 * i, 350.0, 40.0 * i + 10))]
    assert L.aligned(rows, 400.0, P) and ids(L.order_page(rows, 400.0, P)) == list(range(12))
    assert not L.aligned(rows[:4], 400.0, P)
    assert L.order_page([], 400.0, P) == [] and ids(L.order_page([(7, 0.0, 0.0, 1.0, 1.0)], 400.0, P)) == [7]
    beside = column(0.0, 180.0, [50, 90, 130], 0, 2) + column(220.0, 400.0, [63, 103, 143], 1, 2) + [(9, 450.0, 70.0, 500.0, 80.0)]
    assert ids(L.order_page(sorted(beside), 520.0, P)) == [0, 1, 2, 3, 4, 5, 9]


def test_the_best_pair_is_that_of_a_plain_search():
    rng = random.Random(8)
    for _ in range(300):
        lanes = L._lanes([(i, x, y, x + rng.choice([30.0, 80.0, 150.0]), y + 10) for i, (x, y) in enumerate((rng.choice([0.0, 90.0, 200.0, 380.0]) + rng.uniform(0, 9), rng.uniform(0, 400)) for _ in range(rng.randint(2, 14)))], P)
        got, want = L.cohort(lanes, 500.0, P), plain_cohort(lanes, 500.0)
        assert (got is None) == (want is None) and (want is None or set(want) <= set(got))


def test_order_of_pages_in_spark(spark):
    two = column(0.0, 180.0, [50, 90, 130], 0, 2) + column(220.0, 400.0, [63, 103, 143], 1, 2)
    rows = [("d", p, *b, 400.0) for p in (1, 2) for b in two]
    made = L.column_order(spark.createDataFrame(rows, "document_id string, page int, block_order int, x0 double, y0 double, x1 double, y1 double, page_width double"))
    assert {p: [r.block_order for r in made.where(f"page = {p}").orderBy("reading_order").collect()] for p in (1, 2)} == {1: [0, 2, 4, 1, 3, 5], 2: [0, 2, 4, 1, 3, 5]}


TP = L.TextTablePolicy()


def test_longest_runs_come_first():
    def row(y, xs):
        return [(x, y, x + 10.0, y + 8.0) for x in xs]

    boxes = row(0, [0, 50, 100]) + row(20, [0, 50, 100]) + row(40, [0, 50, 100]) + row(60, [30, 80, 130]) + row(80, [0, 50]) + row(100, [0, 50, 100]) + row(120, [1, 51, 101])
    assert [len(r) for r in L.aligned_runs(boxes, TP)] == [3]
    more = boxes + row(140, [0, 50, 100]) + row(160, [0, 50, 100])
    assert [(len(r), r[0][0]) for r in L.aligned_runs(more, TP)] == [(3, 0), (4, 14)]
    drift = [b for i in range(6) for b in row(20.0 * i, [5.0 * i, 50 + 5.0 * i, 100 + 5.0 * i])]
    assert [len(r) for r in L.aligned_runs(drift, TP)] == []  # edges move by more than the tolerance within any three rows


SPANS = "document_id string, page int, block_order int, line int, seq int, span_id string, text string, x0 double, y0 double, x1 double, y1 double"


def spans(spark, rows):
    return spark.createDataFrame([("d", 1, *r) for r in rows], SPANS)


def table(n_rows, n_cols, order=0):
    return [(order + r, 0, c, f"{r}:{c}", f"t{r}{c}", 40.0 * c, 20.0 * r, 40.0 * c + 20, 20.0 * r + 10) for r in range(n_rows) for c in range(n_cols)]


def test_spans_that_follow_closely_are_one_segment(spark):
    rows = [(0, 0, 0, "a", "two", 0.0, 0.0, 10.0, 8.0), (0, 0, 1, "b", "words ", 14.0, 1.0, 30.0, 9.0), (0, 0, 2, "c", "on", 31.0, 1.0, 40.0, 9.0), (0, 0, 3, "d", "far", 60.0, 0.0, 70.0, 8.0), (0, 0, 4, "e", "low", 72.0, 6.0, 80.0, 14.0), (0, 0, 5, "f", "  ", 81.0, 6.0, 82.0, 14.0)]
    assert [(r.text, r.x0, r.x1, r.n_spans) for r in L.text_segments(spans(spark, rows)).orderBy("x0").collect()] == [("two words on", 0.0, 40.0, 3), ("far", 60.0, 70.0, 1), ("low", 72.0, 80.0, 1)]


CASES = [
    (table(3, 3), None),
    (table(2, 3), "none"),
    (table(3, 3) + [(2, 1, 0, "x", "goes on", 0.0, 200.0, 50.0, 210.0)], "text_aligned_source_block_crosses_boundary"),
    ([(*r[:4], "= <" if r[2] == 1 else r[4], *r[5:]) for r in table(3, 3)], "text_aligned_operator_lane"),
    ([(*r[:7], r[7] + 10, r[8]) for r in table(3, 3)], "text_aligned_insufficient_column_gap"),
    ([(*r[:6], r[6] - 9 * r[0], r[7], r[8] - 9 * r[0]) for r in table(3, 3)], "text_aligned_dense_row_spacing"),
    ([(*r[:6], r[6] * 3, r[7], r[8] + r[6] * 2) for r in table(3, 3)], "text_aligned_rows_too_far_apart"),
    ([(r[0] * 2, *r[1:]) for r in table(3, 3)] + [(1, 0, 0, "y", "between", 500.0, 300.0, 520.0, 310.0)], "text_aligned_source_blocks_noncontiguous"),
]


@pytest.mark.parametrize(("rows", "reason"), CASES)
def test_text_tables(spark, rows, reason):
    made = L.text_tables(spans(spark, rows)).collect()
    if reason == "none":
        assert made == []
        return
    assert [r.reason for r in made] == [reason]
    if reason is None:
        cells = {(a.row, a.col): (a.x0, a.y0, a.x1, a.y1, a.text) for a in made[0].anchors}
        assert cells[1, 1] == (30.0, 15.0, 70.0, 35.0, "t11") and len(cells) == 9 and made[0].blocks == [0, 1, 2]
