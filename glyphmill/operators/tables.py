"""Ruled tables of pages: grids from strokes, merged grids, inspection against text spans, boundary retry and regions.

All tables are keyed by document_id and page.  A candidate is one row: table_id, box, n_rows,
n_cols and ``cells``, an array of (row, col, box), the box null where a slot has no cell of its
own (:func:`gather` makes it).  Each step adds ``reason``, the first one against it (null:
accepted), and ``anchors``, cells with their spans.  A candidate's cells are worked on as arrays
within its row, so a step has one shuffle at most and plans stay a chain; rows that come dealt by page stay so.

Strokes have x0, y0, x1, y1, and table_id where they belong to one candidate; spans have
block_order, line, seq, span_id, text and a box.  Spans of a page are one array, which meets the
candidate's cells through a coarse lattice, so a page with many objects is not all pairs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import pairwise
from math import ceil
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import BOX, PAGE, _swept
from .rows import by_row

KEY = [*PAGE, "table_id"]
ANCHORS = "array<struct<row:int,col:int,row_span:int,col_span:int,x0:double,y0:double,x1:double,y1:double>>"

#: The reasons against a candidate.  Those of the second row get the prefix merged_ for merged grids.
TOO_SMALL, ROW_TOPOLOGY, COLUMN_TOPOLOGY, MISSING_CELLS, IRREGULAR = "candidate_too_small", "row_topology_mismatch", "column_topology_mismatch", "complex_or_merged_cells", "complex_or_irregular_topology"
UNOWNED, CROSSING, NO_TEXT, APART, SPARSE, TAKEN = "ambiguous_source_span_assignment", "source_block_crosses_table_boundary", "no_source_text_ownership", "source_blocks_noncontiguous", "insufficient_populated_cells", "overlapping_source_ownership"
MERGED_REASONS = ["merged_candidate_too_small", "merged_row_topology_mismatch", "merged_column_topology_mismatch", "merged_invalid_cell_geometry", "candidate_has_no_merged_slots", "merged_grid_boundaries_unresolved", "merged_grid_does_not_cover_table_bbox", "merged_cell_boundary_unresolved", "merged_anchor_slot_mismatch", "merged_grid_overlap", "missing_slots_not_explained_by_span", "merged_grid_hole"]
PARTITION_REASONS = ["boundary_partition_not_applicable", "boundary_partition_ambiguous_block_geometry", "boundary_partition_requires_table_prefix", "boundary_partition_missing_residual_suffix", "boundary_partition_table_reappears_after_residual", "boundary_partition_table_prefix_contains_blank_line", "boundary_partition_visual_order_overlap", "boundary_partition_too_many_blocks", "boundary_partition_table_span_cover_drift"]


@dataclass(frozen=True)
class TablePolicy:
    """Fixed values of the checks; lengths in points."""

    rows: int = 2
    cols: int = 2
    cells: int = 6
    populated_rows: int = 2
    populated_cols: int = 2
    populated_cells: int = 4
    overlap: float = 0.5
    tolerance: float = 3.0
    support: float = 0.75
    alignment: float = 0.75
    active_fraction: float = 0.4
    active_least: int = 3
    partitioned_most: int = 2
    regions_least: int = 2
    regions_most: int = 16
    region_reach: float = 3.0
    lattice: float = 64.0


POLICY = TablePolicy()


def gather(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidates from a table of them and a table of their cells."""
    cell = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in BOX])
    made = cells.groupBy(*KEY).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    none = F.array().cast("array<struct<row:int,col:int,x0:double,y0:double,x1:double,y1:double>>")
    rows = tables.select(*KEY, *[F.col(c).cast("double").alias(c) for c in BOX], F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"))
    return rows.join(made, KEY, "left").withColumn("cells", F.coalesce("cells", none))


# Boundaries and their support


def segments(strokes: DataFrame, tolerance: float) -> DataFrame:
    """Strokes along an axis: ``axis`` (the one whose boundaries they support), ``at``, ``start``, ``stop``."""
    flat, tall = F.abs(F.col("y1") - F.col("y0")) <= tolerance, F.abs(F.col("x1") - F.col("x0")) <= tolerance
    keys = KEY if "table_id" in strokes.columns else PAGE
    along = lambda c: (F.least(f"{c}0", f"{c}1").cast("double").alias("start"), F.greatest(f"{c}0", f"{c}1").cast("double").alias("stop"))
    line = lambda axis, other: F.struct(F.lit(axis).alias("axis"), ((F.col(f"{axis}0") + F.col(f"{axis}1")) / 2).cast("double").alias("at"), *along(other))
    return strokes.select(*keys, F.when(flat & ~tall, line("y", "x")).when(tall & ~flat, line("x", "y")).alias("s")).where("s is not null").select(*keys, "s.*")


def box_strokes(boxes: DataFrame) -> DataFrame:
    """The four edges of boxes as strokes."""
    edges = [("x0", "y0", "x1", "y0"), ("x0", "y1", "x1", "y1"), ("x0", "y0", "x0", "y1"), ("x1", "y0", "x1", "y1")]
    keep = [c for c in boxes.columns if c not in BOX]
    return boxes.select(*keep, F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(e, BOX, strict=True)]) for e in edges])).alias("e")).select(*keep, "e.*")


def _drawn(lines: Column) -> Column:
    """Lines at one place that touch or overlap, as one line: they cover the same, and grids draw a boundary cell by cell."""

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        on = F.coalesce((s["at"] == last["at"]) & (s["start"] <= last["stop"]), F.lit(False))
        grown = F.struct(last["at"].alias("at"), last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(on, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(lines), F.slice(lines, 1, 0), step)


class _Lines:
    """Lines (at, start, stop) along one axis, and the share of a stretch that those near a boundary cover together.

    Lines at one place that touch or overlap are one: they cover the same, and grids draw a boundary cell by cell.
    """

    def __init__(self, lines: list[tuple], alignment: float):
        self.lines: list[tuple] = []
        for s in sorted(lines):
            last = self.lines[-1] if self.lines else None
            if last is not None and s[0] == last[0] and s[1] <= last[2]:
                if s[2] > last[2]:
                    self.lines[-1] = (*last[:2], s[2])
            else:
                self.lines.append(s)
        self.places, self.alignment = [s[0] for s in self.lines], alignment
        self.near: dict[float, list[tuple]] = {}
        self.shares: dict[tuple, float] = {}

    def share(self, at: float, low: float, high: float) -> float:
        known = self.shares.get((at, low, high))
        if known is None:
            known = self.shares[at, low, high] = self._share(at, low, high)
        return known

    def _share(self, at: float, low: float, high: float) -> float:
        if not high > low:
            return 0.0
        near = self._near(at)
        if len(near) == 1:
            start, stop = max(low, near[0][0]), min(high, near[0][1])
            return min(1.0, (stop - start) / (high - low)) if stop > start else 0.0
        cut = sorted((max(low, start), min(high, stop)) for start, stop in near if stop > low and start < high)
        total, reached = 0.0, low
        for start, stop in cut:
            if stop > start:
                total += max(0.0, stop - max(start, reached))
                reached = max(reached, stop)
        return min(1.0, total / (high - low))

    def _near(self, at: float) -> list[tuple]:
        near = self.near.get(at)
        if near is None:
            # the bounds of the search are wide, the comparison decides
            first, last = bisect_left(self.places, at - 2 * self.alignment), bisect_right(self.places, at + 2 * self.alignment)
            near = self.near[at] = sorted([s[1:] for s in self.lines[first:last] if abs(s[0] - at) <= self.alignment])
        return near

    def whole(self, at: float, low: float, high: float) -> bool:
        """Whether one line covers the stretch, and with it each part of it."""
        near = self._near(at)
        return len(near) == 1 and near[0][0] <= low and near[0][1] >= high

    def kept(self, bounds: list[float], low: float, high: float, p: TablePolicy) -> list[float]:
        """Ascending boundaries with enough support, each within the tolerance of the last one kept averaged into it."""
        out: list[float] = []
        for b in bounds:
            if self.share(b, low, high) >= p.support:
                if out and b - out[-1] <= p.tolerance:
                    out[-1] = (out[-1] + b) / 2
                else:
                    out.append(b)
        return out


# Grids from strokes

#: The reasons against a grid from strokes.
GRID_REASONS = ["segmented_invalid_candidate_bbox", "segmented_insufficient_raw_column_boundaries", "segmented_insufficient_raw_row_boundaries", "segmented_insufficient_source_vector_segments", "segmented_insufficient_supported_column_boundaries", "segmented_no_stable_vertical_grid_core", "segmented_multiple_stable_vertical_grid_cores", "segmented_insufficient_refined_column_boundaries", "segmented_empty_stable_grid_core", "segmented_logical_column_boundaries_unresolved", "segmented_logical_row_boundaries_unresolved", "segmented_grid_core_top_boundary_unsupported", "segmented_grid_core_bottom_boundary_unsupported", "segmented_normalized_grid_too_small", "segmented_nonrectangular_merged_component"]


def _core(bounds: list[float], ys: list[float], vertical: _Lines, p: TablePolicy) -> tuple[int, float | None, float | None]:
    """Runs of neighbouring row bands in which enough boundaries are drawn: their number, and top and bottom of the first."""
    wanted = min(len(bounds), max(p.active_least, ceil(len(bounds) * p.active_fraction)))
    broken = [b for b in bounds if not vertical.whole(b, ys[0], ys[-1])]
    wanted -= len(bounds) - len(broken)
    active = [wanted <= 0 or sum([vertical.share(b, low, high) >= p.support for b in broken]) >= wanted for low, high in pairwise(ys)]
    starts = [i for i, on in enumerate(active) if on and not (i and active[i - 1])]
    if not starts:
        return 0, None, None
    end = next((i for i in range(starts[0], len(active)) if not active[i]), len(active))
    return len(starts), ys[starts[0]], ys[end]


def _rooms(cols: int, right: list[bool], below: list[bool]) -> list[tuple]:
    """Connected slots of a grid, given row by row with their open walls: first row and column, spans, and number of slots."""
    if not any(right) and not any(below):
        return [(i // cols, i % cols, 1, 1, 1) for i in range(len(right))]
    up = list(range(len(right)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (r, b) in enumerate(zip(right, below, strict=True)):
        for beside in [i + 1] * r + [i + cols] * b:
            x, y = sorted((root(i), root(beside)))
            up[y] = x
    members: dict[int, list[int]] = {}
    for i in range(len(up)):
        members.setdefault(root(i), []).append(i)
    out = []
    for found in members.values():
        rows, columns = [i // cols for i in found], [i % cols for i in found]
        out.append((min(rows), min(columns), max(rows) - min(rows) + 1, max(columns) - min(columns) + 1, len(found)))
    return out


def _grid(box: tuple, cells: list[tuple], strokes: list[tuple], p: TablePolicy) -> tuple:
    """Reason against a candidate, or rows, columns and anchors of the grid that strokes support; whether it merges slots; and the boundaries there were before."""
    invalid, few_x, few_y, no_lines, few_kept, no_core, cores, few_second, empty, no_cols, no_rows, top_off, bottom_off, small, uneven = GRID_REASONS
    tall, flat = [], []
    for stroke in strokes:
        if None in stroke:
            continue
        x0, y0, x1, y1 = stroke
        level, upright = abs(y1 - y0) <= p.alignment, abs(x1 - x0) <= p.alignment
        if upright and not level:
            tall.append(((x0 + x1) / 2, y0, y1) if y0 <= y1 else ((x0 + x1) / 2, y1, y0))
        elif level and not upright:
            flat.append(((y0 + y1) / 2, x0, x1) if x0 <= x1 else ((y0 + y1) / 2, x1, x0))
    raw = []
    for i, lines in enumerate((tall, flat)):
        drawn = [v for c in cells if c[2] is not None for v in (c[2 + i], c[4 + i])] if cells else [s[0] for s in lines]
        values = [box[i], box[i + 2], *drawn]
        there = [v for v in values if v is not None]
        raw.append((_means(sorted(there), p.tolerance), len(values) - len(there)))
    (xs, x_lost), (ys, y_lost) = raw
    sizes = len(xs) + x_lost, len(ys) + y_lost
    no = lambda reason, merged=False: (reason, None, None, None, merged, *sizes)
    if any(box[i] is not None and box[i + 2] is not None and box[i + 2] <= box[i] for i in (0, 1)):
        return no(invalid)
    if sizes[0] < p.cols + 1 or sizes[1] < p.rows + 1:
        return no(few_x if sizes[0] < p.cols + 1 else few_y)
    if not tall or not flat:
        return no(no_lines)
    vertical, horizontal = _Lines(tall, p.alignment), _Lines(flat, p.alignment)
    first = vertical.kept(xs, box[1], box[3], p) if None not in (box[1], box[3]) else []
    if len(first) < p.cols + 1:
        return no(few_kept)
    runs, top, bottom = _core(first, ys, vertical, p)
    if runs != 1:
        return no(cores if runs else no_core)
    second = vertical.kept(xs, top, bottom, p)
    if len(second) < p.cols + 1:
        return no(few_second)
    if second != first:
        runs, second_top, second_bottom = _core(second, ys, vertical, p)
        if runs != 1:
            return no(cores if runs else no_core)
        top, bottom = max(top, second_top), min(bottom, second_bottom)
    if bottom <= top:
        return no(empty)
    gx = vertical.kept(xs, top, bottom, p) if second != first else second
    n_cols = len(gx) - 1
    if n_cols < p.cols:
        return no(no_cols)
    gy = horizontal.kept([b for b in ys if top - p.tolerance <= b <= bottom + p.tolerance], gx[0], gx[-1], p)
    n_rows = len(gy) - 1
    if n_rows < p.rows:
        return no(no_rows)
    if abs(gy[0] - top) > p.tolerance or abs(gy[-1] - bottom) > p.tolerance:
        return no(top_off if abs(gy[0] - top) > p.tolerance else bottom_off)
    if n_rows * n_cols < p.cells:
        return no(small)
    walls = [c + 1 == n_cols or vertical.whole(gx[c + 1], gy[0], gy[-1]) for c in range(n_cols)]
    floors = [r + 1 == n_rows or horizontal.whole(gy[r + 1], gx[0], gx[-1]) for r in range(n_rows)]
    beside = [not wall and vertical.share(gx[c + 1], gy[r], gy[r + 1]) < p.support for r in range(n_rows) for c, wall in enumerate(walls)]
    below = [not floor and horizontal.share(gy[r + 1], gx[c], gx[c + 1]) < p.support for r, floor in enumerate(floors) for c in range(n_cols)]
    rooms = _rooms(n_cols, beside, below)
    merged = any([r[4] > 1 for r in rooms])
    if any([slots != high * wide for _, _, high, wide, slots in rooms]):
        return no(uneven, merged)
    return None, n_rows, n_cols, [(r, c, high, wide, gx[c], gy[r], gx[c + wide], gy[r + high]) for r, c, high, wide, _ in rooms], merged, *sizes


def _stroke_boxes(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """Strokes of a page or of a candidate as one array."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX])
    return strokes.groupBy(*keys).agg(F.collect_list(box).alias("gm_strokes"))


def normalise_grids(candidates: DataFrame, strokes: DataFrame, policy: TablePolicy = POLICY) -> DataFrame:
    """Candidates with the grid that strokes support: ``reason``, n_rows, n_cols, ``anchors``, ``merged``, and how many boundaries there were before.

    Boundaries come from the candidate's cells where it has any, else from the strokes themselves.  Column
    boundaries are kept by the share of the stable core that strokes cover; the core is the one run
    of row bands in which enough of them are drawn, found again with those kept; row boundaries
    are kept by their cover between the outer columns.  Neighbouring slots without a wall
    between them are one cell, which must be a rectangle.
    """
    keys = KEY if "table_id" in strokes.columns else PAGE
    kind = f"struct<reason:string,n_rows:int,n_cols:int,anchors:{ANCHORS},merged:boolean,raw_cols:int,raw_rows:int>"
    find = by_row(kind, lambda x0, y0, x1, y1, cells, each: _grid((x0, y0, x1, y1), cells or [], each or [], policy))
    made = candidates.join(_stroke_boxes(strokes, keys), keys, "left").withColumn("gm", find(*BOX, "cells", "gm_strokes"))
    return made.select(*KEY, *BOX, "gm.*")


# Simple and merged grids from cells


def _shape(cells: list[tuple], n_rows: int, n_cols: int, p: TablePolicy, codes: list[str]) -> tuple[str | None, int, int]:
    """First of three codes (too small, rows, columns) against cells (row, col, box), and how many cells are missing and flat."""
    counts: dict[int, int] = {}
    for c in cells:
        counts[c[0]] = counts.get(c[0], 0) + 1
    missing = sum([c[2] is None for c in cells])
    flat = sum([x0 is not None and (x1 <= x0 or y1 <= y0) for _, _, x0, y0, x1, y1 in cells])
    small = n_rows < p.rows or n_cols < p.cols or n_rows * n_cols < p.cells
    code = codes[0] if small else codes[1] if len(counts) != n_rows else codes[2] if any(n != n_cols for n in counts.values()) else None
    return code, missing, flat


def _irregular(box: tuple, n_rows: int, cells: list[tuple], t: float) -> bool:
    """Whether cells leave the box or do not fill it, are out of line with their row and the first row, or run into those before or above."""
    near = lambda a, b: abs(a - b) <= t
    tops, lows, head, at = {}, {}, [], {}
    for c in cells:
        r = c[0]
        tops[r], lows[r] = min(tops.get(r, c[3]), c[3]), max(lows.get(r, c[5]), c[5])
        at.setdefault(c[:2], c)
        if r == 0:
            head.append(c)
    for row, col, x0, y0, x1, y1 in cells:
        if x0 < box[0] - t or x1 > box[2] + t or y0 < box[1] - t or y1 > box[3] + t:
            return True
        inside = 0 <= row < n_rows
        if inside and not (near(y0, tops[row]) and near(y1, lows[row])):
            return True
        if 0 <= col < len(head) and not (near(x0, head[col][2]) and near(x1, head[col][4])):
            return True
        before = at.get((row, col - 1))
        if (before is not None and x0 < before[4] - t) or (inside and row > 0 and row - 1 in lows and tops[row] < lows[row - 1] - t):
            return True
    return not (near(min(c[2] for c in cells), box[0]) and near(min(c[3] for c in cells), box[1]) and near(max(c[4] for c in cells), box[2]) and near(max(c[5] for c in cells), box[3]))


def simple_grids(candidates: DataFrame, policy: TablePolicy = POLICY) -> DataFrame:
    """First reason against candidates from their cells alone: size, rows, columns, missing or flat cells, cells out of line."""

    def look(x0, y0, x1, y1, n_rows, n_cols, cells):
        code, missing, flat = _shape(cells, n_rows, n_cols, policy, [TOO_SMALL, ROW_TOPOLOGY, COLUMN_TOPOLOGY])
        return code or (MISSING_CELLS if missing or flat else IRREGULAR if _irregular((x0, y0, x1, y1), n_rows, cells, policy.tolerance) else None)

    anchors = F.transform("cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), *[c[x].alias(x) for x in BOX]))
    made = candidates.withColumn("reason", by_row("string", look)(*BOX, "n_rows", "n_cols", "cells"))
    return made.select(*KEY, *BOX, "n_rows", "n_cols", "cells", "reason", F.when(F.col("reason").isNull(), anchors).alias("anchors"))


def _means(ordered: list[float], tolerance: float) -> list[float]:
    """Means of ascending values, those within the tolerance of the one before together."""
    out: list[list] = []
    for v in ordered:
        if out and v - out[-1][2] <= tolerance:
            out[-1] = [out[-1][0] + v, out[-1][1] + 1, v]
        else:
            out.append([v, 1, v])
    return [total / n for total, n, _ in out]


def _place(v: float, bounds: list[float], tolerance: float) -> int | None:
    """The boundary nearest to a value, the lower of two as near, within the tolerance."""
    i = bisect_left(bounds, v)
    if i == len(bounds) or (i > 0 and v - bounds[i - 1] <= bounds[i] - v):
        i -= 1
    return i if i >= 0 and abs(bounds[i] - v) <= tolerance else None


def _merged(box: tuple, n_rows: int, n_cols: int, cells: list[tuple], p: TablePolicy) -> tuple[str | None, list | None]:
    """Reason against a candidate with merged cells, or its anchors."""
    small, rows_off, cols_off, flat_, whole, unresolved, uncovered, edge_off, slot_off, overlapping, no_span, hole = MERGED_REASONS
    code, missing, flat = _shape(cells, n_rows, n_cols, p, [small, rows_off, cols_off])
    code = code or (flat_ if flat else whole if not missing else None)
    if code:
        return code, None
    there = [c for c in cells if c[2] is not None]
    xs, ys = (_means(sorted([box[i], box[i + 2], *(c[i + 2] for c in there), *(c[i + 4] for c in there)]), p.tolerance) for i in (0, 1))
    if len(xs) != n_cols + 1 or len(ys) != n_rows + 1:
        return unresolved, None
    if any(abs(b - v) > p.tolerance for b, v in zip((xs[0], ys[0], xs[-1], ys[-1]), box, strict=True)):
        return uncovered, None
    taken: set[int] = set()
    anchors = []
    at_x = {v: _place(v, xs, p.tolerance) for v in {c[2] for c in there} | {c[4] for c in there}}
    at_y = {v: _place(v, ys, p.tolerance) for v in {c[3] for c in there} | {c[5] for c in there}}
    for row, col, x0, y0, x1, y1 in there:
        a, c, b, d = at_x[x0], at_y[y0], at_x[x1], at_y[y1]
        if a is None or b is None or c is None or d is None:
            return edge_off, None
        if a != col or c != row or b <= a or d <= c:
            return slot_off, None
        slots = [c * n_cols + a] if d - c == b - a == 1 else [r * n_cols + x for r in range(c, d) for x in range(a, b)]
        if not taken.isdisjoint(slots):
            return overlapping, None
        taken.update(slots)
        anchors.append((row, col, d - c, b - a, x0, y0, x1, y1))
    if all(a[2] == 1 and a[3] == 1 for a in anchors):
        return no_span, None
    return (hole, None) if len(taken) < n_rows * n_cols else (None, anchors)


def merged_grids(candidates: DataFrame, policy: TablePolicy = POLICY) -> DataFrame:
    """Anchors with row and column spans inferred from cell boxes; the spans must tile the grid of n_rows by n_cols."""
    look = by_row(f"struct<reason:string,anchors:{ANCHORS}>", lambda x0, y0, x1, y1, n_rows, n_cols, cells: _merged((x0, y0, x1, y1), n_rows, n_cols, cells, policy))
    return candidates.withColumn("gm", look(*BOX, "n_rows", "n_cols", "cells")).select(*KEY, *BOX, "n_rows", "n_cols", "cells", "gm.reason", "gm.anchors")


# Inspection against text


def _contains(q: tuple, x: float, y: float) -> bool:
    return q[0] <= x <= q[2] and q[1] <= y <= q[3]


def _share(s: tuple, q: tuple) -> float:
    """Share of a box in another box."""
    own = max(0.0, s[2] - s[0]) * max(0.0, s[3] - s[1])
    return max(0.0, min(s[2], q[2]) - max(s[0], q[0])) * max(0.0, min(s[3], q[3]) - max(s[1], q[1])) / own if own > 0 else 0.0


def _owner(s: tuple, anchors: list[tuple], near: list[int], least: float) -> int | None:
    """The place of the anchor that holds a span's box, among those near it."""
    x, y = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
    centred = [i for i in near if (a := anchors[i])[4] <= x <= a[6] and a[5] <= y <= a[7]]
    if len(centred) == 1:
        return centred[0]
    claims = sorted([(_share(s, anchors[i][4:]), anchors[i][:4], i) for i in near], reverse=True)[:2]
    if not claims or claims[0][0] < least or (len(claims) > 1 and abs(claims[0][0] - claims[1][0]) <= 1e-9):
        return None
    return claims[0][2]


def _owners(box: tuple, anchors: list[tuple], spans: list[tuple], p: TablePolicy) -> list[tuple[int, int | None]]:
    """Places of the spans (order, line, inked, has text, box) that belong to a candidate, each with the place of the anchor that holds it.

    Anchors are looked up by the lattice cells they lie in, so a candidate with many of them is not all pairs.
    """
    cells: dict[tuple[int, int], list[int]] = {}
    step = p.lattice
    for i, a in enumerate(anchors):
        for gx in range(int(a[4] // step), int(a[6] // step) + 1):
            for gy in range(int(a[5] // step), int(a[7] // step) + 1):
                cells.setdefault((gx, gy), []).append(i)
    out = []
    for at, span in enumerate(spans):
        s = span[4:]
        if not span[3] or None in s:
            continue
        # a box that lies beside has no share, unless a share of none is enough
        if p.overlap > 0 and (s[0] > box[2] or s[2] < box[0] or s[1] > box[3] or s[3] < box[1]) and s[0] <= s[2] and s[1] <= s[3]:
            continue
        if not (_contains(box, (s[0] + s[2]) / 2, (s[1] + s[3]) / 2) or _share(s, box) >= p.overlap):
            continue
        x0, y0, x1, y1 = int(s[0] // step), int(s[1] // step), int(s[2] // step), int(s[3] // step)
        near = cells.get((x0, y0), []) if (x0, y0) == (x1, y1) else sorted({i for gx in range(x0, x1 + 1) for gy in range(y0, y1 + 1) for i in cells.get((gx, gy), [])})
        out.append((at, _owner(s, anchors, near, p.overlap)))
    return out


def _inked() -> Column:
    return F.col("text").rlike("\\S")


SPAN = ["block_order", "line", "inked", "there", *BOX]


def _with_spans(grids: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """Candidates with the spans of their page (or their own, where spans have table_id) as an array, each the numbers of it, beside them what ``more`` names."""
    keys = KEY if "table_id" in spans.columns else PAGE
    numbers = F.struct("block_order", F.col("line").cast("long").alias("line"), F.coalesce(_inked(), F.lit(False)).cast("int").alias("inked"), F.coalesce(F.length("text") > 0, F.lit(False)).cast("int").alias("there"), *[F.col(c).cast("double").alias(c) for c in BOX])
    each = spans.repartition(*PAGE).groupBy(*keys).agg(F.collect_list(F.struct(numbers.alias("n"), *more) if more else numbers).alias("gm_spans"))
    # the planner does not see how much longer arrays of spans are than the rows they come from: no broadcast
    return grids.join(each.hint("merge"), keys, "left")


def _numbers() -> Column:
    return F.col("gm_spans.n")


def span_cells(grids: DataFrame, spans: DataFrame, policy: TablePolicy = POLICY) -> DataFrame:
    """Spans that belong to a candidate, with the cell that holds each: the only one around its centre, else the one that covers at least half of it and more than any other.

    One row of nulls for a candidate to which no span belongs.  ``spans`` may have table_id: then each candidate sees its own.
    """
    find = by_row("array<struct<at:int,cell:int>>", lambda x0, y0, x1, y1, anchors, each: _owners((x0, y0, x1, y1), anchors or [], each or [], policy))
    rows = _with_spans(grids, spans, "span_id", "seq", "text").withColumn("gm_found", find(*BOX, "anchors", _numbers()))
    rows = rows.select(*KEY, "anchors", "gm_spans", F.explode_outer("gm_found").alias("f"))
    s, cell = F.get("gm_spans", F.col("f.at")), F.get("anchors", F.col("f.cell"))
    held = F.when(cell.isNotNull(), F.struct(*[cell[c].alias(c) for c in ("row", "col", "row_span", "col_span")]))
    return rows.select(*KEY, s["span_id"].alias("span_id"), s["n"]["block_order"].alias("block_order"), s["n"]["line"].alias("line"), s["seq"].alias("seq"), s["text"].alias("text"), held.alias("cell"), *[s["n"][c].alias(c) for c in BOX])


def _inspected(box: tuple, anchors: list[tuple], spans: list[tuple], order: list[int], prefix: str, p: TablePolicy) -> tuple:
    """Reason against a candidate from its text, its blocks, and the numbers of spans, cells, rows and columns that hold any.  ``order``: the page's blocks."""
    whole: dict[int, int] = {}
    for s in spans:
        whole[s[0]] = whole.get(s[0], 0) + s[2]
    inked: dict[int, int] = {}
    lost, filled, held = set(), set(), 0
    for at, cell in _owners(box, anchors, spans, p):
        block = spans[at][0]
        inked[block] = inked.get(block, 0) + spans[at][2]
        if cell is None:
            lost.add(block)
        else:
            held += 1
            filled.add(anchors[cell][:4])
    blocks = sorted(b for b in inked if b is not None)
    wrong = next((UNOWNED if b in lost else CROSSING for b in blocks if b in lost or whole[b] > inked[b]), None)
    rows, cols = {c[0] for c in filled}, {x for c in filled for x in range(c[1], c[1] + c[3])}
    sparse = len(filled) < p.populated_cells or len(rows) < p.populated_rows or len(cols) < p.populated_cols
    if wrong is None:
        apart = bool(blocks) and bisect_left(order, blocks[-1]) - bisect_left(order, blocks[0]) + 1 != len(blocks)
        wrong = NO_TEXT if not blocks else APART if apart else SPARSE if sparse else None
    return wrong and prefix + wrong, blocks, held, len(filled), len(rows), len(cols)


def _seen(block: str) -> str:
    return f"struct<seen:string,blocks:array<{block}>,spans:long,cells_filled:int,rows_filled:int,cols_filled:int>"


def _blocks(spans: list[tuple]) -> list[int]:
    return sorted({s[0] for s in spans if s[0] is not None})


def inspect_tables(grids: DataFrame, spans: DataFrame, *, prefix: str = "", policy: TablePolicy = POLICY) -> DataFrame:
    """Verdicts of candidates against the text of their pages: reason, blocks, and cells, rows and columns with text.

    Every span of a candidate has one cell; a block lies in the table or outside; the table's blocks
    follow one another on the page; enough cells, rows and columns hold text; a block belongs to the
    first candidate that takes it.  Candidates with a reason come back as they are.
    """
    rows = _with_spans(grids, spans)
    if "table_id" in spans.columns:
        rows = rows.join(spans.groupBy(*PAGE).agg(F.sort_array(F.collect_set("block_order")).alias("gm_order")), PAGE, "left")
    else:
        rows = rows.withColumn("gm_order", F.lit(None).cast("array<int>"))

    def look(shape, x0, y0, x1, y1, anchors, each, order):
        return (shape, *[None] * 5) if shape else _inspected((x0, y0, x1, y1), anchors or [], each or [], order or _blocks(each or []), prefix, policy)

    found = by_row(_seen(spans.schema["block_order"].dataType.simpleString()), look)("reason", *BOX, "anchors", "gm_spans", "gm_order")
    made = _first_takes(rows.select(*KEY, found.alias("gm")).select(*KEY, "gm.blocks", "gm.spans", "gm.cells_filled", "gm.rows_filled", "gm.cols_filled", "gm.seen"), prefix + TAKEN)
    return made.select(*KEY, F.col("seen").alias("reason"), "blocks", "spans", "cells_filled", "rows_filled", "cols_filled")


def _first_takes(tables: DataFrame, code: str) -> DataFrame:
    """``tables`` with ``code`` for those of a page one of whose blocks an earlier accepted one has taken."""
    rest = [c for c in tables.columns if c not in PAGE]
    pages = tables.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("each"))
    blocks = tables.schema["blocks"].dataType.simpleString()
    kind = tables.schema["table_id"].dataType.simpleString()

    def step(a: Column, x: Column) -> Column:
        late = F.arrays_overlap(a["taken"], x["blocks"])
        return F.struct(F.when(x["seen"].isNull() & ~late, F.concat(a["taken"], x["blocks"])).otherwise(a["taken"]).alias("taken"), F.when(x["seen"].isNull() & late, F.concat(a["late"], F.array(x["table_id"]))).otherwise(a["late"]).alias("late"))

    start = F.struct(F.array().cast(blocks).alias("taken"), F.array().cast(f"array<{kind}>").alias("late"))
    pages = pages.withColumn("late", F.aggregate("each", start, step, lambda a: a["late"]))
    return pages.select(*PAGE, "late", F.explode("each").alias("e")).select(*PAGE, "e.*", "late").withColumn("seen", F.coalesce("seen", F.when(F.array_contains("late", F.col("table_id")), F.lit(code)))).drop("late")


# Boundary retry


def _partition(box: tuple, spans: list[tuple], p: TablePolicy) -> tuple[int | None, str | None, list[str | None]]:
    """Cut blocks of a candidate, first reason against cutting, and the part of each span (none: its block does not reach into the candidate)."""
    none, unclear, no_prefix, no_rest, again, _, overlapping, too_many, _ = PARTITION_REASONS
    t = p.alignment
    low = lambda v: int(v // p.lattice)
    a = [low(v) for v in box]
    touched = {s[0] for s in spans if s[0] is not None and None not in s[4:] and low(s[4]) <= a[2] and low(s[6]) >= a[0] and low(s[5]) <= a[3] and low(s[7]) >= a[1]}
    lines: dict[int, dict[int, list[int]]] = {}
    for at, s in enumerate(spans):
        if s[0] in touched:
            lines.setdefault(s[0], {}).setdefault(s[1], []).append(at)

    def relation(s: tuple) -> str:
        x0, y0, x1, y1 = s[4:]
        if x0 >= box[0] - t and y0 >= box[1] - t and x1 <= box[2] + t and y1 <= box[3] + t and _contains(box, (x0 + x1) / 2, (y0 + y1) / 2):
            return "inside"
        return "outside" if min(x1, box[2]) <= max(x0, box[0]) or min(y1, box[3]) <= max(y0, box[1]) else "ambiguous"

    parts: list[str | None] = [None] * len(spans)
    first, cuts = None, 0
    for block in sorted(lines):
        kinds = {}
        for line, own in lines[block].items():
            seen = {relation(spans[i]) if None not in spans[i][4:] else "ambiguous" for i in own if spans[i][2]}
            kinds[line] = "blank" if not seen else seen.pop() if len(seen) == 1 else "ambiguous"
        # the table part ends before the first line that is not inside
        end = min((line for line, k in kinds.items() if k != "inside"), default=None)
        behind = {line for line in kinds if end is not None and line >= end}
        cut = "inside" in kinds.values() and "outside" in kinds.values()
        cuts += cut
        for line, own in lines[block].items():
            for i in own:
                parts[i] = "whole" if not cut else "residual" if line in behind else "table"
        wrong = unclear if "ambiguous" in kinds.values() else None
        if cut and wrong is None:
            edge = lambda f, of, i: f((v for line in of for at in lines[block][line] if (v := spans[at][i]) is not None), default=None)
            bottom, top = edge(max, kinds.keys() - behind, 7), edge(min, [x for x in behind if kinds[x] == "outside"], 5)
            if len(behind) == len(kinds):
                wrong = no_prefix
            elif not behind:
                wrong = no_rest
            elif any(kinds[x] == "inside" for x in behind):
                wrong = again
            elif bottom is not None and top is not None and top < bottom - t:
                wrong = overlapping
        first = first or wrong
    if not lines:
        return None, None, parts
    return cuts, first or (none if not cuts else too_many if cuts > p.partitioned_most else None), parts


def retry_at_boundaries(grids: DataFrame, spans: DataFrame, policy: TablePolicy = POLICY) -> tuple[DataFrame, DataFrame]:
    """A second look at grids that failed because a block crosses their box: verdicts, and the spans of cut blocks with their part.

    A block that a box cuts has a part in the table (a prefix of whole lines inside) and a residual (the rest, below);
    blocks that only reach into the box are whole.  A crossing block counts with its table lines only, and all their
    spans with text must get a cell.  Verdicts also count the residual spans.
    """
    p = policy

    def look(shape, x0, y0, x1, y1, anchors, each):
        box, each = (x0, y0, x1, y1), each or []
        if shape:
            return None, None, 0, 0, [], (shape, *[None] * 5)
        cuts, code, parts = _partition(box, each, p)
        own = [s for s, part in zip(each, parts, strict=True) if part in ("table", "whole")]
        seen = _inspected(box, anchors or [], own if code is None else [], _blocks(each), "merged_", p)
        return cuts, code, sum(s[3] for s in own), parts.count("residual"), parts, seen

    kind = f"struct<cuts:int,code:string,wanted:int,residual:long,parts:array<string>,seen:{_seen(spans.schema['block_order'].dataType.simpleString())}>"
    rows = _with_spans(grids, spans, "span_id").withColumn("gm", by_row(kind, look)("reason", *BOX, "anchors", _numbers()))
    made = _first_takes(rows.select(*KEY, "gm.cuts", "gm.code", "gm.wanted", "gm.residual", "gm.seen.blocks", "gm.seen.spans", "gm.seen.seen"), "merged_" + TAKEN)
    # a candidate's own spans are those of blocks that reach into it; whole blocks beside its edge are counted by the inspection
    cover = F.when(F.col("spans") > F.col("wanted"), F.lit(PARTITION_REASONS[-1]))
    verdicts = made.select(*KEY, F.coalesce("cuts", F.lit(0)).alias("cuts"), F.when(F.col("cuts").isNull(), F.lit(PARTITION_REASONS[0])).otherwise(F.coalesce("code", "seen", cover)).alias("reason"), "spans", "residual")
    parts = rows.where("gm.cuts is not null and gm.code is null").select(*KEY, "gm_spans", F.posexplode("gm.parts").alias("at", "part")).where("part is not null")
    s = F.get("gm_spans", F.col("at"))
    return verdicts, parts.select(*KEY, s["span_id"].alias("span_id"), s["n"]["block_order"].alias("block_order"), s["n"]["line"].alias("line"), "part")


# Regions


def _rows_of(pages: DataFrame) -> DataFrame:
    """Tables that a function found for each page; an inner generator would infer a filter from the function's result and call it a second time."""
    return pages.select(*PAGE, F.inline_outer("gm")).where("table_id is not null")


def _upright(stroke: tuple) -> tuple:
    """A stroke from its upper left to its lower right end; one end stands for both where the other is not known."""
    x, y = ([v for v in (stroke[i], stroke[i + 2]) if v is not None] or [None] for i in (0, 1))
    return (min(x), min(y), max(x), max(y)) if None not in (*x, *y) else (None,) * 4


def _regions(boxes: list[tuple], reach: float) -> list[tuple[tuple, list[tuple]]]:
    """Groups of strokes (x0, y0, x1, y1) that touch within ``reach``, with their box, from the top of the page; a group without width or height is none."""
    there = {b if None not in b and b[0] <= b[2] and b[1] <= b[3] else _upright(b) for b in boxes}
    ordered = sorted([b for b in there if None not in b], key=itemgetter(1, 0, 2, 3))
    groups: dict[int, list[tuple]] = {}
    for first, b in zip(_swept(ordered, reach), ordered, strict=True):
        groups.setdefault(first, []).append(b)
    found = []
    for own in groups.values():
        x0, y0, x1, y1 = zip(*own, strict=True)
        box = (min(x0), min(y0), max(x1), max(y1))
        if box[2] > box[0] and box[3] > box[1]:
            found.append((box, own))
    return sorted(found, key=lambda r: (r[0][1], r[0][0], r[0][3], r[0][2], r[1][0]))


def stroke_regions(strokes: DataFrame, policy: TablePolicy = POLICY) -> tuple[DataFrame, DataFrame]:
    """Groups of strokes that touch within ``region_reach``: strokes with the table_id of their group, and the groups, numbered from the top of their page."""
    box = "x0:double,y0:double,x1:double,y1:double"
    find = by_row(f"array<struct<table_id:int,{box},own:array<struct<{box}>>>>", lambda each: [(i, *b, own) for i, (b, own) in enumerate(_regions(each, policy.region_reach))])
    rows = _rows_of(_stroke_boxes(strokes, PAGE).select(*PAGE, find("gm_strokes").alias("gm")))
    return rows.select(*KEY, F.explode("own").alias("s")).select(*KEY, "s.*"), rows.drop("own")


def _page_reason(boxes: list[tuple], p: TablePolicy) -> str | None:
    """Reason against all regions of a page: too few, too many, or two that run into each other."""
    if not p.regions_least <= len(boxes) <= p.regions_most:
        return "segmented_insufficient_vector_regions" if len(boxes) < p.regions_least else "segmented_too_many_vector_regions"
    meet = lambda a, b: min(a[2], b[2]) - max(a[0], b[0]) > p.region_reach and min(a[3], b[3]) - max(a[1], b[1]) > p.region_reach
    return "segmented_vector_regions_overlap" if any(meet(a, b) for i, a in enumerate(boxes) for b in boxes[i + 1 :]) else None


def _ruled(strokes: list[tuple], p: TablePolicy) -> tuple[str | None, list[tuple]]:
    """Reason against a page's regions, and the regions: box and grid."""
    regions = _regions(strokes, p.region_reach)
    against = _page_reason([box for box, _ in regions], p)
    return against, [(box, None if against else _grid(box, [], own, p)) for box, own in regions]


def _region_tables(ruled: tuple[str | None, list[tuple]], spans: list[tuple], p: TablePolicy) -> list[tuple]:
    """Verdicts of a page's regions: number, box, reason, rows, columns, strategy and anchors."""
    against, regions = ruled
    if against:
        return [(i, *box, against, None, None, None, None) for i, (box, _) in enumerate(regions)]
    order, taken, out = _blocks(spans), set(), []
    for i, (box, grid) in enumerate(regions):
        reason, n_rows, n_cols, anchors, merged, raw_cols, raw_rows = grid
        strategy = None
        if reason is None:
            strategy = "lines_strict" if not merged and (raw_cols, raw_rows) == (n_cols + 1, n_rows + 1) else "lines"
            reason, blocks, *_ = _inspected(box, anchors, spans, order, "", p)
            if reason is None:
                # a block belongs to the first table that takes it
                reason = None if taken.isdisjoint(blocks) else TAKEN
                taken.update([] if reason else blocks)
        out.append((i, *box, reason, n_rows, n_cols, strategy, None if reason else anchors))
    if sum([r[5] is None for r in out]) >= p.regions_least:
        return out
    return [r if r[5] else (*r[:5], "segmented_minimum_tables_not_met", *r[6:9], None) for r in out]


def region_tables(strokes: DataFrame, spans: DataFrame, policy: TablePolicy = POLICY) -> DataFrame:
    """Tables of pages with several separate ruled regions: verdicts with grid size, strategy and anchors.

    Regions are groups of strokes that touch, numbered from the top of their page.  Each one's grid is made from its
    own strokes and inspected against the page's text; a grid that keeps all drawn boundaries and merges nothing
    is ``lines_strict``.  A page gives its tables only if at least ``regions_least`` regions are accepted.
    Strokes and spans of a page are an array each, so a page is one row and regions are not dealt again; grids of equal
    rulings are made once a batch.
    """
    p = policy
    pages = _with_spans(_stroke_boxes(strokes, PAGE), spans.drop("table_id"))
    kind = f"array<struct<table_id:int,x0:double,y0:double,x1:double,y1:double,reason:string,n_rows:int,n_cols:int,strategy:string,anchors:{ANCHORS}>>"
    find = by_row(kind, lambda ruled, text: _region_tables(ruled, text or [], p), first=lambda each: _ruled(each, p))
    return _rows_of(pages.select(*PAGE, find("gm_strokes", "gm_spans").alias("gm")))
