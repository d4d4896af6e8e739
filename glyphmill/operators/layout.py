"""Order of prose columns on a page, and tables that only the alignment of their text shows.

Both read one row a page with the page's blocks or text segments as an array; what goes from
one object to the next (joining columns, filling rows) and the checks after it are small steps on
that array, in one function of the page's row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import pairwise
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import BOX, PAGE
from .rows import by_row
from .tables import _rows_of


@dataclass(frozen=True)
class ColumnPolicy:
    """Fixed values for columns of prose; shares of the page's width or of the lower of two heights."""

    full_width: float = 0.68
    gap: float = 0.025
    side_by_side: float = 0.20
    join: float = 0.35
    separator_overlap: float = 0.10
    row_overlap: float = 0.50
    row_gap: float = 0.01
    many_rows: int = 6
    wide_rows: int = 3
    balance: float = 0.35
    blocks: int = 2


# Columns


def _share(a0: float, a1: float, b0: float, b1: float) -> float:
    """Shared length of two intervals as a share of the shorter one."""
    least = min(max(0.0, a1 - a0), max(0.0, b1 - b0))
    return max(0.0, min(a1, b1) - max(a0, b0)) / least if least > 0 else 0.0


class _Lane:
    """Blocks (order, x0, y0, x1, y1) of one column and their extent."""

    def __init__(self, block: tuple):
        self.blocks, (self.x0, self.y0, self.x1, self.y1) = [block], block[1:]

    def add(self, b: tuple) -> None:
        self.blocks.append(b)
        self.x0, self.y0, self.x1, self.y1 = min(self.x0, b[1]), min(self.y0, b[2]), max(self.x1, b[3]), max(self.y1, b[4])

    def gap(self, other: _Lane) -> float:
        return max(other.x0 - self.x1, self.x0 - other.x1)

    @property
    def width(self) -> float:
        return self.x1 - self.x0


def _lanes(blocks: list[tuple], p: ColumnPolicy) -> list[_Lane]:
    lanes: list[_Lane] = []
    for b in sorted(blocks, key=lambda b: (b[1], b[2], b[0])):
        best = max(lanes, key=lambda lane: _share(b[1], b[3], lane.x0, lane.x1), default=None)
        if best is not None and (s := _share(b[1], b[3], best.x0, best.x1)) >= p.join and s > 0:
            best.add(b)
        else:
            lanes.append(_Lane(b))
    return sorted(lanes, key=lambda lane: lane.x0)


def cohort(lanes: list[_Lane], width: float, p: ColumnPolicy) -> list[int] | None:
    """Lanes that stand side by side as columns: the pair with most blocks, then most shared height, and further lanes that fit to both and to the height they share."""
    full = [i for i, lane in enumerate(lanes) if len(lane.blocks) >= p.blocks]
    ratio = lambda a, b: min(a, b) / max(a, b) if max(a, b) > 0 else 0.0
    best = None
    for n, i in enumerate(full):
        for j in full[n + 1 :]:
            a, b = lanes[i], lanes[j]
            beside = _share(a.y0, a.y1, b.y0, b.y1)
            if a.gap(b) >= p.gap * width and beside >= p.side_by_side and ratio(a.width, b.width) >= p.balance:
                score = (len(a.blocks) + len(b.blocks), beside)
                if best is None or score > best[0]:
                    best = (score, i, j)
    if best is None:
        return None
    taken = {best[1], best[2]}
    widths = [lanes[i].width for i in taken]
    top, bottom = max(lanes[i].y0 for i in taken), min(lanes[i].y1 for i in taken)
    if bottom > top:
        for i in full:
            c = lanes[i]
            if i in taken or any(c.gap(lanes[o]) < p.gap * width for o in taken) or ratio(min(c.width, *widths), max(c.width, *widths)) < p.balance:
                continue
            if _share(c.y0, c.y1, top, bottom) >= p.side_by_side:
                taken.add(i)
                widths.append(c.width)
                top, bottom = max(top, c.y0), min(bottom, c.y1)
    return sorted(taken)


def _band(blocks: list[tuple], width: float, p: ColumnPolicy) -> list[tuple]:
    """Columns from left to right, with what lies above and below them; native order where anything lies beside."""
    lanes = _lanes(blocks, p)
    found = cohort(lanes, width, p)
    if found is None:
        return blocks
    by_top = lambda b: (b[2], b[1], b[0])
    columns = [lanes[i] for i in found]
    inside = {b[0] for lane in columns for b in lane.blocks}
    top, bottom = min(lane.y0 for lane in columns), max(lane.y1 for lane in columns)
    rest = [b for b in blocks if b[0] not in inside]
    above, below = [b for b in rest if (b[2] + b[4]) / 2 < top], [b for b in rest if (b[2] + b[4]) / 2 > bottom]
    if len(above) + len(below) < len(rest):
        return blocks
    return sorted(above, key=by_top) + [b for lane in columns for b in sorted(lane.blocks, key=by_top)] + sorted(below, key=by_top)


def aligned(blocks: list[tuple], width: float, p: ColumnPolicy) -> bool:
    """Whether blocks lie in rows as in a table or form rather than in columns of prose."""
    if len(blocks) < 4:
        return False
    heights = [b[4] - b[2] for b in blocks if b[4] > b[2]]
    near = max(1.0, 0.35 * median(heights) if heights else 1.0)
    seen, from_left = [], sorted(blocks, key=lambda b: (b[1], b[2], b[0]))
    for seed in blocks:
        row: list[tuple] = []
        y0, y1 = seed[2], seed[4]
        # boxes that share no height are left out before their share is worked out
        for b in [b for b in from_left if b[2] < y1 and b[4] > y0] if p.row_overlap > 0 else from_left:
            if _share(y0, y1, b[2], b[4]) >= p.row_overlap and (not row or b[1] - row[-1][3] >= p.row_gap * width):
                row.append(b)
        if row:
            seen.append((sum((b[2] + b[4]) / 2 for b in row) / len(row), len(row)))

    def rows(least: int) -> list[int]:
        out: list[list] = []
        for centre, n in sorted(x for x in seen if x[1] >= least):
            if not out or centre - out[-1][0] > near:
                out.append([centre, n])
            else:
                out[-1][1] = max(out[-1][1], n)
        return [n for _, n in out]

    twos = rows(2)
    return max(twos, default=0) >= 4 or len(rows(3)) >= p.wide_rows or len(twos) >= p.many_rows


def order_page(blocks: list[tuple], width: float, p: ColumnPolicy) -> list[tuple]:
    """Blocks (order, x0, y0, x1, y1) of a page in reading order: bands between full-width separators, and columns in a band."""
    if len(blocks) < 2 or aligned(blocks, width, p):
        return blocks
    apart = lambda b: max((_share(b[2], b[4], o[2], o[4]) for o in blocks if o is not b), default=0.0) <= p.separator_overlap
    wide = [b for b in blocks if (b[3] - b[1]) / width >= p.full_width and apart(b)]
    if not wide or cohort(_lanes([b for b in blocks if b not in wide], p), width, p) is None:
        return _band(blocks, width, p)
    left, out = list(blocks), []
    for s in sorted(wide, key=lambda b: (b[2], b[1], b[0])):
        if s in left:
            before = [b for b in left if b is not s and (b[2] + b[4]) / 2 < s[2]]
            out += [*_band(before, width, p), s]
            left = [b for b in left if b not in before and b is not s]
    return out + _band(left, width, p)


def column_order(blocks: DataFrame, policy: ColumnPolicy = ColumnPolicy()) -> DataFrame:
    """``reading_order`` of the blocks (block_order, box) of pages (page_width)."""

    ordered = by_row("array<int>", lambda rows, w: [b[0] for b in order_page(rows, w, policy)] if w and w > 0 else None)
    row = F.struct(F.col("block_order").cast("int").alias("block_order"), *[F.col(c).cast("double").alias(c) for c in BOX])
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("blocks"), F.max("page_width").cast("double").alias("width"))
    return pages.withColumn("order", ordered("blocks", "width")).select(*PAGE, F.posexplode("order").alias("reading_order", "block_order"))


# Tables that alignment shows


@dataclass(frozen=True)
class TextTablePolicy:
    """Fixed values for tables without rules; lengths in points, gaps of rows in heights of the lower row."""

    rows: int = 3
    cols: int = 3
    join: float = 8.0
    align: float = 8.0
    column_gap: float = 12.0
    row_gap_least: float = 0.30
    row_gap_most: float = 3.0
    overlap: float = 0.60
    operators: float = 0.60


#: Characters of lanes that only hold operators, and the reasons against a candidate in the order they are looked at.
OPERATORS = "=:;+−-×÷*/|<>≤≥±→←↔"
TEXT_REASONS = ["text_aligned_insufficient_column_gap", "text_aligned_dense_row_spacing", "text_aligned_rows_too_far_apart", "text_aligned_operator_lane", "text_aligned_source_block_crosses_boundary", "text_aligned_no_source_text_ownership", "text_aligned_source_blocks_noncontiguous", "text_aligned_invalid_column_boundaries", "text_aligned_invalid_row_boundaries", "text_aligned_overlapping_source_ownership"]


#: White space as Spark's patterns have it, and the end of a text before its last line's end.
BLANK = " \t\n\x0b\f\r"
_BLANK_END = re.compile(f"[{BLANK}](?=[\x85\u2028\u2029]?\\Z)")
_OPERATORS = re.compile("[" + re.escape(OPERATORS) + "]+[\x85\u2028\u2029]?")
_NO_BLANK = str.maketrans("", "", BLANK)


def _joined(last: str, text: str) -> str:
    """Two texts with a blank between them, unless one of them has it."""
    return last + ("" if text[0] in BLANK or _BLANK_END.search(last) else " ") + text


def _segments(spans: list[tuple], p: TextTablePolicy) -> list[tuple]:
    """Spans (block_order, line, seq, box, text) of a page that follow closely in a line and stand at one height, as segments: y0, x0, x1, y1, block_order, text, number of spans.

    Spans without text or without a box are in no segment.
    """
    lines: dict[tuple, list[tuple]] = {}
    for block, line, seq, x0, y0, x1, y1, text in spans:
        if text is not None and text.strip(BLANK) and x0 is not None and y0 is not None and x1 is not None and y1 is not None:
            lines.setdefault((block, line), []).append((x0, (seq is not None, seq), y0, x1, y1, text))
    out = []
    for (block, _), own in lines.items():
        own.sort()
        x0, _, y0, x1, y1, text = own[0]
        n = 1
        for a, _, b, c, d, more in own[1:]:
            if a - x1 <= p.join and _share(y0, y1, b, d) >= p.overlap:
                x0, y0, x1, y1, text, n = min(x0, a), min(y0, b), max(x1, c), max(y1, d), _joined(text, more), n + 1
            else:
                out.append((y0, x0, x1, y1, block, text, n))
                x0, y0, x1, y1, text, n = a, b, c, d, more, 1
        out.append((y0, x0, x1, y1, block, text, n))
    return out


SEGMENT_SPAN = ["block_order", "line", "seq", *BOX, "text"]


def _page_spans(spans: DataFrame) -> DataFrame:
    """Spans of a page as one array."""
    made = F.struct(*[F.col(c).cast("double").alias(c) if c in BOX else F.col(c) for c in SEGMENT_SPAN])
    return spans.groupBy(*PAGE).agg(F.collect_list(made).alias("spans"))


def text_segments(spans: DataFrame, policy: TextTablePolicy = TextTablePolicy()) -> DataFrame:
    """Spans of a line that follow closely and stand at one height, as one segment: block_order, box, text, n_spans."""
    kind = f"array<struct<y0:double,x0:double,x1:double,y1:double,block_order:{spans.schema['block_order'].dataType.simpleString()},text:string,n_spans:int>>"
    found = _page_spans(spans).select(*PAGE, by_row(kind, lambda each: _segments(each, policy))("spans").alias("s"))
    return found.select(*PAGE, F.inline_outer("s")).where("n_spans is not null").select(*PAGE, "block_order", *BOX, "text", "n_spans")


def aligned_runs(boxes: list[tuple], p: TextTablePolicy) -> list[list[list[int]]]:
    """Runs of visual rows whose columns align, as rows of places: the longest first, none that shares a row with a longer one.

    ``boxes``: x0, y0, x1, y1 by (y0, x0).  A box joins one of the last three rows where it shares most of the lower height.
    """
    rows: list[tuple[list[int], list[float]]] = []
    for i, (_, y0, _, y1) in enumerate(boxes):
        for own, reach in rows[:-4:-1]:
            if _share(y0, y1, reach[0], reach[1]) >= p.overlap:
                own.append(i)
                if y0 < reach[0] or y1 > reach[1]:
                    reach[:] = [min(reach[0], y0), max(reach[1], y1)]
                break
        else:
            rows.append(([i], [y0, y1]))
    lines = sorted(([sorted(own, key=lambda i: boxes[i][0]) for own, _ in rows]), key=lambda own: (min([boxes[i][1] for i in own]), boxes[own[0]][0]))
    found, reached = [], 0
    for start, head in enumerate(lines):
        if len(head) < p.cols:
            continue
        if start < reached:
            # a run that no edge ends goes on from each of its rows
            if reached - start >= p.rows:
                found.append((start, reached))
            continue
        edges = [[boxes[i][0], boxes[i][0], boxes[i][2], boxes[i][2]] for i in head]
        end = start + 1
        while end < len(lines) and len(lines[end]) == len(head):
            grown = []
            for e, i in zip(edges, lines[end], strict=True):
                x0, _, x1, _ = boxes[i]
                # edges that stay as they are have been looked at
                if not (e[0] <= x0 <= e[1] and e[2] <= x1 <= e[3]):
                    e = [min(e[0], x0), max(e[1], x0), min(e[2], x1), max(e[3], x1)]
                    if e[1] - e[0] > p.align and e[3] - e[2] > p.align:
                        break
                grown.append(e)
            if len(grown) < len(head):
                break
            edges, end = grown, end + 1
        else:
            reached = end
        if end - start >= p.rows:
            found.append((start, end))
    taken: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda r: (r[0] - r[1], r[0])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
    return [lines[a:b] for a, b in sorted(taken)]


def _text_table(rows: list[list[tuple]], inked: dict, order: dict, p: TextTablePolicy) -> tuple:
    """Reason against a run of rows of segments, the blocks it owns, and its cells (row, column, box, text).  ``inked``: spans with text of the page's blocks, ``order``: their places."""
    tight, dense, far, operators, crossing, none, apart, bad_x, bad_y, _ = TEXT_REASONS
    n_rows, lanes = len(rows), list(zip(*rows, strict=True))
    left, right = [min([s[1] for s in lane]) for lane in lanes], [max([s[2] for s in lane]) for lane in lanes]
    top, low = [min([s[0] for s in row]) for row in rows], [max([s[3] for s in row]) for row in rows]
    height = [max(0.01, b - a) for a, b in zip(top, low, strict=True)]
    gaps = sorted([max(0.0, top[i + 1] - low[i]) / min(height[i], height[i + 1]) for i in range(n_rows - 1)])
    half = (n_rows - 2) // 2
    middle = gaps[half] if n_rows % 2 == 0 else (gaps[half] + gaps[half + 1]) / 2
    owned: dict = {}
    for row in rows:
        for s in row:
            if s[4] is not None:
                owned[s[4]] = owned.get(s[4], 0) + s[6]
    blocks = sorted(owned)
    xs = [left[0], *[(a + b) / 2 for a, b in zip(right, left[1:], strict=False)], right[-1]]
    ys = [top[0], *[(a + b) / 2 for a, b in zip(low, top[1:], strict=False)], low[-1]]
    signs = lambda lane: sum([s[5].lstrip(BLANK)[0] in OPERATORS and _OPERATORS.fullmatch(s[5].translate(_NO_BLANK)) is not None for s in lane])
    if any([b[1] - a[2] < p.column_gap for row in rows for a, b in pairwise(row)]):
        reason = tight
    elif middle < p.row_gap_least or middle > p.row_gap_most:
        reason = dense if middle < p.row_gap_least else far
    elif any([signs(lane) >= p.operators * n_rows for lane in lanes]):
        reason = operators
    elif any([inked[b] > n for b, n in owned.items()]):
        reason = crossing
    elif not blocks:
        reason = none
    elif order[blocks[-1]] - order[blocks[0]] + 1 != len(blocks):
        reason = apart
    else:
        reason = bad_x if any([b <= a for a, b in pairwise(xs)]) else bad_y if any([b <= a for a, b in pairwise(ys)]) else None
    cells = None if reason else [(i, j, xs[j], ys[i], xs[j + 1], ys[i + 1], s[5]) for i, row in enumerate(rows) for j, s in enumerate(row)]
    return reason, blocks, cells


def _text_tables(spans: list[tuple], p: TextTablePolicy) -> list[tuple]:
    """Tables of a page: number, reason, rows, columns, blocks and cells; a block belongs to the first table that takes it."""
    segments = sorted(_segments(spans, p), key=lambda s: (*s[:4], (s[4] is not None, s[4]), *s[5:]))
    runs = aligned_runs([(x0, y0, x1, y1) for y0, x0, x1, y1, *_ in segments], p)
    if not runs:
        return []
    inked: dict = {}
    for s in spans:
        inked[s[0]] = inked.get(s[0], 0) + (s[7] is not None and s[7].strip(BLANK) != "")
    order = {b: i for i, b in enumerate(sorted(b for b in inked if b is not None))}
    taken, out = set(), []
    for i, run in enumerate(runs):
        reason, blocks, cells = _text_table([[segments[at] for at in row] for row in run], inked, order, p)
        if reason is None:
            reason = None if taken.isdisjoint(blocks) else TEXT_REASONS[-1]
            taken.update([] if reason else blocks)
        out.append((i, reason, len(run), len(run[0]), blocks, None if reason else cells))
    return out


def text_tables(spans: DataFrame, policy: TextTablePolicy = TextTablePolicy()) -> DataFrame:
    """Tables without rules: table_id, reason, n_rows, n_cols, blocks, and ``anchors`` with their text for accepted ones.

    A page's spans are one array, and its segments, runs and checks one function of it, called once.
    """
    kind = f"array<struct<table_id:int,reason:string,n_rows:int,n_cols:int,blocks:array<{spans.schema['block_order'].dataType.simpleString()}>,anchors:array<struct<row:int,col:int,x0:double,y0:double,x1:double,y1:double,text:string>>>>"
    found = _page_spans(spans).select(*PAGE, by_row(kind, lambda each: _text_tables(each, policy))("spans").alias("gm"))
    return _rows_of(found)
