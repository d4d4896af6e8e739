"""Page geometry over tables of spans, blocks, strokes and boxes: visibility, reading order, table grids and ownership.

All tables carry document_id and page; every theta join is keyed by them, so its sides are one page's objects.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PAGE = ["document_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0.0), F.col(f"{p}y1") - F.col(f"{p}y0"))


def shared_area(p: str, q: str) -> Column:
    return overlap(F.col(f"{p}x0"), F.col(f"{p}x1"), F.col(f"{q}x0"), F.col(f"{q}x1")) * overlap(F.col(f"{p}y0"), F.col(f"{p}y1"), F.col(f"{q}y0"), F.col(f"{q}y1"))


def normalise_boxes(boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Boxes in page units (width, height) clipped and divided to 0..1; those beyond the tolerance get a code instead."""
    out = (F.col("x0") < -tolerance) | (F.col("y0") < -tolerance) | (F.col("x1") > F.col("width") + tolerance) | (F.col("y1") > F.col("height") + tolerance)
    code = F.when(out, F.lit("BOX_OUTSIDE_PAGE")).when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), F.lit("BOX_EMPTY"))
    clip = lambda c, m: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(m))) / F.col(m)
    made = boxes.withColumn("code", code)
    return made.withColumns({c: F.when(F.col("code").isNull(), clip(c, "width" if c[0] == "x" else "height")) for c in BOX})


def opaque_fills(drawings: DataFrame, opacity: float = 0.98) -> DataFrame:
    return drawings.where((F.col("kind") == "fill") & F.col("axis_aligned") & (F.coalesce("opacity", F.lit(1.0)) >= opacity))


def hidden_blocks(blocks: DataFrame, fills: DataFrame, coverage: float = 0.95) -> DataFrame:
    """Text blocks that an opaque fill painted later covers, with the fill that covers most."""
    b = blocks.select(*PAGE, "block_id", F.col("paint_seq").alias("b_seq"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    f = fills.select(*PAGE, "fill_id", F.col("paint_seq").alias("f_seq"), *[F.col(c).alias(f"f_{c}") for c in BOX])
    share = F.when(area("b_") > 0, shared_area("b_", "f_") / area("b_")).otherwise(0.0)
    hit = b.join(f, PAGE).where("f_seq > b_seq").withColumn("coverage", share).where(F.col("coverage") >= coverage)
    return hit.groupBy(*PAGE, "block_id").agg(F.max("coverage").alias("coverage"), F.max_by("fill_id", F.struct("coverage", "f_seq")).alias("fill_id"))


def visible_blocks(blocks: DataFrame, fills: DataFrame) -> DataFrame:
    return blocks.join(hidden_blocks(blocks, fills).select(*PAGE, "block_id"), [*PAGE, "block_id"], "left_anti")


def span_owners(spans: DataFrame, cells: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The cell of each span: most overlap, at least ``ratio`` of the span; a code where none or several centres claim it."""
    s = spans.select(*PAGE, "span_id", *[F.col(c).alias(f"s_{c}") for c in BOX])
    c = cells.select(*PAGE, "cell_id", *[F.col(x).alias(f"c_{x}") for x in BOX])
    cx, cy = (F.col("s_x0") + F.col("s_x1")) / 2, (F.col("s_y0") + F.col("s_y1")) / 2
    inside = (cx >= F.col("c_x0")) & (cx < F.col("c_x1")) & (cy >= F.col("c_y0")) & (cy < F.col("c_y1"))
    pairs = s.join(c, PAGE).withColumns({"share": F.when(area("s_") > 0, shared_area("s_", "c_") / area("s_")).otherwise(0.0), "centred": inside.cast("int")}).where("share > 0")
    best = pairs.groupBy(*PAGE, "span_id").agg(F.max_by("cell_id", F.struct("share", "cell_id")).alias("cell_id"), F.max("share").alias("share"), F.sum("centred").alias("centres"))
    made = spans.select(*PAGE, "span_id").join(best, [*PAGE, "span_id"], "left")
    code = F.when(F.col("cell_id").isNull(), F.lit("NO_CELL")).when(F.col("share") < ratio, F.lit("OVERLAP_TOO_SMALL")).when(F.col("centres") > 1, F.lit("CENTRE_NOT_UNIQUE"))
    return made.select(*PAGE, "span_id", F.when(code.isNull(), F.col("cell_id")).alias("cell_id"), code.alias("code"))


def cell_text(spans: DataFrame, owners: DataFrame, line_gap: float = 0.5) -> DataFrame:
    """Text of each cell: spans in visual lines (a new one where a span starts below most of the line before), joined by spaces."""
    rows = spans.join(owners.where("cell_id is not null").select(*PAGE, "span_id", "cell_id"), [*PAGE, "span_id"])
    w = Window.partitionBy(*PAGE, "cell_id").orderBy("y0", "x0")
    fresh = F.coalesce(F.col("y0") > F.lag("y0").over(w) + line_gap * (F.lag("y1").over(w) - F.lag("y0").over(w)), F.lit(False))
    rows = rows.withColumn("gm_line", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = rows.groupBy(*PAGE, "cell_id", "gm_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("t"))
    return lines.groupBy(*PAGE, "cell_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gm_line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def covered_length(intervals: DataFrame, key: list[str]) -> DataFrame:
    """Length of the union of intervals (start, stop) of each key, by the greatest stop so far."""
    w = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("gm_reached", F.max("stop").over(w))
    own = F.greatest(F.lit(0.0), F.col("stop") - F.greatest(F.col("start"), F.coalesce("gm_reached", "start")))
    return rows.groupBy(*key).agg(F.sum(own).alias("covered"))


def support_ratio(strokes: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Share of each boundary's length (key, length) that strokes (key, start, stop) cover."""
    return spans.join(covered_length(strokes, key), key, "left").withColumn("support", F.when(F.col("length") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("length")))


def cluster_values(values: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """One-dimensional clusters of ``value``: a new one where the gap to the value before exceeds the tolerance; mean and count."""
    w = Window.partitionBy(*key).orderBy("value")
    fresh = F.coalesce(F.col("value") - F.lag("value").over(w) > tolerance, F.lit(False))
    rows = values.withColumn("cluster", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*key, "cluster").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def rectilinear(strokes: DataFrame, tolerance: float = 1.0, least: int = 3) -> DataFrame:
    """Pages with enough horizontal and vertical strokes to hold a ruled table."""
    flat, tall = F.abs(F.col("y1") - F.col("y0")) <= tolerance, F.abs(F.col("x1") - F.col("x0")) <= tolerance
    made = strokes.groupBy(*PAGE).agg(F.sum(flat.cast("int")).alias("horizontal"), F.sum(tall.cast("int")).alias("vertical"))
    return made.withColumn("ruled", (F.col("horizontal") >= least) & (F.col("vertical") >= least))


def grid_cells(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Cells between neighbouring column and row lines (document_id, page, table_id, mean)."""
    key = [*PAGE, "table_id"]
    w = Window.partitionBy(*key).orderBy("mean")
    lanes = lambda d, a, b, n: d.withColumns({b: F.lead("mean").over(w), n: F.row_number().over(w) - 1}).where(f"{b} is not null").select(*key, F.col("mean").alias(a), b, n)
    return lanes(xs, "x0", "x1", "col").join(lanes(ys, "y0", "y1", "row"), key).withColumn("cell_id", F.concat_ws(":", F.col("table_id").cast("string"), F.col("row").cast("string"), F.col("col").cast("string")))


def simple_topology(cells: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Whether the cells of each table line up in rows and columns within a tolerance."""
    key = [*PAGE, "table_id"]
    spread = lambda by, *cs: cells.groupBy(*key, by).agg(F.greatest(*[F.max(c) - F.min(c) for c in cs]).alias("d")).groupBy(*key).agg(F.max("d").alias(f"{by}_spread"))
    made = spread("row", "y0", "y1").join(spread("col", "x0", "x1"), key)
    return made.withColumn("simple", (F.col("row_spread") <= tolerance) & (F.col("col_spread") <= tolerance))


def table_verdicts(tables: DataFrame, *, rows: int = 2, cols: int = 2, cells: int = 6, populated: int = 4) -> DataFrame:
    """The first reason against each candidate (n_rows, n_cols, n_cells, n_populated, unowned_spans, crossing_blocks, contiguous)."""
    reason = (
        F.when((F.col("n_rows") < rows) | (F.col("n_cols") < cols), F.lit("GRID_TOO_SMALL")).when(F.col("n_cells") < cells, F.lit("TOO_FEW_CELLS")).when(F.col("unowned_spans") > 0, F.lit("SPAN_WITHOUT_CELL"))
        .when(F.col("crossing_blocks") > 0, F.lit("BLOCK_CROSSES_TABLE")).when(~F.col("contiguous"), F.lit("BLOCKS_NOT_CONTIGUOUS")).when(F.col("n_populated") < populated, F.lit("TOO_FEW_POPULATED_CELLS"))
    )
    return tables.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def first_strategy(*candidates: DataFrame) -> DataFrame:
    """Tables of the first strategy that found any on a page; later ones only where none did."""
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c.join(out.select(*PAGE).distinct(), PAGE, "left_anti"))
    return out


def merged_slots(cells: DataFrame) -> DataFrame:
    """The logical slots of cells with row_span and col_span."""
    rows = cells.withColumn("slot_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)))
    return rows.withColumn("slot_col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))


def slot_violations(cells: DataFrame) -> DataFrame:
    """Slots that more than one cell claims."""
    return merged_slots(cells).groupBy(*PAGE, "table_id", "slot_row", "slot_col").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def block_partition(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks cut by a table box: an exact prefix of whole lines inside and the rest outside, else a code.

    ``lines``: document_id, page, block_id, line, box; ``tables``: document_id, page, table_id, box.
    """
    t = tables.select(*PAGE, "table_id", *[F.col(c).alias(f"t_{c}") for c in BOX])
    inside = (F.col("x0") >= F.col("t_x0")) & (F.col("x1") <= F.col("t_x1")) & (F.col("y0") >= F.col("t_y0")) & (F.col("y1") <= F.col("t_y1"))
    touching = (overlap(F.col("x0"), F.col("x1"), F.col("t_x0"), F.col("t_x1")) > 0) & (overlap(F.col("y0"), F.col("y1"), F.col("t_y0"), F.col("t_y1")) > 0)
    w = Window.partitionBy(*PAGE, "block_id", "table_id").orderBy("line")
    rows = lines.join(t, PAGE).withColumns({"inside": inside, "touching": touching})
    # In a prefix the flag never rises again once it has fallen.
    rows = rows.withColumn("rises", F.coalesce(F.col("inside") & ~F.lag("inside").over(w), F.lit(False)))
    made = rows.groupBy(*PAGE, "block_id", "table_id").agg(F.sum(F.col("inside").cast("int")).alias("inside"), F.count(F.lit(1)).alias("lines"), F.max("rises").alias("rises"), F.sum((F.col("touching") & ~F.col("inside")).cast("int")).alias("partial")).where("inside > 0")
    return made.select(*PAGE, "block_id", "table_id", F.col("inside").alias("prefix_lines"), F.when(F.col("partial") > 0, F.lit("LINE_CROSSES_TABLE")).when(F.col("rises"), F.lit("NOT_A_PREFIX")).alias("code"))


def span_conservation(original: DataFrame, *parts: DataFrame) -> DataFrame:
    """Spans that the parts lose, invent or hold twice."""
    key = [*PAGE, "span_id"]
    every = parts[0].select(*key)
    for p in parts[1:]:
        every = every.unionByName(p.select(*key))
    lost = original.select(*key).subtract(every).withColumn("code", F.lit("SPAN_LOST"))
    fresh = every.subtract(original.select(*key)).withColumn("code", F.lit("SPAN_INVENTED"))
    twice = every.groupBy(*key).count().where("count > 1").select(*key, F.lit("SPAN_TWICE").alias("code"))
    return lost.unionByName(fresh).unionByName(twice)


def dominant_style(spans: DataFrame, key: list[str]) -> DataFrame:
    """The style (font_name, font_size, bold, italic) of most characters, the first seen of equals."""
    style = ["font_name", "font_size", "bold", "italic"]
    sums = spans.groupBy(*key, *style).agg(F.sum(F.greatest(F.lit(1), F.length("text"))).alias("weight"), F.min("seq").alias("seen"))
    return sums.groupBy(*key).agg(F.max_by(F.struct(*style), F.struct("weight", -F.col("seen"))).alias("s")).select(*key, "s.*")


def block_text(spans: DataFrame) -> DataFrame:
    """Text of blocks from spans (block_id, line, seq, text) with the offsets of each span in it."""
    w = Window.partitionBy(*PAGE, "block_id").orderBy("line", "seq")
    fresh = F.coalesce(F.col("line") != F.lag("line").over(w), F.lit(False)).cast("int")
    rows = spans.withColumn("piece", F.concat(F.when(fresh == 1, F.lit("\n")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))).withColumn("gm_n", fresh)
    end = F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.length(F.coalesce("text", F.lit("")))).drop("gm_n")


def aligned_rows(blocks: DataFrame, vertical: float = 0.5, gap: float = 0.01) -> DataFrame:
    """Pairs of blocks side by side: shared height of at least half the lower one, and a gap of at least 1 % of the width."""
    a = blocks.select(*PAGE, F.col("block_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = blocks.select(*PAGE, F.col("block_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    share = overlap(F.col("a_y0"), F.col("a_y1"), F.col("b_y0"), F.col("b_y1")) / F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0"))
    return a.join(b, PAGE).where((F.col("b_x0") - F.col("a_x1") >= gap) & (share >= vertical)).select(*PAGE, "a", "b")


def keeps_native_order(rows: DataFrame) -> DataFrame:
    """Pages whose aligned rows (cells each) look like a table rather than columns: native order stays."""
    made = rows.groupBy(*PAGE).agg(F.max("cells").alias("most"), F.sum((F.col("cells") >= 3).cast("int")).alias("threes"), F.sum((F.col("cells") == 2).cast("int")).alias("twos"))
    return made.withColumn("native", (F.col("most") >= 4) | (F.col("threes") >= 3) | (F.col("twos") >= 6))


def reading_order(blocks: DataFrame, *, full_width: float = 0.68, gap: float = 0.025, join: float = 0.35, balance: float = 0.35) -> DataFrame:
    """Order of blocks on each page (normalised boxes): bands between full-width blocks, and columns within a band.

    A band has columns if its blocks fall, by horizontal overlap, into two or more lanes with a gap between them and widths
    in balance; else it is read by position.
    """

    def lanes(band: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for b in sorted(band, key=lambda b: (b[1], b[3])):
            for lane in out:
                a0, a1 = min(x[1] for x in lane), max(x[3] for x in lane)
                if min(a1, b[3]) - max(a0, b[1]) >= join * min(a1 - a0, b[3] - b[1]):
                    lane.append(b)
                    break
            else:
                out.append([b])
        return out

    def flow(band: list[tuple]) -> list[tuple]:
        cols = lanes(band)
        if len(cols) > 1:
            cols.sort(key=lambda c: min(b[1] for b in c))
            spans = [(min(b[1] for b in c), max(b[3] for b in c)) for c in cols]
            widths = [b - a for a, b in spans]
            apart = all(y[0] - x[1] >= gap for x, y in zip(spans, spans[1:], strict=False))
            if apart and min(widths) >= balance * max(widths) and all(len(c) > 1 for c in cols):
                return [b for c in cols for b in sorted(c, key=lambda b: (b[2], b[1]))]
        return sorted(band, key=lambda b: (round(b[2], 3), b[1]))

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["block_id", *BOX]].itertuples(index=False, name=None), key=lambda b: (b[2], b[1]))
        out, band = [], []
        for b in rows:
            if b[3] - b[1] >= full_width:
                out += [*flow(band), b]
                band = []
            else:
                band.append(b)
        out += flow(band)
        return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "page": pdf["page"].iloc[0], "block_id": [b[0] for b in out], "reading_order": range(len(out))})

    return blocks.select(*PAGE, "block_id", *BOX).groupBy(*PAGE).applyInPandas(page, "document_id string, page int, block_id string, reading_order int")


def visual_rows(spans: DataFrame, overlap_share: float = 0.5) -> DataFrame:
    """Spans by visual row from the top: a new row where a span lies below half of the row so far; with the row's span count."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    reached = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("y0") + (1 - overlap_share) * (F.col("y1") - F.col("y0")) >= reached, F.lit(True))
    rows = spans.withColumn("visual_row", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return rows.withColumn("row_spans", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "visual_row")))


def text_table_runs(rows: DataFrame, least_rows: int = 3, least_cols: int = 3) -> DataFrame:
    """Runs of neighbouring visual rows (document_id, page, visual_row, row_spans) with one count of columns: candidates for unruled tables."""
    each = rows.select(*PAGE, "visual_row", "row_spans").distinct()
    w = Window.partitionBy(*PAGE).orderBy("visual_row")
    fresh = F.coalesce(F.col("row_spans") != F.lag("row_spans").over(w), F.lit(True))
    each = each.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    made = each.groupBy(*PAGE, "run").agg(F.min("visual_row").alias("first_row"), F.max("visual_row").alias("last_row"), F.count(F.lit(1)).alias("n_rows"), F.first("row_spans").alias("n_cols"))
    return made.where((F.col("n_rows") >= least_rows) & (F.col("n_cols") >= least_cols))


def _swept(boxes: list[tuple], reach: float) -> list[int]:
    """For boxes (x0, y0, x1, y1) in order of (y0, x0) the first place of each one's connected group, by a sweep that looks at groups still open only.

    A group's boxes are looked at from the last one until one touches; those that the sweep has passed are dropped.
    """
    up = list(range(len(boxes)))
    live: list[list] = []
    for i, box in enumerate(boxes):
        left, top, right = box[0] - reach, box[1], box[2]
        on, rest = None, []
        for group in live:
            members = group[1]
            for x0, _, x1, y1 in reversed(members):
                if x0 - reach <= right and left <= x1 and y1 + reach >= top:
                    if on is None:
                        on = group
                    else:
                        first, last = (on, group) if on[0] < group[0] else (group, on)
                        up[last[0]] = first[0]
                        small, large = sorted((on[1], members), key=len)
                        on[0], on[1], on[2] = first[0], large + small, len(boxes)
                    break
            else:
                members = group[1] = [b for b in members if b[3] + reach >= top]
                if members:
                    rest.append(group)
        if on is None:
            on = [i, [], 16]
        up[i] = on[0]
        on[1].append(box)
        if len(on[1]) > on[2]:
            on[1] = [b for b in on[1] if b[3] + reach >= top]
            on[2] = 2 * len(on[1]) + 16
        live = [*rest, on]
    for i, first in enumerate(up):
        up[i] = up[first]
    return up


def box_clusters(boxes: DataFrame, reach: float = 2.0) -> DataFrame:
    """Connected groups of boxes that touch within ``reach`` on a page, by sweeping each page's boxes; a group is named by its first box."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def swept(pages: pd.Series) -> pd.Series:
        return pd.Series([_swept([tuple(b[c] for c in BOX) for b in page], reach) for page in pages])

    row = F.struct(*[F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1")], F.col("box_id").cast("string").alias("box_id"))
    pages = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("boxes")).withColumn("firsts", swept("boxes"))
    each = pages.select(*PAGE, "boxes", F.posexplode("firsts").alias("at", "first"))
    return each.select(*PAGE, F.get("boxes", F.col("at"))["box_id"].alias("box_id"), F.get("boxes", F.col("first"))["box_id"].alias("cluster"))


def leading_row_fingerprint(cells: DataFrame) -> DataFrame:
    """Hash of the first row's texts of each table, blanks compacted, case folded; null where all are blank."""
    top = cells.where("row = 0").groupBy(*PAGE, "table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " "))).alias("t")))), lambda x: x["t"]).alias("ts"))
    return top.select(*PAGE, "table_id", F.when(F.exists("ts", lambda t: t != ""), F.sha2(F.array_join("ts", "|").cast("binary"), 256)).alias("leading_row_fingerprint"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Facts of pages rolled up to documents."""
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("blocks").alias("blocks"), F.sum("tables").alias("tables"), F.sort_array(F.collect_list(F.struct("page", "width", "height", "rotation"))).alias("facts"))


def contract_matches(contracts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Largest one-to-one matching of table contracts and predictions of a document by page, rows and columns.

    Where ids belong to one (page, rows, columns) alone, any pairing of the two sides is a largest one: they are paired in order.  Only
    where an id of either side has several such keys do paths of exchanges matter; they are sought among those keys of a document.
    """
    key = ["document_id", "page", "n_rows", "n_cols"]

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*key, F.col(name).cast("string").alias(name)).distinct()
        rows = rows.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("document_id", name)) > 1)
        same = Window.partitionBy(*key)
        return rows.withColumns({"several": F.max("several").over(same), "nth": F.row_number().over(same.orderBy(name))})

    wanted, offered = side(contracts.where("contract_id is not null"), "contract_id"), side(predictions, "table_id")
    tied = wanted.where("several").select(*key).unionByName(offered.where("several").select(*key)).distinct()
    plain = wanted.drop("several").join(offered.drop("several"), [*key, "nth"]).join(tied, key, "left_anti").select("document_id", "contract_id", "table_id")
    pairs = wanted.join(tied, key, "left_semi").join(offered, key).select("document_id", "contract_id", "table_id")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        wants = pdf.groupby("contract_id")["table_id"].apply(list).to_dict()
        taken: dict = {}

        def place(c, seen: set) -> bool:
            for t in wants[c]:
                if t not in seen:
                    seen.add(t)
                    if t not in taken or place(taken[t], seen):
                        taken[t] = c
                        return True
            return False

        for c in sorted(wants):
            place(c, set())
        return pd.DataFrame([(pdf["document_id"].iloc[0], c, t) for t, c in sorted(taken.items())], columns=["document_id", "contract_id", "table_id"])

    found = pairs.groupBy("document_id").applyInPandas(match, "document_id string, contract_id string, table_id string")
    return plain.withColumn("document_id", F.col("document_id").cast("string")).unionByName(found)
