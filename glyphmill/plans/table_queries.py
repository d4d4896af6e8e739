"""Queries of ruled tables: a page for each order of four or more line items, with a row of its grid for each item.

The order's key says what is drawn and written; the SQL says what has to come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout
from ..operators import tables as T
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


#: Rows r = 0 .. n - 1 of each page.
PAGES = "pages as (select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as r, count(*) over (partition by l_orderkey) as n from lineitem qualify n >= 4)"
COLS, WIDE, HIGH = 4, 40.0, 20.0


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of pages, dealt by page once: what is made of them for the operators stays so dealt."""
    page = F.col("l_orderkey").cast("int")
    rows = table(spark, d, "lineitem").select((page % 50).cast("string").alias("document_id"), page.alias("page"), "l_linenumber")
    w = Window.partitionBy("document_id", "page")
    return rows.select("document_id", "page", (F.row_number().over(w.orderBy("l_linenumber")) - 1).alias("r"), F.count(F.lit(1)).over(w).cast("int").alias("n")).where("n >= 4")


def _candidates(rows: DataFrame, cols: int = COLS, table_id: int = 0) -> DataFrame:
    return rows.where("r = 0").select("document_id", "page", F.lit(table_id).alias("table_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(cols * WIDE).alias("x1"), (F.col("n") * HIGH).alias("y1"), F.col("n").alias("n_rows"), F.lit(cols).alias("n_cols"))


def _strokes(rows: DataFrame, kind: Column, dx: float | Column = 0.0, cols: int = COLS) -> DataFrame:
    """Row by row the left walls, the last right wall and the upper walls; below the last row a full line.  ``kind`` says what is left out."""
    r, n, c = F.col("r"), F.col("n"), F.col("c")
    # walls, then the line above the row, then the one below the last row: rows are read once
    drawn = rows.withColumn("kind", kind).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols + 2))))
    top, wall, above = r * HIGH, c <= cols, c == cols + 1
    no_wall = ((F.col("kind").isin(1, 3)) & (r == 0) & (c == cols - 1)) | ((F.col("kind") == 5) & (r == 1))
    low = F.when((F.col("kind") == 4) & (c > 0), top + HIGH / 2).otherwise(top + HIGH)
    end = F.when(F.col("kind").isin(2, 3) & (r == 1), F.lit((cols - 1) * WIDE)).otherwise(F.lit(cols * WIDE))
    drawn = drawn.where(F.when(wall, ~no_wall).otherwise(above | (r == n - 1)))
    x0, x1 = F.when(wall, c * WIDE).otherwise(0.0), F.when(wall, c * WIDE).when(above, end).otherwise(cols * WIDE)
    y0, y1 = F.when(wall | above, top).otherwise(n * HIGH), F.when(wall, low).when(above, top).otherwise(n * HIGH)
    return drawn.select("document_id", "page", (x0 + dx).alias("x0"), y0.alias("y0"), (x1 + dx).alias("x1"), y1.alias("y1"))


@query("stroke_grids", f"""with {PAGES}, p as (select distinct page, n::int as n, page % 6 as k from pages)
select page::int as page, case k when 3 then 'segmented_nonrectangular_merged_component' when 4 then 'segmented_insufficient_supported_column_boundaries' when 5 then 'segmented_multiple_stable_vertical_grid_cores' end as reason,
  case when k < 3 then n end as n_rows, case when k < 3 then 4 end as n_cols, case when k < 3 then 4 * n - (k > 0)::int end::bigint as cells, case when k < 3 then (k > 0)::int end::bigint as spread from p""")
def stroke_grids(spark, d):
    """Whole grids, a missing wall beside or below, an L-shaped cell, columns drawn half, and a row without columns."""
    rows = _pages(spark, d)
    none = _cells(rows, F.lit(0)).where("false")
    made = T.normalise_grids(T.gather(_candidates(rows), none), _strokes(rows, F.col("page") % 6))
    spread = F.size(F.filter("anchors", lambda a: (a["row_span"] > 1) | (a["col_span"] > 1)))
    return made.select("page", "reason", "n_rows", "n_cols", F.size("anchors").cast("long").alias("cells"), spread.cast("long").alias("spread"))


def _cells(rows: DataFrame, kind: Column, cols: int = COLS) -> DataFrame:
    """Cell boxes of a grid.  Kinds: 0 plain, 1 the first cell spans two columns, 2 it spans two rows, 3 it spans two columns over a cell, 4 a hole beside a span, 5 a hole alone, 6 a cell beside its slot."""
    r, c, k = F.col("r"), F.col("c"), F.col("kind")
    slots = rows.withColumn("kind", kind).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    head = (r == 0) & (c == 0)
    gone = (k.isin(1, 4) & (r == 0) & (c == 1)) | ((k == 2) & (r == 1) & (c == 0)) | (k.isin(4, 5) & (r == 2) & (c == 2)) | ((k == 3) & (r == 3) & (c == 3)) | ((k == 6) & (r == 0) & (c == 1))
    left = F.when((k == 6) & (r == 1) & (c == 1), F.lit(0.0)).otherwise(c * WIDE)
    right = F.when(head & k.isin(1, 3, 4), F.lit(2 * WIDE)).otherwise((c + 1) * WIDE)
    below = F.when(head & (k == 2), F.lit(2 * HIGH)).otherwise((r + 1) * HIGH)
    box = {"x0": left, "y0": r * HIGH, "x1": right, "y1": below}
    return slots.select("document_id", "page", F.lit(0).alias("table_id"), r.alias("row"), c.alias("col"), *[F.when(~gone, v).alias(n) for n, v in box.items()])


@query("merged_tables", f"""with {PAGES}, p as (select distinct page, n, page % 7 as k from pages)
select page::int as page, case k when 0 then 'candidate_has_no_merged_slots' when 3 then 'merged_grid_overlap' when 4 then 'merged_grid_hole' when 5 then 'missing_slots_not_explained_by_span' when 6 then 'merged_anchor_slot_mismatch' end as reason,
  case when k in (1, 2) then 4 * n - 1 else 0 end::bigint as anchors, case k when 1 then 2 when 2 then 1 else 0 end as widest, case k when 1 then 1 when 2 then 2 else 0 end as tallest from p""")
def merged_tables(spark, d):
    rows = _pages(spark, d)
    made = T.merged_grids(T.gather(_candidates(rows), _cells(rows, F.col("page") % 7)))
    most = lambda c: F.coalesce(F.array_max(F.transform("anchors", lambda a: a[c])), F.lit(0))
    return made.select("page", "reason", F.coalesce(F.size("anchors"), F.lit(0)).cast("long").alias("anchors"), most("col_span").alias("widest"), most("row_span").alias("tallest"))


def _spans(rows: DataFrame, kind: Column, cols: int = COLS, dx: float | Column = 0.0, tag: str | Column = "a", first: int | Column = 0) -> DataFrame:
    """A block for each row with a span in each cell.  Kinds: 1 a span half in each of two cells, 2 a block goes on below the table,
    3 a block outside lies between those of the table in the page's order, 4 text in the first row only, 5 no text, 6 the second span hangs over its cell's edge.  ``first``: the number of the first block."""
    r, n, c, k = F.col("r"), F.col("n"), F.col("c"), F.col("kind")
    # cells, then the one span beside them: rows are read once
    slots = rows.withColumn("kind", kind).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols))))
    cell, after, between = c < cols, (k == 2) & (r == n - 1), (k == 3) & (r == 0)
    slots = slots.where(F.when(cell, ~((k == 4) & (r > 0)) & (k != 5)).otherwise(after | between))
    left = F.when((k == 1) & (r == 2) & (c == 0), F.lit(WIDE - 4)).when((k == 6) & (c == 1), c * WIDE - 2).otherwise(c * WIDE + 4)
    pick = lambda inside, below, note: F.when(cell, inside).when(after, below).otherwise(note)
    made = {
        "block_order": pick(r * 2, r * 2, F.lit(1)) + first, "line": pick(F.lit(0), F.lit(1), F.lit(0)), "seq": pick(c, F.lit(0), F.lit(0)),
        "span_id": F.concat_ws(":", F.lit(tag), r.cast("string"), pick(c.cast("string"), F.lit("below"), F.lit("between"))), "text": pick(F.concat(F.lit("t"), r.cast("string")), F.lit("rest"), F.lit("note")),
        "x0": pick(left, F.lit(4.0), F.lit(4.0)) + dx, "y0": pick(r * HIGH + 4, n * HIGH + 10, n * HIGH + 30), "x1": pick(left + 8, F.lit(30.0), F.lit(30.0)) + dx, "y1": pick(r * HIGH + 12, n * HIGH + 18, n * HIGH + 38),
    }
    return slots.select("document_id", "page", *[v.alias(x) for x, v in made.items()])


@query("inspected_tables", f"""with {PAGES}, p as (select distinct page, n, page % 7 as k from pages)
select page::int as page, case k when 1 then 'ambiguous_source_span_assignment' when 2 then 'source_block_crosses_table_boundary' when 3 then 'source_blocks_noncontiguous' when 4 then 'insufficient_populated_cells' when 5 then 'no_source_text_ownership' end as reason,
  case k when 1 then 4 * n - 1 when 4 then 4 when 5 then 0 else 4 * n end::bigint as cells_filled, case k when 4 then 1 when 5 then 0 else n end::bigint as rows_filled, case when k = 5 then 0 else 4 end::bigint as cols_filled from p""")
def inspected_tables(spark, d):
    rows = _pages(spark, d)
    grids = T.simple_grids(T.gather(_candidates(rows), _cells(rows, F.lit(0))))
    return T.inspect_tables(grids, _spans(rows, F.col("page") % 7)).select("page", "reason", *[F.col(c).cast("long").alias(c) for c in ("cells_filled", "rows_filled", "cols_filled")])


@query("simple_table_verdicts", f"""with {PAGES}, p as (select distinct page, page % 4 as k from pages)
select page::int as page, case k when 1 then 'complex_or_merged_cells' when 2 then 'complex_or_irregular_topology' when 3 then 'column_topology_mismatch' end as reason from p""")
def simple_table_verdicts(spark, d):
    rows = _pages(spark, d)
    k = F.col("page") % 4
    cells = _cells(rows, F.when(k == 1, F.lit(1)).otherwise(F.lit(0)))
    cells = cells.withColumn("x0", F.when((k == 2) & (F.col("row") == 2) & (F.col("col") == 1), F.col("x0") + 6).otherwise(F.col("x0"))).where(~((k == 3) & (F.col("row") == 1) & (F.col("col") == 3)))
    return T.simple_grids(T.gather(_candidates(rows), cells)).select("page", "reason")


@query("boundary_retries", f"""with {PAGES}, p as (select distinct page, n, page % 5 as k from pages)
select page::int as page, (k in (2, 3))::bigint as cuts, case when k in (0, 4) then 'boundary_partition_not_applicable' when k = 1 then 'boundary_partition_ambiguous_block_geometry' when k = 3 then 'merged_insufficient_populated_cells' end as reason,
  case when k = 2 then 4 * n else 0 end::bigint as owned, case when k = 2 then 1 else 0 end::bigint as residual from p""")
def boundary_retries(spark, d):
    """Tables whose last block goes on below them, one of them with too little text, a span over the edge of the table, and two that need no cut."""
    rows = _pages(spark, d)
    k = F.col("page") % 5
    spans = _spans(rows, F.when(k.isin(2, 3), F.lit(2)).otherwise(F.lit(0)))
    spans = spans.where(~((k == 3) & (F.col("seq") > 0))).withColumn("x0", F.when((k == 1) & (F.col("span_id") == "a:0:0"), F.lit(-3.0)).otherwise(F.col("x0")))
    verdicts, _ = T.retry_at_boundaries(T.simple_grids(T.gather(_candidates(rows), _cells(rows, F.lit(0)))), spans)
    good = F.col("reason").isNull()
    return verdicts.select("page", F.col("cuts").cast("long").alias("cuts"), "reason", F.when(good, F.col("spans")).otherwise(0).cast("long").alias("owned"), F.when(good, F.col("residual")).otherwise(0).cast("long").alias("residual"))


@query("region_tables", f"""with {PAGES}, p as (select distinct page, n::int as n, page % 4 as k from pages), t as (select unnest([0, 1]) as table_id)
select page::int as page, table_id::int as table_id,
  case when k = 3 then 'segmented_insufficient_vector_regions' when k = 2 and table_id = 1 then 'segmented_nonrectangular_merged_component' when k = 2 then 'segmented_minimum_tables_not_met' end as reason,
  case when k < 2 or k = 2 and table_id = 0 then n end as n_rows, case when k < 2 then case when k = 1 and table_id = 1 then 'lines' else 'lines_strict' end when k = 2 and table_id = 0 then 'lines_strict' end as strategy, case when k < 2 then 4 * n - (k = 1 and table_id = 1)::int else 0 end::bigint as cells
from p join t on k < 3 or table_id = 0""")
def region_tables(spark, d):
    """Two grids side by side: both whole, one with a wide cell, one that fails and takes the other with it, and a page with one grid only."""
    rows = _pages(spark, d)
    k, side = F.col("page") % 4, F.col("side")
    # both grids of a page are drawn and written in one pass over its rows
    rows = rows.withColumn("side", F.explode(F.when(k < 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kind = F.when((side == 1) & (k == 1), F.lit(1)).when((side == 1) & (k == 2), F.lit(3)).otherwise(F.lit(0))
    apart = side * (COLS * WIDE + 40)
    spans = _spans(rows, F.lit(0), dx=apart, tag=F.when(side == 1, F.lit("b")).otherwise(F.lit("a")), first=side * 100)
    made = T.region_tables(_strokes(rows, kind, apart), spans)
    return made.select("page", "table_id", "reason", "n_rows", "strategy", F.coalesce(F.size("anchors"), F.lit(0)).cast("long").alias("cells"))

@query("column_order", f"""with {PAGES}, b as (select page, r, n, c, case when page % 4 = 3 and c = 2 then null else r * 10 + c end as block_order from pages cross join (select unnest([0, 1, 2]) as c) where c < 2 + page % 2),
t as (select page, n, -1 as r, -1 as c, 100 as block_order, page % 4 as k from pages where r = 0 and page % 4 >= 2 union all select page, n, r, c, block_order, page % 4 from b where block_order is not null)
select page::int as page, block_order::int as block_order, row_number() over (partition by page order by case when k = 3 then 0 else c end, case when k = 3 then block_order else r end)::int - 1 as reading_order from t""")
def column_order(spark, d):
    """Pages of two or three columns whose blocks alternate in the native order, some below a title, and some with a row of blocks that is no column."""
    rows = _pages(spark, d)
    k, r, c = F.col("page") % 4, F.col("r"), F.col("c")
    each = rows.withColumn("c", F.explode(F.sequence(F.lit(0), 1 + F.col("page") % 2))).where(~((k == 3) & (c == 2)))
    narrow = (k == 3) & (c == 1)
    blocks = each.select("document_id", "page", (r * 10 + c).alias("block_order"), (c * 200.0).alias("x0"), (r * 40.0 + c * 13 + 50).alias("y0"), (c * 200.0 + F.when(narrow, F.lit(20.0)).otherwise(180.0)).alias("x1"), (r * 40.0 + c * 13 + 60).alias("y1"))
    title = rows.where((r == 0) & (k >= 2)).select("document_id", "page", F.lit(100).alias("block_order"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(20.0).alias("y1"))
    return layout.column_order(blocks.unionByName(title).withColumn("page_width", F.lit(600.0))).select("page", "block_order", "reading_order")


@query("text_tables", f"""with {PAGES}, p as (select distinct page, n, page % 6 as k from pages)
select page::int as page, n::int as n_rows, 4 as n_cols, case k when 1 then 'text_aligned_operator_lane' when 2 then 'text_aligned_source_block_crosses_boundary' when 3 then 'text_aligned_insufficient_column_gap' when 5 then 'text_aligned_dense_row_spacing' end as reason,
  case when k in (0, 4) then 4 * n else 0 end::bigint as cells, case when k in (0, 4) then 4 end as in_last, case when k in (0, 4) then 't' || (n - 1) end as last_text from p""")
def text_tables(spark, d):
    """Aligned rows: whole, with a lane of operators, with a block that goes on, with narrow gaps, with an indented cell, and with rows close together."""
    rows = _pages(spark, d)
    k = F.col("page") % 6
    spans = _spans(rows, F.when(k == 2, F.lit(2)).otherwise(F.lit(0)))
    wide = F.when((k == 3) & (F.col("seq") == 1), F.lit(22.0)).otherwise(F.lit(0.0))
    shift = F.when((k == 4) & (F.col("seq") == 2) & (F.col("block_order") == 2), F.lit(5.0)).otherwise(F.lit(0.0))
    squeeze = F.when(k == 5, F.col("block_order") * 5.5).otherwise(F.lit(0.0))
    spans = spans.withColumns({"x0": F.col("x0") + shift, "x1": F.col("x1") + wide + shift, "y0": F.col("y0") - squeeze, "y1": F.col("y1") - squeeze, "text": F.when((k == 1) & (F.col("seq") == 1), F.lit("=")).otherwise(F.col("text"))})
    made = layout.text_tables(spans)
    last = F.filter("anchors", lambda a: a["row"] == F.col("n_rows") - 1)
    return made.select("page", "n_rows", "n_cols", "reason", F.coalesce(F.size("anchors"), F.lit(0)).cast("long").alias("cells"), F.size(last).alias("in_last"), F.get(last, F.lit(3))["text"].alias("last_text"))
