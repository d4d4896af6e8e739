"""Retrieval units: logical units and left-over elements as texts with context, anchors and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import complete

#: Retrieval type of each unit type and element type, and types that are never emitted alone.
UNIT_TYPES = {
    "TEXT_BLOCK": "TEXT", "SECTION": "SECTION", "TOPIC_GROUP": "SECTION", "QA_PAIR": "QA_PAIR", "DIALOGUE_SEGMENT": "DIALOGUE", "CODE_BLOCK": "CODE", "TABLE_BLOCK": "TABLE",
    "LOG_WINDOW": "LOG", "KEY_VALUE_GROUP": "TEXT", "LIST_GROUP": "LIST", "UNKNOWN_GROUP": "UNKNOWN",
}
SINGLE_TYPES = {"TITLE": "SECTION", "HEADING": "SECTION", "CODE": "CODE", "TABLE": "TABLE", "LIST": "LIST", "LIST_ITEM": "LIST", "LOG_ENTRY": "LOG", "DIALOGUE_TURN": "DIALOGUE", "UNKNOWN": "UNKNOWN"}
UNSAFE_SINGLES = ["TABLE_ROW", "TABLE_CELL", "LIST_ITEM", "QUESTION", "ANSWER"]
EXCLUDED_ZONES = ["header", "footer"]


def _lookup(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key], F.lit(default))


def excluded(zones: list[str] | None = None) -> Column:
    """Whether an element is kept out of retrieval: by flag, as a page number, or by its zone."""
    return F.coalesce("exclude_from_retrieval", F.lit(False)) | (F.col("type") == "PAGE_NUMBER") | F.coalesce(F.lower("source_zone").isin(zones or EXCLUDED_ZONES), F.lit(False))


def views(elements: DataFrame) -> DataFrame:
    """Elements with display_text (raw first) and retrieval_text (normalized first), and whether they are excluded."""
    rows = complete(elements)
    raw, norm = F.coalesce("raw_text", "text"), F.coalesce("normalized_text", "text")
    return rows.withColumns({"display_text": T.first_nonblank(raw, norm), "content_text": T.first_nonblank(norm, raw), "excluded": excluded()})


def retrieval_text(title: Column, labels: Column, content: Column) -> Column:
    """Title, context labels and content, those that are there, line by line."""
    context = F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, F.array_join(labels, " > "))
    return F.concat_ws("\n", T.nonblank(T.strip(title)), context, content)


def unit_id(identity: Column, text: Column, version: str = "1") -> Column:
    return T.joined_id("ru_", F.lit(version), F.col("document_id").cast("string"), identity, text)


def mixed_exclusion_violations(elements: DataFrame, units: DataFrame) -> DataFrame:
    """Units of which some but not all members are excluded."""
    members = units.select("document_id", "unit_id", F.explode("element_ids").alias("element_id")).join(views(elements).select("document_id", "element_id", "excluded"), ["document_id", "element_id"])
    made = members.groupBy("document_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("excluded").cast("int")).alias("m"))
    return made.where("m > 0 and m < n").select("document_id", "unit_id", F.lit("UNIT_MIXES_EXCLUDED").alias("code"))


def ownership_violations(units: DataFrame) -> DataFrame:
    """Elements that more than one unit has."""
    made = units.select("document_id", "unit_id", F.explode("element_ids").alias("element_id")).groupBy("document_id", "element_id").agg(F.countDistinct("unit_id").alias("n"))
    return made.where("n > 1").select("document_id", "element_id", "n", F.lit("ELEMENT_IN_SEVERAL_UNITS").alias("code"))


def table_view(cells: DataFrame) -> DataFrame:
    """Cells (document_id, unit_id, row, col, text) as one tab and line grid; null where places are missing or come twice."""
    made = cells.groupBy("document_id", "unit_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row", "col").alias("places"))
    rows = cells.groupBy("document_id", "unit_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\t").alias("line"))
    grid = rows.groupBy("document_id", "unit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("grid"))
    return made.join(grid, ["document_id", "unit_id"]).select("document_id", "unit_id", F.when(F.col("n") == F.col("places"), F.col("grid")).alias("grid"))


def anchor(df_columns: list[str]) -> Column:
    """Location of an element as an anchor; identity alone where nothing of it is known."""
    place = [c for c in ("page", "x0", "y0", "x1", "y1", "start_char", "end_char", "line_start", "line_end") if c in df_columns]
    known = F.coalesce(*[F.col(c).cast("string") for c in place]).isNotNull() if place else F.lit(False)
    return F.struct(F.col("element_id").alias("element_id"), *[F.col(c).alias(c) for c in place], known.alias("located"))


def location_class(anchors: Column) -> Column:
    """none, partial or all of the anchors are located."""
    n = F.size(F.filter(anchors, lambda a: a["located"]))
    return F.when(n == 0, F.lit("none")).when(n == F.size(anchors), F.lit("all")).otherwise(F.lit("partial"))


def strategy(region_mode: Column, document_mode: Column) -> Column:
    """The region's mode if known, FLAT for mixed documents, else the document's; unknown modes are FLAT."""
    mode = F.when(region_mode.isNotNull() & (region_mode != "UNKNOWN"), region_mode).when(document_mode == "MIXED", F.lit("FLAT")).otherwise(document_mode)
    return F.when(F.coalesce(mode, F.lit("UNKNOWN")).isin("UNKNOWN", "FLAT"), F.lit("FLAT")).otherwise(mode)


def pack(sizes: list[int], head: int, budget: int) -> list[int]:
    """Part of each element: greedy packing of token counts behind ``head`` tokens; blank elements (0) never start a part."""
    part, used, out = 0, 0, []
    for n in sizes:
        if n and used and head + used + n > budget:
            part, used = part + 1, 0
        used += n
        out.append(part)
    return out


def partition_units(rows: DataFrame, max_tokens: int) -> DataFrame:
    """Text units as parts within a token budget.

    ``rows``: document_id, unit_id, head (tokens of title and context) and sizes (tokens of each element in order).  The fold
    resets at each part, which no window expresses, so it runs as an array fold in the plan.
    """
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(a: Column, n: Column) -> Column:
        cut = (n > 0) & (a["used"] > 0) & (F.col("head") + a["used"] + n > max_tokens)
        part = a["part"] + cut.cast("int")
        return F.struct(part.alias("part"), F.when(cut, n).otherwise(a["used"] + n).alias("used"), F.concat(a["parts"], F.array(part)).alias("parts"))

    return rows.withColumn("parts", F.aggregate(F.col("sizes").cast("array<int>"), start, step, lambda a: a["parts"]))


def build(elements: DataFrame, units: DataFrame, paths: DataFrame | None = None, titles: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """Retrieval units of logical units and of single elements that none has.

    ``paths``: document_id, element_id and labels (context labels of the element, its own node last for headings);
    ``titles``: document_id and title.
    """
    rows = views(elements)
    if paths is not None:
        rows = rows.join(paths.select("document_id", "element_id", "labels"), ["document_id", "element_id"], "left")
    else:
        rows = rows.withColumn("labels", F.array().cast("array<string>"))
    if titles is not None:
        rows = rows.join(titles.select("document_id", "title"), "document_id", "left")
    else:
        rows = rows.withColumn("title", F.lit(None).cast("string"))
    rows = rows.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "anchor": anchor(rows.columns)})
    owner = units.select("document_id", "unit_id", "unit_type", F.posexplode("element_ids").alias("pos", "element_id"))
    joined = rows.join(owner, ["document_id", "element_id"], "left")
    prefix = F.aggregate(F.slice("gm_labels", 2, F.greatest(F.size("gm_labels"), F.lit(1))), F.element_at("gm_labels", 1), _common)
    members = joined.where(F.col("unit_id").isNotNull() & ~F.col("excluded"))
    item = F.struct("pos", "element_id", F.col("display_text").alias("d"), F.col("content_text").alias("c"), "anchor", F.coalesce(T.tokens(F.col("content_text")), F.lit(0)).alias("n"))
    made = members.groupBy("document_id", "unit_id", "unit_type").agg(F.sort_array(F.collect_list(item)).alias("items"), F.collect_list("labels").alias("gm_labels"), F.min("ord").alias("first_ord"), F.first("title").alias("title")).withColumn("labels", prefix)
    head = T.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("labels", " > ")))
    made = made.withColumns({"head": head, "sizes": F.transform("items", lambda x: x["n"])})
    if max_tokens is None:
        made = made.withColumn("parts", F.transform("items", lambda x: F.lit(0)))
    else:
        made = partition_units(made, max_tokens).withColumn("parts", F.when(F.col("unit_type") == "TEXT_BLOCK", F.col("parts")).otherwise(F.transform("items", lambda x: F.lit(0))))
    made = made.withColumn("n_parts", F.array_max("parts") + 1).select("*", F.explode(F.sequence(F.lit(0), F.array_max("parts"))).alias("part"))
    mine = F.filter("items", lambda x, i: F.get(F.col("parts"), i) == F.col("part"))
    made = made.withColumn("items", mine)
    of = lambda f: F.filter(F.transform("items", lambda x: x[f]), lambda x: x.isNotNull())
    identity = F.when(F.col("n_parts") == 1, F.concat(F.lit("logical:"), F.col("unit_id"))).otherwise(F.concat(F.lit("logical:"), F.col("unit_id"), F.lit(":part:"), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("n_parts").cast("string"), F.lit(":"), F.array_join(F.transform("items", lambda x: x["element_id"]), ",")))
    from_units = made.select("document_id", identity.alias("identity"), F.col("unit_id").alias("logical_unit_id"), _lookup(UNIT_TYPES, F.col("unit_type"), "TEXT").alias("unit_type"), F.transform("items", lambda x: x["element_id"]).alias("element_ids"), F.array_join(of("d"), "\n\n").alias("display_text"), F.array_join(of("c"), "\n").alias("content_text"), "labels", "title", F.transform("items", lambda x: x["anchor"]).alias("anchors"), "first_ord")
    single = joined.where(F.col("unit_id").isNull() & ~F.col("excluded") & ~F.col("type").isin(UNSAFE_SINGLES) & F.col("display_text").isNotNull())
    own = F.when(F.col("type").isin("TITLE", "HEADING") & (F.size("labels") > 0), F.slice("labels", F.lit(1), F.greatest(F.size("labels") - 1, F.lit(0)))).otherwise(F.col("labels"))
    from_singles = single.select("document_id", F.concat(F.lit("element:"), F.col("element_id")).alias("identity"), F.lit(None).cast("string").alias("logical_unit_id"), _lookup(SINGLE_TYPES, F.col("type"), "TEXT").alias("unit_type"), F.array("element_id").alias("element_ids"), "display_text", "content_text", own.alias("labels"), "title", F.array("anchor").alias("anchors"), F.col("ord").alias("first_ord"))
    out = from_units.unionByName(from_singles).where((F.length(T.strip(F.col("display_text"))) > 0) & (F.length(T.strip(F.col("content_text"))) > 0))
    out = out.withColumn("retrieval_text", retrieval_text(F.col("title"), F.col("labels"), F.col("content_text")))
    n = T.tokens(F.col("retrieval_text"))
    over = F.lit(False) if max_tokens is None else n > max_tokens
    return out.select("document_id", unit_id(F.col("identity"), F.col("retrieval_text")).alias("retrieval_unit_id"), "identity", "logical_unit_id", "unit_type", "element_ids", "retrieval_text", "display_text", F.col("labels").alias("context_path"), "anchors", location_class(F.col("anchors")).alias("location_projection"), F.greatest(n, F.lit(1)).alias("token_count"), over.alias("oversized"), "first_ord")


def _common(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    differs = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), F.lit(False))
    return F.slice(a, F.lit(1), (differs - 1).cast("int"))


def withheld(elements: DataFrame, units: DataFrame) -> DataFrame:
    """Elements of types that are never emitted alone and that no unit has."""
    owned = units.select("document_id", F.explode("element_ids").alias("element_id"))
    return views(elements).where(~F.col("excluded") & F.col("type").isin(UNSAFE_SINGLES)).join(owned, ["document_id", "element_id"], "left_anti").select("document_id", "ord", "element_id", "type")


def unit_violations(retrieval_units: DataFrame, elements: DataFrame) -> DataFrame:
    """Retrieval units that name unknown elements, name one twice, are out of order, or have no text."""
    known = elements.select("document_id", "element_id", F.col("ord").alias("gm_ord"))
    members = retrieval_units.select("document_id", "retrieval_unit_id", F.posexplode("element_ids").alias("pos", "element_id")).join(known, ["document_id", "element_id"], "left")
    checks = members.groupBy("document_id", "retrieval_unit_id").agg(F.sum(F.col("gm_ord").isNull().cast("int")).alias("unknown"), (F.count(F.lit(1)) - F.countDistinct("element_id")).alias("twice"), F.sort_array(F.collect_list(F.struct("pos", "gm_ord"))).alias("o"))
    ordered = F.transform("o", lambda x: x["gm_ord"])
    code = F.when(F.col("unknown") > 0, F.lit("UNKNOWN_ELEMENT")).when(F.col("twice") > 0, F.lit("ELEMENT_TWICE")).when(ordered != F.array_sort(ordered), F.lit("OUT_OF_ORDER"))
    blank = retrieval_units.where(F.length(T.strip(F.col("retrieval_text"))) == 0).select("document_id", "retrieval_unit_id", F.lit("BLANK_TEXT").alias("code"))
    return checks.select("document_id", "retrieval_unit_id", code.alias("code")).where("code is not null").unionByName(blank)
