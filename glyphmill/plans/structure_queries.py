"""Queries of the structure layer: elements, signals, boundaries, groups, hierarchy, regions, relations, retrieval units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boundaries, elements, evaluation, grouping, hierarchy, regions, relations, retrieval, signals
from .inputs import LINES, MARKS, TURNS, event_elements, line_elements, table, turn_elements

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


@query("document_profile", "select doc_id::varchar as document_id, 1::bigint as blocks, case when length(trim(text)) > 0 then 1 else 0 end::bigint as text_blocks, len(string_split(text, chr(10)))::bigint as lines, length(text)::bigint as characters from documents where text <> ''")
def document_profile(spark, d):
    made = elements.text_blocks(_texts(spark, d))
    return made.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum((F.col("type") == "PARAGRAPH").cast("long")).alias("text_blocks"), (F.max("line_end") + F.max(F.col("raw_text").endswith("\n").cast("int"))).cast("long").alias("lines"), F.sum(F.length("raw_text")).cast("long").alias("characters"))


@query("line_elements", """with l as (select doc_id::varchar as document_id, unnest(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$')) as raw, generate_subscripts(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$'), 1) - 1 as line from documents)
select document_id, line::int as line, raw, coalesce(sum(length(raw)) over (partition by document_id order by line rows between unbounded preceding and 1 preceding), 0)::bigint as start_char, (sum(length(raw)) over (partition by document_id order by line rows unbounded preceding))::bigint as end_char from l""")
def line_rows(spark, d):
    return elements.line_rows(_texts(spark, d))


@query("normalised_elements", f"with {LINES} select document_id, ord, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as normalized_text, case when k = 3 then 'UNKNOWN' else type end as type, k = 3 as type_unresolved from el")
def normalised(spark, d):
    rows = line_elements(spark, d).withColumnRenamed("type", "gm_type")
    hint = F.when(F.col("k") == 3, F.lit("weird kind")).otherwise(F.concat(F.lit(" "), F.lower(F.replace("gm_type", F.lit("_"), F.lit("-")))))
    made = elements.normalise(rows.select("document_id", "ord", F.col("text").alias("raw_text"), hint.alias("type_hint"), "k", "gm_type"))
    return made.select("document_id", "ord", "normalized_text", "type", "type_unresolved")




@query("content_profile", f"""with {LINES}, c as (select *, case when type in ('TITLE','HEADING','PARAGRAPH') then 'narrative' when type = 'LIST_ITEM' then 'list' when type = 'CODE' then 'code' when type = 'TABLE_CELL' then 'table' when type = 'LOG_ENTRY' then 'log' when type = 'SEPARATOR' then 'separator' else 'unknown' end as category from el),
s as (select *, case when category <> lag(category) over (partition by document_id order by ord) then 1 else 0 end as sw from c),
g as (select document_id, count(*) as element_count, sum(sw)::bigint as category_switches, count(*) filter (category = 'narrative') as category_narrative, count(*) filter (category = 'log') as category_log, count(*) filter (category = 'code') as category_code, count(*) filter (category = 'list') as category_list, count(*) filter (category = 'table') as category_table, count(*) filter (category = 'separator') as category_separator from s group by document_id),
b as (select *, greatest(category_narrative, category_log, category_code, category_list, category_table, category_separator) as best from g)
select document_id, element_count, category_switches, category_narrative, category_log, category_code, category_narrative / element_count::double as share_narrative,
case when (category_narrative = best)::int + (category_log = best)::int + (category_code = best)::int + (category_list = best)::int + (category_table = best)::int + (category_separator = best)::int = 1 then case best when category_narrative then 'narrative' when category_log then 'log' when category_code then 'code' when category_list then 'list' when category_table then 'table' else 'separator' end end as dominant_category from b""")
def content_profile(spark, d):
    return elements.content_profile(line_elements(spark, d)).select("document_id", "element_count", "category_switches", "category_narrative", "category_log", "category_code", "share_narrative", "dominant_category")


@query("structure_signals", f"with {MARKS} " + r"""select document_id, ord, kind, text_value from (
 select document_id, ord, 'ELEMENT_TYPE' as kind, type as text_value from m2
 union all select document_id, ord, 'NUMBERING_MARKER', trim(numbering) from m2 where numbering is not null
 union all select document_id, ord, 'SECTION_MARKER', section from m2 where section is not null
 union all select document_id, ord, 'QUESTION_MARKER', trim(question) from m2 where question is not null
 union all select document_id, ord, 'ANSWER_MARKER', trim(answer) from m2 where answer is not null
 union all select document_id, ord, 'STYLE_BOLD', null from m2 where bold
 union all select document_id, ord, 'ELEMENT_TYPE_TRANSITION', lt || '>' || type from pr where lt <> type)""")
def structure_signals(spark, d):
    kinds = ["ELEMENT_TYPE", "NUMBERING_MARKER", "SECTION_MARKER", "QUESTION_MARKER", "ANSWER_MARKER", "STYLE_BOLD", "ELEMENT_TYPE_TRANSITION"]
    return signals.extract_signals(line_elements(spark, d)).where(F.col("kind").isin(kinds)).select("document_id", "ord", "kind", "text_value")


@query("signal_counts", f"with {MARKS} select kind, count(*) as n from (select 'SPEAKER_LABEL_CANDIDATE' as kind from m2 where speaker union all select 'TIMESTAMP_PATTERN' from m2 where stamp is not null union all select 'HEADING_LEVEL' from m2 where type = 'HEADING' and heading_level is not null union all select 'STYLE_FONT_SIZE' from m2 where font_size is not null) group by kind")
def signal_counts(spark, d):
    kinds = ["SPEAKER_LABEL_CANDIDATE", "TIMESTAMP_PATTERN", "HEADING_LEVEL", "STYLE_FONT_SIZE"]
    return signals.extract_signals(line_elements(spark, d)).where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("boundary_scores", f"with {MARKS} select document_id, ord, 'bnd_' || substr(sha256(l_id || '|' || element_id), 1, 20) as boundary_id, class, round(score, 6) as score, guard from bd")
def boundary_scores(spark, d):
    return boundaries.score_boundaries(line_elements(spark, d)).select("document_id", "ord", "boundary_id", "class", F.round("score", 6).alias("score"), "guard")


@query("dialogue_segments", f"""with {TURNS}, i as (select *, type = 'DIALOGUE_TURN' as m, lag(type) over (partition by document_id order by ord) as lt from tn),
r as (select *, sum(case when m and coalesce(lt, '') <> 'DIALOGUE_TURN' then 1 else 0 end) over (partition by document_id order by ord) as isl from i)
select document_id, min(ord) as first_ord, max(ord) as last_ord, count(*) as n, string_agg(element_id, ',' order by ord) as members from r where m group by document_id, isl having count(*) >= 2""")
def dialogue_segments(spark, d):
    return grouping.dialogue_segments(grouping.with_boundaries(turn_elements(spark, d))).select("document_id", "first_ord", "last_ord", "n", F.array_join("element_ids", ",").alias("members"))


@query("qa_pairs", f"""with {TURNS}, p as (select *, lead(type) over (partition by document_id order by ord) as nt, lead(element_id) over (partition by document_id order by ord) as nid from tn)
select document_id, 'lu_' || substr(sha256('QA_PAIR|' || element_id || '|' || nid), 1, 20) as unit_id, element_id || ',' || nid as members, ord as first_ord from p where type = 'QUESTION' and nt = 'ANSWER'""")
def qa_pairs(spark, d):
    return grouping.qa_pairs(grouping.with_boundaries(turn_elements(spark, d))).select("document_id", "unit_id", F.array_join("element_ids", ",").alias("members"), "first_ord")


@query("lexical_qa_pairs", f"with {MARKS} select document_id, l_id || ',' || element_id as members from bd where guard = 'QA_PAIR' and class = 'NONE'")
def lexical_qa_pairs(spark, d):
    return grouping.qa_pairs(grouping.with_boundaries(line_elements(spark, d))).select("document_id", F.array_join("element_ids", ",").alias("members"))


@query("log_windows", f"""with {MARKS}, i as (select e.*, lag(e.type) over (partition by e.document_id order by e.ord) as lt, b.class from el e left join bd b on b.document_id = e.document_id and b.ord = e.ord),
r as (select *, sum(case when type = 'LOG_ENTRY' and (coalesce(lt, '') <> 'LOG_ENTRY' or class in ('HARD','UNKNOWN')) then 1 else 0 end) over (partition by document_id order by ord) as isl from i)
select document_id, min(ord) as first_ord, max(ord) as last_ord, count(*) as n from r where type = 'LOG_ENTRY' group by document_id, isl having count(*) >= 2""")
def log_windows(spark, d):
    return grouping.log_windows(grouping.with_boundaries(line_elements(spark, d))).select("document_id", "first_ord", "last_ord", "n")


@query("text_blocks", f"""with {MARKS}, i as (select e.*, lag(e.type) over (partition by e.document_id order by e.ord) as lt, b.class from el e left join bd b on b.document_id = e.document_id and b.ord = e.ord),
r as (select *, sum(case when type = 'PARAGRAPH' and (coalesce(lt, '') <> 'PARAGRAPH' or class in ('HARD','UNKNOWN')) then 1 else 0 end) over (partition by document_id order by ord) as isl from i)
select document_id, min(ord) as first_ord, count(*) as n, string_agg(element_id, ',' order by ord) as members from r where type = 'PARAGRAPH' group by document_id, isl""")
def text_blocks(spark, d):
    return grouping.text_blocks(grouping.with_boundaries(line_elements(spark, d)), F.lit(True)).select("document_id", "first_ord", "n", F.array_join("element_ids", ",").alias("members"))


@query("lexical_lists", f"""with {LINES} select a.document_id, a.element_id || ',' || b.element_id as members from el a join el b on b.document_id = a.document_id and b.ord = a.ord + 1 where a.k = 2 and a.ord > 0 and b.k = 3""")
def lexical_lists(spark, d):
    return grouping.lexical_lists(grouping.with_boundaries(line_elements(spark, d))).select("document_id", F.array_join("element_ids", ",").alias("members"))


@query("logical_units")
def logical_units(spark, d):
    return grouping.group(line_elements(spark, d)).groupBy("unit_type").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("elements"))


@query("subdocuments", f"""with {LINES}, s as (select *, case when ord % 2 = 0 and (ord = 0 or k = 1) then 1 else 0 end as st from el),
r as (select *, sum(st) over (partition by document_id order by ord) as part, sum(st) over (partition by document_id) as starts, lead(st) over (partition by document_id order by ord) as nx from s)
select document_id, min(ord) as first_ord, count(*) as n, 'subdoc_' || substr(sha256(string_agg(element_id, '|' order by ord)), 1, 20) as subdocument_id from r where part > 0 and starts >= 2 and not (coalesce(nx, 0) = 1 and type = 'SEPARATOR') group by document_id, part""")
def subdocuments(spark, d):
    rows = line_elements(spark, d).withColumn("type", F.when(F.col("type") == "HEADING", F.lit("TITLE")).otherwise(F.col("type")))
    return grouping.subdocuments(rows).select("document_id", "first_ord", F.size("element_ids").cast("long").alias("n"), "subdocument_id")


@query("native_spans", f"""with {LINES}, g as (select *, k // 3 as grp, row_number() over (partition by document_id order by ord) as rn from el)
select document_id, grp::varchar as integrity_group_id, min(ord) as first_ord, max(ord) as last_ord, count(*) as n, count(*) <> max(rn) - min(rn) + 1 as interleaved from g group by document_id, grp""")
def native_spans(spark, d):
    rows = line_elements(spark, d).withColumn("integrity_group_id", F.floor(F.col("k") / 3).cast("string"))
    return grouping.integrity_spans(rows).select("document_id", "integrity_group_id", "first_ord", "last_ord", "n", "interleaved")


@query("hierarchy_parents", f"""with {LINES}, n as (select document_id, ord, element_id, case when type = 'TITLE' then 0 else heading_level end as level from el where (type = 'TITLE' or type = 'HEADING') and length(trim(text)) > 0)
select a.document_id, a.ord, a.level, (select max(b.ord) from n b where b.document_id = a.document_id and b.ord < a.ord and b.level < a.level) as parent_ord from n a""")
def hierarchy_parents(spark, d):
    built = hierarchy.nodes(hierarchy.build(line_elements(spark, d), calibrate=False))
    parent = built.select("document_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("parent_ord"))
    return built.join(parent, ["document_id", "parent_id"], "left").select("document_id", "ord", "level", "parent_ord")


@query("context_depth", f"""with {LINES}, n as (select document_id, ord, case when type = 'TITLE' then 0 else heading_level end as level from el where (type = 'TITLE' or type = 'HEADING') and length(trim(text)) > 0)
select e.document_id, e.ord, (select count(*) from n a where a.document_id = e.document_id and a.ord <= e.ord and not exists (select 1 from n b where b.document_id = e.document_id and b.ord > a.ord and b.ord <= e.ord and b.level <= a.level)) as depth from el e""")
def context_depth(spark, d):
    return hierarchy.build(line_elements(spark, d), calibrate=False).select("document_id", "ord", F.size("path").cast("long").alias("depth"))


@query("structure_modes")
def structure_modes(spark, d):
    return hierarchy.structure(hierarchy.build(line_elements(spark, d)))


@query("context_paths", "with recursive e as (select 'r' || r_regionkey as id, null as parent_id from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier), w as (select id, 0 as depth, id::varchar as path from e where parent_id is null union all select e.id, w.depth + 1, w.path || '>' || e.id from w join e on e.parent_id = w.id) select id, depth, path from w")
def context_paths(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_id"))
    edges = r.unionByName(n).unionByName(s)
    return hierarchy.tree_paths(edges, edges.where("parent_id is null").select("id")).select("id", "depth", F.array_join("path", ">").alias("path"))


@query("common_context")
def common_context(spark, d):
    built = hierarchy.build(line_elements(spark, d), calibrate=False)
    return hierarchy.common_path(built.select("document_id", F.floor(F.col("ord") / 4).alias("unit"), "path"), ["document_id", "unit"]).select("document_id", "unit", F.size("path").alias("depth"))


@query("region_segments", """with c as (select user_id::varchar as document_id, event_id as ord, case event_type when 'view' then 'narrative' when 'click' then 'list' when 'purchase' then 'table' when 'error' then 'separator' else 'boilerplate' end as category from events),
f as (select *, case when category in ('separator','boilerplate') then null else category end as own from c),
g as (select *, coalesce(last_value(own ignore nulls) over (partition by document_id order by ord rows unbounded preceding), first_value(own ignore nulls) over (partition by document_id order by ord rows between unbounded preceding and unbounded following)) as fill from f),
h as (select *, case when fill <> lag(fill) over (partition by document_id order by ord) then 1 else 0 end as st from g),
r as (select *, sum(st) over (partition by document_id order by ord) as region from h)
select document_id, region::bigint as region, min(fill) as category, min(ord) as first_ord, max(ord) as last_ord, count(*) as n, sum(case when own is null then 1 else 0 end)::bigint as bridges from r group by document_id, region""")
def region_segments(spark, d):
    kinds = {"view": "narrative", "click": "list", "purchase": "table", "error": "separator"}
    category = F.lit("boilerplate")
    for k, v in kinds.items():
        category = F.when(F.col("event_type") == k, F.lit(v)).otherwise(category)
    return regions.segments(event_elements(spark, d).withColumn("category", category), categories=True).select("document_id", "region", "category", "first_ord", "last_ord", "n", "bridges")


@query("document_modes", f"""with {LINES}, c as (select document_id, case when type in ('TITLE','HEADING','PARAGRAPH') then 'narrative' when type = 'LIST_ITEM' then 'list' when type = 'CODE' then 'code' when type = 'TABLE_CELL' then 'table' when type = 'LOG_ENTRY' then 'log' end as category from el where type <> 'SEPARATOR'),
s as (select document_id, count(distinct category) as cats, max((category = 'log')::int) as acts, avg((category <> 'narrative')::int) as share from c group by document_id)
select document_id, case when cats > 1 and acts = 1 then 'MIXED' when cats > 1 and share >= 0.35 then 'MIXED' else 'UNKNOWN' end as mode, round(share, 9) as share from s""")
def document_modes(spark, d):
    rows = line_elements(spark, d)
    flat = rows.select("document_id").distinct().withColumn("mode", F.lit("UNKNOWN"))
    return regions.document_mode(rows, flat).select("document_id", "mode", F.round("non_narrative_share", 9).alias("share"))


@query("relations_next", f"with {TURNS}, p as (select *, lead(element_id) over (partition by document_id order by ord) as nx from tn) select document_id, element_id as source_id, nx as target_id, 'rel_' || substr(sha256('NEXT|' || element_id || '|' || nx), 1, 20) as relation_id from p where nx is not null")
def relations_next(spark, d):
    return relations.next_edges(turn_elements(spark, d)).select("document_id", "source_id", "target_id", "relation_id")


@query("relations_part_of", f"""with {TURNS}, p as (select *, lead(type) over w as nt, lead(element_id) over w as nid from tn window w as (partition by document_id order by ord)),
u as (select document_id, element_id as a, nid as b, 'lu_' || substr(sha256('QA_PAIR|' || element_id || '|' || nid), 1, 20) as unit_id from p where type = 'QUESTION' and nt = 'ANSWER'),
m as (select document_id, a as e, unit_id from u union all select document_id, b, unit_id from u)
select document_id, e as source_id, unit_id as target_id, 'rel_' || substr(sha256('PART_OF|' || e || '|' || unit_id), 1, 20) as relation_id from m""")
def relations_part_of(spark, d):
    units = grouping.qa_pairs(grouping.with_boundaries(turn_elements(spark, d)))
    return relations.membership_edges(units).select("document_id", "source_id", "target_id", "relation_id")


@query("relations_question_answer", f"""with {TURNS}, p as (select *, lead(type) over w as nt, lead(element_id) over w as nid from tn window w as (partition by document_id order by ord))
select document_id, element_id as source_id, nid as target_id, 0.95::double as confidence from p where type = 'QUESTION' and nt = 'ANSWER'""")
def relations_question_answer(spark, d):
    units = grouping.qa_pairs(grouping.with_boundaries(turn_elements(spark, d)))
    return relations.question_answer_edges(units).select("document_id", "source_id", "target_id", "confidence")


def _fragments(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("document_id"), k.cast("string").alias("fragment_id"), (k % 7).cast("int").alias("page"), F.lit(0.1).alias("x0"), F.when(k % 3 == 0, 0.5).otherwise(0.05).alias("y0"), F.when(k % 5 == 0, 0.7).otherwise(0.9).alias("x1"),
        F.when(k % 4 == 0, 0.6).otherwise(0.95).alias("y1"), F.array(F.lit(0.1), F.lit(0.4), F.when(k % 5 == 0, 0.7).otherwise(0.9)).alias("column_boundaries"), F.lit(2).alias("column_count"), F.when(k % 11 == 0, F.lit("MERGED")).otherwise(F.lit("SIMPLE")).alias("topology"),
        F.when(k % 2 == 0, F.lit("PORTRAIT")).alias("orientation"), F.lit(None).cast("string").alias("leading_row_fingerprint"),
    )


@query("table_continuation", """with f as (select o_custkey::varchar as document_id, o_orderkey as k, (o_orderkey % 7)::int as page, case when o_orderkey % 3 = 0 then 0.5 else 0.05 end as y0, case when o_orderkey % 4 = 0 then 0.6 else 0.95 end as y1, o_orderkey % 5 = 0 as narrow, o_orderkey % 11 = 0 as merged from orders),
p as (select a.document_id, a.k as l, b.k as r, a.page, case when 1.0 - a.y1 > 0.12 or b.y0 > 0.12 then 'page_edge_evidence_insufficient' when a.narrow <> b.narrow then 'column_geometry_mismatch' when a.merged <> b.merged then 'table_topology_incompatible' else 'compatible_adjacent_table_fragments' end as reason
 from f a join f b on a.document_id = b.document_id and b.page = a.page + 1)
select document_id, l::varchar as left_id, r::varchar as right_id, reason from p""")
def table_continuation(spark, d):
    return relations.continuation_pairs(_fragments(spark, d)).select("document_id", "left_id", "right_id", "reason")


@query("table_continuation_edges", """with f as (select o_custkey::varchar as document_id, o_orderkey as k, (o_orderkey % 7)::int as page, case when o_orderkey % 3 = 0 then 0.5 else 0.05 end as y0, case when o_orderkey % 4 = 0 then 0.6 else 0.95 end as y1, o_orderkey % 5 = 0 as narrow, o_orderkey % 11 = 0 as merged from orders),
p as (select a.document_id, a.k as l, b.k as r, a.page from f a join f b on a.document_id = b.document_id and b.page = a.page + 1 where 1.0 - a.y1 <= 0.12 and b.y0 <= 0.12 and a.narrow = b.narrow and a.merged = b.merged),
u as (select *, count(*) over (partition by document_id, page) as n from p) select document_id, l::varchar as source_id, r::varchar as target_id from u where n = 1""")
def table_continuation_edges(spark, d):
    return relations.continuations(_fragments(spark, d)).select("document_id", "source_id", "target_id")


@query("retrieval_units", f"""with {TURNS}, p as (select *, lead(type) over w as nt, lead(element_id) over w as nid, lead(text) over w as ntext from tn window w as (partition by document_id order by ord)),
q as (select document_id, element_id || ',' || nid as members, text || chr(10) || ntext as retrieval_text, 'QA_PAIR' as unit_type, ord from p where type = 'QUESTION' and nt = 'ANSWER')
select document_id, members, retrieval_text, unit_type from q""")
def retrieval_units(spark, d):
    rows = turn_elements(spark, d)
    units = grouping.qa_pairs(grouping.with_boundaries(rows))
    made = retrieval.build(rows, units)
    return made.where("logical_unit_id is not null").select("document_id", F.array_join("element_ids", ",").alias("members"), "retrieval_text", "unit_type")


@query("token_partitions", f"""with recursive {LINES}, s as (select document_id, ord, len(regexp_extract_all(text, '\\S+')) as n, row_number() over (partition by document_id order by ord) as i from el),
w as (select document_id, i, 0 as part, n as used from s where i = 1 union all
  select s.document_id, s.i, case when s.n > 0 and w.used > 0 and 3 + w.used + s.n > 64 then w.part + 1 else w.part end, case when s.n > 0 and w.used > 0 and 3 + w.used + s.n > 64 then s.n else w.used + s.n end from w join s on s.document_id = w.document_id and s.i = w.i + 1)
select document_id, string_agg(part, ',' order by i) as parts from w group by 1""")
def token_partitions(spark, d):
    rows = line_elements(spark, d)
    sizes = rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", T.tokens(F.col("text")).alias("n")))), lambda x: x["n"]).alias("sizes")).withColumns({"unit_id": F.col("document_id"), "head": F.lit(3)})
    return retrieval.partition_units(sizes, 64).select("document_id", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query("pairwise_comembership", """select user_id::varchar as document_id, event_type as unit_id, count(*) as n, (count(*) * (count(*) - 1) / 2)::bigint as pairs from events group by 1, 2""")
def pairwise_comembership(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_type").alias("unit_id"))
    return evaluation.co_member_counts(rows)


@query("boundary_changes", "with r as (select user_id::varchar as document_id, event_id as ord, event_type, lead(event_type) over (partition by user_id order by event_id) as nx from events) select document_id, ord from r where nx is not null and nx <> event_type")
def boundary_changes(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("region"))
    return evaluation.boundary_set(rows)
