"""Queries of single rules over rows of orders and line items: retrieval, semantics, evaluation, curation and page geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, geometry, library, retrieval, review, semantics, studio
from .inputs import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _pick(index, *values):
    """One of some values by an index from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


K, P, S, N = F.col, "l_partkey", "l_suppkey", "l_linenumber"
#: Line items with a name of their own, and their place in the order.
ITEMS = "items as (select l_orderkey as o, l_partkey as p, l_suppkey as s, l_linenumber as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as r from lineitem)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), (F.row_number().over(w) - 1).alias("r"))


# Retrieval


@query("table_views", f"with {ITEMS} select o as unit_id, case when o % 7 <> 0 then string_agg('a' || p || chr(9) || case when s % 2 = 0 then '' else 'b' || s end, chr(10) order by r) end as grid from items group by o")
def table_views(spark, d):
    """Grids of two columns; in every seventh order a place comes twice."""
    rows = _items(spark, d).select((K("o") % 9).alias("document_id"), K("o").alias("unit_id"), K("r").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.concat(F.lit("a"), K("p").cast("string")).alias("text")), F.struct(F.lit(1).alias("col"), F.when(K("s") % 2 == 1, F.concat(F.lit("b"), K("s").cast("string"))).alias("text")))).alias("x")).select("document_id", "unit_id", "row", "x.*")
    twice = rows.where((K("unit_id") % 7 == 0) & (K("row") == 0) & (K("col") == 0))
    return retrieval.table_view(rows.unionByName(twice)).select("unit_id", "grid")


@query("unit_strategies", """select o_orderkey as unit_id, case when o_orderkey % 4 = 2 then 'QA' when o_orderkey % 4 = 3 then 'FLAT' when o_custkey % 4 = 1 then 'QA' when o_custkey % 4 = 3 then 'HIERARCHICAL' else 'FLAT' end as strategy from orders""")
def unit_strategies(spark, d):
    region, document = _pick(K("o_orderkey") % 4, None, "UNKNOWN", "QA", "FLAT"), _pick(K("o_custkey") % 4, "MIXED", "QA", "UNKNOWN", "HIERARCHICAL")
    return table(spark, d, "orders").select(K("o_orderkey").alias("unit_id"), retrieval.strategy(region, document).alias("strategy"))


# Semantics


@query("rendered_payloads", """with v as (select o_orderkey as id, (['KEY_POINT','NOTE','LEARNING_OBJECTIVE'])[o_orderkey % 3 + 1] as kind, (['Key Point','Note','Learning Objective'])[o_orderkey % 3 + 1] as label, o_orderkey % 2 as m, o_orderpriority || '  ' || o_orderstatus as value from orders),
t as (select *, case when m = 0 then label || ': ' || value else label end as whole from v)
select id, case when length(whole) > 20 then rtrim(whole[:19]) || '…' else whole end as payload, rtrim(regexp_replace(value, ' +', ' ', 'g')[:9]) as limited from t""")
def rendered_payloads(spark, d):
    k = K("o_orderkey")
    value = F.concat_ws("  ", "o_orderpriority", "o_orderstatus")
    return table(spark, d, "orders").select(k.alias("id"), semantics.payload(_pick(k % 3, "KEY_POINT", "NOTE", "LEARNING_OBJECTIVE"), _pick(k % 2, "EXTRACTIVE", "LABEL_ONLY"), value, 20).alias("payload"), semantics.limited(value, 9).alias("limited"))


@query("accepted_predictions", f"with {ITEMS} select o, r, 'role' || (s % 4) as role, (p % 100) / 100.0::double as probability from items where (p % 100) / 100.0::double >= case s % 4 when 0 then 0.25 when 1 then 0.75 when 2 then 0.5 else 0.5 end")
def accepted_predictions(spark, d):
    rows = _items(spark, d).select("o", "r", F.concat(F.lit("role"), (K("s") % 4).cast("string")).alias("role"), ((K("p") % 100) / 100).alias("probability"))
    thresholds = rows.where("role in ('role0', 'role1', 'role2')").select("role").distinct().withColumn("threshold", 0.25 * F.element_at(F.create_map(F.lit("role0"), F.lit(1), F.lit("role1"), F.lit(3), F.lit("role2"), F.lit(2)), K("role")))
    return semantics.accept_predictions(rows, thresholds).select("o", "r", "role", "probability")


@query("unit_scopes", f"""with {ITEMS}, a as (select o, r, case p % 4 when 0 then 'e' || o || ':' || r when 1 then 'u' || o when 2 then 'c' || o % 10 else 'g' || o % 5 end as target, p % 4 as k from items)
select 'u' || u.o_orderkey as unit_id, a.o || ':' || a.r as annotation_id, a.k::int as scope_rank from a join orders u on case when a.k in (0, 1) then u.o_orderkey = a.o when a.k = 2 then u.o_orderkey % 10 = a.o % 10 and u.o_orderkey % 50 = a.o % 50 else u.o_orderkey % 5 = a.o % 5 and u.o_orderkey % 50 = a.o % 50 end and u.o_orderkey % 200 = a.o % 200""")
def unit_scopes(spark, d):
    """Annotations of an element, a unit, a context or a region of a document, with the units they reach."""
    items, orders = _items(spark, d), table(spark, d, "orders").select(K("o_orderkey").alias("o"))
    doc, unit = (K("o") % 200).alias("document_id"), F.concat(F.lit("u"), K("o").cast("string")).alias("unit_id")
    name = lambda p, *c: F.concat(F.lit(p), F.concat_ws(":", *[x.cast("string") for x in c]))
    k = K("p") % 4
    target = F.when(k == 0, name("e", K("o"), K("r"))).when(k == 1, name("u", K("o"))).when(k == 2, name("c", K("o") % 10)).otherwise(name("g", K("o") % 5))
    annotations = items.select(doc, name("", K("o"), K("r")).alias("annotation_id"), target.alias("target_id"))
    members = items.groupBy("o").agg(F.collect_list(name("e", K("o"), K("r"))).alias("element_ids"))
    units = orders.join(members, "o", "left").select(doc, unit, F.coalesce("element_ids", F.array().cast("array<string>")).alias("element_ids"))
    bridge = lambda p, m: orders.select(doc, unit, name(p, K("o") % m).alias("target_id"))
    return semantics.unit_scopes(annotations, units, bridge("c", 10), bridge("g", 5)).select("unit_id", "annotation_id", "scope_rank")


@query("candidate_violations", f"""with {ITEMS}, c as (select i.o, i.r, i.p % 5 as k, o_orderpriority as text from items i join orders on o_orderkey = i.o)
select o as request_id, r as target_id, case k when 1 then 'TARGET_NOT_REQUESTED' when 2 then 'EVIDENCE_OUT_OF_RANGE' when 3 then 'EVIDENCE_QUOTE_MISMATCH' end as code from c where k between 1 and 3""")
def candidate_violations(spark, d):
    text = table(spark, d, "orders").select(K("o_orderkey").alias("o"), K("o_orderpriority").alias("text"))
    rows = _items(spark, d).join(text, "o").withColumn("k", K("p") % 5)
    requests = rows.where("k != 1").select(K("o").alias("request_id"), K("r").alias("target_id"), "text")
    end = F.when(K("k") == 2, F.length("text") + 1).otherwise(3)
    quote = F.when(K("k") == 3, F.lit("??")).otherwise(F.substring("text", 2, 2))
    candidates = rows.select(K("o").alias("request_id"), K("r").alias("target_id"), F.lit(1).alias("start_char"), end.alias("end_char"), quote.alias("quoted_text"))
    return semantics.candidate_violations(requests, candidates)


@query("resolved_capabilities", """with n as (select distinct c_nationkey % 3 as kind, c_custkey % 6 as type from customer), d as (select distinct c_nationkey % 3 as kind, c_custkey % 6 as type, c_custkey % 12 as cap from customer where c_custkey % 6 < 4 and not (c_custkey % 6 < 2 and c_custkey % 12 >= 6)),
g as (select kind, type, count(*) as n, min('cap' || lpad(cap::varchar, 2, '0')) as cap from d group by 1, 2) select n.kind::varchar as target_kind, n.type::varchar as type, case when g.n = 1 then cap end as capability, case when g.n is null then 'UNSUPPORTED' when g.n > 1 then 'AMBIGUOUS' end as code from n left join g using (kind, type)""")
def resolved_capabilities(spark, d):
    c = table(spark, d, "customer").select((K("c_nationkey") % 3).cast("string").alias("target_kind"), (K("c_custkey") % 6).cast("string").alias("type"), (K("c_custkey") % 12).alias("cap"), F.lit("o").alias("ontology_id"))
    needed = c.drop("cap").distinct()
    declared = c.where("type < 4 and not (type < 2 and cap >= 6)").select("target_kind", "type", "ontology_id", F.concat(F.lit("cap"), F.lpad(K("cap").cast("string"), 2, "0")).alias("capability")).distinct()
    return semantics.resolve_capabilities(declared, needed).drop("ontology_id")


# Evaluation


@query("best_overlaps", f"""with {ITEMS}, g as (select o, 100 * r as start, 100 * r + 40 as "end", p % 4 as k from items) select o as element_id, start as gold_start, "end" as gold_end, start + 20 * k as start, "end" + 20 * k as "end", 40 - 20 * k as overlap from g where k < 2""")
def best_overlaps(spark, d):
    """Gold spans with a prediction that is equal, half beside, or beside them."""
    rows = _items(spark, d).select((K("o") % 9).cast("string").alias("document_id"), K("o").alias("element_id"), F.lit("text").alias("text_view"), (K("r") * 100).cast("long").alias("start"), (K("r") * 100 + 40).cast("long").alias("end"), (K("p") % 4).alias("k"))
    moved = rows.withColumns({"start": K("start") + 20 * K("k"), "end": K("end") + 20 * K("k")})
    return evaluation.best_overlaps(rows, moved).select("element_id", "gold_start", "gold_end", "start", "end", "overlap")


@query("role_differences", f"""with {ITEMS} select (o % 40)::varchar as document_id, (o // 40)::varchar as target, 'E' as kind, 'T' || r as type, case when p % 3 = 0 then 'MISSING' else 'EXTRA' end as difference from items where p % 3 < 2""")
def role_differences(spark, d):
    rows = _items(spark, d).select((K("o") % 40).cast("string").alias("document_id"), F.expr("o div 40").cast("string").alias("target"), F.lit("E").alias("kind"), F.concat(F.lit("T"), K("r").cast("string")).alias("type"), (K("p") % 3).alias("k"))
    return evaluation.role_differences(rows.where("k != 1"), rows.where("k != 0"))


@query("capability_slices", f"""with {ITEMS}, e as (select distinct p % 5 as provider, s % 3 as version from items), x as (select p % 5 as provider, s % 3 as version, count(*) filter (where n = 1) as tp, count(*) filter (where n = 2) as fp, count(*) filter (where n > 2) as fn from items where p % 5 < 4 group by 1, 2)
select e.provider, e.version, coalesce(tp, 0)::bigint as tp, coalesce(fp, 0)::bigint as fp, coalesce(fn, 0)::bigint as fn, round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) end, 9) as f1 from e left join x using (provider, version)""")
def capability_slices(spark, d):
    rows = _items(spark, d).select((K("p") % 5).alias("provider"), (K("s") % 3).alias("version"), F.lit("c").alias("capability"), F.lit("en").alias("language"), "n")
    one = lambda c: c.cast("long")
    outcomes = rows.where("provider < 4").select("provider", "version", "capability", "language", one(K("n") == 1).alias("tp"), one(K("n") == 2).alias("fp"), one(K("n") > 2).alias("fn"))
    made = evaluation.capability_slices(rows, outcomes)
    return made.select("provider", "version", "tp", "fp", "fn", F.round(F.when(K("tp") + K("fp") + K("fn") > 0, 2.0 * K("tp") / (2 * K("tp") + K("fp") + K("fn"))), 9).alias("f1"))


@query("grounding_scores", """with i as (select o_orderkey, o_orderkey % 5 as k from orders) select count(*)::bigint as n, count(*) filter (where k > 0)::bigint as attached, count(*) filter (where k > 1)::bigint as aligned, count(*) filter (where k > 2)::bigint as supported, round(count(*) filter (where k > 2) / count(*)::double, 9) as supported_ratio from i""")
def grounding_scores(spark, d):
    k = K("o_orderkey") % 5
    span = lambda a, s: F.struct(a.alias("aligned"), s.alias("supported"))
    spans = F.when(k == 0, F.array().cast("array<struct<aligned:boolean,supported:boolean>>")).otherwise(F.array(span(k > 1, k > 2), span(F.lit(False), k > 2)))
    return evaluation.grounding(table(spark, d, "orders").select(spans.alias("spans"))).select("n", "attached", "aligned", "supported", F.round("supported_ratio", 9).alias("supported_ratio"))


@query("gate_reasons", """with s as (select c_custkey as id, c_custkey % 4 as k, 0.9 + (c_nationkey % 11) / 100.0::double as f1 from customer)
select id, f1 >= 0.95 and k = 3 as approved, array_to_string(list_filter([case when k = 0 then 'NOT_TEST_SPLIT' end, case when f1 < 0.95 then 'F1_BELOW_MINIMUM' end, case when k = 1 then 'GROUNDING_BELOW_MINIMUM' end, case when k = 2 then 'UNSUPPORTED_EVIDENCE' end], lambda x: x is not null), ',') as reasons from s""")
def gate_reasons(spark, d):
    k = K("c_custkey") % 4
    slices = table(spark, d, "customer").select(K("c_custkey").alias("id"), F.when(k == 0, F.lit("dev")).otherwise("test").alias("split"), (0.9 + (K("c_nationkey") % 11) / 100).alias("f1"), F.when(k != 1, F.lit(1.0)).alias("grounding"), F.when(k == 2, F.lit(0.1)).otherwise(0.0).alias("unsupported"))
    return evaluation.gate_reasons(slices).select("id", "approved", F.array_join("reasons", ",").alias("reasons"))


@query("failure_reasons", "select 'reason ' || (o_orderkey % 6) as reason, count(*) as n from orders where o_orderkey % 4 <> 0 group by 1")
def failure_reasons(spark, d):
    k = K("o_orderkey")
    return evaluation.failure_reasons(table(spark, d, "orders").select(F.concat(F.lit("reason "), (k % 6).cast("string")).alias("reason"), (k % 4 == 0).alias("accepted")))


@query("chain_results", f"with {ITEMS} select o as chain_id, bool_and(p % 9 <> 0) as whole, count(*) as edges from items where o % 3 <> 0 group by 1")
def chain_results(spark, d):
    return evaluation.chain_results(_items(spark, d).select(F.when(K("o") % 3 != 0, K("o")).alias("chain_id"), F.lit(True).alias("truth"), (K("p") % 9 != 0).alias("predicted")))


# Curation


@query("ordered_hashes", """with r as (select o_orderpriority as split, sha256('{"a":' || o_custkey || ',"k":' || o_orderkey || '}') as h from orders) select split, 'sha256:' || sha256(string_agg(h, chr(10) order by h)) as content_hash from r group by 1""")
def ordered_hashes(spark, d):
    """Rows whose JSON has its keys in another order and blanks hash alike."""
    content = F.concat(F.lit('{ "k": '), K("o_orderkey").cast("string"), F.lit(', "a":'), K("o_custkey").cast("string"), F.lit("}"))
    return studio.ordered_hash(table(spark, d, "orders").select(K("o_orderpriority").alias("split"), content.alias("content")), ["split"], "content")


@query("decision_rules", f"""with {ITEMS}, c as (select o || ':' || r as record_id, p % 8 as k from items) select record_id, case when k = 0 then 'STATE_UNKNOWN' when k in (1, 2) then 'PAYLOAD_ON_NON_POSITIVE' when k = 3 then 'EXTRACTIVE_VALUE_MISSING' when k = 4 then 'EXTRACTIVE_EVIDENCE_MISSING' when k = 5 then 'LABEL_ONLY_HAS_VALUE' end as code from c where k < 6""")
def decision_rules(spark, d):
    k = K("p") % 8
    rows = _items(spark, d).select(F.concat_ws(":", K("o").cast("string"), K("r").cast("string")).alias("record_id"), F.lit("NOTE").alias("annotation_type"), F.when(k == 0, F.lit("MAYBE")).when(k.isin(1, 2), F.lit("NEGATIVE")).otherwise("POSITIVE").alias("state"), F.when(k.isin(5, 6), F.lit("LABEL_ONLY")).otherwise("EXTRACTIVE").alias("mode"), F.when(k.isin(1, 4, 5, 7), F.lit("v")).alias("value"), F.when(k.isin(2, 3, 7), F.array(F.lit("e"))).alias("evidence"))
    return studio.decision_rules(rows).select("record_id", "code")


@query("identity_conflicts", "select c_custkey as record_id, case c_custkey % 4 when 1 then 'a' when 2 then 'b' else 'a,b' end as changed from customer where c_custkey % 4 > 0 and c_custkey % 3 > 0")
def identity_conflicts(spark, d):
    k = K("c_custkey")
    old = table(spark, d, "customer").select(k.alias("record_id"), F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("free"))
    new = old.where("record_id % 3 > 0").select("record_id", F.when(K("record_id") % 4 % 2 == 1, F.lit(2)).otherwise(1).alias("a"), F.when(K("record_id") % 4 >= 2, F.lit("x")).alias("b"), F.lit(5).alias("free"))
    return studio.identity_conflicts(old, new, ["a", "b"]).select("record_id", F.array_join("changed", ",").alias("changed"))


@query("namespace_conflicts", "select c_nationkey::varchar as document_id, 'i' || c_custkey as id, case when c_custkey % 5 = 0 then 'ID_IN_SEVERAL_NAMESPACES' else 'ID_NOT_UNIQUE' end as code from customer where c_custkey % 5 < 2")
def namespace_conflicts(spark, d):
    rows = table(spark, d, "customer").select(K("c_nationkey").cast("string").alias("document_id"), F.concat(F.lit("i"), K("c_custkey").cast("string")).alias("id"), F.lit("element").alias("namespace"), (K("c_custkey") % 5).alias("k"))
    again = rows.where("k < 2").withColumn("namespace", F.when(K("k") == 0, F.lit("unit")).otherwise("element"))
    return studio.namespace_conflicts(rows.unionByName(again))


@query("accepted_submissions", f"with {ITEMS} select o as record_id, r::bigint as seq, coalesce(max((p % 6 = 0)::int) over (partition by o order by r rows unbounded preceding), 0) = 0 as accepted from items")
def accepted_submissions(spark, d):
    """Submissions that each expect the hash before them; some expect an old one, and all that build on those are stale."""
    h = lambda n: F.concat(F.lit("h"), n.cast("string"))
    rows = _items(spark, d).select(K("o").alias("record_id"), K("r").cast("long").alias("seq"), F.when(K("p") % 6 == 0, F.lit("old")).otherwise(h(K("r"))).alias("expected_hash"), h(K("r") + 1).alias("new_hash"), F.lit("h0").alias("initial_hash"))
    return library.accepted_submissions(rows)


# Page geometry


@query("block_texts", f"""with {ITEMS}, s as (select o, r, case when r > 0 and r % 2 = 0 then chr(10) else '' end || 's' || p as piece, 's' || p as text from items) select o as page, r as seq, sum(length(piece)) over (partition by o order by r rows unbounded preceding)::bigint as end_char, (sum(length(piece)) over (partition by o order by r rows unbounded preceding) - length(text))::bigint as start_char from s""")
def block_texts(spark, d):
    """Spans of a block, two in each line, with their place in the block's text."""
    rows = _items(spark, d).select(F.lit("d").alias("document_id"), K("o").alias("page"), F.lit("b").alias("block_id"), F.expr("r div 2").alias("line"), K("r").alias("seq"), F.concat(F.lit("s"), K("p").cast("string")).alias("text"))
    return geometry.block_text(rows).select("page", "seq", K("end_char").cast("long").alias("end_char"), K("start_char").cast("long").alias("start_char"))


@query("dominant_styles", f"""with {ITEMS}, s as (select o, p % 3 as font, length('t' || s) as n, r from items), g as (select o, font, sum(n) as w, min(r) as seen from s group by 1, 2) select o as page, 'f' || font as font_name from g qualify row_number() over (partition by o order by w desc, seen) = 1""")
def dominant_styles(spark, d):
    rows = _items(spark, d).select(K("o").alias("page"), F.concat(F.lit("f"), (K("p") % 3).cast("string")).alias("font_name"), F.lit(9.0).alias("font_size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.concat(F.lit("t"), K("s").cast("string")).alias("text"), K("r").alias("seq"))
    return geometry.dominant_style(rows, ["page"]).select("page", "font_name")


@query("aligned_rows", f"""with {ITEMS}, b as (select o, r, (p % 50) / 64.0::double as x, (s % 20) / 32.0::double as y from items) select a.o as page, a.r as a, b.r as b from b a join b b on a.o = b.o and b.x - (a.x + 0.0625) >= 0.01 and greatest(0, least(a.y, b.y) + 0.125 - greatest(a.y, b.y)) / 0.125 >= 0.5""")
def aligned_rows(spark, d):
    x, y = (K("p") % 50) / 64, (K("s") % 20) / 32
    rows = _items(spark, d).select(F.lit("d").alias("document_id"), K("o").alias("page"), K("r").alias("block_id"), x.alias("x0"), y.alias("y0"), (x + 0.0625).alias("x1"), (y + 0.125).alias("y1"))
    return geometry.aligned_rows(rows).select("page", "a", "b")


@query("native_pages", f"""with {ITEMS}, c as (select o, 1 + p % 4 as cells from items) select o as page, max(cells) as most, max(cells) >= 4 or count(*) filter (where cells >= 3) >= 3 or count(*) filter (where cells = 2) >= 6 as native from c group by 1""")
def native_pages(spark, d):
    return geometry.keeps_native_order(_items(spark, d).select(F.lit("d").alias("document_id"), K("o").alias("page"), (1 + K("p") % 4).alias("cells"))).select("page", "most", "native")


@query("leading_rows", f"""with {ITEMS} select o as page, case when o % 5 > 0 then sha256('head ' || o || '|' || 'x' || min(case when r = 0 then p end)) end as leading_row_fingerprint from items group by o""")
def leading_rows(spark, d):
    """Fingerprints of first rows whose texts differ in case and blanks only from the plain ones; some are blank."""
    blank = K("o") % 5 == 0
    texts = F.array(F.struct(F.lit(0).alias("col"), F.when(~blank, F.concat(F.lit("  HEAD \t"), K("o").cast("string"))).otherwise(F.lit(" ")).alias("text")), F.struct(F.lit(1).alias("col"), F.when(~blank, F.concat(F.lit("X"), K("p").cast("string"))).alias("text")))
    rows = _items(spark, d).select(F.lit("d").alias("document_id"), K("o").alias("page"), F.lit(0).alias("table_id"), K("r").alias("row"), F.explode(texts).alias("t")).select("document_id", "page", "table_id", "row", "t.*")
    return geometry.leading_row_fingerprint(rows).select("page", "leading_row_fingerprint")


@query("span_conservation", f"with {ITEMS} select o as page, r as span_id, case p % 9 when 0 then 'SPAN_LOST' when 1 then 'SPAN_TWICE' end as code from items where p % 9 < 2 union all select o, 1000 + r, 'SPAN_INVENTED' from items where p % 9 = 2")
def span_conservation(spark, d):
    rows = _items(spark, d).select(F.lit("d").alias("document_id"), K("o").alias("page"), K("r").alias("span_id"), (K("p") % 9).alias("k"))
    part = rows.where("k > 0")
    other = rows.where("k = 1").unionByName(rows.where("k = 2").withColumn("span_id", K("span_id") + 1000))
    return geometry.span_conservation(rows, part, other).select("page", "span_id", "code")


@query("contract_matches", f"""with {ITEMS}, c as (select o, r from items where r < 4) select (o % 30)::varchar as document_id, count(*) as matched from c where o % 4 > 0 group by 1""")
def contract_matches(spark, d):
    """Contracts and predictions of one shape, so that each finds a partner, but in every fourth order."""
    rows = _items(spark, d).where("r < 4").select((K("o") % 30).cast("string").alias("document_id"), K("o").alias("page"), F.lit(2).alias("n_rows"), F.lit(3).alias("n_cols"), F.concat_ws(":", K("o").cast("string"), K("r").cast("string")).alias("contract_id"))
    predicted = rows.where("page % 4 > 0").withColumn("table_id", F.concat(F.lit("t"), K("contract_id"))).drop("contract_id")
    return geometry.contract_matches(rows, predicted).groupBy("document_id").agg(F.count(F.lit(1)).alias("matched"))


@query("compared_values", "select o_orderkey as id, lower(o_orderpriority) as value from orders")
def compared_values(spark, d):
    """Values as they are compared: compatible forms, blanks and case do not count."""
    wide = F.translate("o_orderpriority", "ABCDEFGHIJKLMNOPQRSTUVWXYZ-", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ-")
    return table(spark, d, "orders").select(K("o_orderkey").alias("id"), T.folded(F.concat(F.lit(" \t"), wide, F.lit("　"))).alias("value"))


# Review payloads


@query("review_tasks", """with r as (select o_orderkey::varchar as id, 'b' || o_custkey % 5 as b, 'h' || o_orderstatus as h, case when o_orderkey % 3 > 0 then o_orderpriority end as t from orders),
c as (select *, '{"current_decisions":[],"document_id":"d","evaluated_types":["A","N"],"target_id":"' || id || '"}' as ctx from r)
select id as record_id, coalesce(t, '') as raw_text, 'sha256:' || sha256('{"batch_id":"' || b || '","context":"' || replace(ctx, '"', '\\"') || '","contract_version":"1","expected_decision_hash":"' || h || '","guideline_version":"g1","normalized_text":"' || lower(coalesce(t, '')) || '","raw_text":"' || coalesce(t, '') || '","record_id":"' || id || '"}') as task_hash from c""")
def review_tasks(spark, d):
    text = F.when(K("o_orderkey") % 3 > 0, K("o_orderpriority"))
    rows = table(spark, d, "orders").select(K("o_orderkey").cast("string").alias("record_id"), F.concat(F.lit("b"), (K("o_custkey") % 5).cast("string")).alias("batch_id"), F.lit("g1").alias("guideline_version"), F.concat(F.lit("h"), "o_orderstatus").alias("decision_hash"), F.lit("d").alias("document_id"), K("o_orderkey").cast("string").alias("target_id"), text.alias("raw_text"), F.lower(text).alias("normalized_text"), F.array(F.lit("N"), F.lit("A")).alias("evaluated_types"), F.array().cast("array<string>").alias("decisions"))
    return review.review_tasks(rows).select("record_id", "raw_text", "task_hash")


@query("review_submissions", """select o_orderkey as record_id, (['CONTRACT_UNSUPPORTED','GUIDELINE_NOT_TRIMMED','NOTES_INVALID','DECISIONS_NOT_JSON','DECISIONS_NOT_A_LIST','DECISION_INVALID','DECISION_INVALID',null,null])[o_orderkey % 9 + 1] as code, case when o_orderkey % 9 = 8 then 2 end as decisions from orders""")
def review_submissions(spark, d):
    """Responses of every shape that is refused, one without decisions and one with two."""
    k = K("o_orderkey") % 9
    decisions = _pick(k, "[]", "[]", "[]", "[1", "{}", '[{"state": "POSITIVE"}]', '[{"annotation_type": "NOTE", "state": "PERHAPS"}]', "  ", '[{"annotation_type": "NOTE", "state": "POSITIVE", "value": "v"}, {"annotation_type": "NOTE", "state": "NEGATIVE"}]')
    rows = table(spark, d, "orders").select(K("o_orderkey").alias("record_id"), F.when(k == 0, F.lit("0")).otherwise("1").alias("contract_version"), F.when(k == 1, F.lit(" g")).otherwise("g").alias("guideline_version"), F.lit("ACCEPTED").alias("outcome"), decisions.alias("decisions_json"), F.when(k == 2, F.lit(" ")).alias("notes"))
    return review.submissions(rows).select("record_id", "code", F.size("decisions").alias("decisions"))
