"""Queries of metadata changes, evaluation, curation records, page geometry and completion checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import completion, elements, evaluation, geometry, library, mutations, relations, semantics, studio
from .inputs import LINES, line_elements, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


# Metadata


def _files(spark, d):
    """Orders as files of an owner: every seventh is deleted, every fifth of these without a time."""
    gone = F.col("o_orderkey") % 7 == 0
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.when(gone, F.lit("DELETED")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.when(gone & (F.col("o_orderkey") % 5 != 0), F.expr("timestamp '2024-01-01 00:00:00'")).alias("deleted_at"), F.floor(F.col("o_totalprice") - 50000).cast("long").alias("size_bytes"), F.col("o_orderpriority").alias("media_type"),
    )


FILES = """f as (select o_orderkey as id, o_custkey as owner_id, case when o_orderkey % 7 = 0 then 'DELETED' else 'ACTIVE' end as status,
  case when o_orderkey % 7 = 0 and o_orderkey % 5 <> 0 then timestamp '2024-01-01 00:00:00' end as deleted_at, floor(o_totalprice - 50000)::bigint as size_bytes, o_orderpriority as media_type from orders)"""


@query("visible_files", f"with {FILES} select id, size_bytes from f where owner_id = 10 and deleted_at is null and status = 'ACTIVE'")
def visible_files(spark, d):
    return library.visible(_files(spark, d), 10).select("id", "size_bytes")


@query("status_violations", f"with {FILES} select id, status from f where (status = 'DELETED') <> (deleted_at is not null)")
def status_violations(spark, d):
    return library.status_violations(_files(spark, d)).select("id", "status")


@query("upload_violations", f"""with {FILES}, c as (select id, case when size_bytes <= 0 then 'SIZE_NOT_POSITIVE' when size_bytes > 200000 then 'TOO_LARGE' when media_type not in ('1-URGENT','2-HIGH') then 'MEDIA_TYPE_NOT_ALLOWED' end as code from f)
select id, code from c where code is not null""")
def upload_violations(spark, d):
    return library.upload_violations(_files(spark, d), 200_000, ("1-URGENT", "2-HIGH")).select("id", "code")


def _tagged(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 20).alias("tag_id"), (F.col("l_suppkey") % 3).alias("part"))


@query("soft_deleted_documents", f"with {FILES} select id, case when id % 11 = 0 then 'DELETED' else status end as status, case when id % 11 = 0 then coalesce(deleted_at, timestamp '2024-02-02 00:00:00') else deleted_at end as deleted_at from f")
def soft_deleted_documents(spark, d):
    files = _files(spark, d)
    marked, _ = library.soft_delete(files, _tagged(spark, d), files.where("id % 11 = 0"), F.expr("timestamp '2024-02-02 00:00:00'"))
    return marked.select("id", "status", "deleted_at")


@query("links_after_delete", "select l_orderkey as document_id, count(*) as links from lineitem where l_orderkey % 11 <> 0 group by 1")
def links_after_delete(spark, d):
    files = _files(spark, d)
    _, links = library.soft_delete(files, _tagged(spark, d), files.where("id % 11 = 0"), F.expr("timestamp '2024-02-02 00:00:00'"))
    return links.groupBy("document_id").agg(F.count(F.lit(1)).alias("links"))


@query("new_links", "with t as (select l_orderkey as document_id, l_partkey % 20 as tag_id, l_suppkey % 3 as part from lineitem) select distinct document_id, tag_id from t where part = 0 and (document_id, tag_id) not in (select (document_id, tag_id) from t where part = 1)")
def new_links(spark, d):
    tags = _tagged(spark, d)
    return library.new_links(tags.where("part = 0"), tags.where("part = 1")).select("document_id", "tag_id")


@query("foreign_links", "select l.l_orderkey as document_id, l.l_suppkey as owner_id from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_custkey = l.l_suppkey)")
def foreign_links(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("owner_id"))
    return library.owner_link_violations(links, _files(spark, d)).select("document_id", "owner_id")


@query("current_versions", "select c_custkey as id, o.o_orderkey as current_version_id, o.o_orderkey % 9 as version_no from customer c left join orders o on o.o_orderkey = c.c_custkey * 4")
def current_versions(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 4).alias("current_version_id"))
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).alias("version_no"), F.col("o_orderpriority").alias("media_type"))
    made = library.with_current_version(docs, versions)
    return made.select("id", F.when(F.col("media_type").isNotNull(), F.col("current_version_id")).alias("current_version_id"), "version_no")


@query("immutable_changes", """with h as (select o_custkey as id, o_orderkey as changed_at, o_orderstatus, o_orderpriority, lag(o_orderstatus) over w as s, lag(o_orderpriority) over w as p, row_number() over w as n from orders window w as (partition by o_custkey order by o_orderkey))
select id, changed_at, (o_orderstatus is distinct from s)::int + (o_orderpriority is distinct from p)::int as changes from h where n > 1 and (o_orderstatus is distinct from s or o_orderpriority is distinct from p)""")
def immutable_changes(spark, d):
    history = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("changed_at"), "o_orderstatus", "o_orderpriority")
    return library.immutability_violations(history, ("o_orderstatus", "o_orderpriority")).select("id", "changed_at", F.size("changed").alias("changes"))


CLAIMED = """c as (select event_id as id, (event_id % 6)::int as attempts, case when event_id % 4 = 0 then 'other' else 'me' end as claim_owner,
  case event_id % 5 when 0 then 'OK' when 1 then 'RETRY' when 2 then 'CONTRACT' when 3 then 'RETRY' end as outcome from events)"""


@query("settled_outbox", f"""with {CLAIMED}, m as (select *, claim_owner = 'me' and outcome is not null as mine from c),
s as (select *, case when outcome = 'OK' then 'PUBLISHED' when outcome = 'CONTRACT' or attempts >= 5 then 'FAILED' else 'PENDING' end as next from m)
select id, case when mine then next else 'PUBLISHING' end as status, case when mine and next = 'PENDING' then timestamp '2024-01-10 00:00:00' + to_seconds(least(300.0, 5.0 * power(2.0, least(attempts - 1, 30)))) else timestamp '2024-01-01 00:00:00' end as available_at,
  case when mine and next = 'PUBLISHED' then timestamp '2024-01-10 00:00:00' end as published_at, case when not mine then claim_owner end as claim_owner from s""")
def settled_outbox(spark, d):
    e = table(spark, d, "events")
    stamp = lambda x: F.expr(f"timestamp '{x}'")
    claimed = e.select(
        F.col("event_id").alias("id"), F.lit("PUBLISHING").alias("status"), (F.col("event_id") % 6).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 == 0, F.lit("other")).otherwise(F.lit("me")).alias("claim_owner"),
        stamp("2024-01-11 00:00:00").alias("claim_expires_at"), stamp("2024-01-01 00:00:00").alias("available_at"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("last_error_code"), F.lit(None).cast("timestamp").alias("last_error_at"),
    )
    outcome = F.element_at(F.array(*map(F.lit, ["OK", "RETRY", "CONTRACT", "RETRY"])), (F.col("event_id") % 5 + 1).cast("int"))
    results = e.where("event_id % 5 < 4").select(F.col("event_id").alias("id"), outcome.alias("outcome"))
    return library.settle(claimed, results, stamp("2024-01-10 00:00:00"), "me").select("id", "status", "available_at", "published_at", "claim_owner")


@query("event_contract", r"""with e as (select event_id, event_type, case when event_id % 9 = 0 then 2 else 1 end as schema_version, event_id % 7 as k, '00000000-0000-0000-0000-' || lpad(event_id::varchar, 12, '0') as u from events),
c as (select event_id, case when event_type not in ('click','view') then 'EVENT_TYPE_UNKNOWN' when schema_version <> 1 then 'SCHEMA_VERSION_UNSUPPORTED' when k = 1 then 'PAYLOAD_INVALID' when k = 2 then 'AGGREGATE_ID_INVALID' when k = 3 then 'VERSION_NOT_POSITIVE' when k = 4 then 'AGGREGATE_MISMATCH' end as code from e)
select event_id, code from c where code is not null""")
def event_contract(spark, d):
    k, u = F.col("event_id") % 7, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    aggregate = F.when(k == 2, F.lit("not-a-uuid")).otherwise(u)
    payload = F.when(k == 1, F.lit("{}")).otherwise(F.to_json(F.struct(aggregate.alias("aggregateId"), F.when(k == 3, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("versionNo"))))
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 9 == 0, F.lit(2)).otherwise(F.lit(1)).alias("schema_version"), payload.alias("payload"), F.when(k == 4, F.lit("elsewhere")).otherwise(u).alias("aggregate_id"))
    return library.event_errors(rows, ("click", "view")).select("event_id", "code")


@query("unreachable_folders", "select n_nationkey + 100 as id from nation where n_nationkey in (2, 7) union all select s_suppkey + 1000 from supplier where s_nationkey in (2, 7)")
def unreachable_folders(spark, d):
    n = F.col("n_nationkey")
    text = lambda c: c.cast("string")
    regions = table(spark, d, "region").select(text(F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    # Two nations are each other's parent.
    nations = table(spark, d, "nation").select(text(n + 100).alias("id"), text(F.when(n == 2, 107).when(n == 7, 102).otherwise(F.col("n_regionkey"))).alias("parent_id"))
    suppliers = table(spark, d, "supplier").select(text(F.col("s_suppkey") + 1000).alias("id"), text(F.col("s_nationkey") + 100).alias("parent_id"))
    return mutations.unreachable(regions.unionByName(nations).unionByName(suppliers)).select(F.col("id").cast("long").alias("id"))


# Evaluation


PAIRS = "pairs as (select doc_id, quality, toxic, case when quality = 1 then 'GOOD' else 'BAD' end as gold, case when toxic = 0 then 'GOOD' when doc_id % 9 > 0 then 'BAD' end as predicted from labels)"


def _pairs(spark, d):
    predicted = F.when(F.col("toxic") == 0, F.lit("GOOD")).when(F.col("doc_id") % 9 > 0, F.lit("BAD"))
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit("GOOD")).otherwise(F.lit("BAD")).alias("gold"), predicted.alias("predicted"))


@query("label_accuracy", f"with {PAIRS} select doc_id % 4 as part, sum((gold is not distinct from predicted)::int)::bigint as correct, count(*) as total, sum((gold is not distinct from predicted)::int)::double / count(*) as accuracy from pairs group by 1")
def label_accuracy(spark, d):
    return evaluation.accuracy(_pairs(spark, d).withColumn("part", F.col("doc_id") % 4), ["part"])


@query("label_macro_f1", f"""with {PAIRS}, l as (select gold, predicted, unnest(list_distinct(list_filter([gold, predicted], lambda x: x is not null))) as label from pairs),
c as (select label, sum((gold = label and coalesce(predicted = label, false))::int) as tp, sum((gold <> label and coalesce(predicted = label, false))::int) as fp, sum((gold = label and not coalesce(predicted = label, false))::int) as fn from l group by 1),
f as (select *, case when tp = 0 then 0.0::double else 2.0::double * (tp / (tp + fp)::double) * (tp / (tp + fn)::double) / ((tp / (tp + fp)::double) + (tp / (tp + fn)::double)) end as f1 from c) select round(avg(f1) filter (where tp + fn > 0), 9) as macro_f1 from f""")
def label_macro_f1(spark, d):
    return M.macro_f1(evaluation.label_scores(_pairs(spark, d))).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("heading_levels", f"with {LINES}, h as (select heading_level as g, (1 + (doc_id + ord) % 2)::int as p from (select *, split_part(element_id, ':', 1)::bigint as doc_id from el) where type = 'HEADING') select sum((g = p)::int)::bigint as correct, count(*) as total, sum((g = p)::int)::double / count(*) as accuracy from h")
def heading_levels(spark, d):
    rows = line_elements(spark, d)
    predicted = (1 + (F.col("document_id").cast("long") + F.col("ord")) % 2).cast("int")
    return evaluation.heading_levels(rows.select(F.col("type").alias("gold"), F.col("type").alias("predicted"), F.col("heading_level").alias("gold_level"), predicted.alias("predicted_level")))


@query("co_member_scores", """with g as (select l_suppkey % 5 as document_id, l_orderkey % 40 as unit_id, l_orderkey || ':' || l_linenumber as e from lineitem), p as (select document_id, e, split_part(e, ':', 1)::bigint % 60 as unit_id from g),
n as (select (select sum(c * (c - 1) // 2) from (select count(*) as c from g group by document_id, unit_id)) as gold, (select sum(c * (c - 1) // 2) from (select count(*) as c from p group by document_id, unit_id)) as pred,
  (select sum(c * (c - 1) // 2) from (select count(*) as c from g join p using (document_id, e) group by document_id, g.unit_id, p.unit_id)) as tp)
select tp::bigint as tp, (pred - tp)::bigint as fp, (gold - tp)::bigint as fn from n""")
def co_member_scores(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("document_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("element_id"), "l_orderkey")
    side = lambda k: rows.select("document_id", (F.col("l_orderkey") % k).alias("unit_id"), "element_id")
    return evaluation.co_member_scores(side(40), side(60)).select("tp", "fp", "fn")


@query("diagnostics_recall", """with o as (select user_id as document_id, event_type as code, count(*) as seen from events group by 1, 2), x as (select distinct user_id as document_id, 'click' as code, 12 as min_count from events where user_id % 2 = 0 union all select distinct user_id, 'crash', 1 from events where user_id % 3 = 0)
select x.document_id, x.code, min_count, coalesce(seen, 0)::bigint as seen, case when coalesce(seen, 0) >= min_count then 'MET' else 'MISSED' end as status from x left join o using (document_id, code)
union all select document_id, code, 0, seen, 'UNEXPECTED' from o where not exists (select 1 from x where x.document_id = o.document_id and x.code = o.code)""")
def diagnostics_recall(spark, d):
    seen = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("code"))
    some = lambda k, code, n: seen.where(F.col("document_id") % k == 0).select("document_id").distinct().select("document_id", F.lit(code).alias("code"), F.lit(n).alias("min_count"))
    return evaluation.diagnostics_recall(some(2, "click", 12).unionByName(some(3, "crash", 1)), seen)


@query("structure_signatures", "select conv_id as group_id, string_agg(distinct role, '|' order by role) as signature from conversations group by 1")
def structure_signatures(spark, d):
    return evaluation.signature(table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("role").alias("token")), ["group_id"])


@query("scoped_relations", "with t as (select l_orderkey as id, l_returnflag as type, l_suppkey % 3 as source_kind, l_partkey % 5 as target_kind from lineitem) select * from t where (type, source_kind, target_kind) in (select (type, source_kind, target_kind) from t where id < 40)")
def scoped_relations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("type"), (F.col("l_suppkey") % 3).alias("source_kind"), (F.col("l_partkey") % 5).alias("target_kind"))
    return evaluation.scoped(rows, rows.where("id < 40")).select("id", "type", "source_kind", "target_kind")


# Curation records


@query("positive_decisions", "select o_orderkey as record_id, 0 as pos, o_orderstatus as type, o_orderpriority as value from orders where o_orderkey % 3 = 0 union all select o_orderkey, 1, 'NOTE', null from orders where o_orderkey % 3 <> 1")
def positive_decisions(spark, d):
    made = lambda positive, kind, value: F.struct(F.when(positive, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("state"), kind.alias("annotation_type"), value.alias("value"), F.array(F.struct(F.lit("e").alias("element_id"), F.lit(0).alias("start_char"), F.lit(1).alias("end_char"), F.lit("q").alias("quoted_text"))).alias("evidence"))
    k = F.col("o_orderkey")
    records = table(spark, d, "orders").select(k.alias("record_id"), F.lit("d").alias("document_id"), F.array(made(k % 3 == 0, F.col("o_orderstatus"), F.col("o_orderpriority")), made(k % 3 != 1, F.lit("NOTE"), F.lit(None).cast("string"))).alias("decisions"))
    known = spark.createDataFrame([("d", "e", 0)], "document_id string, element_id string, ord int")
    return studio.positives(records, known).where("size(evidence) = 1").select("record_id", "pos", "type", "value")


@query("undecided_states", "select o_orderkey as record_id, case when o_orderkey % 5 = 0 then 'UNDECIDED_STATE' else 'UNKNOWN_STATE' end as code from orders where o_orderkey % 5 in (0, 1)")
def undecided_states(spark, d):
    state = F.when(F.col("o_orderkey") % 5 == 0, F.lit("UNDECIDED")).when(F.col("o_orderkey") % 5 == 1, F.lit("MAYBE")).otherwise(F.lit("POSITIVE"))
    return studio.undecided(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.array(F.struct(state.alias("state"))).alias("decisions"))).select("record_id", "code")


@query("inferred_batches", """with b as (select o_custkey as batch_id, count(*) as n, count(distinct o_orderstatus) as g, count(distinct o_orderpriority) as t, min(o_orderstatus) as gv, min('T' || o_orderpriority) as tv from orders group by 1)
select batch_id, n, case when g = 1 and t = 1 then gv end as guideline_version, case when g = 1 and t = 1 then tv end as evaluated_types, case when g <> 1 then 'BATCH_GUIDELINE_CONFLICT' when t <> 1 then 'BATCH_TYPES_CONFLICT' end as code from b""")
def inferred_batches(spark, d):
    return studio.infer_batches(table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderstatus").alias("guideline_version"), F.array(F.concat(F.lit("T"), F.col("o_orderpriority"))).alias("evaluated_types")))


@query("review_guideline_mismatches", "select o_orderkey as record_id, 'REVIEW_GUIDELINE_MISMATCH' as code from orders where o_orderkey % 4 <> 0 and o_orderstatus <> 'O'")
def review_guideline_mismatches(spark, d):
    review = lambda c: F.struct(c.alias("guideline_version"))
    reviews = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<struct<guideline_version:string>>")).otherwise(F.array(review(F.lit("X")), review(F.col("o_orderstatus"))))
    return studio.review_guidelines(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), reviews.alias("reviews"), F.lit("O").alias("guideline_version"))).select("record_id", "code")


@query("distinct_reviews", "select user_id as record_id, event_type as outcome, count(distinct (round(value), ts::date)) as n from events group by 1, 2")
def distinct_reviews(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("record_id"), F.lit("r").alias("reviewer_id"), F.to_date("ts").alias("reviewed_at"), F.col("event_type").alias("outcome"), F.round("value").alias("decision_hash_before"), F.lit("h").alias("decision_hash_after"))
    return studio.distinct_reviews(rows).groupBy("record_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _texts(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select(F.col("conv_id").alias("document_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("element_id"), F.col("turn").alias("ord"), F.when(F.col("turn") % 3 != 1, F.col("text")).alias("raw_text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("n:"), F.col("text"))).alias("normalized_text"))


SNAPSHOTS = "sn as (select conv_id as target_id, string_agg(case when turn % 3 <> 1 then text end, chr(10) || chr(10) order by turn) as raw_text, string_agg(case when turn % 2 = 0 then 'n:' || text end, chr(10) || chr(10) order by turn) as normalized_text from conversations group by 1)"


@query("target_snapshots", f"with {SNAPSHOTS} select target_id, md5(raw_text) as raw_md5, length(normalized_text)::int as normalized_chars from sn")
def target_snapshots(spark, d):
    rows = _texts(spark, d)
    targets = rows.groupBy(F.col("document_id").alias("target_id"), "document_id").agg(F.collect_list("element_id").alias("element_ids"))
    return studio.target_snapshot(targets, rows).select("target_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"), F.length("normalized_text").alias("normalized_chars"))


@query("snapshot_mismatches", f"""with {SNAPSHOTS}, r as (select c_custkey as record_id, case when c_custkey % 5 = 0 then 'other' else raw_text end as r, case when c_custkey % 5 = 1 then 'other' else normalized_text end as n, raw_text, normalized_text, target_id from customer left join sn on target_id = c_custkey),
c as (select record_id, case when target_id is null then 'TARGET_UNRESOLVED' when r is distinct from raw_text then 'TARGET_RAW_TEXT_MISMATCH' when n is distinct from normalized_text then 'TARGET_NORMALIZED_TEXT_MISMATCH' end as code from r) select record_id, code from c where code is not null""")
def snapshot_mismatches(spark, d):
    rows = _texts(spark, d)
    now = studio.target_snapshot(rows.groupBy(F.col("document_id").alias("target_id"), "document_id").agg(F.collect_list("element_id").alias("element_ids")), rows)
    k = F.col("record_id")
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_custkey").alias("target_id")).join(now.drop("document_id"), "target_id", "left")
    records = records.withColumns({"raw_text": F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("raw_text")), "normalized_text": F.when(k % 5 == 1, F.lit("other")).otherwise(F.col("normalized_text"))})
    return studio.snapshot_issues(records, now).select("record_id", "code")


@query("resolved_targets", "select c_custkey as document_id, case when c_custkey % 3 = 0 then 'ELEMENT' when c_custkey % 3 = 1 then 'LOGICAL_UNIT' end as target_kind, case c_custkey % 3 when 0 then 1 when 1 then 2 end::int as members, case when c_custkey % 3 = 2 then 'TARGET_UNKNOWN' end as code from customer")
def resolved_targets(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    targets = docs.select("document_id", F.element_at(F.array(*map(F.lit, ["e", "u", "x"])), (F.col("document_id") % 3 + 1).cast("int")).alias("target_id"))
    made = studio.resolve_targets(targets, docs.select("document_id", F.lit("e").alias("element_id")), docs.select("document_id", F.lit("u").alias("unit_id"), F.array(F.lit("e"), F.lit("f")).alias("element_ids"), F.lit("LIST").alias("unit_type")))
    return made.select("document_id", "target_kind", F.when(F.col("element_ids").isNotNull(), F.size("element_ids")).alias("members"), "code")


@query("source_disagreements", """with a as (select o_custkey as document_id, count(distinct o_orderpriority) as c, count(distinct o_orderstatus) as s, count(distinct o_orderdate) as l from orders group by 1),
x as (select document_id, case when c > 1 then 'CONTENT_HASH_CONFLICT' when s > 1 then 'SNAPSHOT_CONFLICT' when l > 1 then 'LANGUAGE_CONFLICT' end as code from a) select document_id, code from x where code is not null""")
def source_disagreements(spark, d):
    return studio.source_agreement(table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("content_hash"), F.col("o_orderstatus").alias("element_snapshot_hash"), F.col("o_orderdate").alias("language"))).select("document_id", "code")


# Page geometry, on boxes made of line items


def _boxes(spark, d):
    """A page for each order: line items as boxes of 4 x 3 units at places given by their keys; sums stay exact in binary."""
    x, y = (F.col("l_partkey") % 37).cast("double"), (F.col("l_suppkey") % 23).cast("double")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("document_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("box_id"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 3).alias("y1"), F.col("l_linenumber").cast("int").alias("paint_seq"))


BOXES = "bx as (select l_orderkey % 50 as document_id, l_orderkey as page, l_linenumber::int as box_id, (l_partkey % 37)::double as x0, (l_suppkey % 23)::double as y0, (l_partkey % 37 + 4)::double as x1, (l_suppkey % 23 + 3)::double as y1 from lineitem)"
SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 12.0::double"


@query("normalised_boxes", f"""with {BOXES}, c as (select *, case when x1 > 33 or y1 > 21 then 'BOX_OUTSIDE_PAGE' end as code from bx)
select page, box_id, code, case when code is null then least(x0, 32.0) / 32.0::double end as x0, case when code is null then least(y1, 20.0) / 20.0::double end as y1 from c""")
def normalised_boxes(spark, d):
    made = geometry.normalise_boxes(_boxes(spark, d).withColumns({"width": F.lit(32.0), "height": F.lit(20.0)}))
    return made.select("page", "box_id", "code", "x0", "y1")


@query("hidden_blocks", f"with {BOXES} select a.page, a.box_id as block_id, max({SHARED}) as coverage from bx a join bx b on a.document_id = b.document_id and a.page = b.page and b.box_id > a.box_id and b.box_id % 2 = 0 and {SHARED} >= 0.25 group by 1, 2")
def hidden_blocks(spark, d):
    rows = _boxes(spark, d)
    fills = rows.withColumns({"kind": F.lit("fill"), "axis_aligned": F.col("box_id") % 2 == 0, "opacity": F.lit(None).cast("double")}).withColumnRenamed("box_id", "fill_id")
    return geometry.hidden_blocks(rows.withColumnRenamed("box_id", "block_id"), geometry.opaque_fills(fills), 0.25).select("page", "block_id", "coverage")


@query("span_owners", f"""with {BOXES}, p as (select a.page, a.box_id as span_id, b.box_id as cell_id, {SHARED} as share, ((a.x0 + a.x1) / 2 >= b.x0 and (a.x0 + a.x1) / 2 < b.x1 and (a.y0 + a.y1) / 2 >= b.y0 and (a.y0 + a.y1) / 2 < b.y1)::int as centred
  from bx a join bx b on a.document_id = b.document_id and a.page = b.page where a.box_id % 2 = 0 and b.box_id % 2 = 1 and {SHARED} > 0),
g as (select page, span_id, arg_max(cell_id, (share, cell_id)) as cell_id, max(share) as share, sum(centred) as centres from p group by 1, 2),
m as (select a.page, a.box_id as span_id, g.cell_id, case when g.cell_id is null then 'NO_CELL' when share < 0.5 then 'OVERLAP_TOO_SMALL' when centres > 1 then 'CENTRE_NOT_UNIQUE' end as code from bx a left join g on g.page = a.page and g.span_id = a.box_id where a.box_id % 2 = 0)
select page, span_id, case when code is null then cell_id end as cell_id, code from m""")
def span_owners(spark, d):
    rows = _boxes(spark, d)
    return geometry.span_owners(rows.where("box_id % 2 = 0").withColumnRenamed("box_id", "span_id"), rows.where("box_id % 2 = 1").withColumnRenamed("box_id", "cell_id")).select("page", "span_id", "cell_id", "code")


@query("boundary_support", f"""with {BOXES}, r as (select page, x0, x1, max(x1) over (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding) as reached from bx),
c as (select page, sum(greatest(0.0, x1 - greatest(x0, coalesce(reached, x0)))) as covered from r group by 1) select page, covered / 41.0::double as support from c""")
def boundary_support(spark, d):
    rows = _boxes(spark, d)
    strokes = rows.select("page", F.col("x0").alias("start"), F.col("x1").alias("stop"))
    return geometry.support_ratio(strokes, rows.select("page").distinct().withColumn("length", F.lit(41.0)), ["page"]).select("page", "support")


@query("boundary_clusters", f"""with {BOXES}, f as (select page, x0, coalesce(x0 - lag(x0) over (partition by page order by x0) > 3, false)::int as fresh from bx), c as (select page, x0, sum(fresh) over (partition by page order by x0, fresh desc rows unbounded preceding) as cluster from f)
select page, cluster::bigint as cluster, round(avg(x0), 6) as mean, count(*) as n from c group by 1, 2""")
def boundary_clusters(spark, d):
    made = geometry.cluster_values(_boxes(spark, d).select("page", F.col("x0").alias("value")), ["page"], 3.0)
    return made.select("page", F.col("cluster").cast("long").alias("cluster"), F.round("mean", 6).alias("mean"), "n")


@query("ruled_pages", "with s as (select l_orderkey as page, (l_linenumber % 2 = 0)::int as flat, (l_linenumber % 2 = 1 and l_linenumber <> 7)::int as tall from lineitem) select page, sum(flat)::bigint as horizontal, sum(tall)::bigint as vertical, sum(flat) >= 2 and sum(tall) >= 2 as ruled from s group by 1")
def ruled_pages(spark, d):
    n = F.col("l_linenumber")
    strokes = table(spark, d, "lineitem").select(F.lit(1).alias("document_id"), F.col("l_orderkey").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when((n % 2 == 0) | (n == 7), F.lit(9.0)).otherwise(F.lit(0.5)).alias("x1"), F.when((n % 2 == 1) | (n == 7), F.lit(9.0)).otherwise(F.lit(0.5)).alias("y1"))
    return geometry.rectilinear(strokes, least=2).select("page", "horizontal", "vertical", "ruled")


@query("simple_grids", f"""with {BOXES}, k as (select page, box_id % 2 as "row", box_id // 2 as col, x0, x1, y0, y1 from bx), r as (select page, max(d) as rs from (select page, "row", greatest(max(y0) - min(y0), max(y1) - min(y1)) as d from k group by 1, 2) group by 1),
c as (select page, max(d) as cs from (select page, col, greatest(max(x0) - min(x0), max(x1) - min(x1)) as d from k group by 1, 2) group by 1) select page, rs as row_spread, cs as col_spread, rs <= 8 and cs <= 8 as simple from r join c using (page)""")
def simple_grids(spark, d):
    cells = _boxes(spark, d).withColumns({"row": F.col("box_id") % 2, "col": F.floor(F.col("box_id") / 2), "table_id": F.lit(0)})
    return geometry.simple_topology(cells, 8.0).select("page", "row_spread", "col_spread", "simple")


# Relations, completion and annotations


@query("footnotes", "select 'n' || o_orderkey as source_id, 'e' || o_orderkey as target_id from orders where o_orderkey % 3 < 2")
def footnotes(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, F.lit("footnote")).when(k % 3 == 1, F.lit("endnote")).otherwise(F.lit("comment"))
    ref = F.struct(kind.alias("kind"), k.cast("string").alias("id"))
    o = table(spark, d, "orders")
    none = "struct<kind:string,id:string>"
    notes = o.select((k % 10).alias("document_id"), F.concat(F.lit("n"), k.cast("string")).alias("element_id"), ref.alias("source_anchor"), F.array().cast(f"array<{none}>").alias("source_references"))
    texts = o.select((k % 10).alias("document_id"), F.concat(F.lit("e"), k.cast("string")).alias("element_id"), F.lit(None).cast(none).alias("source_anchor"), F.array(ref, ref).alias("source_references"))
    return relations.footnote_edges(notes.unionByName(texts)).select("source_id", "target_id")


@query("unit_subdocuments", """with e as (select event_id // 3 as unit_id, (event_id + (event_id % 50 = 0)::int * 9) // 9 as sub from events), m as (select unit_id, count(*) as n, count(*) filter (where sub % 4 < 3) as m, count(distinct sub) filter (where sub % 4 < 3) as k, min(sub) filter (where sub % 4 < 3) as s from e group by 1)
select unit_id, case when k = 1 and m = n then s end as subdocument_id, case when k > 0 and not (k = 1 and m = n) then 'UNIT_CROSSES_SUBDOCUMENTS' end as code from m""")
def unit_subdocuments(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.lit(1).alias("document_id"), F.expr("event_id div 3").alias("unit_id"), ((k + (k % 50 == 0).cast("int") * 9) / 9).cast("long").alias("subdocument_id"), k.cast("string").alias("element_id"), F.lit(1.0).alias("confidence"))
    units = rows.groupBy("document_id", "unit_id", "confidence").agg(F.collect_list("element_id").alias("element_ids"))
    subs = rows.where("subdocument_id % 4 < 3").groupBy("document_id", "subdocument_id", "confidence").agg(F.collect_list("element_id").alias("element_ids"))
    return relations.unit_subdocument(units, subs).select("unit_id", "subdocument_id", "code")


@query("stage_disagreements", "with a as (select conv_id as d, count(*) as n from conversations group by 1), b as (select conv_id as d, max(turn) + 1 + (conv_id % 5 = 0)::int as n from conversations group by 1) select d as document_id, a.n as found, b.n as normalised from a join b using (d) where a.n <> b.n")
def stage_disagreements(spark, d):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("document_id"))
    found = rows.agg(F.count(F.lit(1)).alias("element_count"))
    normalised = rows.agg(F.max("turn").alias("t")).select("document_id", (F.col("t") + 1 + (F.col("document_id") % 5 == 0).cast("int")).alias("element_count"))
    return completion.stage_counts(found=found, normalised=normalised).select("document_id", F.col("counts")["found"].alias("found"), F.col("counts")["normalised"].alias("normalised"))


@query("changed_tables", "select 'orders' as \"table\", 2 * count(*) as n from orders where o_orderkey % 100 = 1")
def changed_tables(spark, d):
    orders, nation = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "nation")
    after = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 1, F.lit("Z")).otherwise(F.col("o_orderstatus")))
    return completion.only_annotations_added({"orders": orders, "nation": nation, "annotations": nation}, {"orders": after, "nation": nation, "annotations": nation.limit(1)})


@query("semantic_coverage", "select user_id as document_id, count(distinct event_id % 50) as targets, round(avg(value), 3) as mean_confidence, count(*) as annotations, string_agg(distinct event_type, ',' order by event_type) as types from events group by 1")
def semantic_coverage(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), (F.col("event_id") % 50).alias("target_id"), F.col("value").alias("confidence"), F.col("event_type").alias("type"))
    return completion.semantic_coverage(rows).select("document_id", "targets", F.round("mean_confidence", 3).alias("mean_confidence"), "annotations", F.array_join("types", ",").alias("types"))


@query("merged_metrics", "with a as (select c_custkey as d, c_nationkey % 3 as v from customer where c_custkey % 4 <> 0), b as (select c_custkey as d, c_nationkey % 2 as v from customer where c_custkey % 4 <> 1) select coalesce(a.d, b.d) as document_id, coalesce(a.v, b.v) as value, coalesce(a.v <> b.v, false) as conflict from a full join b on a.d = b.d")
def merged_metrics(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("m").alias("metric"), "c_nationkey")
    part = lambda k, m: rows.where(F.col("document_id") % 4 != k).select("document_id", "metric", (F.col("c_nationkey") % m).alias("value"))
    return completion.merge_metrics(part(0, 3), part(1, 2)).select("document_id", "value", "conflict")


@query("document_violations", """with e as (select user_id as d, event_id as id from events), twice as (select d, id from (select d, id from e union all select d, id from e where id % 97 = 0) group by 1, 2 having count(*) > 1)
select d as document_id, id::varchar as id, 'ID_NOT_UNIQUE' as code from twice union all select d, min(id)::varchar, 'ORDER_NOT_UNIQUE' from (select d, id from e union all select d, id from e where id % 97 = 0) group by d, id having count(*) > 1
union all select user_id, 'u' || event_id, 'UNIT_MEMBER_UNKNOWN' from events where event_id % 53 = 0 union all select user_id, 'c' || event_id, 'CONTEXT_PARENT_UNKNOWN' from events where event_id % 31 = 0""")
def document_violations(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").cast("string").alias("element_id"), F.col("event_id").alias("ord"))
    rows = e.unionByName(e.where("ord % 97 = 0"))
    units = e.where("ord % 53 = 0").select("document_id", F.concat(F.lit("u"), "element_id").alias("unit_id"), F.array(F.lit("gone")).alias("element_ids"))
    nodes = e.where("ord % 31 = 0").select("document_id", F.concat(F.lit("c"), "element_id").alias("node_id"), F.lit("gone").alias("parent_id"))
    regions = units.where("false").select("document_id", F.col("unit_id").alias("region_id"), "element_ids")
    edges = units.where("false").select("document_id", F.col("unit_id").alias("relation_id"), F.col("unit_id").alias("source_id"), F.col("unit_id").alias("target_id"))
    return completion.document_violations(rows, units, nodes, regions, edges)


ROLES = "[('Definition:', 'DEFINITION', 0.94), ('For example:', 'EXAMPLE', 0.93), ('WARNING:', 'WARNING', 0.96), ('lưu ý:', 'NOTE', 0.91), ('Exercise:', 'EXERCISE', 0.95), ('tóm tắt:', 'SUMMARY', 0.95), ('steps:', 'PROCEDURE', 0.92), ('Key points:', 'KEY_POINT', 0.93), ('learning objectives:', 'LEARNING_OBJECTIVE', 0.96), ('Theorem:', 'THEOREM', 0.97), ('Chứng minh:', 'PROOF', 0.97), ('Notice:', null, null), ('Note', null, null)]"


@query("marker_roles", f"""with r as (select conv_id as document_id, turn as ord, text, {ROLES}[(conv_id + turn) % 13 + 1] as m from conversations)
select document_id, ord, m[2] as type, m[3]::double as confidence, (length(m[1]) + 4)::bigint as start_char, (length(m[1]) + 4 + length(text))::bigint as end_char from r where m[2] is not null and length(text) > 0""")
def marker_roles(spark, d):
    marks = ["Definition:", "For example:", "WARNING:", "lưu ý:", "Exercise:", "tóm tắt:", "steps:", "Key points:", "learning objectives:", "Theorem:", "Chứng minh:", "Notice:", "Note"]
    mark = F.element_at(F.array(*map(F.lit, marks)), ((F.col("conv_id") + F.col("turn")) % 13 + 1).cast("int"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("element_id"), F.concat(F.lit(" "), mark, F.lit(" - "), F.col("text")).alias("text"))
    return semantics.marker_annotations(rows).select("document_id", "ord", "type", "confidence", "start_char", "end_char")


@query("suspicious_characters", "select doc_id, case when doc_id % 3 = 0 then 2 else 0 end as found from documents")
def suspicious_characters(spark, d):
    plain = F.regexp_replace("text", "[^\\x20-\\x7e]", " ")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(plain, F.lit("\N{REPLACEMENT CHARACTER}\x07"))).otherwise(plain)
    return table(spark, d, "documents").select("doc_id", F.size(elements.suspicious_characters(text)).alias("found"))
