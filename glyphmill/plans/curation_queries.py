"""Queries of evaluation, curation, metadata and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import evaluation, library, semantics, studio
from ..streaming import outbox as stream
from .inputs import LINES, line_elements, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


NOW = "timestamp '2024-01-10 00:00:00'"


def _records(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").cast("string").alias("document_id"), T.content_hash(F.col("text")).alias("content_hash"), F.col("source").alias("source_family_id"), F.concat(F.lit("g"), (F.col("doc_id") % 10).cast("string")).alias("split_group_id"), F.lit("ELEMENT").alias("target_kind"), F.array(F.lit(0)).alias("element_orders"))


def _splits(spark):
    return spark.createDataFrame([(f"g{i}", "test" if i == 9 else "dev" if i == 8 else "train") for i in range(9)] + [("g99", "dev")], "split_group_id string, split string")


RECORDS = """rec as (select doc_id::varchar as id, 'sha256:' || sha256(text) as content_hash, source, 'g' || (doc_id % 10) as grp from documents),
asg as (select * from (values ('g0','train'),('g1','train'),('g2','train'),('g3','train'),('g4','train'),('g5','train'),('g6','train'),('g7','train'),('g8','dev'),('g99','dev')) t(grp, split)),
rs as (select r.*, a.split from rec r left join asg a using (grp))"""


@query("duplicate_content", "select 'sha256:' || sha256(text) as content_hash, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1")
def duplicate_content(spark, d):
    return table(spark, d, "documents").groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("split_leakage", f"""with {RECORDS}, x as (select source as identity, count(distinct grp) as g, count(distinct split) as s, 'SOURCE_FAMILY' as c from rs group by source union all select content_hash, count(distinct grp), count(distinct split), 'CONTENT_HASH' from rs group by content_hash union all select id, count(distinct grp), count(distinct split), 'DOCUMENT' from rs group by id)
select identity, c || '_CROSSES_GROUPS' as code from x where g > 1 union all select identity, c || '_CROSSES_SPLITS' from x where s > 1
union all select content_hash || '|ELEMENT|0', case when count(distinct split) > 1 then 'SOURCE_TARGET_CROSSES_SPLITS' else 'SOURCE_TARGET_DUPLICATE' end from rs group by content_hash having count(*) > 1
union all select distinct grp, 'GROUP_UNASSIGNED' from rs where split is null union all select grp, 'GROUP_UNUSED' from asg where grp not in (select grp from rec)""")
def split_leakage(spark, d):
    return studio.split_leakage(_records(spark, d), _splits(spark))


@query("training_leakage", "with e as (select doc_id, source, case when doc_id % 10 = 9 then 'test' else 'train' end as split, case when doc_id % 20 = 9 then 'MODEL' else 'HUMAN' end as ls, 'sha256:' || sha256(text) as h from documents) select doc_id::varchar as identity, 'TEST_LABEL_NOT_HUMAN' as code from e where split = 'test' and ls <> 'HUMAN' union all select h, 'CONTENT_HASH_CROSSES_SPLITS' from e group by h having count(distinct split) > 1 union all select source, 'SOURCE_FAMILY_ID_CROSSES_SPLITS' from e group by source having count(distinct split) > 1")
def training_leakage(spark, d):
    rows = _records(spark, d).withColumns({"example_id": F.col("record_id"), "split": F.when(F.col("record_id").cast("long") % 10 == 9, F.lit("test")).otherwise(F.lit("train")), "label_source": F.when(F.col("record_id").cast("long") % 20 == 9, F.lit("MODEL")).otherwise(F.lit("HUMAN"))})
    return studio.training_leakage(rows, ("content_hash", "source_family_id"))


@query("batch_expected_actual", """with de as (select 'b' || (doc_id % 4) as batch_id, doc_id as record_id from labels union all select 'b0', 0), ac as (select 'b' || (doc_id % 4) as batch_id, doc_id as record_id from documents where doc_id % 3 <> 0)
select distinct batch_id, record_id, 'BATCH_RECORD_MISSING' as code from de d where not exists (select 1 from ac a where a.batch_id = d.batch_id and a.record_id = d.record_id)
union all select distinct batch_id, record_id, 'BATCH_RECORD_UNEXPECTED' from ac a where not exists (select 1 from de d where a.batch_id = d.batch_id and a.record_id = d.record_id)
union all select batch_id, record_id, 'BATCH_RECORD_DUPLICATE' from de group by all having count(*) > 1""")
def batch_expected_actual(spark, d):
    key = F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("batch_id")
    declared = table(spark, d, "labels").select(key, F.col("doc_id").alias("record_id")).unionByName(spark.createDataFrame([("b0", 0)], "batch_id string, record_id long"))
    actual = table(spark, d, "documents").where("doc_id % 3 != 0").select(key, F.col("doc_id").alias("record_id"))
    return studio.batch_membership(declared, actual)


def _decided(spark, d):
    state = F.when(F.col("toxic") == 1, F.lit("UNDECIDED")).when(F.col("quality") == 1, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE"))
    decision = F.struct(state.alias("state"), F.when(F.col("doc_id") % 7 == 0, F.lit("LOW")).otherwise(F.lit("HIGH")).alias("confidence"), F.when(F.col("doc_id") % 5 == 0, F.lit("GENERATIVE")).otherwise(F.lit("LABEL_ONLY")).alias("mode"), F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r1"))).alias("rule_keys"))
    return table(spark, d, "labels").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, F.lit("REVIEW_REQUIRED")).otherwise(F.lit("PASS")).alias("status"), F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("reviews"), F.array(decision).alias("decisions"))


@query("eligibility_reasons", """select doc_id as record_id, concat_ws(',', case when doc_id % 3 = 0 then 'STATUS_NOT_PASS' end, case when doc_id % 13 = 0 then 'REVIEW_MISSING' end, case when toxic = 1 then 'UNDECIDED_DECISION' end, case when doc_id % 7 = 0 then 'CONFIDENCE_TOO_LOW' end, case when doc_id % 11 = 0 then 'RULE_KEYS_MISSING' end,
 case when coalesce(toxic, 0) <> 1 and quality = 1 and doc_id % 5 = 0 then 'PAYLOAD_MODE_UNSUPPORTED' end) as reasons from labels""")
def eligibility_reasons(spark, d):
    return studio.eligibility(_decided(spark, d)).select("record_id", F.array_join("reasons", ",").alias("reasons"))


@query("prf_labels", "with c as (select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 1) as fn from labels), p as (select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from c) select tp, fp, fn, precision, recall, 2.0::double * precision * recall / (precision + recall) as f1 from p")
def prf_labels(spark, d):
    rows = table(spark, d, "labels")
    one = lambda c: F.sum(c.cast("int")).cast("long")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return M.with_scores(rows.agg(one(good & clean).alias("tp"), one(~good & clean).alias("fp"), one(good & ~clean).alias("fn")))


@query("set_scores_by_language", """with g as (select distinct lang, doc_id from documents where doc_id % 2 = 0), p as (select distinct lang, doc_id from documents where doc_id % 3 = 0),
j as (select coalesce(g.lang, p.lang) as lang, g.doc_id as a, p.doc_id as b from g full join p on g.doc_id = p.doc_id and g.lang = p.lang),
c as (select lang, count(*) filter (a is not null and b is not null) as tp, count(*) filter (a is null) as fp, count(*) filter (b is null) as fn from j group by lang), s as (select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from c)
select lang, tp, fp, fn, precision, recall, 2.0::double * precision * recall / (precision + recall) as f1 from s""")
def set_scores_by_language(spark, d):
    rows = table(spark, d, "documents")
    return M.set_scores(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0"), ["lang", "doc_id"], ["lang"])


@query("label_scores", """with r as (select case when quality = 1 then 'HEADING' else 'PARAGRAPH' end as g, case when toxic = 1 then 'PARAGRAPH' when doc_id % 4 = 0 then 'LINE' else 'HEADING' end as p from labels), l as (select distinct label from (select g as label from r union all select p from r)),
c as (select label, count(*) filter (g = label and p = label) as tp, count(*) filter (g <> label and p = label) as fp, count(*) filter (g = label and p <> label) as fn from r, l group by label) select label, tp, fp, fn from c""")
def label_scores(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, F.lit("HEADING")).otherwise(F.lit("PARAGRAPH")).alias("gold"), F.when(F.col("toxic") == 1, F.lit("PARAGRAPH")).when(F.col("doc_id") % 4 == 0, F.lit("LINE")).otherwise(F.lit("HEADING")).alias("predicted"))
    return evaluation.label_scores(rows).select("label", "tp", "fp", "fn")


def _confidences(spark, d):
    return table(spark, d, "labels").select(((F.col("doc_id") * 37) % 101 / 100.0).cast("double").alias("confidence"), F.col("quality").alias("correct"), (F.col("doc_id") % 3).alias("part"))


CONFIDENCES = "cf as (select (doc_id * 37 % 101) / 100.0::double as confidence, quality as correct, doc_id % 3 as part from labels), bn as (select part, least(floor(confidence * 10), 9)::int as bin, confidence, correct from cf)"


@query("calibration_bins", f"with {CONFIDENCES} select bin, count(*) as n, round(avg(confidence), 9) as mean_confidence, round(avg(correct), 9) as accuracy from bn group by bin")
def calibration_bins(spark, d):
    return M.calibration_bins(_confidences(spark, d)).select("bin", "n", F.round("mean_confidence", 9).alias("mean_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query("pooled_calibration", f"with {CONFIDENCES}, b as (select bin, count(*) as n, avg(confidence) as c, avg(correct) as a, sum((confidence - correct) * (confidence - correct)) as e from bn group by bin) select sum(n)::bigint as n, round(sum(e) / sum(n), 9) as brier, round(sum(n * abs(c - a)) / sum(n), 9) as ece from b")
def pooled_calibration(spark, d):
    parts = M.calibration_bins(_confidences(spark, d), by=["part"])
    return evaluation.pooled_calibration(parts).select("n", F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


@query("pooled_metrics", """with m as (select d.lang, l.doc_id % 5 as doc, count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 0 and toxic = 0) as fp, count(*) filter (quality = 1 and toxic = 1) as fn from labels l join documents d using (doc_id) group by 1, 2),
s as (select *, case when tp + fp + fn = 0 then null when tp = 0 then 0.0 else 2.0::double * (tp / (tp + fp)::double) * (tp / (tp + fn)::double) / (tp / (tp + fp)::double + tp / (tp + fn)::double) end as f1 from m)
select lang, 'clean' as metric, round(avg(f1), 9) as macro_f1, round(min(f1), 9) as min_f1, round(max(f1), 9) as max_f1, count(f1) as n, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from s group by lang""")
def pooled_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    one = lambda c: F.sum(c.cast("int")).cast("long")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    reports = rows.groupBy("lang", (F.col("doc_id") % 5).alias("doc")).agg(one(good & clean).alias("tp"), one(~good & clean).alias("fp"), one(good & ~clean).alias("fn")).withColumn("metric", F.lit("clean"))
    return evaluation.aggregate_reports(reports, ["lang"]).select("lang", "metric", *[F.round(c, 9).alias(c) for c in ("macro_f1", "min_f1", "max_f1")], "n", "tp", "fp", "fn")


@query("role_report", """with g as (select distinct doc_id as document_id, doc_id::varchar as target, case when doc_id % 2 = 0 then 'ELEMENT' else 'UNIT' end as kind, case quality when 1 then 'NOTE' else 'EXAMPLE' end as type from labels), p as (select distinct doc_id as document_id, doc_id::varchar as target, case when doc_id % 2 = 0 then 'ELEMENT' else 'UNIT' end as kind, case toxic when 1 then 'EXAMPLE' else 'NOTE' end as type from labels),
j as (select coalesce(g.type, p.type) as type, coalesce(g.kind, p.kind) as kind, g.target as a, p.target as b from g full join p on g.document_id = p.document_id and g.target = p.target and g.kind = p.kind and g.type = p.type)
select type, kind, count(*) filter (a is not null and b is not null) as tp, count(*) filter (a is null) as fp, count(*) filter (b is null) as fn from j group by grouping sets ((type), (kind), ())""")
def role_report(spark, d):
    base = table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("target"), F.when(F.col("doc_id") % 2 == 0, F.lit("ELEMENT")).otherwise(F.lit("UNIT")).alias("kind"), "quality", "toxic")
    gold = base.withColumn("type", F.when(F.col("quality") == 1, F.lit("NOTE")).otherwise(F.lit("EXAMPLE")))
    predicted = base.withColumn("type", F.when(F.col("toxic") == 1, F.lit("EXAMPLE")).otherwise(F.lit("NOTE")))
    return evaluation.role_report(gold, predicted).where("target is null").select("type", "kind", "tp", "fp", "fn")


def _alignment() -> str:
    """Four passes; each matches gold elements with keys that one free prediction has, the earliest gold element first, and takes them out."""
    keys = {"anchor": ("", "anchor"), "exact_text": ("type,", "text"), "normalized_text": ("type,", "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"), "occurrence": ("type,", "(row_number() over (partition by document_id, type order by ord))::varchar")}
    sql = f"with {LINES}, g0 as (select document_id, element_id as id, ord, type, text, case when k = 1 then element_id end as anchor from el), p0 as (select * replace (case when ord % 5 = 4 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') else text end as text) from g0 where ord % 9 <> 8)"
    for i, (name, (extra, key)) in enumerate(keys.items()):
        sql += f""", gk{i} as (select document_id, {extra} {key} as k, id, ord from g{i}), pe{i} as (select document_id, {extra} {key} as k, id from p{i}), pk{i} as (select document_id, {extra} k, count(*) as n, min(id) as found from pe{i} where k is not null group by all),
f{i} as (select document_id, id as gold_id, found, '{name}' as matched_by from gk{i} join pk{i} using (document_id, {extra} k) where n = 1 qualify row_number() over (partition by document_id, found order by ord, id) = 1),
g{i + 1} as (select * from g{i} where (document_id, id) not in (select document_id, gold_id from f{i})), p{i + 1} as (select * from p{i} where (document_id, id) not in (select document_id, found from f{i}))"""
    return sql + " select matched_by, count(*) as n from (" + " union all ".join(f"select * from f{i}" for i in range(len(keys))) + ") group by 1"


@query("aligned_elements", _alignment())
def aligned_elements(spark, d):
    rows = line_elements(spark, d).select("document_id", F.col("element_id").alias("id"), "ord", "type", "text", F.when(F.col("k") == 1, F.col("element_id")).alias("anchor"))
    moved = rows.where("ord % 9 != 8").withColumn("text", F.when(F.col("ord") % 5 == 4, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("text")))
    return evaluation.align(rows, moved).groupBy("matched_by").agg(F.count(F.lit(1)).alias("n"))


@query("marker_annotations", f"with {LINES} select document_id, ord, 'NOTE' as type, 6::bigint as start_char, rtrim(left(trim(substr(text, 7)), 1024)) as value from el where k = 11 and ord > 0 and length(trim(substr(text, 7))) > 0 and text[7] <> ' '")
def marker_annotations(spark, d):
    return semantics.marker_annotations(line_elements(spark, d).where("type != 'TITLE'")).where("type = 'NOTE'").select("document_id", "ord", "type", "start_char", "value")


@query("topk_annotations", """with a as (select user_id as target_id, event_type as type, round(value) as v, value, event_id from events), b as (select *, row_number() over (partition by target_id, type, v order by value desc, event_id) as r from a), c as (select *, row_number() over (partition by target_id order by value desc, event_id, type) as place from b where r = 1)
select target_id, type, event_id, place::int as place from c where place <= 8""")
def topk_annotations(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("target_id"), F.col("event_type").alias("type"), F.lit("o").alias("ontology_id"), F.round("value").cast("string").alias("value"), F.col("value").alias("confidence"), F.col("event_id").alias("first_seen"))
    return semantics.top_annotations(rows, 8).select("target_id", "type", F.col("first_seen").alias("event_id"), "place")


@query("packed_segments", """with s as (select conv_id as request_id, row_number() over (partition by conv_id order by turn) - 1 as pos, text from conversations), u as (select *, sum(length(text) + case when pos > 0 then 1 else 0 end) over (partition by request_id order by pos rows unbounded preceding) as used from s),
f as (select *, max(case when used > 600 then 1 else 0 end) over (partition by request_id order by pos rows unbounded preceding) as cut from u) select request_id, pos::int as pos, length(substr(text, 1, 600))::int as chars, length(text) > 600 as truncated from f where cut = 0 or pos = 0""")
def packed_segments(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("pos"), "text")
    return semantics.pack_segments(rows, 600).select("request_id", "pos", F.length("text").alias("chars"), "truncated")


@query("context_neighbours", f"""with {LINES}, t as (select document_id, element_id, ord from el where k = 5), o as (select t.document_id, t.element_id as target_id, e.element_id, e.ord - t.ord as off from t join el e on e.document_id = t.document_id and abs(e.ord - t.ord) between 1 and 2),
r as (select *, row_number() over (partition by document_id, target_id order by 2 * abs(off) - (off < 0)::int) as turn from o) select document_id, target_id, element_id, turn::int as turn from r where turn <= 2""")
def context_neighbours(spark, d):
    rows = line_elements(spark, d)
    return semantics.neighbours(rows, rows.where("k = 5"), 2).select("document_id", "target_id", "element_id", "turn")


def _spans(spark, d):
    b = table(spark, d, "benchmark")
    bad = F.col("item_id") % 5
    return b.select(F.col("item_id").cast("string").alias("record_id"), F.lit(0).alias("pos"), F.lit("b").alias("document_id"), F.when(bad == 1, F.lit("none")).otherwise(F.col("item_id").cast("string")).alias("element_id"), F.array(F.when(bad == 2, F.lit("other")).otherwise(F.col("item_id").cast("string")), F.lit("none")).alias("target_ids"), F.lit(3).alias("start_char"), F.when(bad == 3, 100000).otherwise(13).alias("end_char"), F.when(bad == 4, F.lit("xxxxxxxxxx")).otherwise(F.substring("text", 4, 10)).alias("quoted_text"), F.lit("RAW").alias("text_view"))


@query("span_validation", "select item_id::varchar as record_id, case item_id % 5 when 1 then 'EVIDENCE_ELEMENT_UNKNOWN' when 2 then 'EVIDENCE_OUTSIDE_TARGET' when 3 then 'EVIDENCE_OUT_OF_BOUNDS' else 'EVIDENCE_QUOTE_MISMATCH' end as code from benchmark where item_id % 5 <> 0")
def span_validation(spark, d):
    known = table(spark, d, "benchmark").select(F.lit("b").alias("document_id"), F.col("item_id").cast("string").alias("element_id"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("normalized_text"))
    return studio.evidence_issues(_spans(spark, d), known).select("record_id", "code")


@query("review_chain", """with r as (select user_id as record_id, event_id as pos, 'h' || (event_id - case when event_id % 17 = 0 then 99 else 0 end) as before, lag('h' || event_id) over (partition by user_id order by event_id) as prev from events) select record_id, pos from r where prev is not null and prev <> before""")
def review_chain(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    h = lambda c: F.concat(F.lit("h"), c.cast("string"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("pos"), h(F.col("event_id") - F.when(F.col("event_id") % 17 == 0, 99).otherwise(0)).alias("decision_hash_before"), h(F.col("event_id")).alias("decision_hash_after"), F.col("ts").alias("reviewed_at"), h(F.max("event_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("current_hash"))
    return studio.review_chain(rows).select("record_id", "pos")


@query("manifest_hash", "select 'sha256:' || sha256(string_agg(x, chr(10) order by x)) as manifest_hash from (select distinct 'g' || (doc_id % 50) || '=' || case when doc_id % 50 < 40 then 'train' else 'test' end as x from documents)")
def manifest_hash(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("g")).distinct()
    return studio.manifest_hash(rows.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("split_group_id"), F.when(F.col("g") < 40, F.lit("train")).otherwise(F.lit("test")).alias("split")))


@query("upsert_records", "select doc_id, coalesce(l.quality, -1) as quality from (select doc_id, case when doc_id % 2 = 0 then 9 else quality end as quality from labels) l union all select doc_id, 7 from documents where doc_id % 2 = 0 and doc_id not in (select doc_id from labels)")
def upsert_records(spark, d):
    old = table(spark, d, "labels").select("doc_id", "quality")
    fresh = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id").join(old.select("doc_id", F.lit(9).alias("q")), "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(7)).alias("quality"))
    return studio.upsert(old, fresh, "doc_id")


@query("sync_actions", "select coalesce(a.k, b.k)::varchar as record_id, case when b.k is null then 'CREATE' when a.k is null then 'ORPHAN' when a.h = b.h then 'SKIP' when b.r then 'CONFLICT' else 'UPDATE' end as action from (select o_orderkey as k, o_orderkey % 3 as h from orders where o_orderkey % 2 = 0) a full join (select o_orderkey as k, 0 as h, o_orderkey % 4 = 0 as r from orders where o_orderkey % 5 <> 0) b on a.k = b.k")
def sync_actions(spark, d):
    o = table(spark, d, "orders").withColumn("record_id", F.col("o_orderkey").cast("string"))
    local = o.where("o_orderkey % 2 = 0").select("record_id", (F.col("o_orderkey") % 3).cast("string").alias("task_hash"))
    remote = o.where("o_orderkey % 5 != 0").select("record_id", F.lit("0").alias("task_hash"), (F.col("o_orderkey") % 4 == 0).alias("has_response"))
    return studio.sync_actions(local, remote)


# Metadata and events


@query("keyset_page", "select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1997-01-01' or (o_orderdate = timestamp '1997-01-01' and o_orderkey < 500) order by o_orderdate desc, o_orderkey desc limit 51")
def keyset_page(spark, d):
    import datetime

    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return library.keyset_page(rows, 50, (datetime.datetime(1997, 1, 1), 500), ("o_orderdate", "o_orderkey"))


@query("latest_version", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def latest_version(spark, d):
    return library.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("version_promotions", "with v as (select user_id, event_id, ts, floor(value)::bigint as v, max(floor(value)::bigint) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b from events) select user_id as document_id, event_id as version_id, coalesce(v > b, true) as promoted, greatest(v, coalesce(b, v)) as current_version from v")
def version_promotions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version_id"), F.col("ts").alias("arrived_at"), F.floor("value").cast("long").alias("version_no"))
    return library.promotions(rows).select("document_id", "version_id", "promoted", "current_version")


@query("next_versions", "select o_orderkey as upload_id, (o_custkey % 4 + row_number() over (partition by o_custkey order by o_orderdate, o_orderkey))::bigint as version_no from orders")
def next_versions(spark, d):
    o = table(spark, d, "orders")
    uploads = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("arrived_at"))
    have = o.select(F.col("o_custkey").alias("document_id"), (F.col("o_custkey") % 4).alias("version_no")).distinct()
    return library.next_versions(uploads, have).select("upload_id", F.col("version_no").cast("long").alias("version_no"))


@query("tag_filter", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def tag_filter(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("owner_id"))
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("owner_id"), F.col("o_orderpriority").alias("tag_id"))
    return library.with_tag(docs, links, "1-URGENT").select(F.col("id").alias("c_custkey"))


@query("folder_counts", "select n_nationkey as id, (select count(*) from supplier where s_nationkey = n_nationkey) as children, (select count(*) from customer where c_nationkey = n_nationkey) as documents from nation")
def folder_counts(spark, d):
    none = F.lit(None).cast("timestamp").alias("deleted_at")
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), none).unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_nationkey").alias("parent_id"), none))
    docs = table(spark, d, "customer").select(F.col("c_nationkey").alias("folder_id"), none)
    return library.folder_is_empty(folders, docs).where("id < 1000000").select("id", "children", "documents")


@query("name_conflicts", "select c_nationkey as owner_id, lower(trim(c_mktsegment)) as normalized_name, count(*) as n from customer group by 1, 2 having count(*) > 1")
def name_conflicts(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner_id"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return library.name_conflicts(rows, ("owner_id",))


def _outbox(spark, d):
    e = table(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, ["PENDING", "PUBLISHING", "PUBLISHED", "PENDING"])), (F.col("event_id") % 4 + 1).cast("int"))
    lease = F.when(F.col("event_id") % 4 == 1, F.col("ts") + F.expr("interval 60 seconds"))
    return e.select(F.col("event_id").alias("id"), "event_type", status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("available_at"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 == 1, F.lit("w")).alias("claim_owner"), lease.alias("claim_expires_at"), F.when(F.col("event_id") % 4 == 2, F.col("ts")).alias("published_at"), F.lit(None).cast("string").alias("last_error_code"))


OUTBOX = "ob as (select event_id as id, (['PENDING','PUBLISHING','PUBLISHED','PENDING'])[event_id % 4 + 1] as status, ts as available_at, (event_id % 7)::int as attempts, case when event_id % 4 = 1 then ts + interval 60 seconds end as lease from events)"


@query("outbox_claim", f"with {OUTBOX} select id, attempts + 1 as attempts, 'PUBLISHING' as status from ob where ((status = 'PENDING' and available_at <= {NOW}) or (status = 'PUBLISHING' and lease <= {NOW})) and attempts < 5 order by available_at, id limit 100")
def outbox_claim(spark, d):
    return library.claim(_outbox(spark, d), F.expr(NOW), "me", 100).select("id", "attempts", "status")


@query("outbox_exhausted", f"with {OUTBOX} select id from ob where ((status = 'PENDING' and available_at <= {NOW}) or (status = 'PUBLISHING' and lease <= {NOW})) and attempts >= 5")
def outbox_exhausted(spark, d):
    return library.exhausted(_outbox(spark, d), F.expr(NOW)).where("status = 'FAILED'").select("id")


@query("outbox_violations", f"with {OUTBOX} select id from ob where status = 'PUBLISHING' and attempts = 0")
def outbox_violations(spark, d):
    return library.outbox_violations(_outbox(spark, d)).select("id")


@query("backoff", "select event_id as id, least(300.0::double, 5.0::double * pow(2.0::double, event_id % 9)) as seconds from events")
def backoff(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), library.backoff_seconds((F.col("event_id") % 9 + 1).cast("int")).alias("seconds"))


@query("idempotent_requests", """with recursive r as (select user_id, event_type, ts, event_id % 2 as h, row_number() over (partition by user_id, event_type order by ts, event_id::varchar) as i from events),
w as (select user_id, event_type, i, ts as t0, h as h0, 'RUN' as outcome from r where i = 1 union all
  select r.user_id, r.event_type, r.i, case when r.ts < w.t0 + interval 1 day then w.t0 else r.ts end, case when r.ts < w.t0 + interval 1 day then w.h0 else r.h end, case when r.ts >= w.t0 + interval 1 day then 'RUN' when w.h0 = r.h then 'REPLAY' else 'CONFLICT' end from w join r on r.user_id = w.user_id and r.event_type = w.event_type and r.i = w.i + 1)
select outcome, count(*) as n from w group by 1""")
def idempotent_requests(spark, d):
    rows = table(spark, d, "events").select("user_id", F.lit("upload").alias("scope"), F.col("event_type").alias("key"), F.col("ts").alias("requested_at"), F.col("event_id").cast("string").alias("request_id"), (F.col("event_id") % 2).cast("string").alias("request_hash"))
    return library.idempotent_requests(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("windowed_events", "select time_bucket(interval 10 minutes, ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def windowed_events(spark, d):
    return stream.windowed_counts(table(spark, d, "events")).select("window_start", "event_type", "n")


@query("event_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as st from events), s as (select *, sum(st) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as session_start, count(*) as n from s group by user_id, k""")
def event_sessions(spark, d):
    return stream.sessions(table(spark, d, "events")).select("user_id", "session_start", "n")
