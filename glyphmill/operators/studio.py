"""Dataset curation: record checks, eligibility, leakage, compilation and content hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

STATES = ("POSITIVE", "NEGATIVE", "UNDECIDED")


def _issues(rows: DataFrame, code: Column, *columns: str, severity: str = "ERROR") -> DataFrame:
    return rows.withColumn("code", code).where("code is not null").select(*columns, "code", F.lit(severity).alias("severity"))


# Records and batches


def eligibility(records: DataFrame, *, confidences: tuple[str, ...] = ("HIGH",), modes: tuple[str, ...] = ("LABEL_ONLY", "EXTRACTIVE")) -> DataFrame:
    """Reasons against taking each record as gold, in their fixed order; an empty list is eligible.

    ``records``: record_id, status, reviews (array), decisions array<struct<state, confidence, mode, rule_keys, evidence>>.
    """
    d = F.col("decisions")
    checks = [
        ("STATUS_NOT_PASS", F.col("status") != "PASS"),
        ("REVIEW_MISSING", F.size(F.coalesce("reviews", F.array().cast("array<string>"))) == 0),
        ("NO_DECISIONS", F.size(d) == 0),
        ("UNDECIDED_DECISION", F.exists(d, lambda x: x["state"] == "UNDECIDED")),
        ("CONFIDENCE_TOO_LOW", F.exists(d, lambda x: ~x["confidence"].isin(*confidences))),
        ("RULE_KEYS_MISSING", F.exists(d, lambda x: F.size(F.coalesce(x["rule_keys"], F.array().cast("array<string>"))) == 0)),
        ("PAYLOAD_MODE_UNSUPPORTED", F.exists(d, lambda x: (x["state"] == "POSITIVE") & ~x["mode"].isin(*modes))),
    ]
    return records.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))).withColumn("eligible", F.size("reasons") == 0)


def positives(records: DataFrame, elements: DataFrame) -> DataFrame:
    """Positive decisions as rows, their evidence by element orders."""
    rows = records.select("record_id", "document_id", F.posexplode("decisions").alias("pos", "d")).where("d.state = 'POSITIVE'")
    flat = rows.select("record_id", "document_id", "pos", F.explode_outer("d.evidence").alias("e")).select("record_id", "document_id", "pos", F.col("e.element_id").alias("element_id"), F.col("e.start_char").alias("start_char"), F.col("e.end_char").alias("end_char"), F.col("e.quoted_text").alias("quoted_text"))
    placed = flat.join(elements.select("document_id", "element_id", "ord"), ["document_id", "element_id"], "left")
    gathered = placed.groupBy("record_id", "pos").agg(F.sort_array(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "start_char", "end_char", "quoted_text")))).alias("evidence"))
    return rows.select("record_id", "document_id", "pos", F.col("d.annotation_type").alias("type"), F.col("d.value").alias("value")).join(gathered, ["record_id", "pos"], "left")


def undecided(records: DataFrame) -> DataFrame:
    rows = records.select("record_id", F.explode("decisions").alias("d"))
    return _issues(rows, F.when(F.col("d.state") == "UNDECIDED", F.lit("UNDECIDED_STATE")).when(~F.col("d.state").isin(*STATES), F.lit("UNKNOWN_STATE")), "record_id")


def batch_membership(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Records a batch names but lacks, has but does not name, or names twice (batch_id, record_id)."""
    a, b = declared.select("batch_id", "record_id"), actual.select("batch_id", "record_id")
    missing = a.distinct().join(b, ["batch_id", "record_id"], "left_anti").withColumn("code", F.lit("BATCH_RECORD_MISSING"))
    extra = b.distinct().join(a, ["batch_id", "record_id"], "left_anti").withColumn("code", F.lit("BATCH_RECORD_UNEXPECTED"))
    twice = a.groupBy("batch_id", "record_id").count().where("count > 1").select("batch_id", "record_id").withColumn("code", F.lit("BATCH_RECORD_DUPLICATE"))
    return missing.unionByName(extra).unionByName(twice)


def infer_batches(records: DataFrame) -> DataFrame:
    """Batches from their records: one guideline version and one set of evaluated types each, else a code."""
    made = records.groupBy("batch_id").agg(F.collect_set("guideline_version").alias("guidelines"), F.collect_set(F.array_join(F.array_sort("evaluated_types"), "|")).alias("types"), F.count(F.lit(1)).alias("n"))
    code = F.when(F.size("guidelines") != 1, F.lit("BATCH_GUIDELINE_CONFLICT")).when(F.size("types") != 1, F.lit("BATCH_TYPES_CONFLICT"))
    return made.select("batch_id", "n", F.when(code.isNull(), F.col("guidelines")[0]).alias("guideline_version"), F.when(code.isNull(), F.col("types")[0]).alias("evaluated_types"), code.alias("code"))


def duplicates(df: DataFrame, *key: str, code: str = "DUPLICATE_RECORD_ID") -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("code", F.lit(code))


def review_chain(reviews: DataFrame) -> DataFrame:
    """Breaks in the chain of hashes: each review starts from what the one before left, the last leaves the current.

    ``reviews``: record_id, pos, decision_hash_before, decision_hash_after, reviewed_at, current_hash.
    """
    w = Window.partitionBy("record_id").orderBy("pos")
    rows = reviews.withColumns({"prev_hash": F.lag("decision_hash_after").over(w), "prev_time": F.lag("reviewed_at").over(w), "is_last": F.lead("pos").over(w).isNull()})
    code = F.when(F.col("prev_hash") != F.col("decision_hash_before"), F.lit("REVIEW_CHAIN_BROKEN")).when(F.col("prev_time") > F.col("reviewed_at"), F.lit("REVIEW_TIME_REVERSED")).when(F.col("is_last") & (F.col("decision_hash_after") != F.col("current_hash")), F.lit("REVIEW_FINAL_HASH_MISMATCH"))
    return _issues(rows, code, "record_id", "pos")


def review_guidelines(records: DataFrame) -> DataFrame:
    """Records whose last review used another guideline than their batch."""
    last = F.try_element_at("reviews", F.lit(-1))["guideline_version"]
    return _issues(records, F.when(last != F.col("guideline_version"), F.lit("REVIEW_GUIDELINE_MISMATCH")), "record_id")


def review_status(outcome: Column) -> Column:
    return F.when(outcome.isin("ACCEPT", "MODIFY"), F.lit("PASS")).when(outcome == "CONFLICT", F.lit("REVIEW_REQUIRED")).otherwise(F.lit("REJECT"))


def distinct_reviews(submissions: DataFrame) -> DataFrame:
    """Submissions without repeats of the same review."""
    return submissions.dropDuplicates(["record_id", "reviewer_id", "reviewed_at", "outcome", "decision_hash_before", "decision_hash_after"])


# Evidence and snapshots


def evidence_issues(spans: DataFrame, elements: DataFrame) -> DataFrame:
    """The first rule that each evidence span breaks.

    ``spans``: record_id, pos, document_id, element_id, target_ids, start_char, end_char, quoted_text, text_view (RAW or NORMALIZED).
    """
    known = elements.select("document_id", "element_id", "raw_text", "normalized_text", F.lit(True).alias("known"))
    rows = spans.join(known, ["document_id", "element_id"], "left").withColumn("view", F.when(F.col("text_view") == "RAW", F.col("raw_text")).otherwise(F.col("normalized_text")))
    quote = F.expr("substring(view, start_char + 1, end_char - start_char)")
    code = (
        F.when(F.col("known").isNull(), F.lit("EVIDENCE_ELEMENT_UNKNOWN")).when(~F.array_contains("target_ids", F.col("element_id")), F.lit("EVIDENCE_OUTSIDE_TARGET")).when(F.col("view").isNull(), F.lit("EVIDENCE_TEXT_VIEW_MISSING"))
        .when((F.col("start_char") < 0) | (F.col("start_char") >= F.col("end_char")) | (F.col("end_char") > F.length("view")), F.lit("EVIDENCE_OUT_OF_BOUNDS")).when(quote != F.col("quoted_text"), F.lit("EVIDENCE_QUOTE_MISMATCH"))
    )
    return _issues(rows, code, "record_id", "pos", "element_id")


def target_snapshot(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """Raw and normalized text of each target (target_id, document_id, element_ids): its elements' texts by blank lines, nulls skipped, null if none."""
    members = targets.select("target_id", "document_id", F.posexplode("element_ids").alias("pos", "element_id")).join(elements.select("document_id", "element_id", "ord", "raw_text", "normalized_text"), ["document_id", "element_id"])
    items = F.sort_array(F.collect_list(F.struct("ord", "raw_text", "normalized_text")))
    made = members.groupBy("target_id", "document_id").agg(items.alias("items"))
    view = lambda f: F.filter(F.transform("items", lambda x: x[f]), lambda x: x.isNotNull())
    join = lambda f: F.when(F.size(view(f)) > 0, F.array_join(view(f), "\n\n"))
    return made.select("target_id", "document_id", join("raw_text").alias("raw_text"), join("normalized_text").alias("normalized_text"))


def snapshot_issues(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Records whose stored target texts differ from their document's."""
    now = snapshots.select("target_id", F.col("raw_text").alias("raw_now"), F.col("normalized_text").alias("norm_now"), F.lit(True).alias("there"))
    rows = records.join(now, "target_id", "left")
    code = F.when(F.col("there").isNull(), F.lit("TARGET_UNRESOLVED")).when(~F.col("raw_text").eqNullSafe(F.col("raw_now")), F.lit("TARGET_RAW_TEXT_MISMATCH")).when(~F.col("normalized_text").eqNullSafe(F.col("norm_now")), F.lit("TARGET_NORMALIZED_TEXT_MISMATCH"))
    return _issues(rows, code, "record_id")


def resolve_targets(targets: DataFrame, elements: DataFrame, units: DataFrame) -> DataFrame:
    """Targets as an element or else a unit, with kind, ids and code."""
    e = elements.select("document_id", F.col("element_id").alias("target_id"), F.array("element_id").alias("e_ids"))
    u = units.select("document_id", F.col("unit_id").alias("target_id"), F.col("element_ids").alias("u_ids"), "unit_type")
    rows = targets.join(e, ["document_id", "target_id"], "left").join(u, ["document_id", "target_id"], "left")
    return rows.select("document_id", "target_id", F.when(F.col("e_ids").isNotNull(), F.lit("ELEMENT")).when(F.col("u_ids").isNotNull(), F.lit("LOGICAL_UNIT")).alias("target_kind"), F.coalesce("e_ids", "u_ids").alias("element_ids"), "unit_type", F.when(F.coalesce("e_ids", "u_ids").isNull(), F.lit("TARGET_UNKNOWN")).alias("code"))


def source_agreement(records: DataFrame) -> DataFrame:
    """Documents whose records disagree on content hash, snapshot or language."""
    made = records.groupBy("document_id").agg(*[F.countDistinct(c).alias(c) for c in ("content_hash", "element_snapshot_hash", "language")])
    code = F.when(F.col("content_hash") > 1, F.lit("CONTENT_HASH_CONFLICT")).when(F.col("element_snapshot_hash") > 1, F.lit("SNAPSHOT_CONFLICT")).when(F.col("language") > 1, F.lit("LANGUAGE_CONFLICT"))
    return _issues(made, code, "document_id")


# Splits


def crossings(records: DataFrame, identity: str, code: str) -> DataFrame:
    """Identities found in more than one split group (an error even within a split) or split."""
    made = records.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.countDistinct("split_group_id").alias("groups"), F.countDistinct("split").alias("splits"))
    groups = made.where("groups > 1").select(F.col(identity).cast("string").alias("identity"), F.lit(f"{code}_CROSSES_GROUPS").alias("code"))
    splits = made.where("splits > 1").select(F.col(identity).cast("string").alias("identity"), F.lit(f"{code}_CROSSES_SPLITS").alias("code"))
    return groups.unionByName(splits)


def assignment_issues(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Groups without a split (errors) and assigned groups without records (warnings)."""
    groups = records.select("split_group_id").distinct()
    lost = groups.join(assignments, "split_group_id", "left_anti").select("split_group_id", F.lit("GROUP_UNASSIGNED").alias("code"), F.lit("ERROR").alias("severity"))
    idle = assignments.select("split_group_id").distinct().join(groups, "split_group_id", "left_anti").select("split_group_id", F.lit("GROUP_UNUSED").alias("code"), F.lit("WARNING").alias("severity"))
    return lost.unionByName(idle)


def split_leakage(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """All leakage issues of records (record_id, document_id, content_hash, source_family_id, split_group_id, target_kind, element_orders)."""
    rows = records.join(assignments.select("split_group_id", "split"), "split_group_id", "left")
    out = None
    for column, code in (("source_family_id", "SOURCE_FAMILY"), ("content_hash", "CONTENT_HASH"), ("document_id", "DOCUMENT")):
        part = crossings(rows, column, code)
        out = part if out is None else out.unionByName(part)
    targets = rows.groupBy("content_hash", "target_kind", F.array_join(F.col("element_orders").cast("array<string>"), ",").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    same = targets.where("n > 1").select(F.concat_ws("|", "content_hash", "target_kind", "o").alias("identity"), F.when(F.col("splits") > 1, F.lit("SOURCE_TARGET_CROSSES_SPLITS")).otherwise(F.lit("SOURCE_TARGET_DUPLICATE")).alias("code"))
    ids = duplicates(records, "record_id").select(F.col("record_id").cast("string").alias("identity"), "code")
    groups = assignment_issues(records, assignments).select(F.col("split_group_id").cast("string").alias("identity"), "code")
    return out.unionByName(same).unionByName(ids).unionByName(groups)


def training_leakage(examples: DataFrame, keys: tuple[str, ...] = ("document_id", "content_hash", "source_family_id", "split_group_id")) -> DataFrame:
    """Keys of training examples that stand in more than one split, and TEST examples whose labels are not human."""
    out = examples.where((F.col("split") == "test") & (F.col("label_source") != "HUMAN")).select(F.col("example_id").cast("string").alias("identity"), F.lit("TEST_LABEL_NOT_HUMAN").alias("code"))
    for k in keys:
        out = out.unionByName(examples.groupBy(k).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.col(k).cast("string").alias("identity"), F.lit(f"{k.upper()}_CROSSES_SPLITS").alias("code")))
    return out


# Compilation and hashes


def compile_gold(records: DataFrame, elements: DataFrame, assignments: DataFrame) -> DataFrame:
    """Gold cases of eligible records by document: split, scopes and annotations in canonical order."""
    fit = eligibility(records).where("eligible").join(assignments.select("split_group_id", "split"), "split_group_id")
    notes = positives(fit, elements)
    scopes = fit.groupBy("document_id", "split").agg(F.sort_array(F.collect_list(F.struct("element_orders", F.col("target_kind").alias("kind"), F.array_sort("evaluated_types").alias("evaluated_types")))).alias("scopes"))
    annotated = notes.join(fit.select("record_id", "element_orders", F.col("target_kind").alias("kind")), "record_id").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("element_orders", "kind", "type", "value", "evidence"))).alias("annotations"))
    return scopes.join(annotated, "document_id", "left")


def ordered_hash(df: DataFrame, by: list[str], content: str, name: str = "content_hash") -> DataFrame:
    """Hash of each group's JSON contents: every row in canonical form is hashed, and the sorted row hashes are hashed together.

    Sorting is of 64 hex digits a row, so a group of any number of rows is bounded by its hashes, not its contents.
    """
    rows = df.withColumn("gm_row", F.sha2(T.canonical(F.col(content)).cast("binary"), 256))
    return rows.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list("gm_row")), "\n").cast("binary"), 256)).alias(name))


def tree_hash(df: DataFrame, by: list[str], row_hash: str, name: str = "tree_hash", leaf: int = 4096, deepest: int | None = None) -> DataFrame:
    """Hash of each group's rows, whatever their order and number; no task holds more than about ``leaf`` of them at once,
    or than a leaf at ``deepest`` digits where that is given.

    Definition.  Distinct row hashes (lower-case hex, evenly spread) with their counts are the entries ``hash:count``.  The depth is the
    least d with leaf * 16**d not below the number of entries, ``deepest`` at most.  Entries that share their first d digits make a leaf: the SHA-256 of
    the entries in order, a line each.  Nodes that share all digits but the last make a node: the SHA-256 of their ``digit=hash`` lines in
    order; the node of no digits is the group's.  So the hash depends on the rows alone, not on how they are dealt.
    """
    entries = df.groupBy(*by, F.col(row_hash).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    sizes = df.groupBy(*by).agg(F.count_distinct(row_hash).alias("entries"))
    limits = [leaf * 16**d for d in range(12 if deepest is None else deepest)]
    depth = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x < F.col("entries")))
    sizes = sizes.withColumn("depth", depth).drop("entries")
    levels = sizes.agg(F.max("depth")).first()[0] or 0
    digest = lambda rows: F.sha2(F.array_join(F.sort_array(F.collect_list(rows)), "\n").cast("binary"), 256)
    same = [F.col(c).eqNullSafe(F.col(f"gm_{c}")) for c in by]
    named = sizes.select(*[F.col(c).alias(f"gm_{c}") for c in by], "depth")
    joined = entries.join(named, same) if by else entries.withColumn("depth", F.lit(levels))
    nodes = joined.groupBy(*by, F.substring("h", F.lit(1), F.col("depth")).alias("prefix")).agg(digest(F.concat_ws(":", "h", F.col("n").cast("string"))).alias("node"))
    for d in range(levels, 0, -1):
        # nodes of d digits become children of d - 1 digits; those of groups that are less deep wait
        child = F.length("prefix") == d
        up = nodes.where(child).groupBy(*by, F.substring("prefix", 1, d - 1).alias("prefix")).agg(digest(F.concat(F.substring("prefix", d, 1), F.lit("="), F.col("node"))).alias("node"))
        nodes = nodes.where(~child).unionByName(up)
    return nodes.select(*by, F.concat(F.lit("tree:"), F.col("node")).alias(name))


def canonical_hash(value) -> str:
    """Hash of one small value on the driver: manifests, policies, fingerprints."""
    return "sha256:" + hashlib.sha256(T.canonical_json(value).encode()).hexdigest()


def manifest_hash(assignments: DataFrame) -> DataFrame:
    """Hash of the sorted assignments alone; author and time do not count."""
    rows = F.sort_array(F.collect_list(F.concat_ws("=", "split_group_id", "split")))
    return assignments.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(rows, "\n").cast("binary"), 256)).alias("manifest_hash"))


def dataset_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("split").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("scopes")).alias("scopes"), F.sum(F.coalesce(F.size("annotations"), F.lit(0))).alias("annotations"))


def decision_rules(decisions: DataFrame) -> DataFrame:
    """Decisions that break a row rule: positives of extractive types need a value and evidence, others must have none."""
    evidence = F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0
    code = (
        F.when(~F.col("state").isin(*STATES), F.lit("STATE_UNKNOWN")).when((F.col("state") != "POSITIVE") & (F.col("value").isNotNull() | evidence), F.lit("PAYLOAD_ON_NON_POSITIVE"))
        .when((F.col("state") == "POSITIVE") & (F.col("mode") == "EXTRACTIVE") & F.col("value").isNull(), F.lit("EXTRACTIVE_VALUE_MISSING")).when((F.col("state") == "POSITIVE") & (F.col("mode") == "EXTRACTIVE") & ~evidence, F.lit("EXTRACTIVE_EVIDENCE_MISSING"))
        .when((F.col("state") == "POSITIVE") & (F.col("mode") == "LABEL_ONLY") & F.col("value").isNotNull(), F.lit("LABEL_ONLY_HAS_VALUE"))
    )
    return _issues(decisions, code, "record_id", "annotation_type")


def upsert(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """Old rows whose key no new row has, and all new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def identity_conflicts(old: DataFrame, new: DataFrame, immutable: list[str], key: str = "record_id") -> DataFrame:
    """New rows that change an immutable column of the row they replace."""
    joined = new.alias("n").join(old.alias("o"), key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in immutable]))
    return joined.select(key, changed.alias("changed")).where(F.size("changed") > 0)


def sync_actions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What to do with each review task: create, skip, update, or conflict where an answer has begun (record_id, task_hash, has_response)."""
    rows = local.select("record_id", F.col("task_hash").alias("l")).join(remote.select("record_id", F.col("task_hash").alias("r"), "has_response"), "record_id", "full_outer")
    action = F.when(F.col("r").isNull(), F.lit("CREATE")).when(F.col("l").isNull(), F.lit("ORPHAN")).when(F.col("l") == F.col("r"), F.lit("SKIP")).when(F.coalesce("has_response", F.lit(False)), F.lit("CONFLICT")).otherwise(F.lit("UPDATE"))
    return rows.select("record_id", action.alias("action"))


def namespace_conflicts(ids: DataFrame) -> DataFrame:
    """Ids (document_id, namespace, id) in more than one namespace, or more than once in one."""
    made = ids.groupBy("document_id", "id").agg(F.countDistinct("namespace").alias("namespaces"), F.count(F.lit(1)).alias("n"))
    return made.select("document_id", "id", F.when(F.col("namespaces") > 1, F.lit("ID_IN_SEVERAL_NAMESPACES")).when(F.col("n") > 1, F.lit("ID_NOT_UNIQUE")).alias("code")).where("code is not null")
