"""Owner-scoped metadata queries over documents, versions, folders and tags, and their mutations as table transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, owner: str | int) -> DataFrame:
    """Active rows of one owner."""
    return df.where((F.col("owner_id") == F.lit(owner)) & F.col("deleted_at").isNull() & (F.col("status") == "ACTIVE"))


def keyset_page(df: DataFrame, limit: int, cursor: tuple | None = None, order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """One page in descending order of two columns, after a cursor; one row more than the limit tells that there is a next page.

    The cursor is a filter and the page a top-k, so no page costs more than the one before.
    """
    a, b = (F.col(c) for c in order)
    rows = df
    if cursor is not None:
        rows = rows.where((a < F.lit(cursor[0])) | ((a == F.lit(cursor[0])) & (b < F.lit(cursor[1]))))
    return rows.orderBy(a.desc(), b.desc()).limit(limit + 1)


def latest(df: DataFrame, by: str, version: str, tie: str) -> DataFrame:
    """The row of the greatest version of each group, ties by the greatest id; partial aggregation, no sort of groups."""
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(version, tie)).alias("gm_row")
    return df.groupBy(by).agg(best).select("gm_row.*")


def promotions(versions: DataFrame) -> DataFrame:
    """Versions in order of arrival and whether each becomes current: only a greater number than all before does."""
    w = Window.partitionBy("document_id").orderBy("arrived_at", "version_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("version_no").over(w)
    return versions.withColumn("promoted", F.coalesce(F.col("version_no") > before, F.lit(True))).withColumn("current_version", F.greatest(F.col("version_no"), F.coalesce(before, F.col("version_no"))))


def with_current_version(documents: DataFrame, versions: DataFrame) -> DataFrame:
    mine = versions.select(F.col("id").alias("current_version_id"), F.col("version_no"), F.col("media_type"))
    return documents.join(mine, "current_version_id", "left")


def with_tag(documents: DataFrame, links: DataFrame, tag: str | int) -> DataFrame:
    """Documents that have a tag of the same owner."""
    hits = links.where(F.col("tag_id") == F.lit(tag)).select(F.col("document_id").alias("id"), "owner_id")
    return documents.join(hits, ["id", "owner_id"], "left_semi")


def owner_link_violations(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links whose document is not the owner's."""
    return links.join(documents.select(F.col("id").alias("document_id"), "owner_id"), ["document_id", "owner_id"], "left_anti")


def next_versions(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Version numbers of new uploads: the greatest so far and their place among the new ones."""
    top = versions.groupBy("document_id").agg(F.max("version_no").alias("top"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("arrived_at", "upload_id"))
    return uploads.join(top, "document_id", "left").withColumn("version_no", F.coalesce("top", F.lit(0)) + place).drop("top")


def soft_delete(documents: DataFrame, links: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Documents with the chosen ones marked deleted, and the links without theirs."""
    hit = ids.select("id").distinct().withColumn("gm_hit", F.lit(True))
    marked = documents.join(hit, "id", "left").withColumns({"status": F.when(F.col("gm_hit"), F.lit("DELETED")).otherwise(F.col("status")), "deleted_at": F.when(F.col("gm_hit"), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))}).drop("gm_hit")
    return marked, links.join(hit.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def new_links(wanted: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("document_id", "tag_id")) -> DataFrame:
    """Links that are not there yet, each once; only these are audited."""
    return wanted.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def folder_is_empty(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Children and documents of each folder, and whether it may be deleted."""
    children = folders.where("deleted_at is null and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    inside = documents.where("deleted_at is null and folder_id is not null").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    made = folders.select("id").join(children, "id", "left").join(inside, "id", "left").fillna(0, ["children", "documents"])
    return made.withColumn("empty", (F.col("children") == 0) & (F.col("documents") == 0))


def name_conflicts(df: DataFrame, scope: tuple[str, ...] = ("owner_id", "parent_id")) -> DataFrame:
    """Normalised names that active rows share within a scope; null scopes count as equal."""
    name = F.lower(F.trim("name")).alias("normalized_name")
    return df.where("deleted_at is null").groupBy(*scope, name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def status_violations(df: DataFrame) -> DataFrame:
    """Rows whose status and time of deletion disagree."""
    return df.where((F.col("status") == "DELETED") != F.col("deleted_at").isNotNull())


def upload_violations(df: DataFrame, max_bytes: int, media_types: tuple[str, ...]) -> DataFrame:
    code = F.when(F.col("size_bytes") <= 0, F.lit("SIZE_NOT_POSITIVE")).when(F.col("size_bytes") > max_bytes, F.lit("TOO_LARGE")).when(~F.col("media_type").isin(*media_types), F.lit("MEDIA_TYPE_NOT_ALLOWED"))
    return df.withColumn("code", code).where("code is not null")


def immutability_violations(history: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of a change history (id, changed_at) that change a column which must stay."""
    w = Window.partitionBy("id").orderBy("changed_at")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in columns]))
    rows = history.withColumns({"gm_n": F.row_number().over(w), "changed": changed})
    return rows.where((F.col("gm_n") > 1) & (F.size("changed") > 0)).drop("gm_n")


# The outbox


def backoff_seconds(attempts: Column, base: int = 5, most: int = 300) -> Column:
    """base * 2 ** (attempts - 1), no more than ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(30))))


def exhausted(outbox: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """The table after the sweep: due or expired rows whose attempts are used up are FAILED."""
    due = ((F.col("status") == "PENDING") & (F.col("available_at") <= now)) | ((F.col("status") == "PUBLISHING") & (F.col("claim_expires_at") <= now))
    out = due & (F.col("attempts") >= max_attempts)
    return outbox.withColumns({"status": F.when(out, F.lit("FAILED")).otherwise(F.col("status")), "last_error_code": F.when(out, F.lit("ATTEMPTS_EXHAUSTED")).otherwise(F.col("last_error_code")), "claim_owner": F.when(out, F.lit(None)).otherwise(F.col("claim_owner")), "claim_expires_at": F.when(out, F.lit(None)).otherwise(F.col("claim_expires_at"))})


def claim(outbox: DataFrame, now: Column, owner: str, batch: int, lease_seconds: int = 60, max_attempts: int = 5) -> DataFrame:
    """The next due or expired rows in order, as claimed: PUBLISHING, one attempt more, a new lease. The sweep comes first."""
    rows = exhausted(outbox, now, max_attempts)
    due = ((F.col("status") == "PENDING") & (F.col("available_at") <= now)) | ((F.col("status") == "PUBLISHING") & (F.col("claim_expires_at") <= now))
    lease = now + F.make_dt_interval(secs=F.lit(lease_seconds))
    return rows.where(due).orderBy("available_at", "created_at", "id").limit(batch).withColumns({"status": F.lit("PUBLISHING"), "attempts": F.col("attempts") + 1, "claim_owner": F.lit(owner), "claim_expires_at": lease})


def settle(claimed: DataFrame, results: DataFrame, now: Column, owner: str, max_attempts: int = 5) -> DataFrame:
    """Claimed rows after publishing (id, outcome OK, RETRY or CONTRACT); rows of another owner stay as they are."""
    rows = claimed.join(results.select("id", "outcome"), "id", "left")
    mine = (F.col("status") == "PUBLISHING") & (F.col("claim_owner") == owner) & F.col("outcome").isNotNull()
    spent = F.col("attempts") >= max_attempts
    status = F.when(F.col("outcome") == "OK", F.lit("PUBLISHED")).when((F.col("outcome") == "CONTRACT") | spent, F.lit("FAILED")).otherwise(F.lit("PENDING"))
    wait = now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return rows.withColumns({"available_at": F.when(mine & (status == "PENDING"), wait).otherwise(F.col("available_at")), "published_at": F.when(mine & (status == "PUBLISHED"), now).otherwise(F.col("published_at")), "status": F.when(mine, status).otherwise(F.col("status")), "claim_owner": F.when(mine, F.lit(None)).otherwise(F.col("claim_owner")), "claim_expires_at": F.when(mine, F.lit(None)).otherwise(F.col("claim_expires_at"))}).drop("outcome")


def outbox_violations(outbox: DataFrame) -> DataFrame:
    """Rows whose columns don't have one of the four legal shapes."""
    claimed = F.col("claim_owner").isNotNull() & F.col("claim_expires_at").isNotNull()
    free = F.col("claim_owner").isNull() & F.col("claim_expires_at").isNull()
    published = F.col("published_at").isNotNull()
    legal = ((F.col("status") == "PENDING") & free & ~published) | ((F.col("status") == "PUBLISHING") & claimed & ~published & (F.col("attempts") > 0)) | ((F.col("status") == "PUBLISHED") & free & published) | ((F.col("status") == "FAILED") & free & ~published & F.col("last_error_code").isNotNull())
    return outbox.where(~F.coalesce(legal, F.lit(False)))


def job_id(event_type: Column, aggregate: Column, version: Column) -> Column:
    return F.concat_ws(":", event_type, aggregate, version.cast("string"))


def event_errors(events: DataFrame, types: tuple[str, ...], version: int = 1) -> DataFrame:
    """The first contract rule each event breaks: type, schema version, payload, ids, aggregate (payload: JSON text)."""
    p = F.from_json("payload", "aggregateId string, versionNo long")
    uuid = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    code = (
        F.when(~F.col("event_type").isin(*types), F.lit("EVENT_TYPE_UNKNOWN")).when(F.col("schema_version") != version, F.lit("SCHEMA_VERSION_UNSUPPORTED")).when(p.isNull() | p["aggregateId"].isNull(), F.lit("PAYLOAD_INVALID"))
        .when(~p["aggregateId"].rlike(uuid), F.lit("AGGREGATE_ID_INVALID")).when(F.coalesce(p["versionNo"] < 1, F.lit(True)), F.lit("VERSION_NOT_POSITIVE")).when(p["aggregateId"] != F.col("aggregate_id"), F.lit("AGGREGATE_MISMATCH"))
    )
    return events.withColumn("code", code).where("code is not null")


def idempotent_requests(requests: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """Outcome of each request by (user_id, scope, key) in order: the first in a lifetime runs, repeats replay, other bodies conflict.

    A lifetime starts with a request that runs and lasts ``ttl_seconds``.  Requests of a key are folded in order; only their
    times and hashes are gathered.
    """
    items = F.sort_array(F.collect_list(F.struct(F.unix_micros(F.col("requested_at").cast("timestamp")).alias("t"), F.col("request_id").alias("id"), F.col("request_hash").alias("h"))))
    start = F.struct(F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("h"), F.array().cast("array<struct<id:string,outcome:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        live = a["t"].isNotNull() & (x["t"] < a["t"] + ttl_seconds * 1_000_000)
        outcome = F.when(~live, F.lit("RUN")).when(a["h"] == x["h"], F.lit("REPLAY")).otherwise(F.lit("CONFLICT"))
        return F.struct(F.when(live, a["t"]).otherwise(x["t"]).alias("t"), F.when(live, a["h"]).otherwise(x["h"]).alias("h"), F.concat(a["out"], F.array(F.struct(x["id"].cast("string").alias("id"), outcome.alias("outcome")))).alias("out"))

    made = requests.groupBy("user_id", "scope", "key").agg(items.alias("items"))
    return made.select("user_id", "scope", "key", F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("x")).select("user_id", "scope", "key", F.col("x.id").alias("request_id"), "x.outcome")


def accepted_submissions(submissions: DataFrame) -> DataFrame:
    """Submissions (record_id, seq, expected_hash, new_hash, initial_hash) in order: one is taken if it expects the current hash."""
    items = F.sort_array(F.collect_list(F.struct("seq", "expected_hash", "new_hash")))
    made = submissions.groupBy("record_id").agg(items.alias("items"), F.first("initial_hash").alias("initial_hash"))
    start = F.struct(F.col("initial_hash").alias("h"), F.array().cast("array<struct<seq:bigint,accepted:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        ok = F.coalesce(a["h"] == x["expected_hash"], F.lit(False))
        return F.struct(F.when(ok, x["new_hash"]).otherwise(a["h"]).alias("h"), F.concat(a["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), ok.alias("accepted")))).alias("out"))

    return made.select("record_id", F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("x")).select("record_id", "x.seq", "x.accepted")
