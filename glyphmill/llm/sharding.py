"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank is
(rank - u) / rows of its source, where u in (0, 1) is a seeded hash of the source; all
rows in the order of fractional ranks are cut into shards whose counts differ by one at
most.  Any stretch of that order holds each source in proportion, so every shard matches
the mixture; the hash spreads sources of equal size, or of one row, over the order.

No task ranks a whole source.  Hashes are dealt into ranges, rows are ranked within a
range of a source, and the counts of the ranges before are added (first within groups of
ranges, then over the groups); fractional ranks, which are even over (0, 1), are dealt
and ranked likewise.

Defined results.  A null source is a source.  Null texts have size 1 (the end mark) and
the checksum of an empty text.  Rows that are equal in all that the order reads are
interchangeable and each gets a place.  Fewer rows than shards: some shards are empty.
Empty table: no rows.  Each row is carried whole; columns named shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import cut, pieces

SHARDS, SEED = 16, "shard-1"
RANGE_BYTES = 1 << 18
#: Ranges whose counts are added up in one task.
RANGES_AT_ONCE = 1024


def _placed(df: DataFrame, part: list[str], order: list[Column], bucket: str, out: str) -> DataFrame:
    """Adds ``out``: a row's place from 1 in ``order`` within ``part``, where ``bucket`` rises with the order."""
    before = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("n")).withColumn("super", F.floor(F.col(bucket) / RANGES_AT_ONCE))
    supers = counts.groupBy(*part, "super").agg(F.sum("n").alias("n")).select(*part, "super", before(part, "super").alias("ahead_of_super"))
    ahead = counts.select(*part, bucket, "super", before([*part, "super"], bucket).alias("ahead")).join(supers, [*part, "super"]).select(*part, bucket, (F.col("ahead") + F.col("ahead_of_super")).alias("ahead"))
    return df.join(ahead, [*part, bucket]).withColumn(out, F.col("ahead") + F.row_number().over(Window.partitionBy(*part, bucket).orderBy(*order))).drop("ahead")


def interleave(docs: DataFrame, *, shards: int = SHARDS, seed: str = SEED, checksum: str | Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source and, without ``checksum``, text) with the columns shard and slot."""
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("shard", "slot")]
    mark = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")) if checksum is None else checksum if isinstance(checksum, Column) else F.col(checksum)
    ranges = pieces(docs, RANGE_BYTES)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), mark.cast("string")).cast("binary"))
    rows = docs.select(F.struct(*own).alias("row"), F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").alias("id"), key.alias("key"))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    sizes = cut(rows.groupBy("no_source", "source").agg(F.count(F.lit(1)).alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    offset = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("no_source").cast("string"), "source").cast("binary")), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    rows = _placed(rows, ["no_source", "source"], [F.col("key"), F.col("id")], "range", "rank")
    rows = rows.join(sizes, ["no_source", "source"]).withColumn("fraction", (F.col("rank") - offset) / F.col("rows"))
    rows = rows.withColumn("band", F.floor(F.col("fraction") * ranges).cast("int"))
    rows = _placed(rows, [], [F.col(c) for c in ("fraction", "no_source", "source", "rank")], "band", "place").withColumn("place", F.col("place") - 1)
    shard = F.floor(F.col("place") * shards / F.lit(max(total, 1))).cast("int")
    placed = rows.select("row", "place", shard.alias("into"))
    return placed.select("row.*", F.col("into").alias("shard"), (F.col("place") - F.ceil(F.col("into") * F.lit(total) / shards)).cast("long").alias("slot"))


def assignments(docs: DataFrame, *, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row; texts don't travel."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")))
    placed = interleave(rows, shards=shards, seed=seed, checksum="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return assignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
