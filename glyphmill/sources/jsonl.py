"""Strict JSON lines: reading with every bad line reported, upserts, and frozen datasets under content hashes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import studio


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with their file; :func:`numbered_lines` has their numbers too."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files with their file and number from 1.

    A number is the lines of the file's parts before, added to the place in the own part.  Parts are what Spark's reader splits
    files into, in the order of their first byte, so no file is read by one task; it is read twice, once to count.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("path", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("path", "begin", "first", "before")
    return rows.join(parts, ["path", "begin"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"), "line")


def line_issues(lines: DataFrame, key: str = "record_id") -> DataFrame:
    """Blank lines, lines that are no strict JSON object, and keys that come twice."""
    parsed = lines.withColumns({"canonical": T.canonical(F.col("line")), "id": F.get_json_object("line", f"$.{key}")})
    code = F.when(F.length(T.strip(F.col("line"))) == 0, F.lit("BLANK_LINE")).when(F.col("canonical").isNull() | ~F.col("canonical").startswith("{"), F.lit("NOT_A_JSON_OBJECT")).when(F.col("id").isNull(), F.lit("KEY_MISSING"))
    rows = parsed.withColumn("code", code)
    bad = rows.where("code is not null").select("file", "line", "code")
    twice = rows.where("code is null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"), F.min("line").alias("line")).where("n > 1").select("file", "line", F.lit("DUPLICATE_KEY").alias("code"))
    return bad.unionByName(twice)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed records; the read fails on any malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def save_many(old: DataFrame, new: DataFrame, path: str, key: str = "record_id") -> None:
    """Upserts by key and writes the sorted result to a new folder beside ``path``, which then takes its name."""
    spark = new.sparkSession
    made = studio.upsert(old, new, key).orderBy(key)
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    made.write.json(beside)
    _rename(spark, beside, path, replace=True)


def _rename(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """Gives a finished folder its name.  A folder that had the name is moved aside first and deleted last, so one of the two is there at any time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(conf)
    aside = None
    if fs.exists(b):
        if not replace:
            raise FileExistsError(target)
        aside = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}.{uuid.uuid4().hex}.old")
        if not fs.rename(b, aside):
            raise OSError(f"could not move {target} aside")
    if not fs.rename(a, b):
        if aside is not None:
            fs.rename(aside, b)
        raise OSError(f"could not rename {source}")
    if aside is not None:
        fs.delete(aside, True)


def freeze(cases: DataFrame, folder: str, provenance: dict, parts: int = 8) -> dict:
    """Writes cases by split with a manifest of hashes and counts; the folder appears whole or not at all and is never overwritten.

    ``cases``: split, case_id and payload (JSON text).  A split is written by up to ``parts`` tasks; its hash (:func:`studio.tree_hash`)
    doesn't depend on how many.
    """
    spark = cases.sparkSession
    beside = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    rows = cases.select("split", "case_id", T.canonical(F.col("payload")).alias("payload"))
    rows.repartition(3 * parts, "split", F.pmod(F.xxhash64("case_id"), F.lit(parts))).sortWithinPartitions("split", "case_id").write.partitionBy("split").json(beside + "/data")
    manifest = {"provenance": provenance, "splits": _splits(spark.read.json(beside + "/data"))}
    manifest["manifest_hash"] = studio.canonical_hash(manifest)
    spark.createDataFrame([(T.canonical_json(manifest),)], "value string").coalesce(1).write.text(beside + "/manifest")
    _rename(spark, beside, folder)
    return manifest


def _splits(cases: DataFrame) -> dict:
    hashes = studio.tree_hash(cases.withColumn("row_hash", F.sha2(T.canonical(F.col("payload")).cast("binary"), 256)), ["split"], "row_hash", "hash")
    counts = cases.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return {r.split: {"hash": r.hash, "cases": r.n} for r in hashes.join(counts, "split").collect()}


def verify(spark: SparkSession, folder: str) -> list[str]:
    """What is wrong with a frozen dataset; nothing if its splits and manifest are as they were written."""
    manifest = json.loads(spark.read.text(folder + "/manifest").first()[0])
    stated = manifest.pop("manifest_hash", None)
    issues = [] if studio.canonical_hash(manifest) == stated else ["MANIFEST_HASH_MISMATCH"]
    found = _splits(spark.read.json(folder + "/data"))
    for split in sorted({*manifest["splits"], *found}):
        want, have = manifest["splits"].get(split), found.get(split)
        if have is None or want is None:
            issues.append(f"SPLIT_{'MISSING' if have is None else 'UNEXPECTED'}:{split}")
        elif want["cases"] != have["cases"]:
            issues.append(f"COUNT_MISMATCH:{split}")
        elif want["hash"] != have["hash"]:
            issues.append(f"HASH_MISMATCH:{split}")
    return issues


# Materialised benchmarks


def member_issue(name: Column) -> Column:
    """Whether a member's name leaves its folder: absolute names, names of other stores, and parts that go up."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("MEMBER_MISSING")).when(name.startswith("/") | name.contains(":") | F.array_contains(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), F.lit("..")), F.lit("PATH_ESCAPES_ROOT"))


def load_benchmark(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Cases of a folder with manifest.json (benchmark_version, schema_version, cases of document_id, source_file, annotation_file, sha256), and their issues.

    Every source has the bytes that the manifest states; its annotation names the same document, hash, file and versions.
    Cases with an issue are left out.  Issues have the first code of each case.
    """
    case = "struct<document_id:string,source_file:string,annotation_file:string,sha256:string>"
    manifest = spark.read.schema(f"benchmark_version string, schema_version string, cases array<{case}>").option("multiLine", True).json(root.rstrip("/") + "/manifest.json")
    cases = manifest.select("benchmark_version", "schema_version", F.explode("cases").alias("c")).select("benchmark_version", "schema_version", "c.*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # names below the folder, as far as the folder's own name goes
    own = root.rstrip("/").rsplit("/", 1)[-1]
    files = files.select(F.regexp_extract("path", f".*/{_literal(own)}/(.*)$", 1).alias("name"), F.col("content"))
    sources = files.select(F.col("name").alias("source_file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("found_hash"))
    gold = "struct<document_id:string,benchmark_version:string,schema_version:string,source:struct<sha256:string,file_name:string>>"
    notes = files.select(F.col("name").alias("annotation_file"), F.from_json(F.col("content").cast("string"), gold).alias("gold"), F.col("content").cast("string").alias("annotation"))
    rows = cases.join(sources, "source_file", "left").join(notes, "annotation_file", "left")
    base = F.element_at(F.split("source_file", "/"), -1)
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    code = (
        F.coalesce(member_issue(F.col("source_file")), member_issue(F.col("annotation_file")), F.when(F.col("found_hash").isNull(), F.lit("SOURCE_UNREADABLE")).when(differs(F.col("found_hash"), F.col("sha256")), F.lit("SOURCE_HASH_MISMATCH"))
        .when(F.col("annotation").isNull(), F.lit("ANNOTATION_UNREADABLE")).when(differs(F.col("gold.document_id"), F.col("document_id")), F.lit("DOCUMENT_ID_MISMATCH")).when(differs(F.col("gold.source.sha256"), F.col("sha256")), F.lit("GOLD_HASH_MISMATCH"))
        .when(differs(F.col("gold.source.file_name"), base), F.lit("FILE_NAME_MISMATCH")).when(differs(F.col("gold.benchmark_version"), F.col("benchmark_version")), F.lit("BENCHMARK_VERSION_MISMATCH")).when(differs(F.col("gold.schema_version"), F.col("schema_version")), F.lit("SCHEMA_VERSION_MISMATCH")))
    )
    rows = rows.withColumn("code", code)
    return rows.where("code is null").select("document_id", "source_file", "annotation_file", "sha256", "annotation"), rows.where("code is not null").select("document_id", "source_file", "code")


def _literal(name: str) -> str:
    return "\\Q" + name.replace("\\E", "") + "\\E"


def freeze_input_issues(cases: DataFrame, assignments: DataFrame, facts: dict[str, str | None], wanted: dict[str, str | None], required: tuple[str, ...] = ()) -> DataFrame:
    """Why compiled cases may not be frozen: required splits without cases, splits of cases and of assignments that differ, and facts that
    differ from those wanted (hashes and versions by name), one row each."""
    spark = cases.sparkSession
    held, dealt = cases.select("split").distinct(), assignments.select("split").distinct()
    needed = spark.createDataFrame([(s,) for s in required], "split string")
    missing = needed.join(held, "split", "left_anti").select(F.col("split").alias("subject"), F.lit("REQUIRED_SPLIT_MISSING").alias("code"))
    extra = held.join(dealt, "split", "left_anti").select(F.col("split").alias("subject"), F.lit("SPLIT_NOT_ASSIGNED").alias("code"))
    empty = dealt.join(held, "split", "left_anti").select(F.col("split").alias("subject"), F.lit("ASSIGNED_SPLIT_EMPTY").alias("code"))
    other = [(k, f"{k.upper()}_MISMATCH") for k in sorted(wanted) if facts.get(k) != wanted[k]]
    return missing.unionByName(extra).unionByName(empty).unionByName(spark.createDataFrame(other, "subject string, code string"))
