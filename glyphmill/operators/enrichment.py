"""Enrichment of retrieval units: approval of annotations by the quality gate, choice, rendering within two budgets, references.

Tables: units (document_id, unit_id, text, token_count, max_tokens, version, refs), scoped annotations
(those of :func:`semantics.unit_scopes` with provider columns), gate decisions (one a capability slice).
The source text of a unit stays as it is; what is added stands before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .semantics import type_rank

VERSION = "3"
#: What an annotation and a decision must have in common for the decision to hold.
SLICE = ["provider", "provider_version", "configuration_hash", "capability_hash", "policy_hash", "capability", "type", "target_kind", "language"]
REFS = "array<struct<id:string,type:string,value:string,source:string,confidence:double>>"


@dataclass(frozen=True)
class EnrichmentPolicy:
    """Fixed values of the choice; None: no budget."""

    min_confidence: float = 0.75
    most: int = 6
    tokens: int | None = 96
    value_chars: int = 384
    hidden_from: int = 2048
    methods: tuple[str, ...] = ("RULE_PRIOR", "CALIBRATED_PROBABILITY", "EMPIRICAL_PROVIDER_SCORE")
    types: tuple[str, ...] | None = None
    contexts: bool = True
    regions: bool = False
    subdocuments: bool = False
    header: str = "Semantic context:"


def approved(decisions: DataFrame) -> DataFrame:
    """Slices that a gate approves; one that it also rejects, or that two decisions state, does not count."""
    made = decisions.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("least"), F.max("status").alias("most"))
    return made.where((F.col("n") == 1) & (F.col("least") == "APPROVED") & (F.col("most") == "APPROVED")).select(*SLICE)


def gate_conflicts(decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Providers of a gate whose version or hashes a document's manifest (document_id, provider, ...) does not state, with the first code."""
    stated = ["provider_version", "configuration_hash", "capability_hash", "policy_hash"]
    wanted = decisions.select("provider", *[F.col(c).alias(f"g_{c}") for c in stated]).distinct()
    # one list of the gate's providers beside each document; a gate is a short table
    gate = wanted.agg(F.collect_list(F.struct("*")).alias("gate")).withColumn("one", F.lit(1))
    stated_ = manifest.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("provider", F.struct(*stated)))).alias("held")).withColumn("one", F.lit(1))
    rows = stated_.join(gate, "one").select("document_id", "held", F.explode("gate").alias("g")).select("document_id", F.try_element_at("held", F.col("g.provider")).alias("m"), "g.*")
    code = F.when(F.col("m").isNull(), F.lit("PROVIDER_NOT_IN_MANIFEST"))
    for c in stated:
        code = code.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"g_{c}")), F.lit(f"{c.upper()}_DIFFERS"))
    return rows.withColumn("code", code).where("code is not null").select("document_id", "provider", "code")


def judged(scoped: DataFrame, decisions: DataFrame, policy: EnrichmentPolicy = EnrichmentPolicy()) -> DataFrame:
    """``outcome`` of each annotation for each of its units: the first of disallowed type, untrusted confidence, unevaluated, low confidence, else candidate."""
    p = policy
    kind = F.element_at(F.create_map(F.lit(0), F.lit("ELEMENT"), F.lit(1), F.lit("LOGICAL_UNIT")), F.col("scope_rank"))
    open_ = F.lit(True)
    for rank, on in ((2, p.contexts), (3, p.regions), (4, p.subdocuments)):
        if not on:
            open_ = open_ & (F.col("scope_rank") != rank)
    rows = scoped.where(open_).withColumn("target_kind", F.when(F.col("scope_rank") < 2, kind))
    rows = rows.join(approved(decisions).withColumn("approved", F.lit(True)), SLICE, "left")
    outside = F.lit(False) if p.types is None else ~F.col("type").isin(*p.types)
    outcome = (
        F.when((F.col("type") == "CUSTOM") | outside, F.lit("DISALLOWED_TYPE")).when(~F.coalesce(F.col("method").isin(*p.methods), F.lit(False)), F.lit("UNTRUSTED_CONFIDENCE"))
        .when(F.col("approved").isNull(), F.lit("UNEVALUATED")).when(F.col("confidence") < p.min_confidence, F.lit("LOW_CONFIDENCE")).otherwise("CANDIDATE")
    )
    return rows.withColumn("outcome", outcome).drop("approved")


def chosen(candidates: DataFrame, policy: EnrichmentPolicy = EnrichmentPolicy()) -> DataFrame:
    """Candidates of each unit in order of scope, confidence, type, document order and id, equal (type, value) once, with their ``place``."""
    order = [F.col("scope_rank"), F.desc("confidence"), type_rank(F.col("type")), F.col("ord"), F.col("annotation_id")]
    unit = ["document_id", "unit_id"]
    rows = candidates.withColumn("gm_value", T.folded(F.coalesce("value", F.lit(""))))
    first = rows.withColumn("gm_n", F.row_number().over(Window.partitionBy(*unit, "type", "gm_value").orderBy(*order))).where("gm_n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*unit).orderBy(*order))).where(F.col("place") <= policy.most).drop("gm_n", "gm_value")


def rendered(kind: Column, mode: Column, value: Column, limit: int) -> Column:
    """A label, and the value of extractive annotations, compacted and cut."""
    label = F.initcap(F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))
    return F.when(mode == "EXTRACTIVE", F.concat(label, F.lit(": "), T.truncate(T.compact(F.coalesce(value, F.lit(""))), limit))).otherwise(label)


def enrich_units(units: DataFrame, scoped: DataFrame, decisions: DataFrame, policy: EnrichmentPolicy = EnrichmentPolicy()) -> DataFrame:
    """Units with what approved annotations add: id, text, token_count, refs, version, and the ids chosen, rendered and skipped for a budget.

    Lines are tried in order; one with which the block or the whole text would be too long is skipped, and the next is tried.
    All chosen annotations are referred to, those that are there already once; values that a model made up or that are very long
    stay hidden.  Units without chosen annotations come back as they are.
    """
    p = policy
    picked = chosen(judged(scoped, decisions, p).where("outcome = 'CANDIDATE'"), p)
    hidden = (F.col("mode") == "GENERATIVE") | (F.length("value") > p.hidden_from)
    ref = F.struct(F.col("annotation_id").alias("id"), "type", F.when(~hidden, F.col("value")).alias("value"), "source", F.col("confidence").cast("double").alias("confidence"))
    item = F.struct("place", rendered(F.col("type"), F.col("mode"), F.col("value"), p.value_chars).alias("line"), ref.alias("ref"))
    items = picked.groupBy("document_id", "unit_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.array().cast("array<string>")

    def block(lines: Column) -> Column:
        return F.array_join(F.concat(F.array(F.lit(p.header)), lines), "\n")

    def step(a: Column, x: Column) -> Column:
        lines = F.concat(a["lines"], F.array(x["line"]))
        full = F.coalesce(T.tokens(F.concat(block(lines), F.lit("\n"), F.col("text"))) > F.col("max_tokens"), F.lit(False))
        if p.tokens is not None:
            full = full | (T.tokens(block(lines)) > p.tokens)
        taken = F.struct(lines.alias("lines"), F.concat(a["rendered"], F.array(x["ref"]["id"])).alias("rendered"), a["skipped"].alias("skipped"))
        return F.when(full, F.struct(a["lines"].alias("lines"), a["rendered"].alias("rendered"), F.concat(a["skipped"], F.array(x["ref"]["id"])).alias("skipped"))).otherwise(taken)

    df = units.join(items, ["document_id", "unit_id"], "left")
    made = F.aggregate("items", F.struct(none.alias("lines"), none.alias("rendered"), none.alias("skipped")), step)
    df = df.withColumn("made", made)
    refs = F.coalesce(F.col("refs").cast(REFS), F.array().cast(REFS))
    known = F.transform(refs, lambda r: r["id"])
    added = F.filter(F.transform("items", lambda x: x["ref"]), lambda r: ~F.array_contains(known, r["id"]))
    text = F.when(F.size("made.lines") > 0, F.concat(block(F.col("made.lines")), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    ids = F.transform("items", lambda x: x["ref"]["id"])
    there = F.col("items").isNotNull()
    identity = F.concat_ws("|", F.lit(VERSION), "document_id", "unit_id", F.array_join(ids, ","), F.array_join("made.rendered", ","), text)
    new = lambda a, b: F.when(there, a).otherwise(b)
    return df.select(
        "document_id", new(T.short_id("ru_", identity, 32), F.col("unit_id")).alias("unit_id"), F.when(there, F.col("unit_id")).alias("base_unit_id"), new(text, F.col("text")).alias("text"),
        new(T.tokens(text), F.col("token_count")).alias("token_count"), new(F.concat(refs, added), refs).alias("refs"), new(F.concat("version", F.lit("+sem" + VERSION)), F.col("version")).alias("version"),
        F.coalesce(ids, none).alias("chosen"), F.coalesce("made.rendered", none).alias("rendered"), F.coalesce("made.skipped", none).alias("skipped"),
    )


def enrichment_counts(scoped: DataFrame, decisions: DataFrame, policy: EnrichmentPolicy = EnrichmentPolicy()) -> DataFrame:
    """How many annotations of each document were left out for each reason, each once."""
    rows = judged(scoped, decisions, policy).where("outcome != 'CANDIDATE'")
    return rows.groupBy("document_id", "outcome").agg(F.count_distinct("annotation_id").alias("n"))
