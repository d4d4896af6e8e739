"""Review tasks as payloads for a review tool, and its responses as submissions: projections of rows, without any call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .studio import STATES

CONTRACT = "1"
DECISION = "struct<annotation_type:string,state:string,value:string,notes:string>"
NOTES_CHARS, DECISIONS_CHARS = 8192, 131_072


def _json(**fields: Column) -> Column:
    """A JSON object with its keys in order, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def review_tasks(records: DataFrame) -> DataFrame:
    """Payloads of records (record_id, batch_id, guideline_version, decision_hash, document_id, target_id, raw_text, normalized_text, evaluated_types, decisions).

    ``task_hash`` covers all that a reviewer sees and decides on; a task whose hash is unchanged need not be sent again.
    """
    context = _json(evaluated_types=F.array_sort("evaluated_types"), current_decisions=F.col("decisions"), document_id=F.col("document_id"), target_id=F.col("target_id"))
    raw, plain = F.coalesce("raw_text", F.lit("")), F.coalesce("normalized_text", F.lit(""))
    whole = _json(record_id=F.col("record_id"), batch_id=F.col("batch_id"), guideline_version=F.col("guideline_version"), expected_decision_hash=F.col("decision_hash"), raw_text=raw, normalized_text=plain, context=context, contract_version=F.lit(CONTRACT))
    return records.select("record_id", "batch_id", "guideline_version", F.col("decision_hash").alias("expected_decision_hash"), raw.alias("raw_text"), plain.alias("normalized_text"), context.alias("review_context"), F.lit(CONTRACT).alias("contract_version"), T.content_hash(whole).alias("task_hash"))


def submissions(responses: DataFrame) -> DataFrame:
    """Responses (record_id, contract_version, guideline_version, outcome, decisions_json, notes, ...) with parsed ``decisions``, or the first code against them.

    Blank decisions are none (null).  Others must be a JSON list whose items name a type and a known state.
    """
    parsed = F.try_parse_json("decisions_json")
    blank = F.length(T.strip(F.coalesce("decisions_json", F.lit("")))) == 0
    kind = F.regexp_extract(F.schema_of_variant(parsed), "^[A-Z]+", 0)
    items = F.from_json("decisions_json", f"array<{DECISION}>")
    wrong = F.exists(items, lambda x: x.isNull() | x["annotation_type"].isNull() | ~F.coalesce(x["state"].isin(*STATES), F.lit(False)))
    guideline = F.col("guideline_version")
    code = (
        F.when(~F.coalesce(F.col("contract_version") == CONTRACT, F.lit(False)), F.lit("CONTRACT_UNSUPPORTED")).when(F.coalesce((T.strip(guideline) != guideline) | (F.length(guideline) == 0), F.lit(True)), F.lit("GUIDELINE_NOT_TRIMMED"))
        .when(F.col("notes").isNotNull() & ((F.length(T.strip(F.col("notes"))) == 0) | (F.length("notes") > NOTES_CHARS)), F.lit("NOTES_INVALID")).when(F.length("decisions_json") > DECISIONS_CHARS, F.lit("DECISIONS_TOO_LONG"))
        .when(~blank & parsed.isNull(), F.lit("DECISIONS_NOT_JSON")).when(~blank & (kind != "ARRAY"), F.lit("DECISIONS_NOT_A_LIST")).when(~blank & F.coalesce(wrong, F.lit(True)), F.lit("DECISION_INVALID"))
    )
    made = responses.withColumn("code", code)
    return made.withColumn("decisions", F.when(F.col("code").isNull() & ~blank, items)).drop("decisions_json")
