"""Anchors and references that elements state in their attributes (a JSON object), parsed strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The attributes, and the longest kind and id.
ANCHOR, REFERENCES = "source_anchor", "source_references"
KIND_CHARS, ID_CHARS = 128, 256


def _kind(v: Column) -> Column:
    """What a value is: OBJECT, ARRAY, STRING and so on; VOID for null, null for none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _word(v: Column, longest: int) -> Column:
    """A string that is not blank, has no blanks at its ends and is not too long; else null."""
    s = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when((T.strip(s) == s) & (F.length(s) > 0) & (F.length(s) <= longest), s)


def source_references(elements: DataFrame, attributes: str = "attributes") -> DataFrame:
    """A row for each anchor and reference of elements (document_id, element_id, attributes): field, place, kind, id, and a code where it breaks a rule.

    The anchor is an object and the references are a list of objects, each with a kind and an id.  An attribute that is missing or null gives
    no row; one of another shape gives one row with its code; attributes that are no JSON object give one row as well.
    """
    parsed = F.try_parse_json(F.col(attributes))
    rows = elements.select("document_id", "element_id", F.col(attributes).alias("gm_json"), parsed.alias("gm_v"))
    whole = F.col("gm_json").isNotNull() & ((F.col("gm_v").isNull()) | (_kind(F.col("gm_v")) != "OBJECT"))
    get = lambda name: F.try_variant_get(F.col("gm_v"), f"$.{name}", "variant")
    entry = lambda field, place, value, code: F.struct(F.lit(field).alias("field"), place.cast("int").alias("place"), value.alias("value"), code.cast("string").alias("code"))
    none = F.array().cast("array<struct<field:string,place:int,value:variant,code:string>>")
    nothing, no_place, no_code = F.lit(None).cast("variant"), F.lit(None), F.lit(None)
    stated = lambda v: v.isNotNull() & (_kind(v) != "VOID")
    anchor, listed = get(ANCHOR), get(REFERENCES)
    one = F.when(~stated(anchor), none).when(_kind(anchor) == "OBJECT", F.array(entry(ANCHOR, no_place, anchor, no_code))).otherwise(F.array(entry(ANCHOR, no_place, nothing, F.lit("NOT_AN_OBJECT"))))
    items = F.transform(F.try_variant_get(listed, "$", "array<variant>"), lambda v, i: F.when(_kind(v) == "OBJECT", entry(REFERENCES, i, v, no_code)).otherwise(entry(REFERENCES, i, nothing, F.lit("NOT_AN_OBJECT"))))
    many = F.when(~stated(listed), none).when(_kind(listed) == "ARRAY", items).otherwise(F.array(entry(REFERENCES, no_place, nothing, F.lit("NOT_A_LIST"))))
    bad = F.array(entry("attributes", no_place, nothing, F.lit("NOT_A_JSON_OBJECT")))
    out = rows.select("document_id", "element_id", F.explode(F.when(whole, bad).otherwise(F.concat(F.coalesce(one, none), F.coalesce(many, none)))).alias("e")).select("document_id", "element_id", "e.*")
    kind, name = _word(F.try_variant_get("value", "$.kind", "variant"), KIND_CHARS), _word(F.try_variant_get("value", "$.id", "variant"), ID_CHARS)
    out = out.withColumns({"kind": kind, "id": name})
    code = F.coalesce("code", F.when(F.col("kind").isNull(), F.lit("KIND_INVALID")).when(F.col("id").isNull(), F.lit("ID_INVALID")))
    good = code.isNull()
    return out.select("document_id", "element_id", "field", "place", F.when(good, F.col("kind")).alias("kind"), F.when(good, F.col("id")).alias("id"), code.alias("code"))
