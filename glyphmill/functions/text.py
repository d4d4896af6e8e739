"""Text and identity helpers that every layer shares, as Column functions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANKS = "(?U)\\s"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def compact(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def nonblank(c: Column) -> Column:
    """The text, or null where it has nothing but white space."""
    return F.when(F.length(strip(c)) > 0, c)


def first_nonblank(*cs: Column) -> Column:
    return F.coalesce(*(nonblank(c) for c in cs))


def source_lines(c: Column) -> Column:
    """Lines with their terminators (CRLF, CR or LF); the last may have none."""
    return F.regexp_extract_all(c, F.lit("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$"), F.lit(0))


def line_feeds(c: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(c, "\\r\\n?", "\n")


def short_id(prefix: str, identity: Column, size: int = 20) -> Column:
    """Prefix and the first hex digits of the identity's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity.cast("binary"), 256), 1, size))


def joined_id(prefix: str, *parts: Column, size: int = 20) -> Column:
    return short_id(prefix, F.concat_ws("|", *parts), size)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def enum_name(c: Column) -> Column:
    """A type hint as an enumeration name: trimmed, upper case, blanks and hyphens as underscores."""
    return F.upper(F.translate(strip(c), "- ", "__"))


def owned_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def tokens(c: Column) -> Column:
    """Number of runs of non-blank characters; the default token counter."""
    return F.regexp_count(c, F.lit("\\S+"))


def truncate(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, ending in an ellipsis where cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC, white space compacted, case folded: how annotation values are compared."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def canonical_json(value) -> str:
    """Sorted keys, no blanks, no escapes of other scripts, no non-finite numbers."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical(s: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null where it can't be parsed strictly."""

    def one(x):
        if x is None:
            return None
        try:
            return canonical_json(json.loads(x))
        except ValueError:
            return None

    return s.map(one)
