"""Functions of rows that hold the objects of a page or of a candidate as arrays: Spark deals and groups the rows, Arrow brings them by batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def _plain(column: pa.Array) -> list:
    """Values of a column by way of numpy, where its type has one."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


def values(column: pa.Array) -> list:
    """Values of a column; structs come as tuples, lists of structs as lists of tuples."""
    if isinstance(column, pa.StructArray):
        return list(zip(*map(_plain, column.flatten()), strict=True))
    if not isinstance(column, pa.ListArray) or not pa.types.is_struct(column.type.value_type):
        return _plain(column)
    flat, out, at = values(column.flatten()), [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def _bits(column: pa.Array) -> list[bytes | None] | None:
    """The bytes of each row's numbers: rows of equal bytes have equal values.  Nothing for a column that holds more than numbers."""
    lists = isinstance(column, pa.ListArray)
    flat = column.flatten() if lists else column
    parts = []
    for child in flat.flatten() if isinstance(flat, pa.StructArray) else [flat]:
        if not (pa.types.is_integer(child.type) or pa.types.is_floating(child.type)):
            return None
        if child.null_count:
            parts.append(child.is_null().to_numpy(zero_copy_only=False))
            child = child.fill_null(0)
        parts.append(child.to_numpy(zero_copy_only=False))
    each = [np.ascontiguousarray(x).view(np.uint8).reshape(len(flat), x.itemsize) for x in parts]
    wide = sum(x.shape[1] for x in each)
    whole = np.concatenate(each, axis=1).tobytes() if each else b""
    if not lists:
        return [whole[at : at + wide] for at in range(0, wide * len(flat), wide)]
    out, at = [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else whole[at : at + n * wide])
        at += (n or 0) * wide
    return out


def _once(columns: list[pa.Array]) -> tuple[list[int], list[int]] | None:
    """The first of each set of equal rows, and for every row the number of its set; nothing where no two are known to be equal."""
    bits = [_bits(c) for c in columns]
    if any(b is None for b in bits):
        return None
    found: dict[tuple, int] = {}
    firsts, sets = [], []
    for at, key in enumerate(zip(*bits, strict=True)):
        n = found.setdefault(key, len(firsts))
        if n == len(firsts):
            firsts.append(at)
        sets.append(n)
    return (firsts, sets) if len(firsts) < len(sets) else None


def by_row(kind: str, f: Callable, first: Callable | None = None):
    """A function of columns that gives ``f`` of each row's values as ``kind``; structs in it are given as tuples.

    With ``first``, ``f`` gets what that makes of the first column's value.  Both are then called once for equal values of a batch, so they
    must not change what they get: pages of one form have equal rulings.  Nothing is kept from one batch to the next.
    """
    made = DataType.fromDDL(kind)
    arrow = to_arrow_type(made)

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*v) for v in zip(*map(values, columns), strict=True)], type=arrow)

    def led(*columns: pa.Array) -> pa.Array:
        rows = _once(list(columns))
        if rows:
            columns = tuple(c.take(pa.array(rows[0])) for c in columns)
        heads = _once([columns[0]])
        made_of = [first(v) for v in values(columns[0].take(pa.array(heads[0])) if heads else columns[0])]
        lead = [made_of[i] for i in heads[1]] if heads else made_of
        out = pa.array([f(*v) for v in zip(lead, *map(values, columns[1:]), strict=True)], type=arrow)
        return out.take(pa.array(rows[1])) if rows else out

    return F.arrow_udf(led if first else run, made)
