"""Removal of long repeated passages with suffix arrays made by the difference-cover algorithm.

A byte goes if a string of ``min_match`` bytes that covers it also starts in a document
with a smaller doc_id.

How suffixes get to tasks.  Equal strings must meet in one task, and no task may hold all
suffixes.  Each window of ``min_match`` bytes has an *anchor*: the least hash of its short
grams.  It depends on the window's bytes alone, so equal windows have equal anchors, and
neighbouring windows mostly share one; a run of windows with one anchor, with the bytes
they cover, is a *piece*.

1. Workers send the anchors of their texts, packed, to ranges of anchors; a range answers
   which anchors stand in more than one document, with a row for each bucket of texts, so that
   answers grow with the ranges and not with texts times ranges.  Windows with other anchors have no match.
2. The pieces of those anchors are made; equal ones become one with the least doc_id of
   all.  An anchor with more than ``HOT`` different pieces has them cut into single windows,
   which are dealt by their own bytes, so that no anchor makes a large group.
3. A task has some anchors.  Its different pieces become one text, and the difference-cover
   algorithm sorts its suffixes: sampled triples (positions 1 and 2 modulo 3) are sorted and
   named, names that are not yet unique are sorted by recursion until they stand for
   ``min_match`` bytes, and the remaining suffixes are sorted by their first letter and the
   rank behind it, and merged.  Adjacent suffixes whose first ``min_match`` bytes are equal
   form a group, with the least doc_id of its pieces.
4. Windows whose group has a smaller doc_id than their document become removal spans.

Defined results.  Null text: empty, nothing removed, digest of no bytes.  Texts shorter than
``min_match``: nothing removed.  A null doc_id is greater than all others; two rows with equal
(or both null) doc_ids do not remove each other's bytes.  Repeated rows: each gets the same
result.  Very long texts: whole, worked on in blocks.  Empty table: no rows.  Other columns
are not read.  Removed bytes may be parts of characters, so what stays is binary.
Anchors have 64 bits; two that are equal by chance only make a piece to compare more.
Rows and pieces are told apart by 64 and 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .layout import discard, pieces, stored

MIN_MATCH = 50
#: Different pieces of one anchor above which they are cut into windows.
HOT = 1 << 14
#: Windows of one piece at most.
LONGEST_RUN = 256
#: Planner's bytes of text for each range of anchors, and of pieces for each suffix array.
RANGE_BYTES, ARRAY_BYTES = 16 << 20, 512 << 10
ROWS_AT_ONCE = 1 << 14
#: Crowded anchors of which a copy goes to each executor; more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 16
LAST_ID = (1 << 63) - 1

_ASKED = pa.schema([("range", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])
_KNOWN = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])
_PIECES = pa.schema([("anchor", pa.int64()), ("same", pa.int64()), ("windows", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("piece", pa.binary()), ("most", pa.int64())])
_LEAST = pa.schema([("anchor", pa.int64()), ("same", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("least", pa.int64())])


def runs(data: np.ndarray, offsets: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows, row and hash of bytes of each run of windows with one anchor."""
    gram = max(1, 2 * min_match // 5)
    width, n = min_match - gram + 1, len(data)
    if n < min_match:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64)
    power, inverse = W._upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        least = W.mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = np.zeros(n + 1, np.int32)
    whole = np.diff(offsets) >= min_match
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - min_match + 1, -1)
    inside = np.cumsum(inside)[: len(least)] > 0
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    edge[offsets[:-1][whole]] = True
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(least)))
    kept = inside[first]
    first, length = first[kept], length[kept]
    parts = -(-length // LONGEST_RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, length = np.repeat(first, parts) + nth * LONGEST_RUN, np.minimum(np.repeat(length, parts) - nth * LONGEST_RUN, LONGEST_RUN)
    low = least[first]  # a least hash is small: its lower half, which is even, goes first
    with np.errstate(over="ignore"):
        same = W.mix((total[first + length + min_match - 1] - total[first]) * inverse[first] + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (low << np.uint64(32)) | (low >> np.uint64(32)), first, length, np.searchsorted(offsets, first, side="right") - 1, same


def _blocks(column: pa.Array, min_match: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For blocks of about one MiB: bytes, their offsets, the row of each text part, the part's place in its text, and the block's place in the column; parts of one text overlap by ``min_match`` - 1 bytes."""
    data, offsets = W.utf8(column)
    for a, b in W.blocks(offsets):
        start, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - start <= 2 * W.BLOCK:
            yield data[start:end], offsets[a : b + 1] - start, np.arange(a, b), np.zeros(b - a, np.int64), start
            continue
        for x in range(start, end, W.BLOCK):  # one long text
            part = data[x : min(x + W.BLOCK + min_match - 1, end)]
            yield part, np.array([0, len(part)]), np.array([a]), np.array([x - start]), x


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _ask(ranges: int, min_match: int):
    """Anchors of each batch, to their ranges.  Those of several rows of one batch need no answer: they go once, without an owner, and straight to their rows' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            found = [(anchor, rows[row]) for data, offsets, rows, _, _ in _blocks(batch.column(1), min_match) for anchor, _, _, row, _ in [runs(data, offsets, min_match)]]
            anchor, row = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
            if len(anchor):
                yield _questions(anchor, row, keys, ranges)
            del batch, found, anchor, row
            W.release()

    return run


def _grouped(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each anchor begins in an ascending list of them, and the group of each place."""
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _by_bucket(anchor: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """For each bucket of keys: its number, its anchors in order, the place of each one's key, and the keys."""
    bucket = np.mod(key, buckets)
    order = np.lexsort((anchor, bucket))
    anchor, key, bucket = anchor[order], key[order], bucket[order]
    for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1) if len(key) else []:
        held, place = np.unique(key[part], return_inverse=True)
        yield int(bucket[part[0]]), W.pack_sorted(anchor[part]), W.pack(place.reshape(-1)), held.tobytes()


def _questions(anchor: np.ndarray, row: np.ndarray, keys: np.ndarray, ranges: int) -> pa.RecordBatch:
    order = np.argsort(anchor)
    anchor, key = anchor[order], keys[row[order]]
    begins, group = _grouped(anchor)
    more = np.diff(np.append(begins, len(anchor)))[group] > 1
    # most stand once in a batch; of the others, each (anchor, key) counts once
    again, own = anchor[more], key[more]
    order = np.lexsort((own, again))
    again, own = again[order], own[order]
    distinct = np.ones(len(again), bool)
    distinct[1:] = (again[1:] != again[:-1]) | (own[1:] != own[:-1])
    again, own = again[distinct], own[distinct]
    heads, group = _grouped(again)
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    out: dict[str, list] = {name: [] for name in _ASKED.names}

    def add(*values) -> None:
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)

    for bucket, *packed in _by_bucket(again[several], own[several], ranges):
        add(bucket, bucket, *packed)
    first = np.zeros(len(again), bool)
    first[heads] = True
    shown = ~several | first
    asked = np.concatenate((anchor[~more], again[shown]))
    key = np.concatenate((key[~more], own[shown]))
    shared = np.concatenate((np.zeros(np.count_nonzero(~more), bool), several[shown]))
    order = np.argsort(asked)
    asked, key, shared = asked[order], key[order], shared[order]
    to = ((asked >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(to)) + 1):
        held, place = np.unique(key[part], return_inverse=True)
        add(int(to[part[0]]), None, W.pack_sorted(asked[part]), W.pack(np.where(shared[part], 0, place.reshape(-1) + 1)), held.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ASKED], schema=_ASKED)


def _answer(buckets: int):
    """Which of the anchors of a range stand in several documents, to the buckets of the documents that asked."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("bucket"))).select(_KNOWN.names)
        questions = table.filter(pc.is_null(table.column("bucket")))
        asked = [(W.unpack_sorted(a), W.unpack(o).astype(np.int64), np.frombuffer(k, np.int64)) for a, o, k in zip(*(questions.column(c).to_pylist() for c in _KNOWN.names[1:]), strict=True)]
        found: list[tuple] = []
        if asked:
            anchor = np.concatenate([a for a, _, _ in asked])
            several = np.concatenate([o == 0 for _, o, _ in asked])
            key = np.concatenate([np.concatenate((np.zeros(1, np.int64), k))[o] for _, o, k in asked])
            del asked
            order = np.argsort(anchor)
            anchor, key, several = anchor[order], key[order], several[order]
            begins, group = _grouped(anchor)
            met = np.logical_or.reduceat(several, begins) | (np.minimum.reduceat(key, begins) != np.maximum.reduceat(key, begins))
            known = met[group] & ~several
            found = list(_by_bucket(anchor[known], key[known], buckets))
        made = pa.table([pa.array([x[i] for x in found], f.type) for i, f in enumerate(_KNOWN)], schema=_KNOWN)
        W.release()
        return pa.concat_tables([own.cast(_KNOWN), made])

    return run


def _cut(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes of spans as binary values; spans of no bytes are null."""
    ends = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(ends[-1], np.uint8)
    for a, b in W.blocks(ends):
        at = np.arange(ends[a], ends[b]) - np.repeat(ends[a:b] - first[a:b], length[a:b])
        out[ends[a] : ends[b]] = data[at]
    return pa.Array.from_buffers(pa.binary(), len(first), [pa.array(length > 0).buffers()[1], pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def _make_pieces(min_match: int):
    """A row for each piece at each of its places.  Of equal pieces in a batch one row, that of the least id, carries the bytes and the greatest id.

    Rows come in order of their bucket, with its answers (and keys to be left out) before its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, heard, left_out, asked = None, [], [], None
        for batch in batches:
            of, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy() > 0
            edges = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(of)], strict=True) if len(of) else []:
                if of[a] != bucket:
                    bucket, heard, left_out, asked = of[a], [], [], None
                texts = a + int(np.count_nonzero(~is_text[a:b]))
                for anchors, owners, keys, key in zip(*(batch.column(c).slice(a, texts - a).to_pylist() for c in (5, 6, 7, 2)), strict=True):
                    if anchors is None:
                        left_out.append(key)
                    else:
                        heard.append(W.pair(W.unpack_sorted(anchors), np.frombuffer(keys, np.int64)[W.unpack(owners).astype(np.int64)].view(np.uint64)))
                if texts < b:
                    if asked is None:
                        asked, heard = np.unique(np.concatenate([np.zeros(0, np.uint64), *heard])), []
                    part = batch.slice(texts, b - texts)
                    part = part.filter(pa.array(~np.isin(part.column(2).to_numpy(), left_out)))
                    yield from _pieces_of(part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4), asked, min_match)
                    del part
            del batch
            W.release()

    return run


def _pieces_of(keys: np.ndarray, ids: np.ndarray, texts: pa.Array, asked: np.ndarray, min_match: int) -> Iterator[pa.RecordBatch]:
    """The pieces of texts whose (anchor, key) was ``asked``, a sorted list."""
    parts = []
    for data, offsets, rows, begun, origin in _blocks(texts, min_match):
        anchor, first, length, row, same = runs(data, offsets, min_match)
        own = W.pair(anchor, keys[rows[row]].view(np.uint64))
        kept = asked[np.minimum(np.searchsorted(asked, own), len(asked) - 1)] == own if len(asked) else np.zeros(len(own), bool)
        anchor, first, length, row, same = anchor[kept], first[kept], length[kept], row[kept], same[kept]
        parts.append((anchor, same, length, rows[row], first - offsets[row] + begun[row], first + origin))
    anchor, same, length, text, start, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 5)
    id_ = ids[text]
    order = np.lexsort((id_, same, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[order][1:] != anchor[order][:-1]) | (same[order][1:] != same[order][:-1])
    most = np.zeros(len(order), np.int64)
    heads = np.flatnonzero(fresh)
    most[order[heads]] = id_[order[np.append(heads[1:], len(order)) - 1]] if len(heads) else 0
    carries = np.zeros(len(order), bool)
    carries[order[heads]] = True
    data = W.utf8(texts)[0]
    for a in range(0, len(order), ROWS_AT_ONCE):
        x = slice(a, a + ROWS_AT_ONCE)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[x].view(np.int64)), pa.array(same[x].view(np.int64)), pa.array(length[x].astype(np.int32)), pa.array(keys[text[x]]), pa.array(id_[x]), pa.array(start[x]), _cut(data, at[x], np.where(carries[x], length[x] + min_match - 1, 0)), pa.array(most[x])], schema=_PIECES)


def _ordered(key: np.ndarray) -> np.ndarray:
    """Places of keys in ascending order."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits < 64:
        packed = (key << bits) | np.arange(len(key))
        packed.sort()
        return packed & ((1 << bits) - 1)
    return np.argsort(key)


def suffix_array(text: np.ndarray, depth: int | None = None, cover: int = 1) -> np.ndarray:
    """Suffixes of a sequence of non-negative numbers in order, by the difference cover {1, 2} modulo 3.

    With ``depth``, in the order of their first ``depth`` letters at least: names are not sorted
    further once they stand for as many.  ``cover`` is the number of letters that one number stands for.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate((text.astype(np.int64) + 1, np.zeros(3, np.int64)))
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    # sampled triples, sorted and named
    base = int(s.max()) + 1
    head = s[sample] * base + s[sample + 1]
    if base >= 1 << 20:
        head = np.unique(head, return_inverse=True)[1].reshape(-1)
    triple = head * base + s[sample + 2]
    order = _ordered(triple)
    ordered = triple[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if not fresh.all() and (depth is None or 3 * cover < depth):
        name = np.empty(len(sample), np.int64)
        name[order] = np.cumsum(fresh) - 1
        order = suffix_array(name, depth, 3 * cover)  # recursion on names
    sampled = sample[order]
    step = len(sample) + 2
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    if n % 3 == 1:  # the empty suffix behind a text of this length is sampled to close the first part
        sampled = sampled[sampled < n]
    # remaining suffixes: first letter, then the rank behind it
    rest = np.arange(0, n, 3)
    first = s[rest] * step + rank[rest + 1]
    order = _ordered(first)
    rest, first = rest[order], first[order]
    # merge: against samples of class 1 by (letter, rank), of class 2 by (two letters, rank); both are in order but for suffixes that are equal to ``depth``
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(np.sort(s[ones] * step + rank[ones + 1]), first)
    pairs = np.concatenate((s[twos] * base + s[twos + 1], s[rest] * base + s[rest + 1]))
    if 2 * base.bit_length() + step.bit_length() >= 63:
        pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    before += np.searchsorted(np.sort(pairs[: len(twos)] * step + rank[twos + 2]), pairs[len(twos) :] * step + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = np.maximum.accumulate(before) + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def _equal_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` bytes from each of two places are equal."""
    width = 1
    while 2 * width <= min(size, 8):
        width *= 2
    word = np.concatenate((text, np.zeros(size, np.uint8))).astype(np.uint64)
    have = 1
    while have < width:
        word = (word[: len(word) - have] << np.uint64(8 * have)) | word[have:]
        have *= 2
    same = np.ones(len(left), bool)
    for step in [*range(0, size - width + 1, width), size - width]:
        same &= word[left + step] == word[right + step]
    return same


def least_ids(texts: list[bytes], windows: np.ndarray, ids: np.ndarray, min_match: int) -> np.ndarray:
    """The least id of a piece that has it, for each window of each piece in turn."""
    lengths = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begins = np.cumsum(lengths + 1) - lengths - 1
    letters = data.astype(np.int64) + 1
    letters[begins + lengths] = 0  # ends of pieces; no window reaches over one
    piece = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(data), -1, np.int64)
    number[begins[piece] + place] = np.arange(len(piece))
    array = suffix_array(letters, min_match)
    array = array[number[array] >= 0]
    fresh = np.ones(len(array), bool)
    fresh[1:] = ~_equal_prefixes(data, array[:-1], array[1:], min_match)
    starts = np.flatnonzero(fresh)
    out = np.empty(len(piece), np.int64)
    if len(starts):
        out[number[array]] = np.minimum.reduceat(ids[piece[number[array]]], starts)[np.cumsum(fresh) - 1]
    return out


def _sort_suffixes(min_match: int):
    """For the different pieces of a table: runs of windows with the least id of each, where an occurrence has a greater one."""

    def run(table: pa.Table) -> pa.Table:
        anchor, same, offset, least, most = (table.column(c).to_numpy() for c in ("anchor", "same", "offset", "id", "most"))
        order = np.lexsort((least, offset, same, anchor))
        changed = lambda *columns: np.concatenate(([True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)))
        heads = np.flatnonzero(changed(anchor, same, offset))
        most = np.maximum.reduceat(most[order], heads)
        rows = order[heads]
        anchor, same, offset, least = anchor[rows], same[rows], offset[rows], least[rows]
        windows = table.column("windows").to_numpy()[rows].astype(np.int64)
        group = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        met = np.bincount(group)[group] > 1  # a piece alone with its anchor has no other to be compared with
        at = np.repeat(np.arange(len(rows)), windows)
        own = least[at]
        if met.any():
            own[met[at]] = least_ids(table.column("piece").take(pa.array(rows[met])).to_pylist(), windows[met], least[met], min_match)
        fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(at)))
        first = begin - (np.cumsum(windows) - windows)[at[begin]] + offset[at[begin]]
        kept = own[begin] < most[at[begin]]
        begin, length, first = begin[kept], length[kept], first[kept]
        W.release()
        return pa.table([pa.array(anchor[at[begin]]), pa.array(same[at[begin]]), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(own[begin])], schema=_LEAST)

    return run


def _remove(batches: Iterator[pa.RecordBatch], min_match: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.utf8(batch.column(1))
        spans, kept = [], []
        found = batch.column(2)
        for i in range(len(batch)):
            own, pairs = data[offsets[i] : offsets[i + 1]], found[i].as_py()
            if not pairs:
                spans.append([])
                kept.append(own.tobytes())
                continue
            at = np.array([(x["first"], x["windows"]) for x in pairs], np.int64)
            depth = np.bincount(at[:, 0], minlength=len(own) + 1) - np.bincount(at[:, 0] + at[:, 1] - 1 + min_match, minlength=len(own) + 1)
            gone = np.cumsum(depth)[: len(own)] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
            spans.append([{"first": x, "last": y - 1} for x, y in edges.tolist()])
            kept.append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        del batch, data, spans, kept
        W.release()


def remove_repeats(docs: DataFrame, *, min_match: int = MIN_MATCH, hot: int = HOT) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_bytes, the removed spans of bytes (both ends included) and the bytes that stay."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    id_ = F.coalesce("doc_id", F.lit(LAST_ID))
    ranges = pieces(docs.select("text"), RANGE_BYTES)
    asked = rows.select("key", "text").mapInArrow(_ask(ranges, min_match), "range int, bucket int, anchors binary, owners binary, keys binary")
    known, known_at = stored(asked.groupBy("range").applyInArrow(_answer(ranges), "bucket int, anchors binary, owners binary, keys binary"), "repeat-anchors")

    # whole texts that a smaller doc_id has go whole, and have no pieces that the other lacks
    same_text = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]
    texts = rows.where(F.octet_length("text") >= min_match).select("key", id_.alias("id"), (F.octet_length("text") - min_match + 1).cast("int").alias("windows"), *same_text)
    copies = texts.join(texts.groupBy("a", "b").agg(F.min("id").alias("least")), ["a", "b"]).where("least < id").select("key", "windows").distinct()
    copies, copies_at = stored(copies, "repeat-copies")

    # each bucket's answers and the copies in it, then its texts
    bucket, none = F.pmod("key", F.lit(ranges)).cast("int").alias("bucket"), F.lit(None)
    heard = known.select("bucket", F.lit(0).alias("kind"), none.cast("long").alias("key"), none.cast("long").alias("id"), none.cast("string").alias("text"), "anchors", "owners", "keys")
    absent = [none.cast("binary").alias(c) for c in ("anchors", "owners", "keys")]
    out = copies.select(bucket, F.lit(0).alias("kind"), "key", none.cast("long").alias("id"), none.cast("string").alias("text"), *absent)
    held = rows.where(F.octet_length("text") >= min_match).select(bucket, F.lit(1).alias("kind"), "key", id_.alias("id"), "text", *absent)
    held = heard.unionByName(out).unionByName(held).repartition(ranges, "bucket").sortWithinPartitions("bucket", "kind")
    places, places_at = stored(held.mapInArrow(_make_pieces(min_match), "anchor long, same long, windows int, key long, id long, start long, piece binary, most long"), "repeat-pieces")
    discard(spark, known_at)

    each = places.where("piece is not null").select("anchor", "same", "piece", "windows", "id", "most")
    crowded, crowded_at = stored(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor"), "repeat-crowded")
    many = crowded.count()
    crowded = F.broadcast(crowded) if many <= BROADCAST_ROWS else crowded
    arrays = pieces(places, ARRAY_BYTES)
    whole = each.join(crowded, "anchor", "left_anti") if many else each
    whole = whole.select("anchor", "same", "piece", "windows", "id", "most", F.lit(0).alias("offset"), F.pmod("anchor", F.lit(arrays)).alias("array"))
    window = F.substring("piece", F.col("offset") + 1, F.lit(min_match))
    single = each.join(crowded, "anchor", "left_semi").groupBy("anchor", "same", "piece", "windows").agg(F.min("id").alias("id"), F.max("most").alias("most"))
    single = single.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))).select("anchor", "same", window.alias("piece"), F.lit(1).alias("windows"), "id", "most", "offset")
    single = single.withColumn("array", F.pmod(F.xxhash64("piece"), F.lit(arrays)))
    least, least_at = stored((whole.unionByName(single) if many else whole).groupBy("array").applyInArrow(_sort_suffixes(min_match), "anchor long, same long, first int, windows int, least long"), "repeat-least")

    hits = places.select("anchor", "same", "key", "id", "start").join(least, ["anchor", "same"]).where("least < id")
    found = hits.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), "windows")).alias("found"))
    found = found.unionByName(copies.select("key", F.array(F.struct(F.lit(0).cast("long").alias("first"), "windows")).alias("found")))
    found, _ = stored(found, "repeat-spans")
    discard(spark, places_at, least_at, copies_at, crowded_at)
    joined = rows.join(found, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(lambda batches: _remove(batches, min_match), "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
