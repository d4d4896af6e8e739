"""Fuzzy line dedup: prefixes of word pairs as a lossless filter, edit similarity, one occurrence per group.

1. A line is normalised (ASCII lower case, digits as 0, words of letters and digits only)
   and gets a 128-bit key of its words; a line with other signs but no word gets one of its
   bytes without outer blanks.  Lines of fewer than ``min_words`` words have no near
   copies; with ``short`` (as the query runs) their exact repeats go, else they stay.
2. Lines with equal keys are one class.  A class is keyed by the first of its neighbouring
   word pairs (line start and end count as words) in one order for all lines, rare pairs
   first.  An edit changes two pairs at most, so with as many keys as all allowed edits can
   change and a few more, any two classes within the similarity share those few (three, or
   what the shortest lines allow), are within the similarity in length, and have those keys
   at places that so many edits can bring together.  None of these tests loses a pair.
   Texts are read once for lines and keys; both travel packed, in one row for each batch
   and range: 40 bits of a key, the id of its class and its place.
3. Lists of classes that share a key give all their pairs that pass these tests, unless the
   list is long and dense: more than ``list_size`` classes that pass with as many others
   each.  In such a list each class is paired with the list's most frequent class, its
   pivot; that is the line of which the others are variants, where there is such a line.
   Dense lists of one pivot are one family, so a passage of many keys that many lines share
   is looked at once and not once for each key.  Pairs travel packed and are added up by ranges.
4. Pairs are verified by edit similarity over words: 1 - edits / words of the longer line.
   Components of the links are groups.  In a family whose classes are not yet in one group,
   those outside of its largest group seek partners by their words that are rare in the
   family: of as many as edits are allowed and one more, two lines within the similarity
   have one in common.  Of these, partners that lack no more of each other's words than edits
   are allowed are verified and their groups joined.  Neither test loses a pair, so every
   pair that is left out is within a group already.
5. Of each group the first occurrence (least doc_id, then line) stays.

How rare a word pair is comes from a bounded sample: that decides how long lists get, not
what is found.  Texts of lines are fetched only for classes that are in a pair.

Defined results.  Null texts: no lines, the result is null.  Empty texts stay.  Blank
lines stay.  Rows with equal doc_id and text: one is the first, all lines with a key go
from the others.  Very long lines are compared whole.  Null ids come last.  Empty table:
no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .layout import pieces, written

MIN_WORDS, SIMILARITY = 5, 0.8
#: Documents whose word pairs are counted for the order of keys.
SAMPLED = 20_000
#: Keys that two lines have to share, where lines of the least length have as many in common.
SHARED = 3
#: Classes that share a key and are all paired, or may be paired with each on average; input bytes whose keys go to one range.
LIST_SIZE, RANGE_BYTES = 64, 16 << 20
#: Bits of a key, of the cell of the table that says how frequent it is, and of a line's length in its class id.
KEY_BITS, CELL_BITS, LENGTH_BITS = 40, 22, 10
#: Ranges of cells whose occurrences are added together.
CELL_PARTS = 16
#: Lines that are keyed at once: their numbers, frequencies and keys share 64 bits.
LINES_AT_ONCE = 1 << 17
#: The place of a key that may be anywhere in its line; pairs of a list that are looked at at once.
ANYWHERE, AT_ONCE = 255, 1 << 20
#: Text bytes that a task splits at once, keys that it holds before it packs them, and keys of a range whose lists are made at once.
SPLIT_BYTES, KEYS_AT_ONCE, SLICE_KEYS = 1 << 18, 1 << 18, 1 << 18
#: Pairs that wait to be packed together.
PAIRS_AT_ONCE = 1 << 20
_CLEAN = np.full(256, 0x20, dtype=np.uint8)
_CLEAN[0x30:0x3A] = 0x30
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)
_CLEAN[0x0A] = 0x0A
_INSIDE = _CLEAN > 0x20

PACKETS = "bucket int, a binary, b binary, c binary, d binary, e binary"
#: What comes of the packets: classes with their first occurrence, their other occurrences, and packed pairs and members of dense lists.
FOUND = "kind int, k1 long, node long, row_key long, doc_id long, line int, bucket int, a binary, b binary, c binary, d binary"
FOUND_TYPES = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for name, t in (x.split(" ") for x in FOUND.split(", "))])
CLASS, REPEAT, PAIRS, MEMBERS, CROSSING = range(5)


def normalised(line: str) -> list[str]:
    """The words by which a line is compared."""
    raw = np.frombuffer(line.encode(), dtype=np.uint8)
    return [x for x in _CLEAN[raw].tobytes().decode().replace("\n", " ").split(" ") if x]


def allowed(n_words, similarity: float):
    """Edits between a line and a longest one of ``n_words`` words."""
    return np.floor((1 - similarity) * n_words + 1e-9).astype(np.int64)


def shared(min_words: int, similarity: float) -> int:
    """Word pairs that any two lines within the similarity have in common, up to SHARED."""
    n_words = np.arange(max(1, min_words), max(1, min_words) + 50)
    return int(min(SHARED, (n_words + 1 - 2 * allowed(n_words, similarity)).min()))


def prefix(n_words: np.ndarray, similarity: float, least: int) -> np.ndarray:
    """Keys that a line needs to share ``least``: as many more than its word pairs that a line within the similarity can lack.

    Of e edits that lead to a line longer by d words, d at least are insertions, which part one pair and not two.
    """
    most = [2 * allowed(n_words + d, similarity) - d for d in range(int(np.ceil(1 / (1 - similarity + 1e-9))) + 1)] if similarity < 1 else [0 * n_words]
    return least + np.max(most, axis=0)


def grams(h: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of each line, with its start and end, and the line of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(h)) + np.repeat(np.arange(len(sizes)), sizes)
    left, right = np.full(len(owner), 0x51A7, np.uint64), np.full(len(owner), 0xE0D, np.uint64)
    left[at + 1] = h
    right[at] = h
    left[heads + np.arange(len(sizes))] = 0x51A7
    return W.pair(left, right), owner


def keys(h: np.ndarray, heads: np.ndarray, sizes: np.ndarray, similarity: float, least: int, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each line, the line of each and its place there; ``frequency`` ranks the cells of word pairs (0 to 63).

    ANYWHERE is the place of a pair that its line holds more than once, or that is too far on.
    """
    found, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for a in range(0, len(sizes), LINES_AT_ONCE):
        size = sizes[a : a + LINES_AT_ONCE]
        begin = heads[a]
        gram, owner = grams(h[begin : heads[a + len(size) - 1] + size[-1]], heads[a : a + len(size)] - begin, size)
        rank = frequency[gram >> np.uint64(64 - CELL_BITS)].astype(np.uint64)
        value = (owner.astype(np.uint64) << np.uint64(46)) | (rank << np.uint64(KEY_BITS)) | (gram & np.uint64((1 << KEY_BITS) - 1))
        order = np.argsort(value)
        value = value[order]
        # Lines are whole runs of the sorted values, so each keeps its places.
        first = np.cumsum(size + 1) - (size + 1)
        at = np.arange(len(value))
        head = first[owner]
        taken = at - head < prefix(size, similarity, least)[owner]
        key = value & np.uint64((1 << KEY_BITS) - 1)
        # Lengths in ids end at what fits, so longer lines have no places.
        place = np.where((size >= (1 << LENGTH_BITS) - 1)[owner], ANYWHERE, np.minimum(order - head, ANYWHERE)).astype(np.uint8)
        again = np.concatenate(([False], value[1:] == value[:-1]))
        if again.any():
            # The n-th occurrence of a pair in its line is a key of its own.
            nth = (at - np.maximum.accumulate(np.where(again, 0, at))).astype(np.uint64)
            key = np.where(again, W.pair(key, nth) >> np.uint64(64 - KEY_BITS), key)
            place[again] = ANYWHERE
            place[:-1][again[1:]] = ANYWHERE
        found.append(key[taken])
        owners.append(owner[taken] + a)
        places.append(place[taken])
    return np.concatenate(found), np.concatenate(owners), np.concatenate(places)


def class_keys(h: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of the words of each line in their order (its length, up to what fits, and a hash), and another 64-bit hash of them."""
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(h)) - np.repeat(heads, sizes)
    out = []
    with np.errstate(over="ignore"):
        for salt, base in ((0, 0x9E3779B97F4A7C15), (0x6A09E667F3BCC909, 0xD6E8FEB86659FD93)):
            power = np.full(int(sizes.max()), base, dtype=np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            each = (h if not salt else W.mix(h ^ np.uint64(salt))) * power[at]
            out.append(W.mix(np.add.reduceat(each, heads) + sizes.astype(np.uint64)))
    length = np.minimum(sizes, (1 << LENGTH_BITS) - 1).astype(np.uint64)
    return ((length << np.uint64(64 - LENGTH_BITS)) | (out[0] >> np.uint64(LENGTH_BITS))).view(np.int64), out[1].view(np.int64)


def lengths(ids: np.ndarray) -> np.ndarray:
    """The lengths that class ids hold."""
    return (ids.view(np.uint64) >> np.uint64(64 - LENGTH_BITS)).astype(np.int64)


def _split(batch: pa.RecordBatch, text: int, short: bool, min_words: int) -> Iterator[tuple]:
    """For blocks of rows: row and number of each line, hashes of all words, first word and words of each line, and its keys."""
    data, offsets = W.utf8(batch.column(text))
    for a, b in W.blocks(offsets, SPLIT_BYTES):
        part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        clean = _CLEAN[part]
        starts, ends, row = W.spans(clean, edges, _INSIDE)
        # Lines: after each line feed and at each text's start.
        fresh = np.zeros(len(part) + 1, dtype=bool)
        fresh[1:][part == 0x0A] = True
        fresh[edges[:-1]] = True
        line_of = np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        line = line_of[starts]
        size = np.bincount(line, minlength=len(begins) + 1)
        if short:
            yield from _wordless(part, edges, begins, size, a)
        if not short:
            keep = size[line] >= min_words
            starts, ends, row, line = starts[keep], ends[keep], row[keep], line[keep]
        if not len(starts):
            continue
        h = W.hashes(clean, starts, ends)
        heads = np.flatnonzero(np.concatenate(([True], np.diff(line) != 0)))
        sizes = np.diff(np.append(heads, len(line)))
        owner = row[heads]
        yield a + owner, line[heads] - line_of[edges[owner]], h, heads, sizes, *class_keys(h, heads, sizes)


def _wordless(part: np.ndarray, edges: np.ndarray, begins: np.ndarray, size: np.ndarray, a: int) -> Iterator[tuple]:
    """Like :func:`_split`, for the lines that have signs but no words."""
    ends = np.append(begins[1:], len(part))
    bare = np.flatnonzero((size[: len(begins)] == 0) & (ends > begins))
    found = [(i, x) for i in bare.tolist() if (x := part[begins[i] : ends[i]].tobytes().strip(W.SPACES))]
    if found:
        at = np.array([i for i, _ in found])
        owner = np.searchsorted(edges, begins[at], side="right") - 1
        none = np.zeros(0, np.int64)
        key = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16, person=b"wordless").digest() for _, x in found), "<i8").reshape(-1, 2)
        yield a + owner, at - np.searchsorted(begins, edges[owner], side="left"), none, none, none, key[:, 0], key[:, 1]


def _lines(min_words: int, short: bool):
    """A row for each line that has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, *_ in _split(batch, 1, short, min_words):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(number, pa.int32())], names=["row_key", "line"])
            del batch
            W.release()

    return run


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))[: len(sorted_values)])


def _part(ids: np.ndarray, ranges: int) -> np.ndarray:
    """The range that ids are dealt to, by their low bits."""
    return ((ids & 0xFFFFFFFF) * ranges) >> 32


def _packets(bucket: np.ndarray, columns: list[tuple]) -> pa.RecordBatch:
    """A row for each of the ascending buckets, with its slices of the columns (values, how they are packed)."""
    heads = _runs(bucket)
    sides = list(zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True))
    packed = [pa.array([f(v[x:y]) for x, y in sides] if f else [b""] * len(sides), pa.binary()) for v, f in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int32()), *packed], names=["bucket", *"abcde"[: len(columns)]])


def _raw(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def _unraw(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in column])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in column])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([W.unpack(x.as_py()).astype(np.int32) for x in column]).astype(np.int64)


def _keyed(min_words: int, similarity: float, least: int, frequency, ranges: int, short: bool):
    """From one pass over the texts, packed: the lines of each batch by ranges of their ids, and the keys of its classes by ranges of keys."""

    def packed(lines: list[tuple], keyed: list[tuple]) -> Iterator[pa.RecordBatch]:
        if lines:
            k1, k2, row, doc, number = (np.concatenate(x) for x in zip(*lines, strict=True))
            lines.clear()
            part = _part(k1, ranges)
            order = np.argsort(part, kind="stable")
            yield _packets(part[order], [(k1[order], _raw), (k2[order], _raw), (row[order], _raw), (doc[order], _raw), (number[order], W.pack)])
        if keyed:
            key, ids, n, place = (np.concatenate(x) for x in zip(*keyed, strict=True))
            keyed.clear()
            order = np.argsort(key)
            key = key[order]
            part = ((key >> np.uint64(8)) * np.uint64(ranges) >> np.uint64(KEY_BITS - 8)).astype(np.int64)
            yield _packets(ranges + part, [(key, W.pack_sorted), (ids[order], _raw), (n[order], W.pack), (place[order], lambda v: v.tobytes()), (key, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, keyed = [], []
            row_key = batch.column(0).to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False), bool)
            doc_id = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, number, h, heads, sizes, k1, k2 in _split(batch, 2, short, min_words):
                lines.append((k1, k2, row_key[row], doc_id[row], 2 * number + null[row]))
                long = np.flatnonzero(sizes >= max(1, min_words))
                if not len(long):
                    continue
                ids, chosen, n = np.unique(k1[long], return_index=True, return_counts=True)
                chosen = long[chosen]
                size = sizes[chosen]
                begin = np.cumsum(size) - size
                word = np.repeat(heads[chosen] - begin, size) + np.arange(size.sum())
                key, owner, place = keys(h[word], begin, size, similarity, least, frequency.value)
                keyed.append((key, ids[owner], n[owner].astype(np.int32), place))
                if sum(len(x[0]) for x in keyed) >= KEYS_AT_ONCE:
                    yield from packed(lines, keyed)
                    W.release()
            yield from packed(lines, keyed)
            del batch
            W.release()

    return run


def _cells(min_words: int):
    """How often the cells of word pairs come in a task, packed, a row for each range of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, h, heads, sizes, _, _ in _split(batch, 0, False, min_words):
                total = np.zeros(1 << CELL_BITS, np.int64) if total is None else total
                cell, n = np.unique(grams(h, heads, sizes)[0] >> np.uint64(64 - CELL_BITS), return_counts=True)
                total[cell] += n
        for part in range(CELL_PARTS if total is not None else 0):
            mine = total.reshape(CELL_PARTS, -1)[part]
            cell = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([W.pack_sorted(cell)], pa.binary()), pa.array([W.pack(mine[cell])], pa.binary())], names=["part", "cells", "counts"])

    return run


def _ranks(table: pa.Table) -> pa.Table:
    """The ranks of a range of cells: logarithms of their occurrences, 0 to 63."""
    total = np.zeros((1 << CELL_BITS) // CELL_PARTS, np.int64)
    for cells, counts in zip(table.column("cells"), table.column("counts"), strict=True):
        total[W.unpack_sorted(cells.as_py()).astype(np.int64)] += W.unpack(counts.as_py()).astype(np.int64)
    ranks = np.minimum(63, 4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table([table.column("part")[:1], pa.array([ranks.tobytes()], pa.binary())], names=["part", "ranks"])


def _frequency(texts: DataFrame, n_rows: int, min_words: int):
    """A broadcast table of fixed size: how frequent the word pairs of a cell are in a sample of ``texts``, on a scale of logarithms."""
    share = min(1.0, SAMPLED / max(1, n_rows))
    some = texts.where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) < share * (1 << 30))
    rows = some.mapInArrow(_cells(min_words), "part int, cells binary, counts binary").groupBy("part").applyInArrow(_ranks, "part int, ranks binary").collect()
    table = np.zeros((CELL_PARTS, (1 << CELL_BITS) // CELL_PARTS), np.uint8)
    for row in rows:
        table[row.part] = np.frombuffer(row.ranks, np.uint8)
    return texts.sparkSession.sparkContext.broadcast(table.reshape(-1))


def _table(kind: int, n: int, **columns) -> pa.Table:
    """Rows of FOUND of a kind; columns that are not given are null."""
    return pa.table([pa.array(np.full(n, kind), pa.int32()) if f.name == "kind" else columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND_TYPES], schema=FOUND_TYPES)


def _packed(kind: int, bucket: np.ndarray, columns: list[tuple]) -> pa.Table:
    rows = _packets(bucket, columns)
    return _table(kind, len(rows), **{name: rows.column(name) for name in rows.schema.names})


def _classes(table: pa.Table) -> pa.Table:
    """The classes of a range of lines with their first occurrences, and all other occurrences."""
    k1, k2, row, doc = (_unraw(table.column(c)) for c in "abcd")
    number = _unpacked(table.column("e"))
    line, null = number >> 1, number & 1
    order = np.lexsort((row, line, doc, null, k2, k1))
    k1, k2, row, doc, line, null = (x[order] for x in (k1, k2, row, doc, line, null))
    fresh = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
    heads = np.flatnonzero(fresh)
    first = np.repeat(heads, np.diff(np.append(heads, len(k1))))
    # A range has fewer than 2**32 classes, so each gets a number that no other class has.
    node = (int(table.column("bucket")[0].as_py()) << 32) + np.arange(len(heads))
    more = np.flatnonzero((row != row[first]) | (line != line[first]))
    found = _table(CLASS, len(heads), k1=pa.array(k1[heads]), node=pa.array(node), row_key=pa.array(row[heads]), doc_id=pa.array(doc[heads], pa.int64(), mask=null[heads] == 1), line=pa.array(line[heads]))
    return pa.concat_tables([found, _table(REPEAT, len(more), row_key=pa.array(row[more]), line=pa.array(line[more]))])


def _near(similarity: float):
    """Whether lines of n and m words with a shared key at these places can be within the similarity.

    What is before the key and what is behind it differ in length by as many edits at least.
    """
    most = allowed(np.arange(1 << LENGTH_BITS), similarity).astype(np.int16)

    def near(n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        longer, behind = n - m, at - to
        edits = np.where((at == ANYWHERE) | (to == ANYWHERE), np.abs(longer), np.abs(behind) + np.abs(longer - behind))
        return edits <= most[np.maximum(n, m)]

    return near


def _summed(a: np.ndarray, b: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (the lesser id first) with the sum of their shared keys, by range of the lesser id."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    # By range of the lesser id; where pairs agree in these bits, one may come twice, and _counted adds them.
    order = np.argsort((a.view(np.uint64) << np.uint64(32)) | (b.view(np.uint64) & np.uint64(0xFFFFFFFF)))
    a, b, often = a[order], b[order], often[order]
    heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[heads], b[heads], np.add.reduceat(often, heads, dtype=np.int64)


def _pairs(a: np.ndarray, b: np.ndarray, often: np.ndarray, ranges: int, kind: int) -> pa.Table:
    """Pairs with the sum of their shared keys, packed by ranges of the lesser id."""
    if not len(a):
        return _table(kind, 0)
    a, b, often = _summed(a, b, often)
    return _packed(kind, _part(a, ranges), [(a, _raw), (b, _raw), (often, W.pack)])


def _slices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, class id, occurrences and place of the keys of a range, about SLICE_KEYS at a time; all of one key come together.

    Ids and places are read where they are; only keys and occurrences are held unpacked.
    """
    held = []
    for batch in (x for x in table.to_batches() if len(x)):
        key = np.concatenate([W.unpack_sorted(x.as_py()) for x in batch.column("a")])
        counts = np.concatenate([_small(W.unpack(x.as_py())) for x in batch.column("c")])
        held.append((key, W.utf8(batch.column("b"))[0].view("<i8"), W.utf8(batch.column("d"))[0], counts))
    if not held:
        return
    low, high = min(int(x[0].min()) for x in held), max(int(x[0].max()) for x in held)
    n = -(-sum(len(x[0]) for x in held) // SLICE_KEYS)
    width = (high - low) // n + 1
    for begin in range(low, high + 1, width):
        some = [np.flatnonzero((key >= begin) & (key < begin + width)) for key, *_ in held] if n > 1 else [slice(None)] * len(held)
        key, ids, place, counts = (np.concatenate([x[i][at] for x, at in zip(held, some, strict=True)]) for i in range(4))
        if len(key):
            yield key.astype(np.int64), ids, counts.astype(np.int32), place


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(counts.max())) if len(counts) else np.zeros(0, np.uint8)


def _lists(table: pa.Table, list_size: int, similarity: float, least: int, ranges: int) -> pa.Table:
    """Pairs of classes that share keys, and the members of dense lists."""
    near = _near(similarity)
    found, waiting, members = [_table(PAIRS, 0)], [], []

    def pack() -> None:
        found.append(_pairs(*(np.concatenate(x) for x in zip(*waiting, strict=True)), ranges, PAIRS))
        waiting.clear()

    for part in _slices(table):
        for pairs, dense in _listed(*part, near, list_size, least):
            if pairs:
                waiting.append(pairs)
                if sum(len(x[0]) for x in waiting) >= PAIRS_AT_ONCE:
                    pack()
            if dense:
                members.append(dense)
    if waiting:
        pack()
    if members:
        pivot, ids = _distinct(*(np.concatenate(x) for x in zip(*members, strict=True)))
        order = np.argsort(_part(ids, ranges), kind="stable")
        found.append(_packed(MEMBERS, _part(ids[order], ranges), [(pivot[order], _raw), (ids[order], _raw)]))
    return pa.concat_tables(found)


def _listed(key: np.ndarray, ids: np.ndarray, counts: np.ndarray, place: np.ndarray, near, list_size: int, least: int) -> Iterator[tuple]:
    """Some pairs of whole lists with their shared keys, as two ids and a number each, or the members of a dense list (its pivot and their ids)."""
    order = np.argsort(key)
    key = key[order]
    common = np.concatenate(([False], key[1:] == key[:-1]))
    common[:-1] |= common[1:]
    order, key = order[common], key[common]
    if not len(key):
        return
    # By key and id; ids that agree in their low bits may come mixed, and a class twice in a list does no harm.
    again = np.argsort((np.cumsum(np.diff(key, prepend=key[:1]) != 0) << 40) | (ids[order] & ((1 << 40) - 1)))
    order = order[again]
    key, ids, counts, place = key[again], ids[order], counts[order], place[order]
    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))))
    counts = np.add.reduceat(counts, heads)
    key, ids, place = key[heads], ids[heads], place[heads]
    begins = _runs(key)
    n = np.diff(np.append(begins, len(key)))
    size = np.repeat(n, n)
    words, place = lengths(ids).astype(np.int16), place.astype(np.int16)

    def pair(x: np.ndarray, y: np.ndarray, shared_keys: int) -> tuple:
        ok = near(words[x], words[y], place[x], place[y])
        return (ids[x[ok]], ids[y[ok]], np.full(int(ok.sum()), shared_keys, np.int8)), None

    x = np.flatnonzero(size <= list_size)
    nth = np.arange(len(key)) - np.repeat(begins, n)
    for lag in range(1, int(size[x].max()) if len(x) else 0):
        x = x[nth[x] >= lag]
        yield pair(x - lag, x, 1)
    for i in np.flatnonzero(n > list_size).tolist():
        mine = np.arange(begins[i], begins[i] + n[i])
        some = mine[:: max(1, len(mine) // 32)]
        if near(words[some][:, None], words[mine], place[some][:, None], place[mine]).mean() * len(mine) <= list_size + 1:
            for at in range(0, len(mine), AT_ONCE // len(mine) + 1):
                x = mine[at : at + AT_ONCE // len(mine) + 1]
                u, v = np.nonzero(near(words[x][:, None], words[mine], place[x][:, None], place[mine]) & (x[:, None] < mine))
                yield (ids[x[u]], ids[mine[v]], np.ones(len(u), np.int8)), None
        else:
            pivot = mine[np.argmax(counts[mine])]
            yield pair(mine[mine != pivot], np.full(len(mine) - 1, pivot), least)
            yield None, (np.full(len(mine), ids[pivot]), ids[mine])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of values, by a and b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    return a[heads], b[heads]


def _gathered(list_size: int, similarity: float, least: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        W.release()
        return _classes(table) if table.column("bucket")[0].as_py() < ranges else _lists(table, list_size, similarity, least, ranges)

    return run


def _member_ids(table: pa.Table) -> pa.Table:
    """The classes of a range of ids that are in dense lists."""
    return pa.table([pa.array(np.unique(_unraw(table.column("b"))))], names=["k1"])


def _expanded(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``begins``, one run after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _codes_of(words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A code of 31 bits for each word of each line (an n-th occurrence is a word of its own), and the words of each line."""
    data, offsets = W.utf8(words)
    codes, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for a, b in W.blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, row = W.spans(part, offsets[a : b + 1] - offsets[a], _INSIDE)
        h = W.hashes(part, starts, ends)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        heads = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))[: len(h)])
        nth = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
        codes.append((W.pair(h, nth.astype(np.uint64)) >> np.uint64(33)).astype(np.uint32))
        sizes.append(np.bincount(row, minlength=b - a))
    return np.concatenate(codes), np.concatenate(sizes)


def _labelled(ranges: int):
    """Members of families with the groups of their classes (-1: none) and the codes of their words (bit 31: the first of a line), packed by ranges of pivots."""

    def run(members: pa.Table, labels: pa.Table) -> pa.Table:
        W.release()
        if not len(members) or not len(labels):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 5], names=["bucket", *"abcde"])
        pivot, ids = _distinct(_unraw(members.column("a")), _unraw(members.column("b")))
        known = labels.column("k1").to_numpy()
        codes, sizes = _codes_of(labels.column("words"))
        begins = np.cumsum(sizes) - sizes
        codes[begins] |= np.uint32(1 << 31)
        order = np.argsort(known, kind="stable")
        at = order[np.minimum(np.searchsorted(known[order], ids), len(known) - 1)]
        found = np.flatnonzero(known[at] == ids)
        part = _part(pivot[found], ranges)
        order = found[np.argsort(part, kind="stable")]
        label = labels.column("root").fill_null(-1).to_numpy()
        return _packets(np.sort(part), [(pivot[order], _raw), (ids[order], _raw), (order, None), (label[at[order]], _raw), (at[order], lambda v: codes[_expanded(begins[v], sizes[v])].tobytes())])

    return lambda members, labels: pa.Table.from_batches([run(members, labels)])


def _bags(codes: np.ndarray, size: np.ndarray, similarity: float):
    """For the lines of a family, by the codes of their words: those that share a rare word with a line, and those of some that lack few enough of its words and it of theirs.

    With e edits each of two lines lacks e words of the other at most.  So the rarest word that they share is among the e + 1 rarest of both.
    """
    _, code, often = np.unique(codes, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner, code = np.divmod(np.unique(np.repeat(np.arange(len(size)), size) * len(often) + rank[code]), len(often))
    n = np.bincount(owner, minlength=len(size))
    begins = np.cumsum(n) - n
    # The longest line within the similarity decides.
    most = allowed(np.floor(size / similarity + 1e-6), similarity)
    rare = np.flatnonzero(np.arange(len(code)) - begins[owner] <= most[owner])
    rare = rare[np.argsort(code[rare], kind="stable")]
    lists, edges = owner[rare], np.searchsorted(code[rare], np.arange(len(often) + 1))
    has = np.zeros(len(often), bool)

    def sharing(x: int) -> np.ndarray:
        if n[x] <= most[x]:
            return np.arange(len(size))
        return np.unique(np.concatenate([lists[edges[c] : edges[c + 1]] for c in code[begins[x] : begins[x] + most[x] + 1].tolist()]))

    def within(x: int, some: np.ndarray) -> np.ndarray:
        mine = code[begins[x] : begins[x] + n[x]]
        has[mine] = True
        both = np.add.reduceat(has[code[_expanded(begins[some], n[some])]], np.cumsum(n[some]) - n[some], dtype=np.int64)
        has[mine] = False
        return np.maximum(n[some], n[x]) - both <= allowed(np.maximum(size[some], size[x]), similarity)

    return sharing, within


def _crossing(similarity: float, ranges: int):
    """Pairs of members of a family that are not in one group and may be within the similarity by their lengths and, where the table has them, their words.

    Pairs that wait are added up as soon as there are PAIRS_AT_ONCE of them, and packed where half as many are left.
    """
    near = _near(similarity)

    def run(table: pa.Table) -> pa.Table:
        W.release()
        key, ids, label = (_unraw(table.column(c)) for c in "abd")
        order = np.argsort(key, kind="stable")
        key, ids, label = key[order], ids[order], label[order]
        worded = "e" in table.column_names
        if worded:
            codes = W.utf8(table.column("e"))[0].view("<u4")
            heads = np.flatnonzero(codes >> np.uint32(31))
            size = np.diff(np.append(heads, len(codes)))[order]
            codes = codes[_expanded(heads[order], size)] & np.uint32((1 << 31) - 1)
            edges = np.append(0, np.cumsum(size))
        found, waiting, n_waiting = [_table(CROSSING, 0)], [], 0
        begins = _runs(key)
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
            i, g = ids[begin:end], label[begin:end]
            w = lengths(i).astype(np.int16)
            groups, n = np.unique(g[g >= 0], return_counts=True)
            # Two members outside of the largest group are both here; they are paired once.
            out = np.flatnonzero(g != groups[np.argmax(n)]) if len(groups) else np.arange(len(g))
            rank = np.full(len(g), -1)
            rank[out] = np.arange(len(out))
            if worded and len(out):
                sharing, within = _bags(codes[edges[begin] : edges[end]], size[begin:end], similarity)
            for x in out.tolist():
                v = sharing(x) if worded else np.arange(len(g))
                v = v[(rank[v] < rank[x]) & ((g[v] != g[x]) | (g[x] < 0))]
                v = v[near(w[v], w[x], ANYWHERE, ANYWHERE)]
                if worded and len(v):
                    step = int(AT_ONCE // size[begin:end].max()) + 1
                    v = np.concatenate([(y := v[k : k + step])[within(x, y)] for k in range(0, len(v), step)])
                if not len(v):
                    continue
                waiting.append((np.full(len(v), i[x]), i[v], np.ones(len(v), np.int8)))
                n_waiting += len(v)
                if n_waiting >= PAIRS_AT_ONCE:
                    waiting = [_summed(*(np.concatenate(c) for c in zip(*waiting, strict=True)))]
                    n_waiting = len(waiting[0][0])
                    if n_waiting >= PAIRS_AT_ONCE // 2:
                        found.append(_pairs(*waiting[0], ranges, CROSSING))
                        waiting, n_waiting = [], 0
        if n_waiting:
            found.append(_pairs(*(np.concatenate(c) for c in zip(*waiting, strict=True)), ranges, CROSSING))
        return pa.concat_tables(found)

    return run


def _counted(least: int):
    """The pairs of a range that share enough keys."""

    def run(table: pa.Table) -> pa.Table:
        W.release()
        a, b, n = _unraw(table.column("a")), _unraw(table.column("b")), _unpacked(table.column("c"))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        keep = np.add.reduceat(n, heads) >= least
        return pa.table([pa.array(a[heads][keep]), pa.array(b[heads][keep])], names=["a", "b"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted lines of a text."""
    for batch in batches:
        k1, node, words = [], [], []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            lines = text.as_py().split("\n")
            for w in wanted.as_py():
                k1.append(w["k1"])
                node.append(w["node"])
                words.append(" ".join(normalised(lines[w["line"]])))
        yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(node, pa.int64()), pa.array(words, pa.string())], names=["k1", "node", "words"])
        del batch, k1, node, words
        W.release()


def _trimmed(x: str, y: str, similarity: float) -> tuple[list[str], list[str], int]:
    """The words of two lines without what both begin or end with, which takes no edit, and the edits they may need."""
    u, v = x.split(" "), y.split(" ")
    n, m = len(u), len(v)
    least, head, tail = min(n, m), 0, 0
    while head < least and u[head] == v[head]:
        head += 1
    while tail < least - head and u[-1 - tail] == v[-1 - tail]:
        tail += 1
    return u[head : n - tail], v[head : m - tail], int((1 - similarity) * max(n, m) + 1e-9)


def _coded(u: list[str], v: list[str], most: int) -> tuple[str, str, int] | None:
    """Words as strings of one character for each, and ``most``; None where they need more edits.

    They take at least as many as the longer one has words that the other lacks.  Words that only ``v`` has are one
    character: none of them is equal to a word of ``u``.
    """
    code = dict.fromkeys(u)
    code = dict(zip(code, _CODES if len(code) <= len(_CODES) else _codes(len(code)), strict=False))
    right = "".join([code.get(w, _OTHER) for w in v])
    if max(len(u), len(v)) - len(v) + right.count(_OTHER) > most:
        return None
    return "".join([code[w] for w in u]), right, most


def _codes(n: int) -> str:
    """Different characters from U+0100 on, past the surrogates."""
    return "".join(chr(k + 0x800 * (k >= 0xD800)) for k in range(0x100, 0x100 + n))


_OTHER, _CODES = "\u00ff", _codes(4096)


def _apart(x: str, y: str, similarity: float) -> tuple[str, str, int] | None:
    """What two lines differ in, as :func:`_coded` has it."""
    return _coded(*_trimmed(x, y, similarity))


def _compared(x: str, y: str, similarity: float) -> tuple[str, str, int] | None:
    """Like :func:`_apart`, but nothing of lines that differ in no more words than they may."""
    u, v, most = _trimmed(x, y, similarity)
    return ("", "", most) if max(len(u), len(v)) <= most else _coded(u, v, most)


def _as_codes(similarity: float):
    """The pairs of lines that may be within the similarity, with what :func:`_compared` says of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_compared(x, y, similarity) for x, y in zip(batch.column("a_words").to_pylist(), batch.column("b_words").to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(found) if x], pa.int32())
            left, right, most = zip(*(x for x in found if x), strict=True) if len(at) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(most, pa.int32())], names=["a", "b", "a_codes", "b_codes", "most"])
            del batch, found, at, left, right, most
            W.release()

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, drops = batch.column(1), batch.column(2).to_pylist()
        left, gone = [], [len(set(drop or ())) for drop in drops]
        for i, drop in enumerate(drops):
            if drop:
                out = set(drop)
                left.append("\n".join(x for k, x in enumerate(text[i].as_py().split("\n")) if k not in out))
        kept = pc.replace_with_mask(text, pa.array([n > 0 for n in gone], pa.bool_()), pa.array(left, text.type))
        totals = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1).fill_null(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), totals, pa.array(gone, pa.int64()), kept.cast(pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])
        # Workers are used again, so what a batch took would stay with the next stage's.
        del batch, text, drops, left, gone, kept, totals
        W.release()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The links (u, v) among pairs of ids (a, b)."""
    side = lambda p: texts.select(F.col("k1").alias(f"{p}_id"), F.col("node").alias(p), F.col("words").alias(f"{p}_words"))
    both = pairs.select(F.col("a").alias("a_id"), F.col("b").alias("b_id")).join(side("a"), "a_id").join(side("b"), "b_id").where("a != b")
    codes = both.select("a", "b", "a_words", "b_words").mapInArrow(_as_codes(similarity), "a long, b long, a_codes string, b_codes string, most int")
    # Beyond the allowed edits the distance is -1, and nothing far from the diagonal is looked at.
    alike = codes.where(F.expr("levenshtein(a_codes, b_codes, most) >= 0"))
    return written(alike.select(F.col("a").alias("u"), F.col("b").alias("v")), "line-links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()


def _words_of(ends: DataFrame, classes: DataFrame, rows: DataFrame, repeated_rows: bool) -> DataFrame:
    """k1, node and words of the classes with the ids ``ends``."""
    wanted = classes.join(written(ends, "line-ends"), "k1").groupBy("row_key").agg(F.collect_list(F.struct("k1", "node", "line")).alias("wanted"))
    texts = rows.join(written(wanted, "line-wanted"), "row_key").select("text", "wanted").mapInArrow(_texts, "k1 long, node long, words string")
    return written(texts.dropDuplicates(["node"]) if repeated_rows else texts, "line-texts")


def _groups(found: DataFrame, rows: DataFrame, repeated_rows: bool, ranges: int, similarity: float, least: int) -> DataFrame:
    """node and root of every class that is linked with another, roots included."""
    classes, packed = found.where(F.col("kind") == CLASS), found.select("kind", "bucket", "a", "b", "c")
    counted = lambda x, least: x.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(_counted(least), "a long, b long")
    pairs = written(counted(packed.where(F.col("kind") == PAIRS), least), "line-pairs")
    members = packed.where(F.col("kind") == MEMBERS)
    dense = not members.isEmpty()
    ends = _ends(pairs)
    if dense:
        listed = written(members.groupBy("bucket").applyInArrow(_member_ids, "k1 long"), "line-members")
        ends = ends.unionByName(listed).distinct()
    texts = _words_of(ends, classes, rows, repeated_rows)
    links = _verified(pairs, texts, similarity)
    rooted = _with_roots(written(components(links), "line-roots"))
    if dense:
        part = F.shiftright(F.col("k1").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(ranges), 32).cast("int").alias("bucket")
        labels = texts.join(listed, "k1").join(rooted, "node", "left").select(part, "k1", "root", "words")
        labelled = members.groupBy("bucket").cogroup(labels.groupBy("bucket")).applyInArrow(_labelled(ranges), PACKETS)
        crossing = written(labelled.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(_crossing(similarity, ranges), FOUND).select(packed.columns), "line-crossing")
        if not crossing.isEmpty():
            # What a family gives was compared by all words, so no number of keys is asked for.
            again = _verified(written(counted(crossing, 1), "line-pairs"), texts, similarity)
            rooted = _joined(written(rooted, "line-roots"), again)
    return rooted


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` with the groups joined that further links lead between; only groups and lone classes that have such a link are looked at."""
    root = lambda p: rooted.select(F.col("node").alias(p), F.col("root").alias(f"{p}_root"))
    between = links.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    merged = _with_roots(written(components(between), "line-groups"))
    moved = rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(merged.join(rooted, "node", "left_anti")), "line-roots")


def _with_roots(rooted: DataFrame) -> DataFrame:
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, short: bool = False, list_size: int = LIST_SIZE) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for each row of ``docs`` (doc_id, text)."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("below a similarity of 0.5 two lines need not share a word pair")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.withColumn("row_key", F.xxhash64("doc_id", "text"))
    texts = rows.where("text is not null")
    # Only rows of equal ids can be equal.
    several = written(plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "row-ids")
    repeated_rows = not several.isEmpty()
    if repeated_rows:
        alike = texts.alias("t").join(several.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
        copied = written(alike.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("row_key"), "row-copies")
        repeated_rows = not copied.isEmpty()
    ranges, least = pieces(docs.select("doc_id", "text"), RANGE_BYTES), shared(min_words, similarity)
    packets = texts.select("row_key", "doc_id", "text").mapInArrow(_keyed(min_words, similarity, least, _frequency(texts.select("text"), plain.count(), min_words), ranges, short), PACKETS)
    found = written(packets.repartition(2 * ranges, "bucket").groupBy("bucket").applyInArrow(_gathered(list_size, similarity, least, ranges), FOUND), "line-found")
    rooted = _groups(found, texts.select("row_key", "text"), repeated_rows, ranges, similarity, least)
    # All but the first occurrence of a class go, and of the first ones of a group's classes all but the first.
    grouped = found.where(F.col("kind") == CLASS).join(rooted, "node").select("root", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line", "row_key").alias("first"))
    grouped = written(grouped, "line-grouped")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    linked = grouped.join(stays, "root").where("first.row_key != stays.row_key or first.line != stays.line").select("first.row_key", "first.line")
    drop = found.where(F.col("kind") == REPEAT).select("row_key", "line").unionByName(linked).groupBy("row_key").agg(F.collect_set("line").alias("drop"))
    marked = rows.join(written(drop, "line-drops"), "row_key", "left")
    if repeated_rows:
        every = texts.join(copied, "row_key").select("row_key", "text").mapInArrow(_lines(min_words, short), "row_key long, line int").groupBy("row_key").agg(F.collect_set("line").alias("every"))
        several = marked.join(copied, "row_key").withColumn("nth", F.row_number().over(Window.partitionBy("row_key").orderBy("doc_id"))).join(every, "row_key", "left")
        several = several.withColumn("drop", F.when(F.col("nth") > 1, F.col("every")).otherwise(F.col("drop")))
        marked = marked.join(copied, "row_key", "left_anti").unionByName(several.select(marked.columns))
    return marked.select("doc_id", "text", "drop").mapInArrow(_removed, "doc_id long, n_lines long, n_removed long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True)
