"""Benchmark decontamination with an FM-index for each shard of the training texts.

A worker indexes the words of its batch of texts: a suffix array by prefix doubling, the
Burrows-Wheeler transform as a wavelet matrix with rank counts, and a sample of suffix
positions.  All windows of the benchmark run through it together by backward search;
occurrences are located by walking to the next sampled position, and overlapping ones
are merged to spans.

Words outside the benchmark's vocabulary cannot be in an occurrence.  They part the text
into stretches, and only stretches at least as long as the shortest window are indexed,
so that the index holds every place where an occurrence can be, and little else.

The benchmark is the stated query set.  It goes to the workers in blocks of items of about
``block_bytes`` of text.  Where it is one block, as benchmarks are, one pass over the
texts finds all.  A larger one takes a pass for each block, one block in memory at a
time; what the passes find is written, then joined by a hash of doc_id and text.

Defined results.  Null, empty and wordless texts: no words, no hits.  Wordless or null
items: no windows.  Windows of texts without an item id hit, but name no item.  Items with
equal texts are all reported.  Repeated rows: each is searched.  An empty table, or an
empty benchmark: every text is clean.  Other columns are not read, or pass through whole
in :func:`remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .layout import written

WINDOW = 10
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BLOCK_BYTES = 4 << 20
#: Text bytes that one index covers, and the distance between sampled positions.
SHARD_BYTES, SAMPLE = 8 << 20, 8

FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,last:long>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


class Phrases:
    """The windows of some items: distinct rows of word codes, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        names, texts = [x for x, _ in items], pa.array([x for _, x in items], pa.string())
        self.names = names
        rows, own, lengths = [], [], []
        for a, b, h, row in W.words(texts, W.ALNUM_BYTES):
            first = np.searchsorted(row, np.arange(b - a + 1))
            for i in range(b - a):
                n = first[i + 1] - first[i]
                for j in range(max(1, n - window + 1) if n else 0):
                    part = h[first[i] + j : min(first[i] + j + window, first[i + 1])]
                    rows.append(np.concatenate((part, np.zeros(window - len(part), np.uint64))))
                    own.append(a + i)
                    lengths.append(len(part))
        self.empty = not rows
        if self.empty:
            return
        grid, lengths = np.array(rows), np.array(lengths)
        inside = np.arange(window) < lengths[:, None]
        self.vocabulary = np.unique(grid[inside])
        codes = np.where(inside, np.searchsorted(self.vocabulary, grid) + 1, 0)
        distinct, at = np.unique(codes, axis=0, return_inverse=True)
        self.codes, self.lengths = distinct, (distinct > 0).sum(axis=1)
        pairs = np.unique(np.stack((at.reshape(-1), np.array(own)), axis=1), axis=0)
        self.items, self.first_item = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of codes in order, by prefix doubling; each 0 is a separator of its own, ordered by position."""
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    step = 1
    while True:
        key = np.zeros(n, np.int64)
        key[: n - step] = rank[step:] + 1 if step < n else 0
        key += rank * (n + int(rank.max()) + 2)
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class WaveletMatrix:
    """Codes with rank and access, a level for each bit from the highest."""

    def __init__(self, codes: np.ndarray):
        self.levels = max(1, int(codes.max()).bit_length()) if len(codes) else 1
        self.ones, self.zeros = [], []
        for level in range(self.levels):
            bit = (codes >> (self.levels - 1 - level)) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(codes) - int(self.ones[-1][-1]))
            codes = np.concatenate((codes[bit == 0], codes[bit == 1]))

    def rank(self, code: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often ``code`` stands before each place."""
        spots = [np.zeros_like(places[0]), *places]
        for level in range(self.levels):
            bit = (code >> (self.levels - 1 - level)) & 1
            ones, zeros = self.ones[level], self.zeros[level]
            spots = [np.where(bit == 1, zeros + ones[x], x - ones[x]) for x in spots]
        return [x - spots[0] for x in spots[1:]]

    def access(self, place: np.ndarray) -> np.ndarray:
        code = np.zeros_like(place)
        for level in range(self.levels):
            ones = self.ones[level]
            bit = ones[place + 1] - ones[place]
            code = code * 2 + bit
            place = np.where(bit == 1, self.zeros[level] + ones[place], place - ones[place])
        return code


class FMIndex:
    """Count and locate over codes; 0 separates stretches and is never searched for."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.size = len(text)
        self.bwt = WaveletMatrix(text[order - 1])
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))
        starts = np.concatenate(([True], text[:-1] == 0))  # a walk never crosses a separator
        kept = ((order % sample == 0) | starts[order])
        self.kept, self.kept_rank = kept, np.cumsum(kept) - 1
        self.position = order[kept]

    def search(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), self.size)
        for step in range(int(lengths.max())):
            live = np.flatnonzero((step < lengths) & (low < high))
            c = codes[live, lengths[live] - 1 - step]
            known = c + 1 < len(self.before)
            first = self.before[np.where(known, c, 0)]
            a, b = self.bwt.rank(np.where(known, c, 0), low[live], high[live])
            low[live], high[live] = np.where(known, first + a, 0), np.where(known, first + b, 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their rows."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.kept[rows[left]]
            at = left[done]
            out[at] = self.position[self.kept_rank[rows[at]]] + walked[at]
            left = left[~done]
            if len(left):
                c = self.bwt.access(rows[left])
                rows[left] = self.before[c] + self.bwt.rank(c, rows[left])[0]
                walked[left] += 1
        return out


def _search(h: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hit; and the pairs of row and item."""
    none = np.zeros(len(h), bool), np.zeros((0, 2), np.int64)
    if phrases.empty or not len(h):
        return none
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    origin = np.flatnonzero(phrases.vocabulary[at] == h)
    if not len(origin):
        return none
    fresh = np.concatenate(([True], (np.diff(origin) != 1) | (np.diff(row[origin]) != 0)))
    stretch = np.cumsum(fresh) - 1
    keep = np.bincount(stretch)[stretch] >= phrases.lengths.min()
    origin, fresh = origin[keep], fresh[keep]
    if not len(origin):
        return none
    place = np.arange(len(origin)) + np.cumsum(fresh) - 1  # one separator after each stretch
    text = np.zeros(place[-1] + 2, np.int64)
    text[place] = at[origin] + 1
    source = np.zeros(len(text), np.int64)
    source[place] = origin
    index = FMIndex(text)
    low, high = index.search(phrases.codes, phrases.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    begun = source[index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which])]
    depth = np.bincount(begun, minlength=len(h) + 1).astype(np.int64) - np.bincount(begun + phrases.lengths[which], minlength=len(h) + 1)
    each = phrases.first_item[which + 1] - phrases.first_item[which]
    item = phrases.items[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(phrases.first_item[which], each)]
    pairs = np.stack((np.repeat(row[begun], each), item), axis=1)
    return np.cumsum(depth)[: len(h)] > 0, np.unique(pairs, axis=0)


def scan(texts: pa.Array, blocks: list[Phrases]) -> Iterator[dict]:
    """For each text in order: n_words, n_hit, the ids of its items, and the merged spans of hit words."""
    data, offsets = W.utf8(texts)
    for a, b in W.blocks(offsets, SHARD_BYTES):
        part = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.ascontiguousarray(offsets[a : b + 1] - offsets[a])), pa.py_buffer(np.ascontiguousarray(data[offsets[a] : offsets[b]]))])
        found = [(h, row + x) for x, _, h, row in W.words(part, W.ALNUM_BYTES)]
        h, row = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        n_words = np.bincount(row, minlength=b - a)
        hit, items = np.zeros(len(h), bool), [set() for _ in range(b - a)]
        for phrases in blocks:
            own, pairs = _search(h, row, phrases)
            hit |= own
            for r, i in pairs.tolist():
                if phrases.names[i] is not None:
                    items[r].add(phrases.names[i])
        n_hit = np.bincount(row[hit], minlength=b - a)
        first = np.cumsum(n_words) - n_words
        edges = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1] | (np.diff(row) != 0))[: len(hit)])) if len(hit) else np.zeros(0, np.int64)
        ends = np.flatnonzero(hit & np.concatenate((~hit[1:] | (np.diff(row) != 0), [True])[: len(hit)])) if len(hit) else np.zeros(0, np.int64)
        spans: list[list] = [[] for _ in range(b - a)]
        for x, y, r in zip(edges.tolist(), ends.tolist(), row[edges].tolist(), strict=True):
            spans[r].append({"first": x - int(first[r]), "last": y - int(first[r])})
        for r in range(b - a):
            yield {"n_words": int(n_words[r]), "n_hit": int(n_hit[r]), "items": sorted(items[r]), "spans": spans[r]}


def _blocks(phrases: DataFrame, window: int, block_bytes: int) -> Iterator:
    """Broadcasts of the phrases, a block of items each, read one at a time."""
    rows = phrases.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        block = rows.where(F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield count, phrases.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in block], window))


def _mapper(block, render: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield render(batch, list(scan(batch.column(batch.schema.get_field_index("text")), [block.value])))
            del batch
            W.release()

    return run


def _report(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    digest = [hashlib.sha256(",".join(x["items"]).encode()).hexdigest() for x in found]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(([x["n_words"] for x in found], [x["n_hit"] for x in found], [len(x["items"]) for x in found], digest, [x["n_hit"] > 0 for x in found], [x["spans"] for x in found]), _FOUND.types[1:], strict=True))], schema=_FOUND)


def _hits(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    """The rows that are hit: their keys, items and spans."""
    at = [i for i, x in enumerate(found) if x["n_hit"]]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([found[i]["items"] for i in at], pa.list_(pa.string())), pa.array([found[i]["spans"] for i in at], _FOUND.field("spans").type)], names=["row_key", "items", "spans"])


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (x["first"] <= F.get(done, F.size(done) - 1)["last"] + 1), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), step)


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _hits_of_blocks(docs: DataFrame, first, rest: Iterator) -> DataFrame:
    """row_key, items and spans of the rows that any block hits, a pass for each block."""
    rows, parts = docs.select(_row_key().alias("row_key"), F.col("text").cast("string").alias("text")), []
    for block in (first, *(x for _, x in rest)):
        parts.append(written(rows.mapInArrow(_mapper(block, _hits), "row_key long, items array<string>, spans array<struct<first:long,last:long>>"), "benchmark-hits"))
        block.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits.groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))


def find_contamination(docs: DataFrame, phrases: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): hit words, items and merged spans of word numbers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(phrases, window, block_bytes)
    count, first = next(blocks)
    if count == 1:
        return rows.mapInArrow(_mapper(first, _report), FOUND)
    hits = written(_hits_of_blocks(rows, first, blocks), "benchmark-hits")
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    all_rows = rows.select("doc_id", _row_key().alias("row_key"), n_words.alias("n_words")).join(hits, "row_key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    spans = F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return all_rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"), spans.alias("spans"))


def remove_contaminated(docs: DataFrame, phrases: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit word, with all their columns."""
    blocks = _blocks(phrases, window, block_bytes)
    count, first = next(blocks)
    if count == 1:
        keep = lambda batch, found: batch.filter(pa.array([x["n_hit"] == 0 for x in found], pa.bool_()))
        return docs.mapInArrow(_mapper(first, keep), docs.schema)
    hits = written(_hits_of_blocks(docs, first, blocks).select(F.col("row_key").alias("hit_key")), "benchmark-hits")
    rows = docs.select(F.struct("*").alias("row"), _row_key().alias("own_key"))
    return rows.join(hits, F.col("own_key") == F.col("hit_key"), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans")
