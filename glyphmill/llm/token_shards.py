"""Token-ID shards with a minimal perfect hash index over their document keys.

Documents in ascending order are range-dealt; each task encodes its documents and writes
one shard: a payload of raw ids (two bytes each where the vocabulary allows) and an index.
The index is a minimal perfect hash of the shard's keys (levels of bits with a rank each)
into slots of fingerprint, first id and number of ids, so that a key is found in constant
time, and a key that was never stored is told by its fingerprint, but for one in 2**32.

The folder holds a manifest beside the shards: for each shard its documents, ids, and
least and greatest doc_id.  :class:`Folder` finds the shards of a key by it, reads the
index, and of the payload only the ids asked for.

A key is (doc_id, how many rows of this id are before it in the shard), so repeated ids
have keys of their own.  Files are written beside their final name and then renamed;
a task that runs again writes the same bytes.

Encoding.  A text is cut where the byte-level pattern ends a piece whatever follows, each
distinct chunk is encoded once by the tokenizers library, and the ids are laid out.  Texts
with white space outside ASCII or with the string of an added token (which is that token's
id, as in the library's default) are encoded whole.

Defined results.  Null and empty texts: the end id alone.  Null ids sort first.  Equal
rows are stored as often as they come.  Empty table: no shard has documents, no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .layout import new_folder, pieces

END_ID = 0
#: Input bytes of a shard, text bytes encoded at once, and chunks that a worker remembers (twice this at most).
SHARD_BYTES, ENCODE_BYTES, REMEMBERED = 8 << 20, 2 << 20, 150_000
MAGIC = b"GMIDS001"
MANIFEST = "manifest.json"
_SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("first", "<u8")])

_OTHER, _SPACE, _BLANK, _LETTER, _MARK, _DIGIT, _APOSTROPHE = range(7)
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x09:0x0E] = _BLANK
_KIND[0x20] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _APOSTROPHE
#: _CUT[before, after]: a piece always ends between such bytes.
_CUT = np.zeros((7, 7), dtype=bool)
for _k in (_OTHER, _LETTER, _MARK, _DIGIT, _APOSTROPHE):
    _CUT[_k, [_SPACE, _BLANK]] = True
    _CUT[_BLANK, _k] = True
_CUT[_LETTER, [_MARK, _DIGIT, _APOSTROPHE]] = True
_CUT[_MARK, [_LETTER, _DIGIT]] = True
_CUT[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = True
_WIDE_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_PLAIN = re.compile(rb" ?[A-Za-z]+")


class Encoder:
    """A tokenizer with a memory of the chunks it has seen."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Every place where the string of an added token (special or not) begins; without such tokens, none.
        self.strings = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"(?=" + b"|".join(map(re.escape, self.strings)) + b")" if self.strings else b"(?!)")
        # Only such a string can be inside of a plain chunk.
        self.in_plain = any(_PLAIN.fullmatch(x) or x == b" " for x in self.strings)
        self.model = self.tokenizer.model
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit numbers."""
        out: list = [None] * len(chunks)
        missing, longer = [], []
        for i, x in enumerate(chunks):
            got = self.new.get(x) or self.old.get(x)
            if got is None:
                missing.append(i)
            out[i] = got
        for i in missing:
            x = chunks[i]
            if _PLAIN.fullmatch(x) and not (self.in_plain and self.added.search(x)):
                out[i] = struct.pack(f"<{len(t)}I", *t) if (t := [k.id for k in self.model.tokenize(x.decode().replace(" ", "Ġ"))]) else b""
            else:
                longer.append(i)
        if longer:
            for i, e in zip(longer, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in longer], add_special_tokens=False), strict=True):
                out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        for i in missing:
            if len(chunks[i]) <= 64:
                self.new[chunks[i]] = out[i]
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block of texts: their ids in one array, and how many each text has."""
        data, offsets = W.utf8(column)
        for a, b in W.blocks(offsets, ENCODE_BYTES):
            part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            raw = part.tobytes()
            kinds = _KIND[part]
            cut = np.zeros(len(part) + 1, dtype=bool)
            if len(part):
                cut[1:-1] = _CUT[kinds[:-1], kinds[1:]]
                # The last blank of a run of several is a piece of its own: the run stays with what follows.
                blank = (kinds == _SPACE) | (kinds == _BLANK)
                cut[2:-1] &= ~(blank[:-2] & blank[1:-1] & ~blank[2:])
            cut[edges] = True
            # Most blocks hold none of these; that is told faster than by the patterns.
            sought = [_WIDE_BYTES] * any(x in raw for x in _WIDE_LEADS) + [self.added] * any(x in raw for x in self.strings)
            wide = {int(np.searchsorted(edges, m.start(), side="right")) - 1 for found in sought for m in found.finditer(raw)}
            for r in wide:
                cut[edges[r] + 1 : edges[r + 1]] = False
            bounds = np.flatnonzero(cut)
            starts, ends = bounds[:-1], bounds[1:]
            if not len(starts):
                yield np.zeros(0, np.uint32), np.zeros(b - a, np.int64)
                continue
            _, first, at = np.unique(W.hashes(part, starts, ends), return_index=True, return_inverse=True)
            known = self._ids([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            size = np.fromiter((len(x) >> 2 for x in known), np.int64, len(known))
            flat, origin = np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(size) - size
            n = size[at]
            ids = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(origin[at], n)]
            row = np.searchsorted(edges, starts, side="right") - 1
            yield ids, np.bincount(row, weights=n, minlength=b - a).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_hash(doc_ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Hash of a key; different for different ids that come once."""
    h = W.mix(doc_ids.astype(np.int64).view(np.uint64))
    h = np.where(null, W.pair(np.full(len(h), 0xA5A5, np.uint64), np.uint64(7)), h)
    return np.where(nth > 0, W.pair(h, nth.astype(np.uint64)), h)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys alone in their cell are placed, the others go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + at)
            at += int(bits.sum())
        self.size = at

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (W.pair(keys, np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 2 * len(keys) + 1
            cell = cls._cell(keys, len(levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            keys = keys[~alone[cell]]
            if len(levels) > 200:
                raise ValueError("two keys have the same hash")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where a key can't be stored."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            cell = self._cell(keys[left], level, len(bits))
            hit = bits[cell] == 1
            out[left[hit]] = self.ranks[level][cell[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + np.packbits(x.astype(np.uint8)).tobytes() for x in self.levels)

    @classmethod
    def load(cls, blob: bytes, at: int = 0) -> tuple[PerfectHash, int]:
        (n,), at = struct.unpack_from("<I", blob, at), at + 4
        levels = []
        for _ in range(n):
            (size,), at = struct.unpack_from("<Q", blob, at), at + 8
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at))[:size].astype(np.int64))
            at += width
        return cls(levels), at


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (W.pair(keys, np.uint64(0xF1)) >> np.uint64(32)).astype(np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", uri):
        uri = "file://" + uri[5:]
    # Hadoop's name of a scheme that Arrow has under another.
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Shard:
    """One shard read back: keyed access to its documents' ids."""

    def __init__(self, folder: str, number: int):
        files, path = _filesystem(folder)
        with files.open_input_stream(f"{path}/{number:06d}.idx") as f:
            index = bytes(f.read())
        assert index[:8] == MAGIC, "not an index of token ids"
        self.width, n = struct.unpack_from("<IQ", index, 8)
        self.hash, at = PerfectHash.load(index, 20)
        self.slots = np.frombuffer(index, _SLOT, n, at)
        at += n * _SLOT.itemsize
        self.doc_ids, at = np.frombuffer(index, "<i8", n, at), at + 8 * n
        self.null, at = np.frombuffer(index, np.uint8, n, at).astype(bool), at + n
        self.nth = np.frombuffer(index, "<u4", n, at)
        self._files, self._payload, self._all = files, f"{path}/{number:06d}.ids", None

    @property
    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        if self._all is None:
            with self._files.open_input_stream(self._payload) as f:
                self._all = np.frombuffer(f.read(), f"<u{self.width}")
        return self._all

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key hash, -1 for keys that are not in this shard."""
        slot = self.hash.find(keys)
        known = slot >= 0
        known[known] = self.slots["fingerprint"][slot[known]] == _fingerprint(keys[known])
        return np.where(known, slot, -1)

    def get(self, doc_id: int, nth: int = 0) -> np.ndarray | None:
        """Ids of a document with their end id, None if it isn't in this shard."""
        slot = int(self.find(key_hash(np.array([doc_id]), np.array([False]), np.array([nth])))[0])
        if slot < 0:
            return None
        first, count = int(self.slots["first"][slot]), int(self.slots["count"][slot])
        with self._files.open_input_file(self._payload) as f:
            return np.frombuffer(f.read_at(count * self.width, first * self.width), f"<u{self.width}")


class Folder:
    """All shards of a folder, by its manifest."""

    def __init__(self, folder: str):
        files, path = _filesystem(folder)
        with files.open_input_stream(f"{path}/{MANIFEST}") as f:
            self.shards = json.loads(bytes(f.read()))
        self.folder = folder

    def get(self, doc_id: int, nth: int = 0) -> np.ndarray | None:
        """Ids of the ``nth`` document with this id, in the order of the shards; None where there is none."""
        for s in self.shards:
            if s["least"] is not None and s["least"] <= doc_id <= s["greatest"]:
                shard = Shard(self.folder, s["shard"])
                here = int(((shard.doc_ids == doc_id) & ~shard.null).sum())
                if nth < here:
                    return shard.get(doc_id, nth)
                nth -= here
        return None


def _occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal keys come before each, in ascending order of keys."""
    if not len(ids):
        return np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(null.astype(np.int8)) != 0)))
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def _writer(path: str, folder: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, tokenizer = task.partitionId(), encoder(path)
        files, root = _filesystem(folder)
        name, own = f"{root}/{number:06d}", f"{root}/.{number:06d}-{task.taskAttemptId()}"
        counts, ids, nulls = [], [], []
        with files.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                column = batch.column(0)
                nulls.append(np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool))
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for flat, per in tokenizer.encode(batch.column(1)):
                    whole = np.full(len(flat) + len(per), end_id, dtype=f"<u{tokenizer.width}")
                    whole[np.arange(len(flat)) + np.repeat(np.arange(len(per)), per)] = flat
                    out.write(whole.tobytes())
                    counts.append(per + 1)
                del batch, column
                W.release()
        counts, ids, nulls = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((counts, np.int64), (ids, np.int64), (nulls, bool)))
        nth = _occurrences(ids, nulls)
        keys = key_hash(ids, nulls, nth)
        table = PerfectHash.build(keys)
        slots = np.zeros(len(ids), _SLOT)
        at = table.find(keys)
        slots["fingerprint"][at], slots["count"][at], slots["first"][at] = _fingerprint(keys), counts, np.cumsum(counts) - counts
        with files.open_output_stream(f"{own}.idx") as out:
            out.write(MAGIC + struct.pack("<IQ", tokenizer.width, len(ids)) + table.dump() + slots.tobytes() + ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + nth.astype("<u4").tobytes())
        for kind in ("ids", "idx"):
            files.move(f"{own}.{kind}", f"{name}.{kind}")
        known = ids[~nulls]
        ends = [int(known.min()), int(known.max())] if len(known) else [None, None]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, len(ids), int(counts.sum()), *ends), (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["shard", "n_docs", "n_ids", "least", "greatest"])

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int]]:
    """Writes ``docs`` (doc_id, text) in ascending order and a manifest to ``folder``; shard, documents and ids of each shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    dealt = rows.repartitionByRange(pieces(rows, shard_bytes), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    found = dealt.mapInArrow(_writer(tokenizer_path, folder, end_id), "shard int, n_docs long, n_ids long, least long, greatest long").collect()
    # A row for each shard, whatever its size: as many as the input has shards. Sorted here, since Spark would run the tasks twice to find ranges.
    found.sort(key=lambda r: r.shard)
    with files.open_output_stream(f"{root}/.{MANIFEST}") as out:
        out.write(json.dumps([r.asDict() for r in found]).encode())
    files.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
    return [(r.shard, r.n_docs, r.n_ids) for r in found]


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, number)
                slot = shard.find(key_hash(shard.doc_ids, shard.null, shard.nth))
                if (slot < 0).any():
                    raise ValueError(f"shard {number} does not find its own keys")
                first, count = shard.slots["first"][slot].astype(np.int64), shard.slots["count"][slot].astype(np.int64)
                sums = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.null), pa.array(before + first, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_shards(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, by keyed access to the files."""
    rows, before = [], 0
    for number, n_docs, n_ids in manifest:
        if n_docs:
            rows.append((number, before))
        before += n_ids
    listed = spark.createDataFrame(rows, "shard int, before long").repartition(max(1, len(rows)), "shard")
    return listed.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-ids")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(spark, folder, manifest)
