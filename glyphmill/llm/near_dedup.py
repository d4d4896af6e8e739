"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A text's set is its distinct word shingles, as 64-bit hashes.  Texts with equal sets
   are one class; all that follows is between classes.
2. A class retains its k least hashes.  Inverted lists are keyed by two retained values
   that are neighbours in the order of hashes; two sets of similarity 0.8 have about 0.64
   of these keys in common, and with k = 32 the chance that they share none is about
   0.512 ** 32, or nil for sets of up to k hashes.
3. Classes that meet in a list of at most ``list_size`` are pairs; pairs whose sizes
   cannot reach the threshold go, then those whose similarity estimated from the union
   of the two sketches is more than five standard errors below it.
4. Pairs that stay are verified on full sets.
5. A class of which a quarter of the keys stand in longer lists belongs to a large group
   of near copies.  Such classes bring their full sets to half of these lists, where a worker
   verifies links by pivots: once most of a list is one component, only the classes
   outside are compared with it.  Lists are split into chunks of about ``chunk`` classes
   and ``CHUNK_SHINGLES`` shingles that all hold the list's pivot; a second pass compares the classes that a split list left
   outside its pivot's component with all chunks of that list.  Only the edges of a
   spanning forest leave a worker, never the pairs of a group.
6. Components of the links give each document the least doc_id that it reaches.

Defined results.  Null, empty and wordless texts: no shingles, a component of their own.
Texts of fewer words than a shingle: the whole sequence as one.  Very long texts are
hashed whole.  Rows with the same doc_id: their own sets; each row has its result.  Null
ids: never the least where another is there.  Empty table: no rows.  Columns that clash
with added ones are kept by :func:`deduplicate` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .graph import components
from .layout import cut

KEPT, SIMILARITY = 32, (4, 5)
LIST_SIZE, CHUNK = 24, 4000
#: Shingles of all sets of a chunk, unless one set alone has more.
CHUNK_SHINGLES = 2 << 20
SKETCHED = "row_key long, doc_id long, n_shingles long, set_key binary, sketch array<long>"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for a, b, h, row in W.words(texts):
        first = np.searchsorted(row, np.arange(b - a + 1))
        n = np.diff(first)
        grams = h[: max(0, len(h) - width + 1)]
        for j in range(1, width):
            grams = W.pair(grams, h[j : j + len(grams)])
        for i in range(b - a):
            if n[i] >= width:
                yield np.unique(grams[first[i] : first[i + 1] - width + 1])
            elif n[i]:
                whole = h[first[i] : first[i] + 1]
                for j in range(1, n[i]):
                    whole = W.pair(whole, h[first[i] + j : first[i] + j + 1])
                yield W.mix(whole + np.uint64(n[i]))
            else:
                yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketcher(width: int, kept: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, sketches, ends = [], [], [np.zeros(0, np.uint64)], [0]
        for s in shingle_sets(batch.column(2), width):
            sizes.append(len(s))
            keys.append(set_key(s))
            sketches.append(s[:kept].copy())
            ends.append(ends[-1] + min(len(s), kept))
        values = np.concatenate(sketches).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["row_key", "doc_id", "n_shingles", "set_key", "sketch"])

    return W.lean(step)


def _setter(width: int):
    """Sets of texts, for those whose set is the one that the key names (a doc_id may have other texts)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(k, W.pack_sorted(s)) for k, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True) if set_key(s) == k]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["set_key", "hashes"])

    return W.lean(step)


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether |a n b| / |a u b| reaches the threshold, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and similarity[1] * both >= similarity[0] * (len(a) + len(b) - both)


def _estimate(kept: int, least: float):
    """Keeps the pairs whose union sketch does not speak against them."""

    def near(a: pa.Scalar, b: pa.Scalar) -> bool:
        x, y = (np.asarray(s.values).view(np.uint64) for s in (a, b))
        union = np.union1d(x, y)[:kept]
        return (np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)).mean() >= least

    return W.lean(lambda batch: batch.filter(pa.array([near(a, b) for a, b in zip(batch.column("a_sketch"), batch.column("b_sketch"), strict=True)], pa.bool_())).select(["a", "b"]))


def _verify(similarity: tuple[int, int]):
    """Keeps the pairs whose full sets are similar enough."""

    def holds(x: pa.Scalar, y: pa.Scalar) -> bool:
        return similar(W.unpack_sorted(x.as_py()), W.unpack_sorted(y.as_py()), similarity)

    return W.lean(lambda batch: batch.filter(pa.array([holds(x, y) for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True)], pa.bool_())).select(["a", "b"]))


def forest(sets: list[np.ndarray], similarity: tuple[int, int], outside: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets; every link of a set that is ``outside`` (default: of every set) is in it or implied.

    One set after the other is the pivot and is compared with all at once.  A set whose links can only lead into
    its own component is skipped: when all that is left lies in one component, its members need not be pivots.
    """
    n = len(sets)
    flat, own = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids = np.unique(flat, return_inverse=True)
    size = np.array([len(s) for s in sets])
    heads = np.cumsum(size) - size
    label, edges = np.arange(n), []
    todo = np.ones(n, bool) if outside is None else outside.copy()
    mask = np.zeros(int(ids.max()) + 1, bool)
    while True:
        # Pivots from the largest component come first while they add to it, then all that is outside of it.
        left = np.flatnonzero(todo)
        if not len(left):
            return edges
        if outside is None:
            counts = np.bincount(label, minlength=n)
            out = left[label[left] != counts.argmax()]
            if not len(out):
                return edges
            pivot = int(out[0])
        else:
            pivot = int(left[0])
        todo[pivot] = False
        mine = ids[heads[pivot] : heads[pivot] + size[pivot]]
        mask[mine] = True
        both = np.bincount(own, weights=mask[ids], minlength=n).astype(np.int64)
        mask[mine] = False
        linked = np.flatnonzero((both > 0) & (similarity[1] * both >= similarity[0] * (size + size[pivot] - both)))
        for other in linked.tolist():
            if label[other] != label[pivot]:
                edges.append((pivot, other))
                label[label == label[other]] = label[pivot]


def _crowd(similarity: tuple[int, int]):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("set_key").to_pylist()
        first = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        rows = list(first.values())
        outside = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)[rows]
        hashes = table.column("hashes")
        W.release()
        edges = forest([W.unpack_sorted(hashes[i].as_py()) for i in rows], similarity, outside if outside.any() else None)
        return pa.table([pa.array([keys[rows[i]] for i, _ in edges], pa.binary()), pa.array([keys[rows[j]] for _, j in edges], pa.binary())], names=["a", "b"])

    return run


def _roots(classes: DataFrame, texts_of, kept: int, similarity: tuple[int, int], list_size: int, chunk: int) -> DataFrame:
    """node and root of linked classes (set_key, n_shingles, sketch) but the roots themselves; ``texts_of`` gives the sets of chosen classes."""
    share = similarity[0] / similarity[1]
    keyed = classes.where(F.size("sketch") > 1).select("set_key", "n_shingles", F.explode(F.transform(F.sequence(F.lit(0), F.size("sketch") - 2), lambda i: F.xxhash64(F.get("sketch", i), F.get("sketch", i + 1)))).alias("list"))
    lengths = keyed.groupBy("list").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    members = cut(keyed.join(lengths, "list"))
    short = members.where(F.col("length") <= list_size)
    a = short.select("list", F.col("set_key").alias("a"), F.col("n_shingles").alias("a_n"))
    b = short.select("list", F.col("set_key").alias("b"), F.col("n_shingles").alias("b_n"))
    fits = (F.least("a_n", "b_n") * similarity[1] >= F.greatest("a_n", "b_n") * similarity[0]) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "list").where(fits).select("a", "b").distinct()
    sketch = classes.select("set_key", "sketch")
    least = share - 5 * (share * (1 - share) / kept) ** 0.5
    with_a = pairs.join(sketch.select(F.col("set_key").alias("a"), F.col("sketch").alias("a_sketch")), "a")
    with_both = with_a.join(sketch.select(F.col("set_key").alias("b"), F.col("sketch").alias("b_sketch")), "b")
    likely = cut(with_both.mapInArrow(_estimate(kept, least), "a binary, b binary"))

    long = members.where(F.col("length") > list_size)
    keys = F.least(F.col("n_shingles"), F.lit(kept)) - 1
    crowded = cut(long.groupBy("set_key").agg(F.count(F.lit(1)).alias("hot"), F.first(keys).alias("keys")).where(F.col("hot") * 4 >= F.col("keys")).select("set_key"))
    needed = likely.select(F.col("a").alias("set_key")).unionByName(likely.select(F.col("b").alias("set_key"))).unionByName(crowded).distinct()
    sets = cut(texts_of(needed))
    one = likely.join(sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("a_hashes")), "a")
    two = one.join(sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("b_hashes")), "b")
    links = cut(two.mapInArrow(_verify(similarity), "a binary, b binary"))

    # Of whole sketches the even keys: linked classes have ten of these in common on average, and none with a chance of 0.36 ** 15.
    even = (F.least(F.col("n_shingles"), F.lit(kept)) < kept) | (F.col("list") % 2 == 0)
    in_lists = long.where(even).join(crowded, "set_key", "left_semi").select("list", "set_key", "n_shingles")
    # Each list's own order of its classes decides its chunks and its pivot.
    dealt = in_lists.withColumn("turn", F.xxhash64("list", "set_key"))
    lists = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.min(F.struct("turn", "set_key")).alias("least")).where("n > 1").select("list", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"), F.col("least.set_key").alias("pivot"))
    lists = cut(lists)
    placed = dealt.join(lists, "list").select("list", "set_key", "chunks", "pivot", F.pmod("turn", F.col("chunks")).cast("int").alias("part"))
    rows = placed.select("list", "set_key", "part").unionByName(lists.where("chunks > 1").select("list", F.col("pivot").alias("set_key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part")))
    crowd = lambda r: r.join(sets, "set_key").groupBy("list", "part").applyInArrow(_crowd(similarity), "a binary, b binary")
    links = links.unionByName(cut(crowd(rows.withColumn("outside", F.lit(False))).distinct()))
    rooted = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    if lists.where("chunks > 1").isEmpty():
        return rooted
    root = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    split = placed.where("chunks > 1").join(root("set_key"), "set_key", "left").join(root("pivot"), "pivot", "left")
    apart = F.coalesce("set_key_root", "set_key") != F.coalesce("pivot_root", "pivot")
    strangers = split.where(apart).select("list", "set_key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.lit(True).alias("outside"))
    again = strangers.unionByName(split.where(~apart).select("list", "set_key", "part", F.lit(False).alias("outside")).join(strangers.select("list").distinct(), "list", "left_semi"))
    found = cut(crowd(again).distinct())
    if found.isEmpty():
        return rooted
    # The components so far are stars: with the new links they converge in few rounds.
    return components(rooted.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def groups(docs: DataFrame, *, width: int = 5, kept: int = KEPT, similarity: tuple[int, int] = SIMILARITY, list_size: int = LIST_SIZE, chunk: int = CHUNK) -> DataFrame:
    """row_key (a hash of doc_id and text), doc_id, n_shingles, group (null without shingles) and component_id for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = cut(rows.select(row_key().alias("row_key"), "doc_id", "text").mapInArrow(_sketcher(width, kept), SKETCHED))
    classes = cut(sketched.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))

    def texts_of(needed: DataFrame) -> DataFrame:
        # The class's least id finds its text.
        wanted = needed.join(classes.select("set_key", F.col("doc_id").alias("least_id")), "set_key")
        found = wanted.join(rows, F.col("least_id").eqNullSafe(F.col("doc_id"))).select("set_key", "text")
        return found.mapInArrow(_setter(width), "set_key binary, hashes binary").dropDuplicates(["set_key"])

    rooted = _roots(classes, texts_of, kept, similarity, list_size, chunk)
    placed = classes.select("set_key", "doc_id").join(rooted, F.col("set_key") == F.col("node"), "left").select("set_key", "doc_id", F.coalesce("root", "set_key").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = placed.join(least, "root").select("set_key", "root", "component_id")
    joined = sketched.select("row_key", "doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    shingled = F.col("n_shingles") > 0
    return joined.select("row_key", "doc_id", "n_shingles", F.when(shingled, F.col("root")).alias("group"), F.when(shingled, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the least doc_id, then the least row key; rows without shingles all stay."""
    found = cut(groups(docs, **options))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
    stay = found.where("group is not null").groupBy("group").agg(first).select("first.row_key").join(found.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies")), "row_key")
    stay = cut(stay.unionByName(found.where("group is null").select("row_key").distinct().withColumn("copies", F.lit(1).cast("long"))).select(F.col("row_key").alias("stay"), "copies"))
    kept = docs.select(F.struct("*").alias("row"), row_key().alias("own_key")).join(stay, F.col("own_key") == F.col("stay"))
    if not stay.where("copies > 1").isEmpty():
        # Rows that come more than once as they are: one of them stays.
        kept = kept.where("copies = 1").unionByName(kept.where("copies > 1").dropDuplicates(["own_key"]))
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
