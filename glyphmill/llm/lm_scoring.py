"""LM scoring with a weighted backoff automaton, over any number of machines.

The model is a trigram model in which each order is smoothed by a Dirichlet prior on the
next lower one, down to an add-one unigram model:

    p1(w)       = (c(w) + 1) / (N + V + 1)
    p2(w | h)   = (c(h w) + m2 * p1(w)) / (c(h) + m2)
    p3(w | g h) = (c(g h w) + m3 * p2(w | h)) / (c(g h) + m3)

As an automaton: state 0 is the root; each training word, the start of a text, and each
pair of neighbours seen in training is a state.  A pair's state has an arc for each
trigram seen, with log10 p3, and a failure arc to the state of its second word with
log10(m3 / (c(g h) + m3)); a word's state has an arc for each bigram seen, with log10 p2,
and a failure arc to the root with log10(m2 / (c(h) + m2)); the root has an arc for each
training word with log10 p1 and one for all other words.  An arc leads to the state of
the longest suffix that was seen: the last pair, the last word, or the root.

No machine ever holds the whole automaton.  Texts are dealt to shards by a hash.  Each
shard sends its distinct n-grams with their local training counts to buckets of the hash
range; buckets add them up and answer each shard for its own n-grams; a shard then has
every state and arc that its texts can visit and traverses them from left to right.
What travels is packed arrays, one row for each shard and bucket that have n-grams in
common, so never more rows than n-grams.

Defined results.  Null and empty texts: one end token.  Null doc_id: its text is "null"
for the hash (an empty string), so it counts by crc32('').  Repeated rows: each is
scored and each is learned from.  Empty table: no rows.  Other columns are not read.
Hot keys: the shard is a hash of doc_id and text, n-grams are counted within a shard
before they travel, so that neither a common word nor a common pair is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .layout import pieces

#: The end of a text as a token, and its start as a history.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
START = np.uint64(0x57A757A757A757A7)

SHARD_BYTES = 3 << 20
#: Distinct tokens that a task holds before it sends them.
HELD_WORDS = 4 << 20
#: Prior strengths of pairs and of triples; of a few tried, those under which held-out texts of a small table are likeliest.
M2, M3 = 400.0, 8.0
#: An n-gram of several words has a key of this many bits more than the number of tokens has: at any size it shares its key with a chance of about one in a million.
SPARE_BITS = 20
KINDS = ("word", "pair", "triple")
ASKED = "bucket int, shard int, " + ", ".join(f"{k}s binary, {k}_counts binary" for k in KINDS)
TOLD = "shard int, bucket int, " + ", ".join(f"{k}_counts binary" for k in KINDS)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts with their ends, and where each text starts (one more at the end)."""
    tokens, starts, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for a, b, h, row in W.words(table.column("text")):
        per = np.bincount(row, minlength=b - a) + 1
        out = np.full(len(h) + b - a, END, dtype=np.uint64)
        out[np.arange(len(h)) + row] = h
        tokens.append(out)
        starts.append(at + np.cumsum(per))
        at += len(out)
    return np.concatenate(tokens), np.concatenate(starts)


def _grams(table: pa.Table, bits: int) -> dict:
    """Distinct n-grams of a shard in ascending order of their keys, and each token's place in them."""
    tokens, starts = _tokens(table)
    out: dict = {"starts": starts}
    out["words"], at = np.unique(tokens, return_inverse=True)
    out["word_at"] = at.astype(np.int32)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = START
    pair = W.pair(before, tokens)
    short = np.uint64(64 - bits)
    out["pairs"], at = np.unique(pair >> short, return_inverse=True)
    out["pair_at"] = at.astype(np.int32)
    del before
    # The pair before with this token; the first of a text has none.
    key = np.full(len(tokens), START, np.uint64)
    key[1:] = pair[:-1]
    key[starts[:-1]] = START
    out["triples"], at = np.unique(W.pair(key, tokens) >> short, return_inverse=True)
    out["triple_at"] = at.astype(np.int32)
    return out


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket of the hash range begins in ascending keys."""
    return np.searchsorted((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _sides(g: dict, buckets: int, bits: int) -> tuple[list[int], dict[str, np.ndarray]]:
    """The buckets that hold n-grams of a shard, and where each bucket begins in the n-grams of each kind."""
    cuts = {k: _cuts(g[f"{k}s"], buckets, 64 if k == "word" else bits) for k in KINDS}
    return np.flatnonzero(sum(np.diff(c) for c in cuts.values())).tolist(), cuts


def _ask(buckets: int, bits: int):
    def ask(table: pa.Table) -> pa.Table:
        W.release()
        g = _grams(table, bits)
        held = table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        learned = np.repeat(~held, np.diff(g["starts"])).astype(np.float64)
        asked, cuts = _sides(g, buckets, bits)
        columns = [pa.array(asked, pa.int32()), pa.array([table.column("shard")[0].as_py()] * len(asked), pa.int32())]
        for k in KINDS:
            counts = np.bincount(g.pop(f"{k}_at"), weights=learned, minlength=len(g[f"{k}s"])).astype(np.uint64)
            sides = [(cuts[k][i], cuts[k][i + 1]) for i in asked]
            columns += [pa.array([f(v[a:b]) for a, b in sides], pa.binary()) for f, v in ((W.pack_sorted, g[f"{k}s"]), (W.pack, counts))]
        return pa.table(columns, names=["bucket", "shard", *(f"{k}{x}" for k in KINDS for x in ("s", "_counts"))])

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """Adds up one bucket's counts over all shards and answers every shard in the order it asked."""
    W.release()
    told: dict[str, list] = {}
    for k in KINDS:
        keys = [W.unpack_sorted(x.as_py()) for x in table.column(f"{k}s")]
        counts = [W.unpack(x.as_py()) for x in table.column(f"{k}_counts")]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)
        ends = np.cumsum([len(x) for x in keys])
        told[k] = [W.pack(total[at[e - len(x) : e]]) for x, e in zip(keys, ends, strict=True)]
    return pa.table([table.column("shard").combine_chunks().cast(pa.int32()), table.column("bucket").combine_chunks().cast(pa.int32()), *(pa.array(told[k], pa.binary()) for k in KINDS)], names=["shard", "bucket", *(f"{k}_counts" for k in KINDS)])


class Automaton:
    """The states and arcs that one shard's texts can visit.  States: 0 the root, then words, the start, and pairs."""

    def __init__(self, counts: dict[str, np.ndarray], end: int, total: int, types: int, m2: float, m3: float):
        """Counts are those of all training texts; ``end`` is the place of the end token among the words, or -1."""
        words, self.pairs, self.triples = (counts[k].astype(np.float64) for k in KINDS)
        self.root_arc = np.log10((words + 1) / (total + types + 1))
        self.word_state = np.where(words > 0, np.arange(1, len(words) + 1), 0)
        self.start = len(words) + 1
        begun = words[end] if end >= 0 else 0.0
        self.pair_state = np.where(self.pairs > 0, np.arange(len(self.pairs)) + self.start + 1, 0)
        #: How often each state was a history in training, and the prior strength at it.
        self.history = np.concatenate(([0.0], words, [begun], self.pairs))
        self.m2, self.m3 = m2, m3

    def traverse(self, starts: np.ndarray, word_at: np.ndarray, pair_at: np.ndarray, triple_at: np.ndarray) -> np.ndarray:
        """log10 probability of each text: all texts advance together, a token a step, each with its state."""
        length = np.diff(starts)
        order = np.argsort(-length, kind="stable")
        first, left = starts[:-1][order], length[order]
        state = np.full(len(order), self.start if self.history[self.start] > 0 else 0, dtype=np.int64)
        back = state.copy()  # where the failure arc of a pair's state leads
        total = np.zeros(len(order))
        # Texts that still have a token at each step: a prefix of the order.
        active = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="right")
        for t, k in enumerate(active):
            at = first[:k] + t
            w, pair, s, lower = word_at[at], pair_at[at], state[:k], back[:k]
            p = 10.0 ** self.root_arc[w]
            n = self.history[lower]
            p = np.where(lower > 0, (np.where(n > 0, self.pairs[pair], 0.0) + self.m2 * p) / (n + self.m2), p)
            high = s > self.start
            p[high] = (self.triples[triple_at[at[high]]] + self.m3 * p[high]) / (self.history[s[high]] + self.m3)
            total[:k] += np.log10(p)
            back[:k] = self.word_state[w]
            state[:k] = np.where(self.pair_state[pair] > 0, self.pair_state[pair], back[:k])
        out = np.empty(len(order))
        out[order] = total
        return out


def _score(total: int, types: int, bits: int, m2: float, m3: float):
    def score(_key, docs: pa.Table, told: pa.Table) -> pa.Table:
        W.release()
        g = _grams(docs, bits)
        told = told.sort_by("bucket")
        counts = {k: np.concatenate([np.zeros(0, np.uint64), *(W.unpack(x.as_py()) for x in told.column(f"{k}_counts"))]) for k in KINDS}
        del told
        end = int(np.searchsorted(g["words"], END)) if len(g["words"]) else -1
        automaton = Automaton(counts, end, total, types, m2, m3)
        scores = automaton.traverse(g["starts"], *(g[f"{k}_at"] for k in KINDS))
        heads = g["starts"][:-1]
        base = np.add.reduceat(automaton.root_arc[g["word_at"]], heads) if len(heads) else np.zeros(0)
        known = np.add.reduceat((counts["word"] > 0).astype(np.int64)[g["word_at"]], heads) if len(heads) else np.zeros(0, np.int64)
        n = docs.num_rows
        return pa.table([docs.column("doc_id").combine_chunks().cast(pa.int64()), docs.column("held_out").combine_chunks(), pa.array(np.diff(g["starts"]), pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of a task's texts and how often each comes, in parts of some millions at most."""

    def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
        w, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return w, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)

    found: list = []
    for batch in batches:
        found.append(np.unique(_tokens(pa.table([batch.column(0)], names=["text"]))[0], return_counts=True))
        if sum(len(x) for x, _ in found) > HELD_WORDS:
            found = [merged(found)]
            if len(found[0][0]) > HELD_WORDS // 2:
                yield _counted(*found.pop())
        del batch
        W.release()
    if found:
        yield _counted(*merged(found))


def _counted(w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


def score_documents(docs: DataFrame, *, held_out=None, m2: float = M2, m3: float = M3, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) with its log10 probability.

    ``held_out``: a boolean column over docs; its rows are scored but not learned from.
    By default crc32(doc_id as text) mod 7 is 2.
    """
    shards = pieces(docs.select("doc_id", "text"), shard_bytes)
    buckets = -(-shards // 2)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2 if held_out is None else held_out
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held_out")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    words = docs.where(~F.coalesce(held, F.lit(False))).select(F.col("text").cast("string").alias("text")).mapInArrow(_vocabulary, "word long, n long")
    total, types = words.groupBy("word").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(64, max(32, int(total).bit_length() + SPARE_BITS))
    asked = dealt.groupBy("shard").applyInArrow(_ask(buckets, bits), ASKED).repartition(buckets, "bucket")
    told = asked.groupBy("bucket").applyInArrow(_tell, TOLD)
    return dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_score(total, types, bits, m2, m3), SCORED)


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
