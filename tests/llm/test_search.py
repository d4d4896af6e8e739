"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import hard_negatives, lexical_search, suffix_dedup, words

LOWER = {a: a + 32 for a in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def clash(df):
    """The same rows with extra columns of names that operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ["key", "id", "rank", "score", "query", "group", "start", "piece", "anchor", "row", "vector", "size", "spans", "kept"]})


# op11


def ranked(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in rows]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(w for _, c in rows for w in c)
    out = Counter()
    for item, text in set(items):
        found = []
        for (i, c), size in zip(rows, n, strict=True):
            if size:
                m = 100 - 90 + (90 * size * count) // total
                s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
                if s > 0:
                    found.append((-s, i is None, i or 0))
        for r, (s, none, i) in enumerate(sorted(found)[:k]):
            out[item, r + 1, None if none else i, -s] += 1
    return out


ITEMS = [(1, "w1 w2 W3"), (2, "w3"), (3, None), (4, ""), (5, "--- !!"), (6, "nowhere to be found zzz"), (7, "w10 w11 w12 w13 w14 w250 w300"), (7, "another text of item 7 w5"), (1, "w1 w2 W3"), (None, "w7 w8"), (8, "Ünïcode w1 one"), (9, " ".join(f"w{i}" for i in range(60)))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("blocks", [4 << 20, 100])
def test_search_equals_brute_force(docs, rows, items, blocks):
    got = lexical_search.search(clash(docs), clash(items), block_bytes=blocks, shard_bytes=4000 if blocks == 100 else lexical_search.SHARD_BYTES)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == ranked([r[:2] for r in rows], ITEMS)


def test_search_of_empty_tables(docs, items, empty):
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_with_a_large_group_of_equal_texts(spark):
    rng = random.Random(3)
    texts = [(i, "same words in a third of all rows") for i in range(400)] + [(400 + i, " ".join(f"v{rng.randrange(90)}" for _ in range(rng.randint(1, 60)))) for i in range(800)]
    ask = [(i, " ".join(f"v{rng.randrange(90)}" for _ in range(5)) + " words rows") for i in range(12)]
    got = lexical_search.search(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(ask, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == ranked(texts, ask)


def cost(values, starts, fixed):
    edges = [*np.flatnonzero(starts).tolist(), len(values)]
    return sum(max(values[a:b]) * (b - a) - sum(values[a:b]) + fixed for a, b in zip(edges, edges[1:], strict=False))


def test_block_boundaries_cost_least():
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 1000, n) for n in (1, 2, 9, 11, 7, 11)]
    sizes = np.array([len(x) for x in lists])
    starts = lexical_search.block_starts(np.concatenate(lists), sizes, longest=20, cost=1.5)
    a = 0
    for values in lists:
        own, fixed = starts[a : a + len(values)], values.mean() * 1.5
        a += len(values)
        assert own[0]
        least = min(cost(values, np.array([True, *[(code >> i) & 1 for i in range(len(values) - 1)]], bool), fixed) for code in range(1 << (len(values) - 1)))
        assert math.isclose(cost(values, own, fixed), least)
    assert not lexical_search.block_starts(np.zeros(0, np.int64), np.zeros(0, np.int64)).any()


def test_search_skips_blocks():
    rng = np.random.default_rng(5)
    n = 20000
    places = [np.sort(rng.choice(top, size, replace=False)) for top, size in ((n, 7500), (n, 3000), (2000, 40))]
    counts = [np.where((p // 64) % 16 == 3, 30, 1) for p in places]
    shard = lexical_search.Shard(np.full(n, 50), np.arange(3), np.array([len(p) for p in places]), np.concatenate(places), np.concatenate(counts), np.array([900, 2000, 5000]), n, n * 50)
    place, score = shard.search(np.arange(3), 10)
    full = np.zeros(n, np.int64)
    first = 0
    for p in places:
        full[p] += shard.impacts[first : first + len(p)]
        first += len(p)
    best = np.lexsort((np.arange(n), -full))[:10]
    assert (place == best).all() and (score == full[best]).all()
    assert shard.read < len(shard.places) / 2  # whole blocks were left out


# op12


def mined(rows, anchors, k=5, m=10):
    good = [(i, lab, [math.floor(256 * float(x)) for x in v], n) for n, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, lab, v, n in good:
        if i is None or not anchors(i):
            continue
        score = lambda o: sum(a * b for a, b in zip(v, o[2], strict=True))  # noqa: E731, B023
        order = sorted((o for o in good if o[3] != n and len(o[2]) == len(v)), key=lambda o: (-score(o), o[0] is None, o[0] or 0))  # noqa: B023
        for p in [o for o in order if o[1] == lab][:k]:
            window = [o for o in order if o[1] != lab and 30 * score(p) <= 100 * score(o) <= 90 * score(p)]
            for r, o in enumerate(window[:m]):
                out[i, p[0], r + 1, o[0], score(p), score(o)] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed=1, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) / math.sqrt(dim) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]


def odd(rows):
    v = rows[0][1]
    return rows + [(None, v, 0), (None, v, 1), (901, v, None), (902, None, 1), (903, [*v[:-1], None], 1), (904, [*v[:-1], float("nan")], 1), (905, [*v[:-1], float("inf")], 1), (906, v[:2], 1), (910, v[:2], 1), (907, [], 1), (20, v, 1), (908, [0.0] * len(v), 0)]


@pytest.mark.parametrize("leaf", [4, 512])
def test_mining_equals_brute_force(spark, leaf):
    rows = odd(vectors(300, 8))
    got = hard_negatives.mine(clash(spark.createDataFrame(rows, VECTORS).repartition(3)), F.col("vec_id") % 10 == 0, leaf=leaf, anchors_at_once=16)
    assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows, lambda i: i % 10 == 0)


def test_mining_with_one_vector_in_a_third_of_the_rows(spark):
    rows = vectors(240, 6, 4)
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(120)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 40 == 0, leaf=8)
    assert Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows, lambda i: i % 40 == 0)


def test_mining_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(vectors(20, 4), VECTORS), F.lit(None).cast("boolean")).count() == 0


def test_trees_leave_out_what_the_annulus_cannot_hold():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 4000, (12, 3))
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 30, (1200, 3))).astype(np.int64)
    order, nodes = hard_negatives.Tree.build(rows, 16)
    tree = hard_negatives.Tree(rows[order], nodes)
    tree.rank = order
    query, leaves = rows[7], {}
    scores = rows @ query
    high = int(np.quantile(scores, 0.6))
    place, score = tree.traverse(query, leaves, np.ones(1200, bool), high // 2, high, 10)
    inside = np.flatnonzero((scores >= high // 2) & (scores <= high))
    best = inside[np.lexsort((inside, -scores[inside]))][:10]
    assert (order[place] == best).all() and (score == scores[best]).all()
    assert len(leaves) < len(nodes) / 2


# op13


def removed(rows, size=50):
    out, first = [], {}
    rank = lambda i: (i is None, i or 0)
    windows = lambda b: {b[s : s + size] for s in range(len(b) - size + 1)}
    for i, t in rows:
        for w in windows((t or "").encode()):
            first[w] = min(first.get(w, rank(i)), rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < rank(i):
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digest(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return Counter(map(tuple, df.select("doc_id", "n_bytes", n, F.size("spans"), F.sha2("kept", 256)).collect()))


def passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(20) for _ in range(4)]
    rows = [(i, text(30) + shared[i % 4] + text(10) + (shared[(i + 1) % 4][: 40 + i] if i % 3 else "")) for i in range(40)]
    rows += [(50, rows[7][1]), (51, rows[7][1]), (52, rows[7][1][3:]), (53, "a" * 300), (54, "b" + "a" * 120), (55, "ab" * 90), (56, rows[3][1][:50]), (57, rows[3][1][:49]), (58, None), (59, ""), (5, rows[9][1]), (5, rows[5][1]), (5, rows[5][1]), (None, rows[2][1] + "x"), (None, rows[2][1] + "x"), (60, text(900) + shared[0])]
    return rows


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_removal_equals_brute_force(spark, hot):
    rows = passages()
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert digest(suffix_dedup.remove_repeats(df, hot=hot)) == removed(rows)
    assert digest(suffix_dedup.remove_repeats(df, min_match=17, hot=hot)) == removed(rows, 17)


def test_answers_are_rows_of_buckets_not_of_texts(spark, monkeypatch):
    keys = np.arange(1, 401, dtype=np.int64)
    asked = suffix_dedup._questions(np.repeat(np.arange(1, 9, dtype=np.uint64), 50), np.arange(400), keys, 4).to_pylist()
    parts = [suffix_dedup._questions(np.full(400, 77, np.uint64), np.arange(400), k, 4) for k in (keys, keys + 400)]
    assert len(asked) <= 8
    answers = suffix_dedup._answer(4)(pa.Table.from_batches(parts))
    assert len(answers) <= 8 and {int(k) for x in answers.column("keys").to_pylist() for k in np.frombuffer(x, np.int64)} == set(range(1, 801))
    rows = passages()
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 4096)  # many ranges and buckets
    assert digest(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == removed(rows)


def test_removal_of_fixture_rows_and_of_nothing(docs, rows, empty):
    assert digest(suffix_dedup.remove_repeats(docs)) == removed([r[:2] for r in rows])
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_worked_on_in_overlapping_blocks(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 64)
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(700))
    seen = defaultdict(list)
    for data, offsets, _, begun, origin in suffix_dedup._blocks(pa.array([text]), 20):
        _, first, length, row, _ = suffix_dedup.runs(data, offsets, 20)
        for f, n, r in zip(first.tolist(), length.tolist(), row.tolist(), strict=True):
            seen[origin].extend(range(f - int(offsets[r]) + int(begun[r]), f - int(offsets[r]) + int(begun[r]) + n))
    assert sorted(x for xs in seen.values() for x in xs) == list(range(681))  # each window once


def test_suffixes_of_any_sequence_are_in_order():
    rng = np.random.default_rng(3)
    for n in [*range(30), 100, 257]:
        for letters in (1, 2, 5, 300):
            text = rng.integers(0, letters, n)
            assert suffix_dedup.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
            near = suffix_dedup.suffix_array(text, 7).tolist()
            assert sorted(near) == list(range(n))
            heads = [text[i : i + 7].tolist() for i in near]
            assert heads == sorted(heads)
