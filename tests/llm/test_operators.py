import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, decontamination, language_id, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, sharding, token_shards, words
from glyphmill.llm.graph import components

LOWER = {a: a + 32 for a in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return (t or "").translate(LOWER)


def held(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == 2


def clash(df):
    """The same rows with extra columns of names that operators use themselves."""
    names = ["shard", "slot", "size", "kept", "score", "row_key", "gm_size", "hashes", "list", "level", "target", "copies", "n_words", "held_out", "set_key"]
    return df.withColumns({c: F.lit("x") for c in names})


# words


def test_words_equal_regex_and_hashes_are_per_word(rows):
    texts = [r[1] for r in rows]
    found = [[] for _ in texts]
    for a, _, h, row in words.words(pa.array(texts, pa.string())):
        for x, r in zip(h.tolist(), row.tolist(), strict=True):
            found[a + r].append(x)
    known = {}
    for t, hs in zip(texts, found, strict=True):
        ws = WORD.findall(low(t))
        assert len(ws) == len(hs)
        for w, h in zip(ws, hs, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_blocks_of_any_size_give_the_same_words(rows, monkeypatch):
    texts = pa.array([r[1] for r in rows], pa.string())
    whole = np.concatenate([h for _, _, h, _ in words.words(texts)])
    data, offsets = words.utf8(texts)
    parts = [words.hashes(words.LOWER[data[offsets[a] : offsets[b]]], *words.spans(words.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])[:2]) for a, b in words.blocks(offsets, 64)]
    assert (np.concatenate(parts) == whole).all()


def test_packing_round_trips():
    v = np.array([0, 1, 255, 256, 2**40, 2**63 + 5], dtype=np.uint64)
    assert (words.unpack(words.pack(v)) == v).all()
    assert (words.unpack_sorted(words.pack_sorted(v)) == v).all()
    assert len(words.unpack(words.pack(np.zeros(0, np.uint64)))) == 0


# LM scoring


def brute_lm(rows, m2, m3):
    tokens = [(i, [*WORD.findall(low(t)), None]) for i, t, *_ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, ts in tokens:
        if not held(i, 7):
            one.update(ts)
            two.update(zip(["<s>", *ts[:-1]], ts, strict=True))
            three.update((ts[j - 2] if j > 1 else "<s>", ts[j - 1], ts[j]) for j in range(1, len(ts)))
    total, types = sum(one.values()), len(one)
    out = []
    for i, ts in tokens:
        base = score = 0.0
        for g, h, w in zip([0, "<s>", *ts[:-2]], ["<s>", *ts[:-1]], ts, strict=False):
            p1 = (one[w] + 1) / (total + types + 1)
            p2 = (two[h, w] + m2 * p1) / ((one[None] if h == "<s>" else one[h]) + m2)
            base += math.log10(p1)
            score += math.log10((three[g, h, w] + m3 * p2) / (two[g, h] + m3) if g else p2)
        out.append((i, held(i, 7), len(ts), sum(one[w] > 0 for w in ts), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1, 1 << 30])
def test_lm_scores_equal_brute_force(docs, rows, shard_bytes, monkeypatch):
    monkeypatch.setattr(lm_scoring, "pieces", lambda df, n: 7 if n == 1 else 1)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score_documents(clash(docs), m2=50.0, m3=3.0, shard_bytes=shard_bytes).collect()]
    assert sorted(got, key=repr) == brute_lm(rows, 50.0, 3.0)


def test_lm_empty(empty):
    assert lm_scoring.score_documents(empty).count() == 0


# Near-dedup


def brute_groups(rows, width, a=4, b=5):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            n = len(x & sets[j])
            if n and b * n >= a * (len(x) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("width", "list_size", "chunk"), [(2, 24, 1000), (5, 24, 1000), (2, 3, 4), (5, 2, 3)])
def test_near_copies_equal_brute_force(docs, rows, width, list_size, chunk):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.groups(clash(docs), width=width, list_size=list_size, chunk=chunk).collect()]
    assert sorted(got, key=repr) == brute_groups(rows, width)


def test_deduplicate_keeps_one_of_each_group(docs, rows):
    kept = near_dedup.deduplicate(clash(docs), width=2)
    assert kept.columns == clash(docs).columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    wordless = [(d, t) for d, t, *_ in rows if not WORD.findall(t or "")]
    assert all(found.count(x) == wordless.count(x) for x in wordless)
    assert len(found) == len(set(found))
    groups = Counter(x[2] for x in brute_groups(rows, 2) if x[1])
    ids = Counter(d for d, t in found if WORD.findall(t or ""))
    assert all(ids[g] >= 1 for g in groups if g is not None)


def test_near_dedup_of_nothing(empty):
    assert near_dedup.groups(empty).count() == 0
    assert near_dedup.deduplicate(empty).count() == 0


def test_forest_joins_all_links():
    sets = [np.array(sorted(x), dtype=np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [10, 11], [2, 3, 4, 5, 6], [10, 11, 12])]
    edges = near_dedup.forest(sets, (4, 5))
    assert {frozenset(e) for e in edges} <= {frozenset((0, 1)), frozenset((1, 3))} and len(edges) == 2


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8), (8, 9), (7, 7), (20, 30), (30, 40), (10, 40)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {5: 1, 4: 1, 3: 1, 9: 8, 20: 10, 30: 10, 40: 10}


# Language ID

TEXTS = {"en": "the house and the old man with their garden were there", "fr": "la maison et le vieux monsieur avec leur jardin étaient là", "de": "das haus und der alte mann mit ihrem garten waren dort"}


def test_language_id_learns_and_predicts(spark):
    made = [(i, TEXTS[lang][k:] + " " + TEXTS[lang], lang) for i, (lang, k) in enumerate((x, k) for k in range(20) for x in TEXTS)]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "123 ... 456", "de"), (903, "le vieux jardin était là avec la maison", None), (904, "日本", "en"), (None, TEXTS["de"], "de")]
    docs = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(clash(docs), language_id.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in made if got[i].held_out)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "fr" and got[904].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.held_out for r in got.values()} == {True, False}
    assert language_id.keep_identified(docs, language_id.fit(docs)).count() == len(made) + 3


def test_texts_in_no_learned_language_are_rejected(spark):
    rng = random.Random(2)
    words = {x: TEXTS[x].split() for x in TEXTS}
    made = [(i, " ".join(rng.choices(words[x], k=12)), x) for i, x in enumerate(list(TEXTS) * 1700)]
    odd = [(90001, "zqx vkj wqz kzx jqv xzk qvw zjx", None), (90002, None, None), (90003, "4 5 6", "en"), (90004, "the old man and the garden", None)]
    docs = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.keep_identified(clash(docs), language_id.fit(docs)).collect()}
    assert not kept & {90001, 90002, 90003} and 90004 in kept
    assert len(kept & set(range(len(made)))) >= 0.99 * len(made)


def test_a_language_of_long_texts_is_learned(spark):
    made = [(i, " ".join([TEXTS[x]] * (3 if x == "de" else 1)), x) for i, x in enumerate(list(TEXTS) * 20)]
    docs = spark.createDataFrame([*made, *made[:6]], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs, most_bytes=100)).collect()
    assert len(got) == len(made) + 6
    assert {r.lang_pred for r in got if r.doc_id % 3 == 2} == {"de"}


def test_language_id_without_labels_or_with_one(spark, empty):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.fit(docs)).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one, language_id.fit(one)).collect()} == {"en"}
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5, 12])
def test_codewords_are_apart(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else 2)


# Quality rules


def test_quality_counts_equal_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r) for r in quality_rules.judge(clash(docs).drop("kept"), labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        twice = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)] += 1
    assert got == want


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.02), (3, 400, 0.02), (10, 1000, 0.02), (150, 10000, 0.02), (19, 1000, 0.02), (5, 5, 0.02)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == pytest.approx(1.0 if k >= n * p else want, rel=1e-9)


def test_cutoffs_reject_bad_texts_only(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w{i}#$%" for i in range(60))
    rows = [(i, bad if i % 10 == 9 else good, "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 9), 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels, risk=0.02).collect()}
    assert all(got[i] == (i % 10 != 9) for i in range(2000))
    few = quality_rules.judge(docs, labels.where("doc_id < 100"), risk=0.02)
    assert few.where("not kept").count() == 0


def test_production_cutoffs_reach_languages_with_few_labels(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"w{i}#$%" for i in range(60))
    langs = ["en"] * 1500 + ["de"] * 300 + [None] * 60
    rows = [(i, bad if i % 10 == 9 else good, lang) for i, lang in enumerate(langs)] + [(5000 + i, bad, "unlabelled") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 9), 0) for i in range(len(langs))], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[i] == (i % 10 != 9) for i in range(len(langs)))
    assert all(got[5000 + i] for i in range(5))


def test_pooled_cutoffs_spare_a_language_that_differs(spark):
    plain, marked = (" ".join(f"word{i}{x}" for i in range(60)) for x in ("", "#"))
    rows = [(i, plain, "en") for i in range(9000)] + [(9000 + i, marked if i % 2 else plain, "xx") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(docs, labels).where("not kept").count() == 0


def test_quality_of_nothing(spark, empty):
    assert quality_rules.judge(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# Line dedup


def test_lines_keep_one_occurrence(spark):
    line = "this is a line that many documents share 12 times"
    near = "this is a line that many documents share 99 times!"
    docs = spark.createDataFrame([(2, f"first own line of text here\n{line}\nshort"), (1, f"{line.upper()}\nshort\n\n{near}"), (3, None), (4, ""), (5, "short"), (5, f"same id {line}"), (None, line)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed): r.text for r in line_dedup.dedup_lines(clash(docs)).collect()}
    assert got[1, 1] == f"{line.upper()}\nshort\n" and got[2, 1] == "first own line of text here\nshort"
    assert got[3, 0] is None and got[4, 0] == "" and got[5, 0] in ("short", f"same id {line}") and got[None, 1] == ""


def test_lines_of_repeated_rows_and_nothing(spark, empty):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3, "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == ["", "", "a b c d e f g"]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_near_lines_are_found(spark):
    base = [f"common{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(30)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).where("n_removed = 0").count() <= 2


def test_what_lines_differ_in_takes_as_many_edits():
    def edits(u, v):
        row = list(range(len(v) + 1))
        for i, x in enumerate(u, 1):
            now = [i]
            for j, y in enumerate(v, 1):
                now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    pick = random.Random(1)
    for _ in range(3000):
        u = [pick.choice("abcdef") for _ in range(pick.randint(1, 14))]
        v = [pick.choice("abcdefg") if pick.random() < 0.1 else x for x in u for _ in range(pick.choice((0, 1, 1, 1, 1, 1, 1, 2)))] or ["a"]
        got = line_dedup._apart(" ".join(u), " ".join(v), 0.8)
        most = int(0.2 * max(len(u), len(v)) + 1e-9)
        assert (got is None) <= (edits(u, v) > most)
        if got is not None:
            assert got[2] == most and edits(got[0], got[1]) == edits(u, v)


def test_lone_pairs_of_near_lines_are_all_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        n = rng.randint(7, 60)
        w = [f"w{rng.randrange(300)}" for _ in range(n)]
        # As many edits as the similarity allows, of one kind or mixed, spread over the line.
        v, kind = list(w), i % 4
        for k, at in enumerate(sorted(rng.sample(range(n), n // 5), reverse=True)):
            how = k % 3 if kind == 3 else kind
            v[at : at + (how != 1)] = [] if how == 2 else [f"e{i}x{k}"]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).where("doc_id % 2 = 1 and n_removed = 0").count() == 0


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("list_size", [2, 24])
def test_groups_of_near_lines_equal_brute_force(spark, list_size):
    rng = random.Random(11)
    stems = [[f"s{chr(97 + i)}w{chr(97 + rng.randrange(12))}" for _ in range(rng.choice([5, 6, 9, 14, 40]))] for i in range(6)]
    made = []
    for i in range(150):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["e" + chr(97 + rng.randrange(26))]])
        made.append((i, " ".join(w)))
    made.append((150, " ".join(f"long{chr(97 + k % 26)}{chr(97 + k % 23)}" for k in range(30000)) + "\n" + "\n".join(["tie tie tie tie tie"] * 3)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    lines = [(d, n, x.split(" ")) for d, t in made for n, x in enumerate(t.split("\n")) if len(x.split(" ")) >= 5]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (*_, x) in enumerate(lines):
        for j in range(i):
            y = lines[j][2]
            longest = max(len(x), len(y))
            if min(len(x), len(y)) >= 0.8 * longest and word_edits(x, y) <= int(0.2 * longest + 1e-9):
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = Counter({d: 0 for d, _ in made})
    for i, (d, *_) in enumerate(lines):
        want[d] += find(i) != i
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs, list_size=list_size).collect()}
    assert got == dict(want)


def test_near_lines_of_repeated_words_are_found(spark):
    rows = [(1, "a b a b a b a b a b"), (2, "a b a b x b a b a b"), (3, "q q q q q"), (4, "q q q q z"), (5, "k l m n o"), (6, "k l m y z")]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}


def test_long_lists_give_the_pairs_that_can_be_near_and_dense_ones_go_on_packed():
    rng = np.random.default_rng(4)
    n = rng.integers(9, 16, 200)
    ids = np.unique((n << 54) | rng.integers(1, 1 << 54, 200))
    n, at = ids >> 54, rng.integers(0, 9, len(ids))

    def found(at):
        packed = line_dedup._packets(np.full(len(ids), 7), [(np.full(len(ids), 5, np.uint64), words.pack_sorted), (ids, line_dedup._raw), (np.ones(len(ids), np.int64), words.pack), (at.astype(np.uint8), lambda v: v.tobytes()), (ids, None)])
        rows = line_dedup._gathered(64, 0.8, 3, 7)(pa.Table.from_batches([packed])).to_pylist()
        pairs = {x for r in rows if r["kind"] == line_dedup.PAIRS for x in zip(*(np.frombuffer(r[c], "<i8").tolist() for c in "ab"), strict=True)}
        return pairs, [r for r in rows if r["kind"] == line_dedup.MEMBERS]

    want = {(x, y) for x, n1, p in zip(ids.tolist(), n, at, strict=True) for y, n2, q in zip(ids.tolist(), n, at, strict=True) if x < y and abs(p - q) + abs((n1 - p) - (n2 - q)) <= int(0.2 * max(n1, n2) + 1e-9)}
    assert found(at) == (want, [])
    n[:] = 30
    ids = (n << 54) | (ids & ((1 << 54) - 1))
    pairs, members = found(np.full(len(ids), 3))
    assert len(pairs) == len(ids) - 1 and len(members) <= 7 and sum(len(r["b"]) // 8 for r in members) == len(ids)


def test_lists_of_a_large_range_take_little_memory_and_give_all_pairs():
    rng = np.random.default_rng(6)
    n, each = 100, 25_000
    key = rng.permutation(np.cumsum(rng.integers(1, 3000, n * each))).astype(np.uint64)
    key[: n * each // 10] = key[-(n * each // 10) :]  # every tenth key comes twice
    key, ids = rng.permutation(key), (np.int64(12) << 54) | rng.integers(1, 1 << 54, n * each)
    packets = []
    for i in range(0, n * each, each):
        order = np.argsort(key[i : i + each]) + i
        packets.append(line_dedup._packets(np.full(each, 7), [(key[order], words.pack_sorted), (ids[order], line_dedup._raw), (np.ones(each, np.int64), words.pack), (np.full(each, 3, np.uint8), lambda v: v.tobytes()), (ids[order], None)]))
    table = pa.Table.from_batches(packets)
    tracemalloc.start()
    got = line_dedup._gathered(64, 0.8, 3, 7)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    want = {tuple(sorted(x)) for x in zip(ids[order][same].tolist(), ids[order][same + 1].tolist(), strict=True)}
    pairs = [x for a, b in zip(got.column("a"), got.column("b"), strict=True) for x in zip(np.frombuffer(a.as_py(), "<i8").tolist(), np.frombuffer(b.as_py(), "<i8").tolist(), strict=True)]
    assert len(want) == len(pairs) == n * each // 10 and set(pairs) == want
    assert peak < 24 * n * each, peak / n / each


def test_query_drops_exact_repeats_of_short_lines(spark, tmp_path):
    docs = [(1, "Short line\n---\n\n***\n\nend"), (2, "short LINE!\n ---\n\nnew\n***\n"), (3, "---"), (4, "\n\n"), (5, "1 2\nshort line x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {1: docs[0][1], 2: "\nnew\n", 3: "", 4: "\n\n", 5: docs[4][1]}


# Decontamination


def brute_hits(rows, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[j : j + window])].add(str(i))
    out = []
    for d, t, *_ in rows:
        w = ALNUM.findall(low(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    names |= windows[k]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_hits_equal_brute_force(spark, docs, rows, block):
    texts = [r[1] for r in rows if r[1] and len(r[1]) > 200]
    items = [(0, texts[0][:150]), (1, " ".join(texts[1].split()[5:9])), (2, texts[2].upper()), (3, None), (4, "..."), (5, texts[0][:150]), (10, "one"), (6, "not there at all in any text of these"), (7, " ".join(texts[-1].split()[:60]))]
    phrases = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(clash(docs), phrases, window=6, block_bytes=block)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=repr) == brute_hits(rows, items, 6)
    for r in got.collect():
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_hit
    kept = decontamination.remove_contaminated(clash(docs), phrases, window=6, block_bytes=block)
    assert kept.columns == clash(docs).columns and kept.count() == sum(not x[-1] for x in brute_hits(rows, items, 6))


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_texts_without_an_item_id_hit(spark, block):
    phrases = spark.createDataFrame([(None, "a passage that nobody gave an id"), (None, "another such passage of seven words"), (7, "one with its own id")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "see a passage that nobody gave an id here"), (2, "one with its own id, another such passage of seven words"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.find_contamination(docs, phrases, window=6, block_bytes=block).collect()}
    assert got == {1: (7, 0, True), 2: (11, 1, True), 3: (0, 0, False)}
    assert [r.doc_id for r in decontamination.remove_contaminated(docs, phrases, window=6, block_bytes=block).collect()] == [3]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 5, 400)
    text[-1] = 0
    index = decontamination.FMIndex(text, 4)
    for pattern in ([1], [2, 3], [4, 4, 1], [1, 2, 3, 4]):
        low_, high = index.search(np.array([pattern]), np.array([len(pattern)]))
        want = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(low_[0], high[0])).tolist()) == want


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.find_contamination(empty, none).count() == 0


# Chat formatting


def test_maximal_conversations_stay(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|end|>"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes <|end|>"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (6, 1, "b", "y"), (6, 1, "a", "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.render(clash(rows)).collect()}
    assert set(got) == {1, 4, 5, 6, None} and got[1].copies == 2 and got[None].n_turns == 1
    assert got[1].rendered == "<|turn|>user\nhi<|end|>\n<|turn|>assistant\nyes < |end|><|end|>\n"
    assert got[6].rendered.startswith("<|turn|>a\nx")
    assert chat_format.render(rows.where("false")).count() == 0


# Token shards


def test_shards_give_back_every_text(spark, docs, rows, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from glyphmill.llm.layout import new_folder

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "ids")
    manifest = token_shards.write_shards(clash(docs), path, folder, shard_bytes=2000)
    got = token_shards.read_shards(spark, folder, manifest).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for i, r in enumerate(rows)}
    assert sum(r.n_tokens for r in got) == sum(map(len, ids.values())) and len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())) for i, r in enumerate(rows))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    whole = token_shards.Folder(folder)
    assert whole.get(10).tolist() == ids[10] and whole.get(123456789) is None and whole.get(4, 3) is None
    assert sorted(whole.get(4, n).tolist() for n in (0, 1, 2)) == sorted(ids[i] for i, r in enumerate(rows) if r[0] == 4)
    shard = next(s for s in (token_shards.Shard(folder, n) for n, d, _ in manifest if d) if 10 in s.doc_ids.tolist())
    assert shard.get(10).tolist() == ids[10] and shard.get(123456789) is None
    assert token_shards.read_shards(spark, new_folder(spark, "none"), token_shards.write_shards(empty, path, new_folder(spark, "none"))).count() == 0


def test_shards_are_written_once(spark, docs, tmp_path, monkeypatch):
    import public_tokenizers

    real, runs = token_shards._writer, str(tmp_path)

    def counting(*args):
        write = real(*args)

        def run(batches):
            import uuid

            open(f"{runs}/{uuid.uuid4().hex}", "w").close()
            yield from write(batches)

        return run

    monkeypatch.setattr(token_shards, "_writer", counting)
    manifest = token_shards.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), token_shards.new_folder(spark, "once"), shard_bytes=2000)
    assert len(list(tmp_path.iterdir())) == len(manifest) > 1


def test_chunks_encode_as_whole_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    e = token_shards.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "a  b   c\n\n d\n  e", "don't 'tis rock'n'roll  it's,'s ,'s x'll", "café  ok 　x  y", "tab\t\tx \t y\r\n z ", " lead", "trail ", "12ab34,56.78 a1 1a -a a- --a", "<|endoftext|> x<|endoftext|>", "\x1c x\x1c\x1c y\x00z \x7f", "你好 世界, 한글 😀 😀😀x", "'", "''s'", " 's a 's", "\n\n\na", "a \n b", "x\u0085y z", "x  y"]
    got = []
    for ids, per in e.encode(pa.array(texts, pa.string())):
        ends = np.cumsum(per)
        got += [ids[b - n : b].tolist() for b, n in zip(ends, per, strict=True)]
    assert got == [e.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_added_tokens_are_encoded_as_by_an_unmodified_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, e = Tokenizer.from_file(path), token_shards.Encoder(path)
    texts = ["<|endoftext|>", "a b <|endoftext|> c", "x<|endoftext|><|endoftext|>y", "cut <|endof", "text|> here", "<|endof text|>", "plain words"]
    got = []
    for ids, per in e.encode(pa.array(texts, pa.string())):
        ends = np.cumsum(per)
        got += [ids[b - n : b].tolist() for b, n in zip(ends, per, strict=True)]
    assert got == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(got[0]) == 1


def test_perfect_hash_is_minimal():
    keys = words.mix(np.arange(5000, dtype=np.uint64))
    table, end = token_shards.PerfectHash.load(token_shards.PerfectHash.build(keys).dump())
    assert sorted(table.find(keys).tolist()) == list(range(5000)) and end > 0


# Mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_targets_and_copies(spark, docs, rows, empty):
    extra = [(1000 + i, "x y z", None, f"t{i % 7}", 5) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = mixing.mixture(clash(both).drop("size", "target")).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows + extra:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert {round(r.target, 6) for r in got} == {round(x, 6) for x in want.values()}
    assert len(got) == len(rows) + len(extra) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixture(both.repartition(7)).collect()), key=repr)
    mixed = mixing.mix(clash(both))
    assert mixed.columns == clash(both).columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_taken_words_come_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 3}") for i in range(6000)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) < 0.1 * r.target


def test_taken_words_come_near_targets_of_small_sources(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(20 * rng.paretovariate(2))), f"s{i % 12}") for i in range(600)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    off = [abs(r.t - r.target) / r.target for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.05


# Sharding


def test_shards_are_even_and_match_the_mixture(docs, rows, empty):
    got = sharding.assignments(clash(docs).drop("size"), shards=5).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    own = sharding.interleave(docs, shards=5)
    mixture = own.groupBy("source").pivot("shard").count().fillna(0).collect()
    assert all(max(r[1:]) - min(r[1:]) <= 2 for r in mixture)
    assert sharding.assignments(empty).count() == 0


def test_sharding_is_the_same_again(docs):
    once = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assignments(docs).collect()}
    assert once and once == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assignments(docs.repartition(9)).collect()}


def test_sharding_equals_brute_force(docs, rows):
    def point(*parts):
        return hashlib.md5("|".join(parts).encode()).digest()

    marks = [(zlib.crc32((t or "").encode()), d, s) for d, t, _, s, _ in rows]
    by_source = defaultdict(list)
    for m, d, s in marks:
        by_source[s].append((point("shard-1", "" if d is None else str(d), str(m)), d, m))
    order = []
    for s, own in by_source.items():
        u = (int.from_bytes(point("shard-1", "false" if s is not None else "true", s or "")[:6], "big") + 0.5) / 2.0**48
        order += [((rank - u) / len(own), s is None, s or "", rank, d, m) for rank, (_, d, m) in enumerate(sorted(own, key=lambda x: (x[0], x[1] or 0)), 1)]
    places = {k: (x[4], x[5]) for k, x in enumerate(sorted(order, key=lambda x: x[:4]))}
    n, want = len(rows), Counter()
    for k, (d, m) in places.items():
        shard = k * 5 // n
        want[d, m, shard, k - -(-shard * n // 5)] += 1
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.assignments(docs, shards=5).collect()) == want


def test_many_small_sources_fill_all_shards_alike(spark):
    rows = spark.createDataFrame([(i, "x", f"s{i}") for i in range(400)], "doc_id long, text string, source string")
    got = sharding.assignments(rows, shards=4).collect()
    assert Counter(r.shard for r in got) == dict.fromkeys(range(4), 100)


def test_rows_are_carried_whole(docs):
    taken = docs.limit(20).withColumns({c: F.lit("mine") for c in ("row", "key", "range", "rank", "place", "fraction", "rate", "turn", "chance", "copy", "copies", "plan", "gm_key", "gm_stay", "gm_chance", "gm_source", "own_key", "stay", "hit_key", "into")})
    for out in (sharding.interleave(taken), mixing.mix(taken), near_dedup.deduplicate(taken)):
        assert [c for c in out.columns if c not in ("shard", "slot")] == taken.columns
        assert all(r[c] == "mine" for r in out.collect() for c in taken.columns[5:])


def test_registry_has_every_operator():
    from glyphmill.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert json.dumps(sorted(registry.QUERIES))


def test_pairs_of_many_dense_lists_are_added_up_as_they_come(monkeypatch):
    """Members of one large group share many lists: what waits is bounded by the pairs, not by pairs times lists."""
    members, lists = 100, 40
    ids = (np.arange(members, dtype=np.int64) << line_dedup.LENGTH_BITS) + 8
    key, each = np.repeat(np.arange(lists, dtype=np.int64), members), np.tile(ids, lists)
    table = line_dedup._packed(line_dedup.MEMBERS, np.zeros(len(key), np.int64), [(key, line_dedup._raw), (each, line_dedup._raw), (np.full(len(key), 3, np.uint8), lambda v: v.tobytes()), (np.full(len(key), -1, np.int64), line_dedup._raw)])
    sizes, summed = [], line_dedup._summed
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 12_000)
    monkeypatch.setattr(line_dedup, "_summed", lambda a, b, n: sizes.append(len(a)) or summed(a, b, n))
    got = {}
    for r in line_dedup._crossing(0.8, 7)(table).to_pylist():
        a, b = (np.frombuffer(r[c], "<i8").tolist() for c in "ab")
        for pair in zip(a, b, words.unpack(r["c"]).tolist(), strict=True):
            got[pair[:2]] = got.get(pair[:2], 0) + pair[2]
    assert got == {(int(x), int(y)): lists for i, x in enumerate(ids) for y in ids[i + 1 :]}
    assert max(sizes) <= 12_000 + members * (members - 1) // 2


def lacking(u, v):
    """Words that one of two lines lacks of the other, at most; edits are as many at least."""
    u, v = Counter(u), Counter(v)
    return max((u - v).total(), (v - u).total())


def test_families_give_all_near_pairs_and_few_others():
    rng, one = random.Random(8), Counter()
    stems = [[f"w{rng.randrange(25)}" for _ in range(n)] for n in (5, 6, 12, 30, 70)]
    lines = []
    for _ in range(160):
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(len(w) // 4 + 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice([[], [f"w{rng.randrange(40)}"]])
        lines.append(tuple(w))
    lines = [x for x in sorted({x for x in lines}) if len(x) >= 5]
    ids = np.array([(len(x) << 54) | rng.randrange(1 << 54) for x in lines], np.int64)
    roots = [None if k % 3 else k % 2 for k in range(len(lines))]
    family = rng.sample(range(1 << 40), 2)
    # Members come from two ranges of keys, some of them twice, and in any order.
    members = pa.concat_tables([line_dedup._packed(line_dedup.MEMBERS, np.zeros(len(m), np.int64), [(np.array(family)[m % 2], line_dedup._raw), (ids[m // 2], line_dedup._raw)]) for m in (np.array(rng.sample(range(2 * len(ids)), len(ids))), np.arange(2 * len(ids)))])
    labels = pa.table({"bucket": pa.array([0] * len(ids), pa.int32()), "k1": ids, "root": pa.array(roots, pa.int64()), "words": [" ".join(x) for x in lines]})
    labelled = line_dedup._labelled(1)(members, labels.take(np.random.default_rng(1).permutation(len(ids))))
    for r in line_dedup._crossing(0.8, 1)(labelled).to_pylist():
        for a, b, n in zip(*(np.frombuffer(r[c], "<i8").tolist() for c in "ab"), words.unpack(r["c"]).tolist(), strict=True):
            one[a, b] += n
    near, fit = set(), set()
    for i, x in enumerate(lines):
        for j in range(i):
            most = int(0.2 * max(len(x), len(lines[j])) + 1e-9)
            if (roots[i] is None or roots[i] != roots[j]) and lacking(x, lines[j]) <= most:
                pair = tuple(sorted((int(ids[i]), int(ids[j]))))
                fit.add(pair)
                if word_edits(x, lines[j]) <= most:
                    near.add(pair)
    assert near and near <= set(one) <= fit and set(one.values()) == {2}


def test_lines_that_share_a_long_passage_are_not_all_compared(spark, monkeypatch):
    """The pairs that are verified follow the lines, not their square; what goes equals brute force."""
    rng = random.Random(9)
    passage = [f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    own = [[word() for _ in range(20)] for _ in range(220)]
    for k in range(60):
        w = list(own[rng.randrange(len(own))])
        for at in rng.sample(range(20), rng.randint(1, 19)):
            w[at] = word()
        own.append(w)
    lines = [[*w, *passage] for w in own]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(own):
        for j in range(i):
            if lacking(x, own[j]) <= 16 and word_edits(lines[i], lines[j]) <= 16:
                up[max(find(i), find(j))] = min(find(i), find(j))
    compared, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: int(find(i) != i) for i in range(len(lines))} and 0 < sum(got.values()) < 60
    assert len(compared) == 2 and sum(compared) < 5 * len(lines), compared
