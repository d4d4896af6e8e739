"""Quality rules with risk-controlled thresholds.

Each text gets counts (words, symbols, repeated lines and words) and from them five
ratios, of which a high value is bad.  A rule rejects a text whose ratio is above a
cutoff.  Cutoffs are chosen for each stratum (by default the language) on the labelled
rows: of the n good rows of the stratum that pass the base rule, a cutoff would reject k,
and it is safe if P(Binomial(n, risk) <= k) <= delta / m.  A rule's cutoffs are tested
from the loosest to the strictest up to the first that is not safe; in such a fixed
sequence the cutoffs need no correction among themselves, so m counts only the rules times
the strata with good rows and the pool.  A stratum that has good rows, but so few that no
cutoff could be safe ((1 - risk)**n > delta / m), takes the cutoffs of the pool of all
strata's good rows, held back where they would reject more than a share ``risk`` of its
own good rows.  Then, with probability 1 - delta, no chosen rule rejects more than
``risk`` of the good texts of a stratum with a test of its own, nor of the pool (for a
stratum that takes the pool's cutoffs the bound is the pool's), and all five together no
more than five times that.  The last safe cutoff of each rule is taken; without one, the
rule is off.

Only DataFrame functions run here: texts are taken apart by array functions within their
row, so nothing but a few numbers of each text is shuffled.

Defined results.  Null, empty and wordless texts: all counts 0, not kept (fewer words
than the least).  A null stratum is a stratum.  Rows without doc_id have no label.
Several labels of one document: good only if all are.  Null labels count as none.
Repeated rows: each has its result.  No labels: only the base rule rejects; so it is for a
stratum without good rows, of which the pool says nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import cut

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED = 50, 50
RISK, DELTA = 0.005, 0.05
BROADCAST_STRATA = 20_000
#: Candidate cutoffs of each rule in ascending order.
CUTOFFS: dict[str, list[float]] = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5],
    "dup_lines": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8],
    "repeats": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45],
    "long_words": [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0],
    "short_words": [-4.0, -3.5, -3.0, -2.5, -2.0, -1.5],
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""

    def of(ws: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        found = _let(windows, starts)
        return F.aggregate(found, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(words, of))


def counts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of each text of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeated(ws).cast("long").alias("n_repeat_words"))

    def lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    made = docs.select(
        *keep,
        _let(F.filter(F.split(text, BLANK), lambda w: w != ""), of).alias("gm_words"),
        _let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lines).alias("gm_lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    names = [c for c in made.columns if c not in ("gm_words", "gm_lines", "n_symbols")]
    return made.select(*names, "gm_words.n_words", "gm_words.word_chars", "n_symbols", "gm_lines.n_lines", "gm_lines.n_dup_lines", "gm_words.n_repeat_words")


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    length = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words"))
    return {"symbols": per("n_symbols", "word_chars"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "long_words": F.coalesce(length, F.lit(0.0)), "short_words": F.coalesce(-length, F.lit(-1e9))}


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) where that is below a half; 1 for k of n * p and more."""
    kd, nd = k.cast("double"), n.cast("double")
    log_term = _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    steps = F.least(kd, 12 * F.sqrt(nd) + 100).cast("long")
    step = lambda a, j: F.struct((a["t"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("t"), (a["s"] + a["t"] * (kd - j + 1) * (1 - p) / ((nd - kd + j) * p)).alias("s"))
    total = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"]))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(log_term) * total)


def thresholds(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA, cutoffs: dict[str, list[float]] | None = None) -> DataFrame:
    """Stratum and cutoff of each rule (null: off) from counts with doc_id, gm_stratum and base_failed, and labels (doc_id, quality)."""
    grid = cutoffs or CUTOFFS
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("gm_label_id")).agg((F.min("quality") >= 1).alias("gm_good")).where("gm_good")
    above = lambda rule, value: F.size(F.filter(F.array(*map(F.lit, grid[rule])), lambda cutoff: cutoff < value)).alias(rule)
    held = measured.where(~F.col("base_failed")).join(good, F.col("doc_id").cast("long") == F.col("gm_label_id")).select("gm_stratum", *[above(r, v) for r, v in _ratios().items()])
    cells = held.select("gm_stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("above")) for r in grid])).alias("x")).groupBy("gm_stratum", "x.rule", "x.above").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(cells)
    counted = cells.select("gm_stratum").distinct().count()
    level = delta / ((counted + 1) * len(grid))
    # A row whose value is above j cutoffs is rejected by the first j.
    held_by = lambda *keys: cells.groupBy(*keys).agg(F.sum("n").alias("n"))
    hist = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("above", "n"))).alias("hist"))
    pool = hist(held_by("rule", "above"), "rule").select("rule", F.col("n").alias("pool_n"), F.col("hist").alias("pool_hist"))
    by_rule = hist(cells, "gm_stratum", "rule").join(F.broadcast(pool), "rule")
    grids = F.create_map(*[y for r, g in grid.items() for y in (F.lit(r), F.array(*map(F.lit, g)))])
    tests = by_rule.select("gm_stratum", "rule", "n", "hist", "pool_n", "pool_hist", F.posexplode(grids[F.col("rule")]).alias("place", "cutoff"))
    rejected = lambda of: F.aggregate(F.map_entries(of), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("place"), e["value"]).otherwise(F.lit(0).cast("long")))
    own = binomial_tail(F.col("k"), F.col("n"), risk) <= level
    pooled = (binomial_tail(F.col("pool_k"), F.col("pool_n"), risk) <= level) & (F.col("k") <= risk * F.col("n"))
    short = F.pow(F.lit(1 - risk), F.col("n")) > level
    # The number rejected falls as the cutoff rises, so the safe cutoffs are the last ones and their least ends the sequence.
    safe = tests.withColumns({"k": rejected("hist"), "pool_k": rejected("pool_hist")}).where(F.when(short, pooled).otherwise(own))
    chosen = safe.groupBy("gm_stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"gm_{r}") for r in grid])
    strata = measured.select("gm_stratum").distinct()
    return strata.join(chosen, strata["gm_stratum"].eqNullSafe(chosen["gm_stratum"]), "left").select(strata["gm_stratum"].alias("gm_key"), *[f"gm_{r}" for r in grid])


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, cutoffs: dict[str, list[float]] | None = None) -> DataFrame:
    """Counts, base_failed and kept of each row of ``docs`` (doc_id, text and the stratum's column)."""
    grid = cutoffs or CUTOFFS
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = cut(counts(docs, [F.col("doc_id"), F.col(stratum).cast("string").alias("gm_stratum")]).withColumn("base_failed", base))
    chosen = cut(thresholds(measured, labels, risk=risk, delta=delta, cutoffs=grid))
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    failed = F.lit(False)
    for rule, value in _ratios().items():
        failed = failed | F.coalesce(value > F.col(f"gm_{rule}"), F.lit(False))
    judged = measured.join(chosen, F.col("gm_stratum").eqNullSafe(F.col("gm_key")), "left").withColumn("kept", ~F.col("base_failed") & ~failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
