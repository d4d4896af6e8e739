"""Evaluation: gold against prediction for elements, structure, relations, spans and calibration."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import metrics as M
from ..functions import text as T

PASSES = ("anchor", "exact_text", "normalized_text", "occurrence")


def align(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-to-one alignment of gold and predicted elements in four passes; matched ones leave.

    Both sides: document_id, id, ord, type, text and anchor (may be null).  In each pass a gold element with exactly one
    free candidate takes it, the earliest gold element first; with more it is ambiguous in this pass and goes on to the next.
    """

    left, right, out = gold, predicted, None
    norm = lambda c: F.lower(T.compact(c))
    for name in PASSES:
        key: Column = {"anchor": F.col("anchor"), "exact_text": F.col("text"), "normalized_text": norm(F.col("text")), "occurrence": F.col("gm_nth")}[name]
        nth = lambda d: d.withColumn("gm_nth", F.row_number().over(Window.partitionBy("document_id", "type").orderBy("ord")) - 1)
        extra = [] if name == "anchor" else ["type"]
        g = nth(left).select("document_id", *extra, key.cast("string").alias("k"), F.col("id").alias("gold_id"), F.col("ord").alias("gold_ord")).where("k is not null")
        p = nth(right).select("document_id", *extra, key.cast("string").alias("k"), F.col("id").alias("predicted_id")).where("k is not null")
        # A gold element's candidates are the free predictions with its key: keys with one candidate alone are joined, so no repeated line is paired with all its repeats.
        p = p.groupBy("document_id", *extra, "k").agg(F.count(F.lit(1)).alias("n"), F.min("predicted_id").alias("predicted_id"))
        both = g.join(p, ["document_id", *extra, "k"])
        found = both.where("n = 1").withColumn("r", F.row_number().over(Window.partitionBy("document_id", "predicted_id").orderBy("gold_ord", "gold_id"))).where("r = 1").select("document_id", "gold_id", "predicted_id", F.lit(name).alias("matched_by"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("document_id", F.col("gold_id").alias("id")), ["document_id", "id"], "left_anti")
        right = right.join(found.select("document_id", F.col("predicted_id").alias("id")), ["document_id", "id"], "left_anti")
    return out


def alignment_errors(gold: DataFrame, predicted: DataFrame, aligned: DataFrame) -> DataFrame:
    """Missing and extra elements after alignment."""
    missing = gold.join(aligned.select("document_id", F.col("gold_id").alias("id")), ["document_id", "id"], "left_anti").select("document_id", "id", F.lit("MISSING").alias("status"))
    extra = predicted.join(aligned.select("document_id", F.col("predicted_id").alias("id")), ["document_id", "id"], "left_anti").select("document_id", "id", F.lit("EXTRA").alias("status"))
    return missing.unionByName(extra)


def label_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of each label from rows of gold and predicted (either may be null)."""
    by = by or []
    long = pairs.select(*by, "gold", "predicted", F.explode(F.array_distinct(F.array_compact(F.array("gold", "predicted")))).alias("label"))
    g, p = F.coalesce(F.col("gold") == F.col("label"), F.lit(False)), F.coalesce(F.col("predicted") == F.col("label"), F.lit(False))
    one = lambda c: F.sum(c.cast("int")).cast("long")
    return M.with_scores(long.groupBy(*by, "label").agg(one(g & p).alias("tp"), one(~g & p).alias("fp"), one(g & ~p).alias("fn")))


def accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    made = pairs.groupBy(*(by or [])).agg(F.sum(F.col("gold").eqNullSafe(F.col("predicted")).cast("int")).cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    return made.withColumn("accuracy", M.ratio(F.col("correct"), F.col("total")))


def heading_levels(pairs: DataFrame) -> DataFrame:
    """Level accuracy over pairs that are headings on both sides (gold_level, predicted_level)."""
    both = pairs.where("gold = 'HEADING' and predicted = 'HEADING' and gold_level is not null")
    return accuracy(both.select(F.col("gold_level").alias("gold"), F.col("predicted_level").alias("predicted")))


def text_preservation(pairs: DataFrame) -> DataFrame:
    """Exact matches and the share of gold characters kept, from gold_text and predicted_text."""
    @F.pandas_udf(LongType())
    def kept(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(m.size for m in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_matching_blocks()) for x, y in zip(a, b, strict=True)])

    equal = F.col("gold_text").eqNullSafe(F.col("predicted_text"))
    rows = pairs.withColumn("kept", F.when(equal, F.length(F.coalesce("gold_text", F.lit("")))).otherwise(kept("gold_text", "predicted_text")))
    return rows.agg(F.sum(equal.cast("int")).cast("long").alias("exact"), F.count(F.lit(1)).alias("total"), M.ratio(F.sum("kept"), F.sum(F.length(F.coalesce("gold_text", F.lit(""))))).alias("character_ratio"))


def co_member_counts(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """How many pairs each unit has, without making them."""
    return units.groupBy("document_id", unit).agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def co_member_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairwise co-membership scores from member rows (document_id, unit_id, element_id), by sizes of overlaps.

    Pairs are counted, never made: n over 2 of each gold unit, each predicted unit, and each overlap of the two.
    """
    choose = lambda n: (n * (n - 1) / 2).cast("long")
    size = lambda d, k: d.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(choose(F.col("n"))), F.lit(0)).alias("n"))
    both = gold.select("document_id", F.col("unit_id").alias("g"), "element_id").join(predicted.select("document_id", F.col("unit_id").alias("p"), "element_id"), ["document_id", "element_id"])
    rows = size(gold, ["document_id", "unit_id"]).select(F.col("n").alias("gold"), F.lit(1).alias("k")).join(size(predicted, ["document_id", "unit_id"]).select(F.col("n").alias("pred"), F.lit(1).alias("k")), "k").join(size(both, ["document_id", "g", "p"]).select(F.col("n").alias("tp"), F.lit(1).alias("k")), "k")
    return M.with_scores(rows.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("gold") - F.col("tp")).alias("fn")))


def boundary_set(regions: DataFrame) -> DataFrame:
    """Adjacencies of elements (document_id, ord, region) at which the region changes."""
    w = Window.partitionBy("document_id").orderBy("ord")
    return regions.withColumn("next", F.lead("region").over(w)).where("next is not null and next != region").select("document_id", "ord")


def diagnostics_recall(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Whether each expected diagnostic (document_id, code, min_count) was seen often enough; unexpected ones are listed too."""
    seen = observed.groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("seen"))
    met = expected.join(seen, ["document_id", "code"], "left").select("document_id", "code", "min_count", F.coalesce("seen", F.lit(0)).alias("seen"), F.when(F.coalesce("seen", F.lit(0)) >= F.col("min_count"), F.lit("MET")).otherwise(F.lit("MISSED")).alias("status"))
    extra = seen.join(expected.select("document_id", "code"), ["document_id", "code"], "left_anti").select("document_id", "code", F.lit(0).alias("min_count"), "seen", F.lit("UNEXPECTED").alias("status"))
    return met.unionByName(extra)


def signature(members: DataFrame, key: list[str], token: str = "token") -> DataFrame:
    """Order-free signature of each group's tokens, by which gold and predicted structures are joined."""
    return members.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(token)), "|").alias("signature"))


def scoped(predicted: DataFrame, gold: DataFrame, scope: tuple[str, ...] = ("type", "source_kind", "target_kind")) -> DataFrame:
    """Predicted relations of the kinds that the gold has at all."""
    return predicted.join(gold.select(*scope).distinct(), list(scope), "left_semi")


def best_overlaps(gold: DataFrame, predicted: DataFrame, key: tuple[str, ...] = ("document_id", "element_id", "text_view")) -> DataFrame:
    """Greedy one-to-one matching of spans by overlap: gold spans in order of start, end take the free prediction with most overlap.

    Ties: smallest start, then end.  Spans without a start or end take no part.  The fold runs over the spans of one element, of which
    those that end before the gold span in hand are left behind; a batch brings many elements.
    """

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, (golds, spans) in enumerate(zip(_pairs(batch.column("g")), _pairs(batch.column("p")), strict=True)):
                free, at = [], 0
                for a, b in golds:
                    while at < len(spans) and spans[at][0] < b:
                        free.append(spans[at])
                        at += 1
                    free = [s for s in free if s[1] > a]
                    best = max(free, key=lambda s: (min(b, s[1]) - max(a, s[0]), -s[0], -s[1]), default=None)
                    if best is not None and min(b, best[1]) > max(a, best[0]):
                        free.remove(best)
                        row.append(i)
                        out.append((a, b, *best, min(b, best[1]) - max(a, best[0])))
            columns = [batch.column(k).take(pa.array(row, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in out], pa.int64()) for i in range(5))], names=[*key, *made])

    made = ("gold_start", "gold_end", "start", "end", "overlap")
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    rows = gold.select(*key, span.alias("s"), F.lit(True).alias("is_gold"), whole.alias("whole")).unionByName(predicted.select(*key, span.alias("s"), F.lit(False).alias("is_gold"), whole.alias("whole"))).where("whole")
    spans = lambda of: F.sort_array(F.collect_list(F.when(of, F.col("s"))))
    each = rows.groupBy(*key).agg(spans(F.col("is_gold")).alias("g"), spans(~F.col("is_gold")).alias("p"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.select(*key).schema) + "".join(f", {c} long" for c in made)
    return each.mapInArrow(match, schema)


def _pairs(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """The spans of each row of a list column."""
    ends = column.offsets.to_numpy()
    flat = column.flatten()
    both = list(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), strict=True))
    ends = (ends - ends[0]).tolist()
    return (both[a:b] for a, b in zip(ends, ends[1:], strict=False))


def aggregate_reports(reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro (mean, least, most, count of metric values) and micro (pooled counts) of documents' reports.

    ``reports``: metric, tp, fp, fn and whatever they are grouped by.
    """
    by = by or []
    scored = M.with_scores(reports)
    made = scored.groupBy(*by, "metric").agg(F.avg("f1").alias("macro_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"), F.count("f1").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return M.with_scores(made).withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})


def role_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores of annotations (document_id, target, kind, type) in total, by type, by kind and by target, in one pass of grouping sets."""
    keys = ["document_id", "target", "kind", "type"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    made = both.sparkSession.sql("select type, kind, target, grouping_id() as level, count_if(g = 1 and p = 1) as tp, count_if(g is null) as fp, count_if(p is null) as fn from {rows} group by grouping sets ((type), (kind), (target), ())", rows=both)
    return M.with_scores(made)


def role_differences(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    keys = ["document_id", "target", "kind", "type"]
    g, p = gold.select(*keys).distinct(), predicted.select(*keys).distinct()
    return g.subtract(p).withColumn("difference", F.lit("MISSING")).unionByName(p.subtract(g).withColumn("difference", F.lit("EXTRA")))


def capability_slices(evaluated: DataFrame, outcomes: DataFrame, key: tuple[str, ...] = ("provider", "version", "capability", "language")) -> DataFrame:
    """Scores of each evaluated slice; slices without outcomes stay with zero counts."""
    sums = outcomes.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    rows = evaluated.select(*key).distinct().join(sums, list(key), "left").fillna(0, ["tp", "fp", "fn"])
    return M.with_scores(rows)


def grounding(predicted: DataFrame) -> DataFrame:
    """Share of predictions with evidence, with aligned evidence and with all evidence supported (spans: array<struct<aligned,supported>>)."""
    has = F.size("spans") > 0
    rows = predicted.select(has.alias("attached"), F.exists("spans", lambda s: s["aligned"]).alias("aligned"), (has & F.forall("spans", lambda s: s["supported"])).alias("supported"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).cast("long")
    made = rows.agg(F.count(F.lit(1)).alias("n"), *[one(c).alias(c) for c in ("attached", "aligned", "supported")])
    return made.withColumns({f"{c}_ratio": M.ratio(F.col(c), F.col("n")) for c in ("attached", "aligned", "supported")})


def pooled_calibration(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score and calibration error of pooled bins: recomputed from the sums, never averaged."""
    return M.calibration(bins, by)


def chain_results(pairs: DataFrame) -> DataFrame:
    """Scores of continuation pairs (truth, predicted) and whether each chain is whole."""
    return pairs.where("chain_id is not null").groupBy("chain_id").agg(F.bool_and(F.col("truth") == F.col("predicted")).alias("whole"), F.count(F.lit(1)).alias("edges"))


def failure_reasons(candidates: DataFrame) -> DataFrame:
    return candidates.where("not accepted").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def gate_reasons(slices: DataFrame, *, min_f1: float = 0.95, min_grounding: float = 1.0, max_unsupported: float = 0.0) -> DataFrame:
    """Why each slice of the TEST split fails the gate: an empty list passes; thresholds are inclusive."""
    low = lambda c, t: F.coalesce(F.col(c) < t, F.lit(True))
    reasons = F.array_compact(F.array(F.when(F.col("split") != "test", F.lit("NOT_TEST_SPLIT")), F.when(low("f1", min_f1), F.lit("F1_BELOW_MINIMUM")), F.when(low("grounding", min_grounding), F.lit("GROUNDING_BELOW_MINIMUM")), F.when(F.coalesce(F.col("unsupported") > max_unsupported, F.lit(True)), F.lit("UNSUPPORTED_EVIDENCE"))))
    return slices.withColumn("reasons", reasons).withColumn("approved", F.size("reasons") == 0)
