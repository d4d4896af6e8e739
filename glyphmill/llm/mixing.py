"""Mixing sources to target weights, by repetition rates and one Bernoulli copy.

The words of each source are added up; a target is set for each source; a source's rate
is its target over its words; each document is emitted floor(rate) times, and once more
if a hash of the seed, its id and its text, read as a point of the circle [0, 1) and moved
on by the source's turn, is below the rate's fraction.  Only DataFrame functions run here.

Turns.  A source of few documents of uneven length would miss its target by much under
most seeds.  So each source has ``TURNS`` draws from the one hash (the circle turned by
0/32, 1/32, ...), each giving every document the same chance, and takes that whose words
come nearest to its target, the first of equals.  One aggregate compares all of them.

Targets.  Sources in the order of their code points, null last, weigh 1, 2, 3 and again,
and share all words.  None gets more than ``most`` times its own words; what is above
goes to the others by weight until none is above.  That is water filling: with sources
in the order of most * size / weight, the level after the first j sources are full is
(all words - their caps) / (weight of the rest), the final level is the largest of these,
and a target is the smaller of cap and level * weight.

Defined results.  Null and empty texts have size 0: their copies count no words.  A null
source is a source.  Sources without words get target 0 and no copies.  Equal rows share
one decision; rows that differ in id or text have their own.  Empty table: no rows.
Columns whose names clash with those added are read before and replaced in the report,
and kept as they are by :func:`mix`, which carries each row whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import cut

WORD = "[^\\x20\\x09-\\x0D]+"
SEED, MOST = "mix-1", 3
#: Draws from which each source takes the one nearest to its target.
TURNS = 32
#: A targets table of no more rows than this is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size and target from rows of source and size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source: an ordering of the sources, not of documents.
    per = per.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    fill = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.col("level") * F.col("weight")).alias("target"))


def _drawn(chance_of: Column, turn: Column, fraction: Column) -> Column:
    """Whether a point of the circle, moved on by a turn, is below the fraction."""
    at = chance_of + turn / F.lit(float(TURNS))
    return F.when(at >= 1, at - 1).otherwise(at) < fraction


def _plan(sized: DataFrame, most: int) -> DataFrame:
    """key, source_size, target, rate and turn of each source, from rows of source, size and chance; broadcast if small."""
    per = cut(targets(sized, most)).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = per.select(F.col("source").alias("key"), "source_size", "target", "rate", (F.col("rate") - F.floor("rate")).alias("fraction"))
    few = per.count() <= BROADCAST_SOURCES
    known = F.broadcast(per) if few else per
    extra = [F.sum(F.when(_drawn(F.col("chance"), F.lit(float(k)), F.col("fraction")), F.col("size")).otherwise(F.lit(0).cast("long"))).alias(f"x{k}") for k in range(TURNS)]
    sums = sized.join(known, F.col("source").eqNullSafe(F.col("key"))).groupBy("key", "source_size", "target", "rate", "fraction").agg(*extra)
    whole = F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs((whole + F.col(f"x{k}")) - F.col("target")).alias("off"), F.lit(k).alias("turn")) for k in range(TURNS)]))
    plan = cut(sums.select("key", "source_size", "target", "rate", "fraction", best["turn"].cast("double").alias("turn")))
    return F.broadcast(plan) if few else plan


def _copies(chance_of: Column) -> Column:
    return (F.floor("rate") + F.when(_drawn(chance_of, F.col("turn"), F.col("fraction")), 1).otherwise(0)).cast("long")


def _narrow(docs: DataFrame, seed: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), chance(seed, F.col("doc_id"), text).alias("chance"))


def mixture(docs: DataFrame, *, seed: str = SEED, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs`` (doc_id, text, source)."""
    rows = cut(_narrow(docs, seed))
    made = rows.join(_plan(rows, most), F.col("source").eqNullSafe(F.col("key")), "left")
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("chance"))).alias("taken"))


def mix(docs: DataFrame, *, seed: str = SEED, most: int = MOST) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mixture takes it."""
    plan = _plan(cut(_narrow(docs, seed).drop("doc_id")), most)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("row_source"), chance(seed, F.col("doc_id"), F.col("text").cast("string")).alias("row_chance"))
    made = rows.join(plan, F.col("row_source").eqNullSafe(F.col("key")), "left").select("row", _copies(F.col("row_chance")).alias("copies")).where("copies > 0")
    return made.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         (('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint) / 4503599627370496.0::double as chance
  from documents),
s as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as weight from d group by source),
l as (select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0))::double
             / sum(weight) over (order by source_size * 3 / weight, source asc nulls last rows between current row and unbounded following) as level from s),
t as (select source, source_size, least(source_size * 3.0::double, max(level) over () * weight) as target from l),
p as (select source, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end as rate from t),
x as (select d.source, k.turn, any_value(p.target) as target, any_value(floor(p.rate) * p.source_size) as whole,
             sum(case when (case when chance + turn / 32.0::double >= 1 then chance + turn / 32.0::double - 1 else chance + turn / 32.0::double end) < rate - floor(rate) then size else 0 end) as extra
      from d join p on d.source is not distinct from p.source cross join (select unnest(range(32))::double as turn) k group by d.source, k.turn),
b as (select source, turn from x qualify row_number() over (partition by source order by abs(whole + extra - target), turn) = 1)
select d.doc_id, d.size, p.source_size, p.target,
       d.size * (floor(p.rate)::bigint + case when (case when chance + turn / 32.0::double >= 1 then chance + turn / 32.0::double - 1 else chance + turn / 32.0::double end) < rate - floor(rate) then 1 else 0 end) as taken
from d join p on d.source is not distinct from p.source join b on d.source is not distinct from b.source
"""
