"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again after each turn.  Each conversation gets rolling
hashes of its prefixes: two 64-bit hashes of (position, role, text), taken together by
exclusive or up to each position.  A conversation whose full hash is a proper prefix of
another goes (anti-join); of equal ones the least conv_id stays; what stays is rendered.

Only DataFrame functions run here.  Prefixes are made distinct before they are shuffled,
so a first turn that a third of all conversations share is one row in the anti-join.

Defined results.  Turns are ordered by turn, then role and text (nulls first).  Null role
or text: empty.  Repeated turns count as often as they come.  Rows without conv_id: each
distinct one is a conversation of one turn with a null id.  Empty table: no rows.  The
marks of the template inside a text are written with a blank in them, so a text cannot
end its own turn.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its conversation's key, its position from 1, and the rolling hashes up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.sha2(F.concat_ws("\x01", F.coalesce(F.col("turn").cast("string"), F.lit("")), "role", "text"), 256))
    rows = rows.withColumn("own", F.coalesce(own, F.lit("")))
    rows = rows.where("conv_id is not null").unionByName(rows.where("conv_id is null").distinct())
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    rows = rows.withColumn("position", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, seed in (("h1", 11), ("h2", 23)):
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed), "position", "role", "text"))
    for name in ("h1", "h2"):
        rows = rows.withColumn(name, F.bit_xor(name).over(so_far))
    return rows.withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "own")))


def maximal(rolled: DataFrame) -> DataFrame:
    """conv_id, own and copies of the conversations that no longer one starts with, one of equals."""
    prefix = ["position", "h1", "h2"]
    full = rolled.where("position = n_turns").groupBy(*prefix).agg(F.min(F.struct("conv_id", "own")).alias("least"), F.count(F.lit(1)).alias("copies"))
    proper = rolled.where("position < n_turns").select(*prefix).distinct()
    return full.join(proper, prefix, "left_anti").select("least.conv_id", "least.own", "copies")


def render(conversations: DataFrame, *, start: str = "<|turn|>", end: str = "<|end|>") -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of each maximal conversation."""
    rolled = turns(conversations)
    stay = maximal(rolled).select(F.col("conv_id").alias("gm_id"), F.col("own").alias("gm_own"), "copies")
    rows = rolled.join(stay, F.col("conv_id").eqNullSafe(F.col("gm_id")) & (F.col("own") == F.col("gm_own")))

    def safe(c):
        for mark in (start, end):
            c = F.replace(c, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
        return c

    line = F.concat(F.lit(start), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(end + "\n"))
    made = rows.select("conv_id", "own", "copies", F.struct("position", line.alias("line")).alias("t")).groupBy("conv_id", "own", "copies").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return made.select("conv_id", F.size("ts").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("rendered"))


def query(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (select conv_id, count(*) as n, list(role || chr(1) || text order by i) as l,
        string_agg('<|turn|>' || replace(replace(role, '<|turn|>', '< |turn|>'), '<|end|>', '< |end|>') || chr(10)
                   || replace(replace(text, '<|turn|>', '< |turn|>'), '<|end|>', '< |end|>') || '<|end|>' || chr(10), '' order by i) as rendered
      from t group by conv_id),
f as (select l, min(conv_id) as conv_id, count(*) as copies, any_value(n) as n_turns, any_value(rendered) as rendered from c group by l),
p as (select distinct l[1:k] as l from (select l, unnest(range(1, n)) as k from c))
select conv_id, n_turns, copies, rendered from f where not exists (select 1 from p where p.l = f.l)
"""
