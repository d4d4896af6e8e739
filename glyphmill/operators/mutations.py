"""Forest checks that several layers share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def unreachable(edges: DataFrame) -> DataFrame:
    """Ids of ``edges`` (id, parent_id) that no root reaches, however deep: they stand on a cycle or below one.

    A root has no parent, or one that is not an id itself.  Each round every id jumps twice as far up, so a forest of depth d
    takes about log2(d) joins; when a round takes nothing off what is left, that never ends.
    """
    ids = edges.select("id", F.col("parent_id").alias("up")).distinct()
    known = edges.select(F.col("id").alias("up")).distinct().withColumn("there", F.lit(True))
    left = cut(ids.join(known, "up", "left").where("there").select("id", "up"))
    before, count = -1, left.count()
    while count not in (0, before):
        above = left.select(F.col("id").alias("up"), F.col("up").alias("further"))
        left = cut(left.join(above, "up").select("id", F.col("further").alias("up")))
        before, count = count, left.count()
    return left.select("id").distinct()


def would_cycle(edges: DataFrame, moved: str | int, new_parent: str | int) -> bool:
    """Whether putting ``moved`` below ``new_parent`` closes a cycle: it is among the parent's ancestors or the parent itself."""
    if moved == new_parent:
        return True
    after = edges.withColumn("parent_id", F.when(F.col("id") == F.lit(moved), F.lit(new_parent)).otherwise(F.col("parent_id")))
    return not unreachable(after).where(F.col("id") == F.lit(moved)).isEmpty()
