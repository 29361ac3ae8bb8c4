"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back, so a vertex with very many
neighbours is pre-aggregated and its join rows may be split by AQE; no
neighbour list is ever collected into one row. Few edges, by a count of them, lie
in one partition, where the same steps need no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


#: Edges that may lie in one partition.
FEW = 10_000


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.sum(F.xxhash64("b", "a") % F.lit(1 << 40))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of integer ids -> ``(id, comp)``: the smallest id reachable, for every id on an edge.

    Null ids and loops are ignored; repeated edges count once. No edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(e)
    held = (lambda df: df.coalesce(1)) if mark[0] <= FEW else (lambda df: df)
    e = held(e)
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")
    while mark[0]:
        both = e.select(sides).select("s.a", "s.b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        e1 = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low1 = e1.groupBy("a").agg(F.min("b").alias("m"))
        moved = e1.join(low1, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e2 = held(materialise(held(moved.union(low1.select("a", F.col("m").alias("b")))).distinct(), "edges"))
        now = _mark(e2)
        e = e2
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
