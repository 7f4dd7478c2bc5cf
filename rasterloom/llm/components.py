"""Connected components over an edge table by random contraction, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ROUNDS = 100
EDGES = 200_000  # in one task, about


def components(edges: DataFrame) -> DataFrame:
    """id, component (least id of its component) for every id in edges (a, b, both long; a <> b).

    In each round every node points to the neighbour with the least hash (or itself), and the graph shrinks to those pointed
    at; the hash changes with the round, so long paths shrink by a share too. Each round is written, so lineage stays short.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    whole = None
    for k in range(ROUNDS):
        n = edges.count()
        if not n:
            break
        few = min(most, 1 + n // EDGES)  # a graph of few edges is not spread over many tasks
        wide = few if whole is None else wide
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("id"))
        to = staged(both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("id"), F.least(F.col("best"), rank("a")).getField("id").alias("to")).coalesce(few))
        if whole is None:
            whole = to
        else:
            whole = staged(whole.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to")).coalesce(wide))
        left, right = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = staged(edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct().coalesce(few))
    else:
        raise RuntimeError(f"components are not found within {ROUNDS} rounds")
    if whole is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = whole.groupBy("to").agg(F.min("id").alias("component"))
    return whole.join(least, "to").select("id", F.least("id", "component").alias("component"))
