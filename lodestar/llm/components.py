"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import written


def _smallest(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), b's smallest per a joined to each pair: a, b, m."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return pairs.join(least, "a")


#: A key with over one in so many of the rows is hot; there are fewer of them than this.
HOT_SHARE = 1000


def attached(many: DataFrame, one: DataFrame, on: str, weight: str) -> DataFrame:
    """``many`` joined to the only row that ``one`` has for each value of ``on``; rows without one are left out.

    ``weight`` is a column of ``one``: how many rows of ``many`` have its value. The fewer than HOT_SHARE values with
    more than a share of 1 / HOT_SHARE are sent to every task, so that their rows stay where they are; the others
    are joined by shuffling. Both tables are read twice, so they should be written ones.
    """
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(one.where(is_hot).drop(weight))
    rest = many.join(F.broadcast(one.where(is_hot).select(on)), on, "left_anti").join(one.where(~is_hot).drop(weight), on)
    return many.join(hot, on).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node in ``edges`` (columns a and b, longs); root: the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges no longer change. Each step is a partial aggregate and
    a sort-merge join by node, whose hot nodes adaptive execution splits, and its edges are written to the shared folder. Self-loops and
    repeated edges are allowed; an empty edge list gives an empty result.
    """
    now = written(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, total) == mark:
            break
        mark = (n, total)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _smallest(both).where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where(F.col("a") != F.col("b")).distinct()
        )
        large = written(large)
        grown = _smallest(large)
        small = (
            grown.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(grown.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        )
        now = written(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    tops = roots.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return roots.unionByName(tops)
