"""Gapless ranks within groups, without bringing a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000


def gapless_rank(df: DataFrame, group: str, order: Sequence[str], out: str, n_rows: int) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``group``, in no stated order.

    A group is cut by a hash of ``order`` into buckets of about ``ROWS_PER_BUCKET`` rows. Ranks are taken within a
    bucket and moved by the number of rows in the group's earlier buckets, so that a group with a third of all rows
    is spread over as many tasks as the rest. ``n_rows`` is the number of rows of ``df``. Equal rows of ``order`` get
    different ranks; only rows that are equal in ``order`` can change places between runs.
    """
    n_buckets = max(1, -(-n_rows // ROWS_PER_BUCKET))
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)))
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(group, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    within = Window.partitionBy(group, "__bucket").orderBy(*order)
    ranked = bucketed.withColumn("__rank", F.row_number().over(within) - 1)
    return (
        ranked.join(offsets, [group, "__bucket"])
        .withColumn(out, (F.col("__rank") + F.col("__offset")).cast("long"))
        .drop("__bucket", "__rank", "__offset")
    )
