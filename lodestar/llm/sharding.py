"""Weighted rendezvous hashing of record keys onto shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranking import gapless_rank
from lodestar.llm.store import written

ROW_OVERHEAD_BYTES = 8


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """The draw of one shard for a key: exponential with rate ``weight``. The shard with the least draw owns the key."""
    if weight <= 0:
        raise ValueError("shard weights must be positive")
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
    return -F.ln(uniform) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the owner of ``key`` among shards 0 to len(weights) - 1.

    The key alone decides (a null key has a shard like any other). Adding a shard moves keys only into it, in
    proportion to its weight; removing one moves only its own keys.
    """
    if not weights:
        raise ValueError("at least one shard is needed")
    draws = [
        F.struct(shard_score(key, i, w).alias("score"), F.lit(i).cast("int").alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*draws))


def shard_documents(
    docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Place every row: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8; a null text has none, and the checksum of the empty text. slot: gapless
    from 0 within a shard. grown_shard: the owner once a shard of ``new_weight`` is added. Rows with equal keys share
    a shard and have different slots. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + ROW_OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("__owner"),
    ).select(
        "*",
        F.col("__owner.shard").alias("shard"),
        F.when(shard_score(F.col(key), len(weights), new_weight) < F.col("__owner.score"), F.lit(len(weights)))
        .otherwise(F.col("__owner.shard")).cast("int").alias("grown_shard"),
    ).drop("__owner")
    placed = written(placed)
    return gapless_rank(placed, "shard", [key, "size", "text_crc32"], "slot", placed.count()).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
