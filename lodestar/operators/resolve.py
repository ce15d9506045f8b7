"""Decisions on scored pairs, and lists of ids per reference record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Inference, Schema
from lodestar.operators.blocking import PAIR, beside


def decide(scored: DataFrame, config: Inference = Inference(), threshold: float | None = None) -> DataFrame:
    """Add predicted_match: the score reaches the threshold, and enough blocking methods found the pair."""
    t = config.threshold if threshold is None else threshold
    if not 0 <= t <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    yes = F.col("score") >= F.lit(t)
    if config.minimum_methods > 1:
        yes = yes & (F.size(F.array_distinct("blocking_methods")) >= config.minimum_methods)
    return scored.withColumn("predicted_match", yes)


def id_lists(reference: DataFrame, pairs: DataFrame, out: str, schema: Schema = Schema()) -> DataFrame:
    """One row per reference record, in its order: its id, and the sorted distinct candidate ids joined by commas.

    ``reference`` may have row_index, which is kept for ordering. Of pairs that have CHUNK, the lists keep it and lie dealt by it.
    """
    order = [c for c in ("row_index",) if c in reference.columns]
    rows = reference.select(F.col(schema.entity_id).alias(schema.truth_id), *order)
    rows, more = beside(pairs, rows, schema.truth_id)
    lists = pairs.groupBy(F.col(PAIR[1]).alias("__id"), *more).agg(F.array_join(F.array_sort(F.collect_set(PAIR[3])), ",").alias(out))
    lists = lists.withColumnsRenamed({"__id": schema.truth_id})
    joined = rows.join(lists, [schema.truth_id, *more], "left").select(schema.truth_id, F.coalesce(out, F.lit("")).alias(out), *more, *order)
    return joined.orderBy(*order).drop(*order) if order else joined


def match_lists(reference: DataFrame, decided: DataFrame, schema: Schema = Schema()) -> DataFrame:
    return id_lists(reference, decided.where("predicted_match"), schema.truth_matches, schema)


def candidate_lists(reference: DataFrame, pairs: DataFrame, schema: Schema = Schema()) -> DataFrame:
    return id_lists(reference, pairs, schema.candidates, schema)


def rule_score(features: DataFrame) -> DataFrame:
    """A score without a model: the mean of the name and address Jaccard similarities."""
    return features.withColumn("score", F.round((F.col("name_token_jaccard") + F.col("address_token_jaccard")) / 2, 6))
