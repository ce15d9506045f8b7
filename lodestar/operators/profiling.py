"""Exploratory profiles of record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Schema
from lodestar.functions.text import text_of, word_tokens


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: row_count, null_count, empty_count, distinct_count (nulls are one value), duplicate_count."""
    def row(c: str) -> Column:
        n, nulls = F.count(F.lit(1)), F.count_if(F.col(c).isNull())
        distinct = F.count_distinct(c) + F.when(nulls > 0, 1).otherwise(0)
        return F.struct(
            F.lit(c).alias("column_name"), n.alias("row_count"), nulls.alias("null_count"), F.count_if(F.col(c).cast("string") == "").alias("empty_count"),
            distinct.alias("distinct_count"), (n - distinct).alias("duplicate_count"),
        )

    return df.agg(F.array(*[row(c) for c in columns]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def profile_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: mean, median and 95th percentile of lengths, mean and median of token counts."""
    def row(c: str) -> Column:
        n, t = F.length(text_of(F.col(c))), F.size(word_tokens(F.col(c)))
        return F.struct(
            F.lit(c).alias("column_name"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"), F.percentile(n, 0.95).alias("p95_length"),
            F.avg(t).alias("mean_tokens"), F.median(t).alias("median_tokens"),
        )

    return df.agg(F.array(*[row(c) for c in columns]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def dimensions(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one in all columns."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def country_counts(df: DataFrame, schema: Schema = Schema()) -> DataFrame:
    return df.groupBy("source", F.col(schema.country).alias("country")).agg(F.count(F.lit(1)).alias("records"))


def country_pivot(df: DataFrame, sources: Sequence[str], schema: Schema = Schema()) -> DataFrame:
    """Countries by source, with 0 for none."""
    return df.groupBy(F.col(schema.country).alias("country")).agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])


def pattern_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values that are empty, have a non-ASCII character, or have punctuation."""
    def row(c: str) -> Column:
        x = text_of(F.col(c))
        return F.struct(
            F.lit(c).alias("column_name"), F.count_if(x == "").alias("empty_values"), F.count_if(x.rlike(r"[^\x00-\x7F]")).alias("non_ascii_values"),
            F.count_if(x.rlike(r"[!-/:-@\[-`{-~]")).alias("punctuated_values"),
        )

    return df.agg(F.array(*[row(c) for c in columns]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def parsed_truth(truth: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """Per entity: match_count, s2_count, s3_count, is_singleton, in_both."""
    ids = F.filter(F.split(text_of(F.col(schema.truth_matches)), ","), lambda x: x != "")
    n = lambda p: F.size(F.filter(ids, lambda x: x.startswith(p)))
    return truth.select(
        F.col(schema.truth_id), F.size(ids).alias("match_count"), n("S2-").alias("s2_count"), n("S3-").alias("s3_count"),
        (F.size(ids) == 0).alias("is_singleton"), ((n("S2-") > 0) & (n("S3-") > 0)).alias("in_both"),
    )


def match_histogram(truth: DataFrame, schema: Schema = Schema()) -> DataFrame:
    return parsed_truth(truth, schema).groupBy("match_count").agg(F.count(F.lit(1)).alias("entities"))


def overlap_patterns(truth: DataFrame, schema: Schema = Schema()) -> DataFrame:
    pattern = F.when(F.col("in_both"), "both").when(F.col("s2_count") > 0, "s2 only").when(F.col("s3_count") > 0, "s3 only").otherwise("zero")
    parsed = parsed_truth(truth, schema)
    total = parsed.agg(F.count(F.lit(1)).alias("total"))
    counts = parsed.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("entities"))
    return counts.crossJoin(F.broadcast(total)).select("pattern", "entities", (F.col("entities") / F.col("total")).alias("share"))


def length_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Values by length in equal bins from the least to the greatest length: bin (from 0), lowest, values."""
    n = F.length(text_of(F.col(column)))
    ends = df.agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / F.lit(bins), F.lit(1e-9))
    at = F.least(F.floor((F.col("n") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return (
        df.select(n.alias("n")).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), (F.col("lo") + at * width).alias("lowest"))
        .agg(F.count(F.lit(1)).alias("values"))
    )


def normalization_collisions(df: DataFrame, column: str, strategies: Mapping[str, Column]) -> DataFrame:
    """Per strategy: unique_raw, unique_normalized, groups of several raw values under one, and their rate."""
    rows = df.select(F.col(column).alias("raw"), F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("norm")) for k, v in strategies.items()])).alias("x"))
    by = rows.select("x.strategy", "x.norm", "raw").groupBy("strategy", "norm").agg(F.count_distinct("raw").alias("n"))
    raw = df.agg(F.count_distinct(column).alias("unique_raw"))
    return by.groupBy("strategy").agg(F.count(F.lit(1)).alias("unique_normalized"), F.count_if(F.col("n") > 1).alias("collision_groups")).crossJoin(F.broadcast(raw)).select(
        "strategy", "unique_raw", "unique_normalized", "collision_groups", F.coalesce(F.try_divide("collision_groups", "unique_normalized"), F.lit(0.0)).alias("collision_rate")
    )


def strategy_comparison(df: DataFrame, strategies: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Per source, column and strategy: raw_unique, normalized_unique, unique_change, collision_groups and collision_rate.

    ``strategies``: for each column its strategies. Null values count as empty ones.
    """
    variants = [
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("strategy"), F.coalesce(c, F.lit("")).alias("raw"), F.coalesce(v, F.lit("")).alias("norm"))
        for c, of in strategies.items() for k, v in of.items()
    ]
    rows = df.select("source", F.explode(F.array(*variants)).alias("x")).select("source", "x.*").distinct()
    keys = ["source", "column_name", "strategy"]
    # a raw value has one normal form, so the raw values of the forms add up to all of them
    by = rows.groupBy(*keys, "norm").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("raw_unique"), F.count(F.lit(1)).alias("normalized_unique"), F.count_if(F.col("n") > 1).alias("collision_groups")
    )
    return by.select(
        *keys, "raw_unique", "normalized_unique", (F.col("normalized_unique") - F.col("raw_unique")).alias("unique_change"), "collision_groups",
        (F.col("collision_groups") / F.col("normalized_unique")).alias("collision_rate"),
    )


def strategy_summary(comparison: DataFrame) -> DataFrame:
    """Per strategy: means of unique_change and collision_rate and all collision_groups, fewest collisions first."""
    by = comparison.groupBy("strategy").agg(F.avg("unique_change").alias("unique_change"), F.avg("collision_rate").alias("collision_rate"), F.sum("collision_groups").alias("collision_groups"))
    return by.orderBy("collision_rate", "unique_change", "strategy")


def name_overlap(df: DataFrame, column: str, sources: Sequence[str]) -> DataFrame:
    """Distinct values of a column that two sources share: (left_source, right_source, shared_values)."""
    own = df.select("source", F.col(column).alias("v")).distinct().groupBy("v").agg(F.collect_set("source").alias("s"))
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("left_source"), F.lit(b).alias("right_source"), F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias("shared_values")) for a, b in pairs]
    return own.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def variations(df: DataFrame, raw: str, simplified: str, n: int = 20) -> DataFrame:
    """The first ``n`` distinct values that normalisation changes."""
    return df.where(F.col(raw) != F.col(simplified)).select(raw, simplified).distinct().orderBy(raw, simplified).limit(n)
