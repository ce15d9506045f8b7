"""Splits, labels and metrics of predicted links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Schema, Sweep, Validation
from lodestar.functions.text import text_of
from lodestar.operators.blocking import PAIR, beside, found_links

R, C = PAIR[1], PAIR[3]


def validation_split(truth: DataFrame, config: Validation = Validation(), schema: Schema = Schema()) -> DataFrame:
    """(reference_entity_id, has_match, is_validation): seeded, stratified by whether an entity has a match.

    Each stratum gives its rounded share (half to even), one at least. Ids must be unique.
    """
    rows = truth.select(F.col(schema.truth_id).alias(R), F.exists(F.split(text_of(F.col(schema.truth_matches)), ","), lambda x: x != "").alias("has_match"))
    if rows.groupBy(R).count().where("count > 1").limit(1).count():
        raise ValueError("reference ids must be unique")
    strata = ["has_match"] if config.stratify else []
    hashed = rows.withColumn("__h", F.xxhash64(R, F.lit(config.seed)))
    sizes = hashed.groupBy(*strata).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(config.fraction))).cast("long").alias("__take"))
    # the hash that the share ends at is found from a histogram of its leading bits, so that no stratum is sorted in one task
    hashed = hashed.withColumn("__b", F.shiftright("__h", 48))
    by_bin = hashed.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = by_bin.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*strata, "__b").orderBy("__h", R)
    ranked = hashed.withColumn("__r", F.row_number().over(within)).join(by_bin, [*strata, "__b"])
    ranked = ranked.join(sizes, strata) if strata else ranked.crossJoin(F.broadcast(sizes))
    return ranked.select(R, "has_match", (F.col("__before") + F.col("__r") <= F.col("__take")).alias("is_validation"))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("has_match").agg(F.count(F.lit(1)).alias("entities"), F.count_if("is_validation").alias("validation_entities"))


def label_pairs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with target 1 for a true link, else 0; every pair that isn't one is a negative."""
    links, more = beside(pairs, links.withColumn("__t", F.lit(1)))
    return pairs.join(links.hint("shuffle_hash") if more else links, [R, C, *more], "left").withColumn("target", F.coalesce("__t", F.lit(0)).cast("int")).drop("__t")


def f05(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(1.25 * precision * recall, 0.25 * precision + recall), F.lit(0.0))


def _scored(entities: DataFrame) -> DataFrame:
    """From counts n_predicted, n_true and n_hit to the metrics of each entity."""
    p = F.coalesce(F.try_divide(F.col("n_hit"), F.col("n_predicted")), F.lit(0.0))
    r = F.when(F.col("n_true") > 0, F.col("n_hit") / F.greatest(F.col("n_true"), F.lit(1))).otherwise((F.col("n_predicted") == 0).cast("double"))
    alone = F.col("n_true") == 0
    return entities.withColumns({"precision": p, "recall": r}).withColumns({
        "f05": F.when(alone & (F.col("n_predicted") == 0), 1.0).otherwise(f05(F.col("precision"), F.col("recall"))),
        "is_singleton": alone, "singleton_correct": alone & (F.col("n_predicted") == 0),
    })


def per_entity(decided: DataFrame, links: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Counts and metrics of each reference entity, with and without predictions.

    ``decided`` has predicted_match (none is predicted without it); ``entities`` lists the ids to report, else all met.
    """
    yes = F.col("predicted_match") if "predicted_match" in decided.columns else F.lit(False)
    predicted = decided.where(yes).select(R, C).distinct()
    both = predicted.withColumn("p", F.lit(1)).join(links.withColumn("t", F.lit(1)), [R, C], "full")
    counts = both.groupBy(R).agg(F.count("p").alias("n_predicted"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("n_hit"))
    if entities is not None:
        counts = entities.select(R).distinct().join(counts, R, "left").na.fill(0, ["n_predicted", "n_true", "n_hit"])
    return _scored(counts).select(
        R, F.col("n_predicted").alias("predicted_match_count"), F.col("n_true").alias("true_match_count"), F.col("n_hit").alias("true_positive_count"),
        (F.col("n_predicted") - F.col("n_hit")).alias("false_positive_count"), (F.col("n_true") - F.col("n_hit")).alias("false_negative_count"),
        "precision", "recall", "f05", "is_singleton", "singleton_correct",
    )


def macro_metrics(entities: DataFrame) -> DataFrame:
    """One row of means over entities; zeros for none. false_merge_rate is false positives of all predictions."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    singles = F.try_divide(F.count_if("singleton_correct"), F.count_if("is_singleton"))
    n = F.count(F.lit(1))
    return entities.agg(
        n.alias("entities"), zero(F.avg("precision")).alias("macro_precision"), zero(F.avg("recall")).alias("macro_recall"), zero(F.avg("f05")).alias("macro_f05"),
        zero(F.try_divide(F.sum("false_positive_count"), F.sum("predicted_match_count"))).alias("false_merge_rate"),
        F.when(n == 0, 0.0).otherwise(F.coalesce(singles, F.lit(1.0))).alias("singleton_accuracy"),
    )


def singleton_metrics(entities: DataFrame) -> DataFrame:
    return entities.where("is_singleton").agg(
        F.count(F.lit(1)).alias("singletons"), F.count_if("singleton_correct").alias("correct"),
        F.coalesce(F.try_divide(F.count_if("singleton_correct"), F.count(F.lit(1))), F.lit(1.0)).alias("singleton_accuracy"),
    )


def candidate_recall(pairs: DataFrame, links: DataFrame) -> DataFrame:
    own = found_links(pairs, links).withColumn("hit", F.lit(1))
    return links.join(own, [R, C], "left").agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(1.0)).alias("candidate_recall"))


def threshold_sweep(scored: DataFrame, links: DataFrame, entities: DataFrame, config: Sweep = Sweep()) -> DataFrame:
    """Macro metrics at each threshold of the grid, from one pass over the scored pairs.

    A pair adds to the counts of an entity at the highest threshold that it reaches; sums from above give those of
    every threshold. The counts have at most one row per entity and threshold.
    """
    grid = config.grid()
    reached = sum((F.when(F.col("score") >= F.lit(t), 1).otherwise(0) for t in grid), F.lit(0)).alias("g")
    # pairs below the lowest threshold count nowhere, and need not be dealt out
    best = scored.where(F.col("score") >= F.lit(min(grid))).groupBy(R, C).agg(F.max("score").alias("score"))
    hits = best.join(links.withColumn("t", F.lit(1)), [R, C], "left").select(R, reached, F.coalesce("t", F.lit(0)).alias("t")).where("g > 0")
    steps = hits.groupBy(R, "g").agg(F.count(F.lit(1)).alias("p"), F.sum("t").alias("h"))
    truths = links.groupBy(R).agg(F.count(F.lit(1)).alias("n_true"))
    thresholds = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("g"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)]))
    rows = entities.select(R).distinct().join(truths, R, "left").na.fill(0, ["n_true"]).select("*", thresholds.alias("x")).select(R, "n_true", "x.g", "x.threshold")
    above = Window.partitionBy(R).orderBy(F.desc("g"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(above)
    rows = rows.join(steps, [R, "g"], "left").withColumns({"n_predicted": total("p"), "n_hit": total("h")})
    scores = _scored(rows).withColumns({"false_positive_count": F.col("n_predicted") - F.col("n_hit"), "predicted_match_count": F.col("n_predicted")})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.groupBy("threshold").agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f05").alias("macro_f05"),
        zero(F.try_divide(F.sum("false_positive_count"), F.sum("predicted_match_count"))).alias("false_merge_rate"),
        F.coalesce(F.try_divide(F.count_if("singleton_correct"), F.count_if("is_singleton")), F.lit(1.0)).alias("singleton_accuracy"),
    )


def best_threshold(sweep: DataFrame, config: Sweep = Sweep()) -> float:
    """The threshold of the best F0.5, then precision, then the highest, among those that meet the limits if any does."""
    rows = sweep.collect()  # as many as the grid has
    fits = [r for r in rows if (config.minimum_precision is None or r.macro_precision >= config.minimum_precision) and (config.maximum_false_merge_rate is None or r.false_merge_rate <= config.maximum_false_merge_rate)]
    return max(fits or rows, key=lambda r: (r.macro_f05, r.macro_precision, r.threshold)).threshold
