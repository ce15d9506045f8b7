"""Measured comparisons: blocking methods, feature families, kinds of models with their thresholds."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Blocking, Config, Schema
from lodestar.operators import blocking as B
from lodestar.operators import evaluation as E
from lodestar.operators import matcher as M
from lodestar.operators.resolve import decide
from lodestar.sources.shared import written

# The settings of the nine compared blocking runs.
BLOCKING_RUNS: dict[str, dict] = {
    "exact_name": {"enabled_methods": ("normalized_name_exact",)},
    "name_tokens": {"enabled_methods": ("name_token",)},
    "name_prefix": {"enabled_methods": ("name_prefix",)},
    "address_tokens": {"enabled_methods": ("address_token",)},
    "postal_tokens": {"enabled_methods": ("postal_token",)},
    "locality_tokens": {"enabled_methods": ("locality_token",)},
    "character_ngrams": {"enabled_methods": ("name_ngram", "address_ngram"), "use_ngrams": True},
    "phonetic": {"enabled_methods": ("name_phonetic",), "use_phonetic": True},
    "composite": {"enabled_methods": ("country_name", "country_address"), "use_combined": True},
}
# How the names of each compared family begin.
FAMILIES = {"all": ("",), "name": ("name_",), "address": ("address_",), "country_combined": ("country_", "name_address"), "missingness": ("missing_",)}


def blocking_runs(settings: Blocking = Blocking(), runs: Mapping[str, dict] = BLOCKING_RUNS) -> dict[str, Blocking]:
    return {name: dataclasses.replace(settings, **changes) for name, changes in runs.items()}


def blocking_ablation(
    reference: DataFrame, candidates: DataFrame, links: DataFrame, settings: Blocking = Blocking(), runs: Mapping[str, dict] = BLOCKING_RUNS, schema: Schema = Schema()
) -> DataFrame:
    """run, the blocking metrics of each run, and missed_of_union: links that ``settings`` find and the run doesn't.

    Methods that are always on take part in every run. ``reference`` and ``candidates`` are prepared records, read several
    times, so they should be written ones. No links: a recall of 1 and nothing missed.
    """
    own = blocking_runs(settings, runs)
    volumes, found = B.compared(reference, candidates, links, [settings, *own.values()], schema)
    ids = [B.PAIR[1], B.PAIR[3]]
    hits = links.join(found, ids).groupBy("run").agg(F.count(F.lit(1)).alias("hits"))
    union = found.where("run = 0").select(*ids)
    shared = found.join(union, ids).groupBy("run").agg(F.count(F.lit(1)).alias("shared"))
    total = links.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(ids[0]).alias("linked"))
    names = _table(reference, list(enumerate(own, 1)), "number int, name string")
    rows = names.join(volumes.withColumnRenamed("run", "number"), "number", "left")
    for more in (hits, shared):
        rows = rows.join(more.withColumnRenamed("run", "number"), "number", "left")
    rows = rows.na.fill(0, ["n", "seen", "hits", "shared"])
    # tables of one row each
    rows = rows.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(union.agg(F.count(F.lit(1)).alias("found"))))
    refs = F.greatest(F.lit(1), F.col("linked"))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("total")), F.lit(1.0)).alias("candidate_recall")
    return rows.select(
        F.col("name").alias("run"), recall, *B.volume_metrics(refs, refs * F.col("seen")), (F.col("found") - F.col("shared")).alias("missed_of_union")
    )


def experiment_record(metrics: Mapping[str, object], name: str = "entity_resolution") -> dict:
    """A record of an experiment for JSON: its name, then its metrics, numbers as floats."""
    number = lambda v: float(v) if isinstance(v, int | float) else v
    return {"experiment_name": name} | {str(k): number(v) for k, v in metrics.items()}


def _table(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """As many rows as there are experiments."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def feature_ablation(training: DataFrame, validation: DataFrame, names: Sequence[str], links: DataFrame, entities: DataFrame, config: Config = Config()) -> DataFrame:
    """Macro metrics of a model on each feature family alone: feature_family, feature_count, then the metrics.

    ``training`` and ``validation`` hold labelled features; links and entities are those of the validation references.
    Families without a feature in ``names`` are left out. Training rows without both classes raise ValueError.
    """
    rows = []
    for family, starts in FAMILIES.items():
        own = [n for n in names if n.startswith(starts)]
        if not own:
            continue
        scored = M.predict_probability(M.train(training, own, config.model), validation)
        m = E.macro_metrics(E.per_entity(decide(scored, config.inference), links, entities)).first()
        rows.append((family, len(own), *m))
    metrics = "entities long, macro_precision double, macro_recall double, macro_f05 double, false_merge_rate double, singleton_accuracy double"
    return _table(training, rows, f"feature_family string, feature_count int, {metrics}")


def experiment_table(
    training: DataFrame, validation: DataFrame, names: Sequence[str], links: DataFrame, entities: DataFrame, recall: float | None = None,
    config: Config = Config(), kinds: Sequence[str] = M.KINDS,
) -> DataFrame:
    """One row per kind of model with the threshold that serves it best on validation, best F0.5, then precision, first.

    Kinds that can't be built or fitted come last, without metrics and with the reason in ``notes``.
    """
    rows = []
    for i, kind in enumerate(dict.fromkeys(kinds)):
        started = time.perf_counter()
        named = (f"{kind}_{i:03d}", kind)
        try:
            model = M.train(training, names, config.model, kind)
        except (ImportError, ValueError) as e:
            rows.append((*named, "{}", None, None, None, None, recall, None, None, time.perf_counter() - started, f"unavailable: {e}"))
            continue
        scored = written(M.predict_probability(model, validation))
        threshold = E.best_threshold(E.threshold_sweep(scored, links, entities, config.sweep), config.sweep)
        m = E.macro_metrics(E.per_entity(decide(scored, config.inference, threshold), links, entities)).first()
        values = {p.name: v for p, v in model.pipeline.stages[-1].extractParamMap().items()}
        rows.append((
            *named, json.dumps(values, default=str, sort_keys=True), threshold, m.macro_precision, m.macro_recall, m.macro_f05, recall, m.false_merge_rate,
            m.singleton_accuracy, time.perf_counter() - started, "threshold chosen on the validation entities",
        ))
    rows.sort(key=lambda r: (r[6] is None, -(r[6] or 0), -(r[4] or 0)))
    return _table(training, rows, (
        "experiment_id string, model string, hyperparameters string, threshold double, macro_precision double, macro_recall double, macro_f05 double, "
        "candidate_recall double, false_merge_rate double, singleton_accuracy double, seconds double, notes string"
    ))
