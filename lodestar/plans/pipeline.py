"""Training, validation, inference and output in one run."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config, config_from_json
from lodestar.operators import blocking as B
from lodestar.operators import evaluation as E
from lodestar.operators import features as Fe
from lodestar.operators import matcher as M
from lodestar.operators import outputs as O
from lodestar.operators import validator as V
from lodestar.operators.records import prepare
from lodestar.operators.resolve import decide, id_lists
from lodestar.plans.experiments import experiment_record
from lodestar.sources.reports import write_json
from lodestar.sources.shared import written
from lodestar.sources.tables import load_ground_truth, load_split

COMPARED = ("logistic_regression", "extra_trees")


@dataclass(frozen=True)
class Artifacts:
    """What inference on unseen records needs."""

    model: M.TrainedModel
    idf: Fe.Idf
    threshold: float


@dataclass(frozen=True)
class InferenceResult:
    pairs: DataFrame
    scored: DataFrame
    decided: DataFrame
    matches: DataFrame


def sides(records: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    return records.where(F.col("source") == reference), records.where(F.col("source") != reference)


def run_inference(records: DataFrame, artifacts: Artifacts, config: Config = Config(), threshold: float | None = None) -> InferenceResult:
    """Candidates, scores, decisions and match lists of new records. Pairs and scores are written to the shared folder."""
    records = prepare(records, config.schema, config.normalization)
    reference, candidates = sides(records, config.dataset.sources[0])
    pairs = written(B.generate_candidates(reference, candidates, config.blocking, config.schema))
    features = Fe.pair_features(pairs, records, artifacts.idf, config.features, config.schema, config.dataset.sources, artifacts.model.feature_names)
    scored = written(M.predict_probability(artifacts.model, features))
    decided = decide(scored, config.inference, artifacts.threshold if threshold is None else threshold)
    return InferenceResult(pairs, scored, decided, id_lists(reference, decided.where("predicted_match"), config.schema.truth_matches, config.schema))


def fit(records: DataFrame, truth: DataFrame, config: Config = Config()) -> tuple[Artifacts, dict]:
    """Choose a kind of model and a threshold on held-out reference records, then fit on all; returns a summary too.

    TF-IDF weights for the choice come from the training references and all candidates.
    """
    s = config.schema
    records = written(prepare(records, s, config.normalization))
    reference, candidates = sides(records, config.dataset.sources[0])
    pairs = written(B.generate_candidates(reference, candidates, config.blocking, s))
    links = written(B.truth_links(truth, s))
    split = written(E.validation_split(truth, config.validation, s))
    labelled = E.label_pairs(pairs, links)
    held = split.where("is_validation").select(B.PAIR[1])
    names = Fe.feature_columns(Fe.feature_names(config.features))
    seen = records.join(held.withColumnRenamed(B.PAIR[1], s.entity_id), s.entity_id, "left_anti")
    idf = Fe.fit_feature_transformers(seen, config.features)
    featured = written(Fe.pair_features(labelled, records, idf, config.features, s, config.dataset.sources, names))
    held = written(held)
    training, validation = featured.join(held, B.PAIR[1], "left_anti"), featured.join(held, B.PAIR[1], "left_semi")
    compared = M.compare_models(list(dict.fromkeys((config.model.kind, *COMPARED))), training, validation, names, config.model)
    best = compared[0]
    if best["model"] is None:
        raise M.ModelConfigurationError("; ".join(r["reason"] for r in compared))
    scored = M.predict_probability(best["model"], validation)
    own_links = links.join(held, B.PAIR[1], "left_semi")
    sweep = E.threshold_sweep(scored, own_links, held, config.sweep)
    threshold = E.best_threshold(sweep, config.sweep)
    metrics = E.macro_metrics(E.per_entity(decide(scored, config.inference, threshold), own_links, held)).first().asDict()
    final_idf = Fe.fit_feature_transformers(records, config.features)
    final_idf = Fe.Idf(written(final_idf.name), written(final_idf.address))
    final = written(Fe.pair_features(labelled, records, final_idf, config.features, s, config.dataset.sources, names))
    model = M.train(final, names, config.model, best["kind"])
    recall = E.candidate_recall(pairs, links).first()[0]
    summary = {"threshold": threshold, "validation": metrics, "candidate_recall": recall, "compared": [{k: v for k, v in r.items() if k != "model"} for r in compared], **model.summary()}
    return Artifacts(model, final_idf, threshold), summary


def save_artifacts(a: Artifacts, path: str) -> None:
    M.save(a.model, f"{path}/model")
    a.idf.name.write.mode("overwrite").parquet(f"{path}/idf_name")
    a.idf.address.write.mode("overwrite").parquet(f"{path}/idf_address")
    spark = SparkSession.active()
    spark.createDataFrame([(a.threshold,)], "threshold double").write.mode("overwrite").parquet(f"{path}/threshold")


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    read = spark.read.parquet
    return Artifacts(M.load(f"{path}/model"), Fe.Idf(read(f"{path}/idf_name"), read(f"{path}/idf_address")), read(f"{path}/threshold").first()[0])


def run_all(spark: SparkSession, config: Config) -> dict:
    """Fit on the training split, infer on the test split, check and write both lists; returns the summary, also written as summary.json."""
    artifacts, summary = fit(load_split(spark, config, "train"), load_ground_truth(spark, config), config)
    save_artifacts(artifacts, f"{config.output.folder}/artifacts")
    records = written(prepare(load_split(spark, config, "test"), config.schema, config.normalization))
    result = run_inference(records, artifacts, config)
    reference, candidates = sides(records, config.dataset.sources[0])
    files = O.generate_outputs(reference, candidates, result.pairs, result.decided, config)
    own, *others = [f"{config.dataset.root}/test/test_{s}.tsv" for s in config.dataset.sources]
    report = V.validate(spark, own, files[config.output.matches], files[config.output.candidates], others, config.schema)
    summary |= {"files": files, "validator": {"errors": report.errors, "warnings": report.warnings}}
    write_json(spark, f"{config.output.folder}/summary.json", experiment_record(summary))
    return summary


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config")
    p.add_argument("--project-root", default=".")
    p.add_argument("--output-dir")
    a = p.parse_args(args)
    config = config_from_json(a.config, a.project_root) if a.config else Config().resolved(a.project_root)
    if a.output_dir:
        import dataclasses

        config = dataclasses.replace(config, output=dataclasses.replace(config.output, folder=a.output_dir))
    print(json.dumps(run_all(SparkSession.builder.getOrCreate(), config), indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
