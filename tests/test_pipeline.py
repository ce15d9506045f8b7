import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.config import Blocking, Config, ConfigurationError, Features, Sweep, config_from_json, config_from_mapping
from lodestar.operators import blocking as B
from lodestar.operators import evaluation as E
from lodestar.operators import features as Fe
from lodestar.operators import matcher as M
from lodestar.operators import outputs as O
from lodestar.operators import validator as V
from lodestar.operators.records import prepare
from lodestar.plans import experiments as X
from lodestar.plans import pipeline
from lodestar.sources import reports, tables
from lodestar.streaming import stream_records

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
DEFAULT = (
    "name_exact name_token_jaccard name_character_similarity name_length_difference address_exact address_token_jaccard address_character_similarity "
    "address_length_difference country_exact name_edit_similarity name_tfidf_cosine name_token_overlap name_token_count_difference name_prefix_similarity "
    "name_suffix_similarity name_order_insensitive_similarity name_address_exact name_address_similarity address_edit_similarity address_tfidf_cosine "
    "address_token_overlap address_postal_agreement address_locality_overlap"
).split()


def make(folder, split, seed, truth):
    rng = random.Random(seed)
    names = ["Acme", "Blue", "Crown", "Delta", "Echo", "Fern", "Gold", "Haven", "Iris", "Jade"]
    kinds = ["Foods", "Traders", "Motors", "Textiles", "Labs"]
    rows, links = {s: [] for s in "123"}, []
    for i in range(60):
        name, addr = f"{rng.choice(names)} {rng.choice(names)} {rng.choice(kinds)}", f"{rng.randrange(1, 99)} {rng.choice(names)} Street, Ward {rng.randrange(9)}, {560000 + i}"
        rows["1"].append((f"S1-{i:03}", f"{name} Ltd", addr, "India"))
        found = []
        for s in "23":
            if rng.random() < 0.6:
                rows[s].append((f"S{s}-{i:03}", name.upper(), addr.replace("Street", "St."), rng.choice(["India", ""])))
                found.append(f"S{s}-{i:03}")
        links.append((f"S1-{i:03}", ",".join(found)))
        rows["2"].append((f"S2-9{i:02}", f"{rng.choice(names)} {rng.choice(kinds)}", f"{rng.randrange(1, 99)} Other Road, {400000 + i}", "US"))
    (folder / split).mkdir(parents=True)
    for s, r in rows.items():
        (folder / split / f"{split}_source{s}.tsv").write_text(HEAD + "".join("\t".join(x) + "\n" for x in r))
    if truth:
        (folder / split / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{b}\n" for a, b in links))
    return links


def test_end_to_end(spark, tmp_path):
    data = tmp_path / "dataset"
    make(data, "train", 1, True)
    links = make(data, "test", 2, False)
    config = dataclasses.replace(Config().resolved(tmp_path), features=Features(enabled=("name_token_jaccard", "address_token_jaccard", "country_exact")))
    summary = pipeline.run_all(spark, config)
    assert summary["validation"]["macro_f05"] > 0.9 and summary["candidate_recall"] == 1.0
    files = summary["files"]
    got = dict(line.split("\t") for line in open(files["matching_results.tsv"].removeprefix("file:")).read().splitlines()[1:])
    assert list(got) == [a for a, _ in links]
    assert sum(got[a] == b for a, b in links) > 0.9 * len(links)
    assert json.load(open(f"{config.output.folder}/summary.json"))["validator"] == {"errors": [], "warnings": []}
    report = V.validate(spark, f"{data}/test/test_source1.tsv", files["matching_results.tsv"], files["candidate_pairs.tsv"], [f"{data}/test/test_source{s}.tsv" for s in "23"])
    assert report == V.Report()
    loaded = pipeline.load_artifacts(spark, f"{config.output.folder}/artifacts")
    again = pipeline.run_inference(tables.load_split(spark, config, "test"), loaded, config)
    assert {r[0]: r[1] for r in again.matches.collect()} == got
    assert json.dumps(summary, default=str)


def test_validator_reports_everything(spark, tmp_path):
    (tmp_path / "s1").write_text(HEAD + "S1-1\ta\tb\tc\nS1-2\ta\tb\tc\nS1-3\ta\tb\tc\n")
    good = "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-3\t\n"
    (tmp_path / "c").write_text(good)
    (tmp_path / "m").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-9,X-1,,S2-7\nS1-1\tS2-1,S2-1,S1-9,X-1,,S2-7\nS1-2\t\nS1-8\t\nno tab\n")
    report = V.validate(spark, f"{tmp_path}/s1", f"{tmp_path}/m", f"{tmp_path}/c", [f"{tmp_path}/s1"])
    text = "\n".join(report.errors)
    for rule in ("missing reference", "unexpected reference", "repeated reference", "repeated id", "self match", "bad prefix: 2", "unknown id", "row without a tab"):
        assert rule in text, rule
    assert len(report.warnings) == 1 and "not a candidate: 3" in report.warnings[0]
    (tmp_path / "h").write_text("source1_entity_id,matched_entity_ids\n")
    assert "comma" in V.validate(spark, f"{tmp_path}/s1", f"{tmp_path}/h", f"{tmp_path}/none").errors[0]
    assert V.main(["--reference", f"{tmp_path}/s1", "--matches", f"{tmp_path}/m", "--candidates", f"{tmp_path}/c"]) == 1


def test_loading_errors(spark, tmp_path):
    for name, body, word in (("a", "", "empty"), ("b", "x\ty\n", "no rows"), ("c", "x\tx\n1\t2\n", "repeated"), ("d", "x\t\n1\t2\n", "blank"), ("e", "x\ty\n1\t2\n", "missing")):
        (tmp_path / name).write_text(body)
        with pytest.raises(tables.DataLoadingError, match=word):
            tables.load_table(spark, f"{tmp_path}/{name}", ["z"] if name == "e" else [])
    with pytest.raises(tables.DataLoadingError):
        tables.load_table(spark, f"{tmp_path}/none")
    (tmp_path / "f").write_text('x\ty\nNA\t\n"a\t""b"\tnull\n')
    assert [tuple(r) for r in tables.load_table(spark, f"{tmp_path}/f").collect()] == [("NA", ""), ('a\t"b', "null")]
    (tmp_path / "g").write_text("x\ty\n1\t2\t3\n")
    with pytest.raises(Exception):
        tables.load_table(spark, f"{tmp_path}/g").collect()


def test_configuration(tmp_path):
    assert Fe.feature_names() == DEFAULT
    assert Fe.feature_names(Features(enabled=("combined",))) == ["name_address_exact", "name_address_similarity"]
    assert Fe.feature_names(Features(enabled=("missingness", "country"))) == ["country_exact", "country_compatible", "missing_name", "missing_address", "missing_country"]
    assert Fe.feature_names(Features(enabled=("source",))) == ["reference_source", "candidate_source"]
    assert Fe.feature_names(Features(enabled=("unknown",))) == list(Fe.ALL_FEATURES)
    assert Fe.feature_columns(["name_exact", "candidate_source"]) == ["name_exact", "candidate_source_code"]
    assert Fe.feature_names(Features(enabled=())) == list(Fe.ALL_FEATURES)
    with pytest.raises(ConfigurationError, match="threshold.*sweep"):
        config_from_mapping({"inference": {"threshold": 2}, "sweep": {"step": 0}})
    with pytest.raises(ConfigurationError, match="unknown section"):
        config_from_mapping({"other": {}})
    (tmp_path / "c.json").write_text('{"blocking": {"max_candidates": 7}}')
    c = config_from_json(tmp_path / "c.json", "/data")
    assert c.blocking.max_candidates == 7 and c.dataset.root == "/data/dataset" and c.to_dict()["blocking"]["max_candidates"] == 7
    assert len(Sweep().grid()) == 25
    assert Config().blocking.probed == ("normalized_name_exact", "name_token", "address_token", "postal_token", "locality_token", "name_prefix")


def test_metrics(spark):
    links = spark.createDataFrame([("a", "S2-1"), ("a", "S3-1"), ("c", "S2-3")], "reference_entity_id string, candidate_entity_id string")
    pairs = spark.createDataFrame([("a", "S2-1", True), ("a", "S2-2", True), ("a", "S3-1", True), ("d", "S2-9", True), ("c", "S2-3", False)], "reference_entity_id string, candidate_entity_id string, predicted_match boolean")
    ids = spark.createDataFrame([(x,) for x in "abcd"], "reference_entity_id string")
    rows = {r.reference_entity_id: r for r in E.per_entity(pairs, links, ids).collect()}
    assert rows["a"].f05 == pytest.approx(0.714286, abs=1e-6)
    assert (rows["b"].precision, rows["b"].recall, rows["b"].f05) == (0, 1, 1)
    assert (rows["c"].precision, rows["c"].recall, rows["c"].f05) == (0, 0, 0) == (rows["d"].precision, rows["d"].recall, rows["d"].f05)
    m = E.macro_metrics(E.per_entity(pairs, links, ids)).first()
    assert m.false_merge_rate == 0.5 and m.singleton_accuracy == 0.5
    assert E.macro_metrics(E.per_entity(pairs, links, ids.limit(0))).first().macro_f05 == 0
    assert all(r.predicted_match_count == 0 for r in E.per_entity(pairs.drop("predicted_match"), links, ids).collect())


def test_split_takes_the_rounded_share(spark):
    truth = spark.createDataFrame([(f"e{i}", "S2-1" if i % 3 else "") for i in range(100)] + [("x", "")], "source1_entity_id string, matched_entity_ids string")
    sizes = {r.has_match: (r.entities, r.validation_entities) for r in E.split_sizes(E.validation_split(truth)).collect()}
    assert sizes == {True: (66, 13), False: (35, 7)}
    assert E.validation_split(truth).exceptAll(E.validation_split(truth)).count() == 0
    with pytest.raises(ValueError):
        E.validation_split(truth.union(truth))


def test_models(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(a, b, int(a + 0.3 * b > 0.8)) for a, b in rows], "a double, b double, target int")
    out = M.compare_models(["logistic-regression", "Random Forest", "xgboost", "nothing"], df, df, ["a", "b"])
    assert [r["status"] for r in out] == ["ok", "ok", "unavailable", "unavailable"] and out[0]["f05"] > 0.9
    with pytest.raises(ValueError):
        M.train(df.where("target = 0"), ["a", "b"])
    with pytest.raises(ValueError):
        M.train(df.limit(0), ["a", "b"])


def test_outputs_are_refused(spark):
    ref = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    cand = spark.createDataFrame([("S2-1",)], "entity_id string")
    lists = lambda c, rows: spark.createDataFrame(rows, f"source1_entity_id string, {c} string")
    fine = lists("candidate_entity_ids", [("S1-1", "S2-1"), ("S1-2", "")])
    O.validate_outputs(ref, cand, lists("matched_entity_ids", [("S1-1", "S2-1"), ("S1-2", "")]), fine)
    for rows, rule in (([("S1-1", "")], "missing"), ([("S1-1", "S2-1,S2-1"), ("S1-2", "")], "repeated id"), ([("S1-1", "S2-5"), ("S1-2", "")], "unknown id"),
                       ([("S1-1", ""), ("S1-2", "S2-1")], "not a candidate"), ([("S1-1", None), ("S1-2", "")], "null list")):
        with pytest.raises(O.SubmissionValidationError, match=rule):
            O.validate_outputs(ref, cand, lists("matched_entity_ids", rows), fine)
    own = ref.withColumn("row_index", F.when(F.col("entity_id") == "S1-1", 0).otherwise(1))
    turned = lists("x", [("S1-1", ""), ("S1-2", "")]).withColumn("row_index", F.when(F.col("source1_entity_id") == "S1-1", 1).otherwise(0))
    assert O.out_of_order(own, turned).count() == 1
    gap = turned.withColumn("row_index", F.when(F.col("row_index") == 1, 7 << 33).otherwise(0))
    assert O.out_of_order(own, gap).count() == 1


def test_reports(spark, tmp_path):
    df = spark.range(100, numPartitions=7).select("id", F.when(F.col("id") == 3, 'a\t"b"').otherwise("").alias("x"))
    for _ in range(2):
        path = tables.write_delimited(df, f"{tmp_path}/out.tsv")
    assert open(path).read() == "id\tx\n" + "".join(f"{i}\t" + ('"a\t""b"""' if i == 3 else "") + "\n" for i in range(100))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.tsv"]
    assert open(tables.write_delimited(df.limit(0), f"{tmp_path}/none.tsv")).read() == "id\tx\n"
    text = open(reports.write_markdown(spark, f"{tmp_path}/r.md", "T", ["n"], {"rows": spark.createDataFrame([("a|b", None)], "x string, y int")})).read()
    assert text == "# T\n\n- n\n\n## rows\n\n| x | y |\n| --- | --- |\n| a\\|b |  |\n"
    assert X.experiment_record({"a": 1, "b": "c"}, "e") == {"experiment_name": "e", "a": 1.0, "b": "c"}


def test_blocking_ablation(spark, tmp_path):
    make(tmp_path, "train", 1, True)
    df = prepare(tables.load_sources(spark, {f"source{s}": f"{tmp_path}/train/train_source{s}.tsv" for s in "123"}))
    links = B.truth_links(tables.load_table(spark, f"{tmp_path}/train/train_ground_truth.tsv"))
    ref, cand = pipeline.sides(df, "source1")
    got = {r.run: r for r in X.blocking_ablation(ref, cand, links).collect()}
    assert set(got) == set(X.BLOCKING_RUNS)
    union = {tuple(r) for r in B.generate_candidates(ref, cand).select(*B.PAIR[1::2]).collect()}
    true = {tuple(r) for r in links.collect()}
    for run, settings in X.blocking_runs().items():
        own = {tuple(r) for r in B.generate_candidates(ref, cand, settings).select(*B.PAIR[1::2]).collect()}
        assert got[run].missed_of_union == len(true & union - own) and got[run].candidate_recall == len(true & own) / len(true)
    one = B.singletons_with_candidates(B.generate_candidates(ref, cand), links, ref).first()
    assert one.singletons == 60 - len({a for a, _ in true})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(HEAD + "S2-1\tCafé Ltd\t1 Main Street\tUS\n")
    q = stream_records(spark, f"{tmp_path}/in", "source2").writeStream.format("memory").queryName("records").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.name_normalized, r.address_normalized, r.source) for r in spark.sql("select * from records").collect()] == [("cafe", "1 main st", "source2")]


def _blocks(spark):
    rows = [(f"S1-{i}", "S1", f"red lamp {i % 7}", f"{i % 5} oak street", "en" if i % 3 else "") for i in range(40)]
    rows += [(f"S2-{i % 50}", "S2", f"red lamp {i % 11}", f"{i % 4} elm street", "en" if i % 4 else "fr") for i in range(60)]
    df = prepare(spark.createDataFrame(rows + rows[:3], "entity_id string, source string, business_name string, business_address string, country string"))
    return df.where("source = 'S1'"), df.where("source <> 'S1'")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocked_is_every_pair_and_deals_none_out(spark):
    ref, cand = _blocks(spark)
    for methods in (["name_token", "name_prefix"], ["address_token", "locality_token", "country_name"]):
        want = B.merged(B.block(ref, cand, methods))
        got = B.blocked(ref, cand, methods)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
        assert "Join" not in _plan(got) and "Aggregate" not in _plan(got)


@pytest.mark.parametrize("at_once, rare", [(200_000, 128), (5, 1), (200_000, 4)])
def test_blocked_names_no_record_per_pair(spark, at_once, rare):
    import pyarrow as pa

    rows = [("S2", f"S2-{i}", "", [f"\nall\nk{i % 3}", f"\nown{i}"]) for i in range(30)] + [("S3", "S3-1", "fr", ["\nall", ""])] * 2
    asked = [("S1", "S1-1", "en", ["\nk1\nnone", "\nown4"]), ("S1", "S1-1", "en", ["\nall", ""]), ("S1", "S1-2", "fr", ["\nk2", "\nown5\nown6"]), ("S1", "S1-3", "", ["\nno", ""])]
    table = pa.table({n: [x[i] for x in rows + asked] for i, n in enumerate(("source", "id", "country"))} | {f"k{j}": [x[3][j] for x in rows + asked] for j in (0, 1)})
    table = pa.concat_tables([table, table])
    cells, sides = [1] * 36 + [2] * 36, ([0] * 32 + [1] * 4) * 2
    table = pa.table([cells, sides, [True] * 72, *table.columns], names=["cell", "side", "gated", *table.column_names])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(B, "_PAIRS_AT_ONCE", at_once)
        patch.setattr(B, "_RARE", rare)
        out = [b.to_pylist()[0] for b in B._met(2)(iter(table.to_batches(max_chunksize=7)))]
    got, low = [], (1 << B._BELOW) - 1
    for r in out:
        assert len(set(r["candidate_ids"])) == len(r["candidate_ids"]) == 31
        got += [(r["reference_ids"][c >> B._BELOW], r["candidate_ids"][(c & low) >> 2], c & 3) for c in r["codes"]]
    want = {("S1-1", f"S2-{i}"): 1 | (i == 4) << 1 for i in range(30)} | {("S1-2", f"S2-{i}"): (i % 3 == 2) | (i in (5, 6)) << 1 for i in range(30) if i % 3 == 2 or i == 6}
    assert sorted(got) == sorted([(*k, v) for k, v in want.items()] * 2)


def test_blocked_joins_the_methods_of_a_pair(spark):
    ref, cand = _blocks(spark)
    for methods in (["address_token"], ["name_token", "name_prefix", "country_name"]):
        want = B.merged(B.block(ref, cand, methods)).collect()
        got = B.blocked(ref, cand, methods, separator=",").collect()
        assert sorted(map(tuple, got)) == sorted((*r[:4], ",".join(r[4])) for r in want)


def test_first_candidates_of_each_reference(spark):
    from collections import defaultdict

    ref, cand = _blocks(spark)
    settings = Blocking(max_candidates=7)
    everyone = defaultdict(list)
    for r in B.merged(B.block(ref, cand, settings.probed)).collect():
        everyone[r[0], r[1]].append((r[2], r[3], tuple(r[4])))
    want = {(*k, *v) for k, found in everyone.items() for v in sorted(found)[:7]}
    pairs = B.chunked_candidates(ref, cand, settings)
    assert {(*r[:4], tuple(r[4])) for r in B.generate_candidates(ref, cand, settings).collect()} == want
    assert pairs.count() == len(want)
    # joins find the pairs where they lie: no exchange by the candidate's id
    links = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-99")], "reference_entity_id string, candidate_entity_id string")
    assert sorted(map(tuple, B.found_links(pairs, links).collect())) == sorted({(a, b) for _, a, _, b, _ in want} & {("S1-1", "S2-1"), ("S1-2", "S2-99")})


def test_what_chunks_have_found_is_not_dealt_out_again(spark):
    ref, cand = _blocks(spark)
    pairs = B.chunked_candidates(ref, cand, fields=("country_normalized",))
    assert pairs.count()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "FileScan" in line and "codes" in line]
    assert found and all("Bucketed: true" in line for line in found)


def test_spread_fills_every_partition_once(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in B._spread(13)], "x int").repartition(13, "x").select("x", F.spark_partition_id().alias("p"))
    assert sorted(r.p for r in rows.collect()) == list(range(13))


def test_ablation_is_that_of_each_run_and_reads_records_once(spark):
    ref, cand = _blocks(spark)
    links = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(12) for j in (i, i + 30, 99)], "reference_entity_id string, candidate_entity_id string")
    settings, runs = Blocking(max_candidates=9), {"names": {"enabled_methods": ("name_token",)}, "grams": {"enabled_methods": ("name_ngram",), "use_ngrams": True}, "few": {"max_candidates": 3, "use_country": False}}
    made = []

    def counted(*a, f=B._ranked):
        made.append(a)
        return f(*a)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(B, "_ranked", counted)
        got = {r.run: r for r in X.blocking_ablation(ref, cand, links, settings, runs).collect()}
    assert len(made) == 1 and set(got) == set(runs)
    union = B.found_links(B.generate_candidates(ref, cand, settings), links)
    for run, own in X.blocking_runs(settings, runs).items():
        pairs = B.generate_candidates(ref, cand, own)
        want = B.blocking_metrics(pairs, links).first().asDict() | {"run": run, "missed_of_union": B.missed_links(pairs, union).count()}
        assert got[run].asDict() == pytest.approx(want)
