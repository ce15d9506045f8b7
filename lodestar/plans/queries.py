"""Queries over the driver's tables, one for each operator or group of operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Blocking, Features, Inference
from lodestar.functions import text as T
from lodestar.operators import blocking as B
from lodestar.operators import evaluation as E
from lodestar.operators import features as Fe
from lodestar.operators import matcher as M
from lodestar.operators import outputs as O
from lodestar.operators import profiling as P
from lodestar.operators import resolve as D
from lodestar.operators.records import prepare
from lodestar.plans import experiments as X
from lodestar.plans import sql as S
from lodestar.plans.pipeline import COMPARED
from lodestar.sources.shared import written
from lodestar.sources.tables import records_from_documents

THRESHOLD = 0.6
TRUTH_ID, TRUTH = "source1_entity_id", "matched_entity_ids"
ID = [B.PAIR[1], B.PAIR[3]]
Query = Callable[[SparkSession, str], DataFrame]


def records(spark: SparkSession, sf: str) -> DataFrame:
    return records_from_documents(spark.read.parquet(f"{sf}/documents.parquet"))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(records(spark, sf))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("source") == "S1"), df.where(F.col("source") != "S1")


def fields(spark: SparkSession, sf: str) -> DataFrame:
    """What blocking and features read of the prepared records, written once."""
    return written(prepared(spark, sf).select("source", "entity_id", *Fe.FIELDS))


def candidates(spark: SparkSession, sf: str, settings: Blocking = Blocking()) -> DataFrame:
    return B.chunked_candidates(*sides(fields(spark, sf)), settings)


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the fields of both records."""
    return B.chunked_candidates(*sides(fields(spark, sf)), fields=Fe.FIELDS)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Weak truth: records of other sources with the same language and the same normalised text. Texts meet as their SHA-256."""
    t = records(spark, sf).select("entity_id", "source", "country", F.unhex(F.sha2(T.normalize(F.col("text")), 256)).alias("t"))
    ref, other = sides(t)
    return ref.select(F.col("entity_id").alias(ID[0]), "country", "t").join(other.select(F.col("entity_id").alias(ID[1]), "country", "t"), ["country", "t"]).select(*ID).distinct()


def truth(spark: SparkSession, sf: str) -> DataFrame:
    ref = sides(records(spark, sf))[0].select("entity_id")
    return D.id_lists(ref, links(spark, sf).select(*ID), TRUTH)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flat(df: DataFrame) -> DataFrame:
    """With lists as text."""
    return df.select(*[F.array_join(c, "," if c == "blocking_methods" else " ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def of_records(column: Callable[[], Column], name: str) -> Query:
    return lambda spark, sf: flat(records(spark, sf).select("entity_id", column().alias(name)))


def of_prepared(*columns: str) -> Query:
    return lambda spark, sf: flat(prepared(spark, sf).select("entity_id", *columns))


def block_of(*methods: str, settings: Blocking = Blocking()) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return B.blocked(*sides(fields(spark, sf)), methods, settings, separator=",")

    return run


def features_of(*names: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = prepared(spark, sf)
        idf = Fe.fit_feature_transformers(df) if any("tfidf" in n for n in names) else None
        pairs = B.chunked_candidates(*sides(Fe.summarised(fields(spark, sf))), fields=Fe.fields_read(names))
        return rounded(Fe.pair_features(pairs, df, idf, names=names).select(*ID, *names), 5 if idf else 6)

    return run


def scored(spark: SparkSession, sf: str) -> DataFrame:
    names = ["name_token_jaccard", "address_token_jaccard"]
    return D.rule_score(Fe.pair_features(looked_up(spark, sf), prepared(spark, sf), None, names=names))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return D.decide(scored(spark, sf), Inference(), THRESHOLD)


def own(spark: SparkSession, sf: str) -> DataFrame:
    return sides(records(spark, sf))[0].select(F.col("entity_id").alias(ID[0]))


def entity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_entity(decided(spark, sf), links(spark, sf), own(spark, sf))


def faulty(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    """Match lists with a repeated, an own, a foreign and an unknown id put into each list that isn't empty. ``pairs``: decided ones, if they are there."""
    m = D.match_lists(sides(records(spark, sf))[0], decided(spark, sf) if pairs is None else pairs)
    return m.select(TRUTH_ID, B.CHUNK, F.when(F.col(TRUTH) != "", F.concat_ws(",", TRUTH, TRUTH, F.lit("S1-0"), F.lit("X-1"), F.lit("S2-none"))).otherwise("").alias(TRUTH))


def check_subset(spark: SparkSession, sf: str) -> DataFrame:
    pairs = decided(spark, sf)
    return O.not_candidates(faulty(spark, sf, pairs), D.candidate_lists(sides(records(spark, sf))[0], pairs))


def check(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    """f: of the faulty lists, reference records and candidate records."""
    return lambda spark, sf: f(faulty(spark, sf), *sides(records(spark, sf)))


_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
_PLAIN = [f for f in Fe.ALL_FEATURES if "tfidf" not in f and "character" not in f and not f.endswith("_source") and f not in ("address_prefix_similarity", "address_suffix_similarity")]
_NGRAM = Blocking(use_ngrams=True)


def labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["name_token_jaccard", "name_edit_similarity", "address_token_jaccard", "address_edit_similarity", "country_exact"]
    return Fe.pair_features(E.label_pairs(looked_up(spark, sf), links(spark, sf)), prepared(spark, sf), None, names=names).drop(B.CHUNK)


_LABELLED = ["name_token_jaccard", "name_edit_similarity", "address_token_jaccard", "address_edit_similarity", "country_exact"]


def match_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(labelled_features(spark, sf))
    model = M.train(rows, _LABELLED)
    return M.predict_probability(model, rows).select(*ID, "target", F.round("score", 6).alias("score"))


def simple_strategies(column: str) -> dict[str, Column]:
    c = F.col(column)
    return {
        "plain": T.simple_strategy(c, punctuation=False), "no punctuation": T.simple_strategy(c), "sorted words": T.simple_strategy(c, sort_words=True),
        "no suffixes": T.simple_strategy(c, sort_words=True, remove_suffixes=True),
    }


def blocking_ablation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.blocking_ablation(*sides(fields(spark, sf)), written(links(spark, sf))))


def experiment(run: Callable[..., DataFrame]) -> Query:
    """run: of training and validation rows, feature names, and the links and ids of the validation references."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        split = written(E.validation_split(truth(spark, sf)))
        held = written(split.where("is_validation").select(ID[0]))
        rows = written(labelled_features(spark, sf))
        own_links = written(links(spark, sf).join(held, ID[0], "left_semi"))
        return run(rows.join(held, ID[0], "left_anti"), rows.join(held, ID[0], "left_semi"), _LABELLED, own_links, held)

    return query


def queries() -> dict[str, Query]:
    own_columns = lambda *c: lambda s, d: records(s, d).select(*c)
    ref = lambda s, d: sides(records(s, d))[0]
    sources = ["S1", "S2", "S3"]
    return {
        "er_records": own_columns("entity_id", "source", "business_name", "business_address", "country"),
        "normalize_text": of_records(lambda: T.normalize(F.col("text")), "text_normalized"),
        "normalize_name": of_prepared("name_normalized"), "normalize_address": of_prepared("address_normalized"), "normalize_country": of_prepared("country_normalized"),
        "name_tokens": of_prepared("name_tokens"), "tokens_sorted": of_prepared("name_tokens_sorted", "address_tokens_sorted"),
        "numeric_tokens": of_prepared("address_numeric_tokens"), "postal_tokens": of_prepared("address_postal_tokens"), "locality_tokens": of_prepared("address_locality_tokens"),
        "name_ngrams": lambda s, d: prepared(s, d).select("entity_id", F.array_join(F.array_sort(T.ngrams(F.col("name_normalized"), 3)), " ").alias("name_ngrams")),
        "phonetic_keys": lambda s, d: prepared(s, d).select("entity_id", T.phonetic(F.col("name_normalized")).alias("phonetic_key")),
        "prepared_records": of_prepared("name_normalized", "address_normalized", "country_normalized", "name_tokens", "address_tokens", "address_postal_tokens", "address_locality_tokens", "name_missing", "address_missing", "country_missing"),
        "block_exact": block_of("normalized_name_exact"), "block_name_tokens": block_of("name_token", "name_prefix"), "block_address_tokens": block_of("address_token"),
        "block_postal": block_of("postal_token"), "block_locality": block_of("locality_token"), "block_ngrams": block_of("name_ngram", "address_ngram", settings=_NGRAM),
        "block_composite": block_of("country_name", "country_address"),
        "blocking_candidates": lambda s, d: flat(candidates(s, d).drop(B.CHUNK)), "blocking_topk": lambda s, d: flat(candidates(s, d, Blocking(max_candidates=20)).drop(B.CHUNK)),
        "blocking_metrics": lambda s, d: rounded(B.blocking_metrics(candidates(s, d), links(s, d))),
        "blocking_by_method": lambda s, d: rounded(B.recall_by_method(candidates(s, d), links(s, d))),
        "blocking_by_country": lambda s, d: rounded(B.recall_by_country(candidates(s, d), links(s, d), ref(s, d))),
        "missed_links": lambda s, d: B.missed_links(candidates(s, d, Blocking(max_candidates=20)), links(s, d)),
        "candidates_per_reference": lambda s, d: rounded(B.candidates_per_reference(candidates(s, d), ref(s, d))),
        "feat_jaccard": features_of("name_token_jaccard", "address_token_jaccard", "address_locality_overlap", "name_address_similarity"),
        "feat_edit": features_of("name_edit_similarity", "address_edit_similarity"), "feat_prefix_suffix": features_of("name_prefix_similarity", "name_suffix_similarity"),
        "feat_length": features_of("name_length_difference", "address_length_difference", "name_token_count_difference"),
        "feat_exact_flags": features_of("name_exact", "address_exact", "country_exact", "country_compatible", "name_address_exact"),
        "feat_missing": features_of("missing_name", "missing_address", "missing_country"),
        "feat_tfidf_cosine": features_of("name_tfidf_cosine"), "feat_char_similarity": features_of("name_character_similarity", "address_character_similarity"),
        "pair_features": features_of(*_PLAIN),
        "truth_links": lambda s, d: B.truth_links(truth(s, d)), "label_pairs": lambda s, d: E.label_pairs(candidates(s, d), links(s, d)).select(*ID, "target"),
        "split_sizes": lambda s, d: E.split_sizes(E.validation_split(truth(s, d))),
        "per_entity_metrics": lambda s, d: rounded(entity_metrics(s, d)), "macro_metrics": lambda s, d: rounded(E.macro_metrics(entity_metrics(s, d))),
        "singleton_metrics": lambda s, d: rounded(E.singleton_metrics(entity_metrics(s, d))),
        "candidate_recall": lambda s, d: rounded(E.candidate_recall(candidates(s, d), links(s, d))),
        "threshold_sweep": lambda s, d: rounded(E.threshold_sweep(scored(s, d), links(s, d), own(s, d))),
        "decided_pairs": lambda s, d: decided(s, d).select(*ID, "score", "predicted_match"),
        "match_lists": lambda s, d: D.match_lists(ref(s, d), decided(s, d)).drop(B.CHUNK), "candidate_lists": lambda s, d: D.candidate_lists(ref(s, d), candidates(s, d)).drop(B.CHUNK),
        "check_duplicates": check(lambda f, r, c: O.repeated_ids(f, TRUTH)), "check_unknown_ids": check(lambda f, r, c: O.unknown_ids(f, TRUTH, c)),
        "check_prefix": check(lambda f, r, c: O.bad_prefixes(f, TRUTH)), "check_coverage": check(lambda f, r, c: O.missing_rows(c.select("entity_id").unionByName(r.select("entity_id")), f)),
        "check_subset": check_subset,
        "profile_columns": lambda s, d: P.profile_columns(records(s, d), _COLUMNS), "profile_lengths": lambda s, d: rounded(P.profile_lengths(records(s, d), _COLUMNS[1:3])),
        "table_dimensions": lambda s, d: P.dimensions(records(s, d)), "duplicate_rows": lambda s, d: P.duplicate_rows(records(s, d).select("business_name", "business_address", "country")),
        "country_counts": lambda s, d: P.country_counts(records(s, d)), "pattern_counts": lambda s, d: P.pattern_counts(records(s, d), _COLUMNS[1:3]),
        "match_histogram": lambda s, d: P.match_histogram(truth(s, d)), "overlap_patterns": lambda s, d: rounded(P.overlap_patterns(truth(s, d))),
        "country_pivot": lambda s, d: P.country_pivot(records(s, d), sources), "length_histogram": lambda s, d: rounded(P.length_histogram(records(s, d), "business_name")),
        "normalization_collisions": lambda s, d: rounded(P.normalization_collisions(records(s, d), "business_name", simple_strategies("business_name"))),
        "name_overlap": lambda s, d: P.name_overlap(prepared(s, d), "name_normalized", sources),
        "variations": lambda s, d: P.variations(prepared(s, d), "business_name", "name_normalized"),
        "feature_summary": lambda s, d: rounded(Fe.feature_summary(labelled_features(s, d), _LABELLED)),
        "feature_spearman": lambda s, d: rounded(Fe.correlated(labelled_features(s, d), _LABELLED, 0.0)), "match_scores": match_scores,
        "strategy_comparison": lambda s, d: rounded(P.strategy_comparison(records(s, d), {c: simple_strategies(c) for c in _COLUMNS[1:]})),
        "strategy_summary": lambda s, d: rounded(P.strategy_summary(P.strategy_comparison(records(s, d), {c: simple_strategies(c) for c in _COLUMNS[1:]}))),
        "singletons_with_candidates": lambda s, d: B.singletons_with_candidates(candidates(s, d), links(s, d), ref(s, d)),
        "blocking_ablation": blocking_ablation, "feature_ablation": experiment(X.feature_ablation),
        "experiment_table": experiment(lambda *a: X.experiment_table(*a, kinds=COMPARED).drop("seconds")),
    }


_TFIDF = f"""with {S.pairs()}, {S.JOINED},
texts as (select distinct name_normalized as t from prep), n as (select count(*) as n from texts),
g as (select t, unnest(list_concat({", ".join(f"list_transform(range(1, greatest(length(t) - {k - 1}, 0) + 1), lambda i: substr(t, i, {k}))" for k in range(2, 6))})) as g from texts),
tf as (select t, g, count(*) as tf from g group by all), df as (select g, count(*) as df, sum(tf) as total from tf group by 1 order by total desc, g limit {Features().max_ngrams}),
w as (select t, tf.g, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from tf join df on tf.g = df.g cross join n),
v as (select t, g, w / sqrt(sum(w * w) over (partition by t)) as w from w),
d as (select distinct l_name_normalized as a, r_name_normalized as b from looked),
c as (select a, b, sum(x.w * y.w) as dot from d join v x on x.t = a join v y on y.t = b and x.g = y.g group by all)
select {S.ID}, round(coalesce(dot, 0), 5) as name_tfidf_cosine from looked left join c on a = l_name_normalized and b = r_name_normalized"""


def oracle_sql() -> dict[str, str]:
    prep = lambda cols: f"with {S.PREPARED} select entity_id, {cols} from prep"
    text = lambda c: f"array_to_string({c}, ' ') as {c}"
    pair = "reference_source, reference_entity_id, candidate_source, candidate_entity_id, blocking_methods"
    block = lambda *m: f"with {S.pairs(m, None)} select {pair} from pairs"
    cand = f"with {S.pairs()}"
    truth = f"with {S.RECORDS}, {S.LINKS}"
    per_truth = f"{truth}, k as (select r.entity_id, count(l.candidate_entity_id) as n, count(*) filter (l.candidate_entity_id like 'S2-%') as s2, count(*) filter (l.candidate_entity_id like 'S3-%') as s3 from rec r left join links l on l.reference_entity_id = r.entity_id where r.source = 'S1' group by 1)"
    ent = f"with {S.per_entity(THRESHOLD)}"
    dec = f"with {S.decided(THRESHOLD)}"
    lists = f"{dec}, m as (select o.reference_entity_id as {TRUTH_ID}, coalesce(string_agg(distinct d.candidate_entity_id, ',' order by d.candidate_entity_id), '') as {TRUTH} from own o left join decided d on d.reference_entity_id = o.reference_entity_id and d.predicted_match group by 1)"
    bad = f"{lists}, f as (select {TRUTH_ID} as id, case when {TRUTH} <> '' then concat_ws(',', {TRUTH}, {TRUTH}, 'S1-0', 'X-1', 'S2-none') else '' end as ids from m), x as (select id, unnest(list_filter(string_split(ids, ','), lambda t: t <> '')) as t from f)"
    feats = lambda *n: S.features(list(n))
    per_column = lambda cols, row: " union all ".join(row(c) for c in cols)
    toks = r"len(regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{N}}_]+'))"
    strategies = {"plain": (False, False, False), "no punctuation": (True, False, False), "sorted words": (True, True, False), "no suffixes": (True, True, True)}

    def strategy(name: str, punct: bool, sort: bool, drop: bool, c: str = "business_name") -> str:
        x = S.norm(c) if punct else S.norm(c).replace(r"regexp_replace(lower(", "(lower(", 1).replace(r", '[^\w\s]', ' ', 'g')", ")", 1)
        w = S.words(x)
        if drop:
            w = f"list_filter({w}, lambda t: not list_contains({S._LIST(S.LEGAL_SUFFIXES)}, t))"
        return f"select source, '{c}' as column_name, '{name}' as strategy, coalesce({c}, '') as raw, array_to_string({f'list_sort({w})' if sort else w}, ' ') as norm from rec"

    collisions = " union all ".join(strategy(k, *v) for k, v in strategies.items())
    compared = " union all ".join(strategy(k, *v, c) for c in _COLUMNS[1:] for k, v in strategies.items())
    key = "source, column_name, strategy"
    compared = f"""with {S.RECORDS}, s as ({compared}), u as (select {key}, norm, count(distinct raw) as n from s group by all),
comparison as (select {key}, sum(n)::bigint as raw_unique, count(*) as normalized_unique, (count(*) - sum(n))::bigint as unique_change,
    count(*) filter (n > 1) as collision_groups, count(*) filter (n > 1) / count(*)::double as collision_rate from u group by all)"""
    summary = " union all ".join(
        f"select '{f}' as feature, min({f}) as minimum, max({f}) as maximum, round(avg({f}), 6) as mean, 0::bigint as nulls, 0::bigint as infinities, round(avg({f}) filter (target = 1), 6) as mean_positive, round(avg({f}) filter (target = 0), 6) as mean_negative, round(avg({f}) filter (target = 1) - avg({f}) filter (target = 0), 6) as difference from q"
        for f in _LABELLED
    )
    found = {
        "er_records": f"with {S.RECORDS} select entity_id, source, business_name, business_address, country from rec",
        "normalize_text": f"with {S.RECORDS} select entity_id, {S.norm('text')} as text_normalized from rec",
        "normalize_name": prep("name_normalized"), "normalize_address": prep("address_normalized"), "normalize_country": prep("country_normalized"),
        "name_tokens": prep(text("name_tokens")),
        "tokens_sorted": prep("array_to_string(list_sort(name_tokens), ' ') as name_tokens_sorted, array_to_string(list_sort(address_tokens), ' ') as address_tokens_sorted"),
        "numeric_tokens": prep(text("address_numeric_tokens")), "postal_tokens": prep(text("address_postal_tokens")), "locality_tokens": prep(text("address_locality_tokens")),
        "name_ngrams": prep(f"array_to_string(list_sort({S.grams('name_normalized')}), ' ') as name_ngrams"),
        "prepared_records": prep(f"name_normalized, address_normalized, country_normalized, {text('name_tokens')}, {text('address_tokens')}, {text('address_postal_tokens')}, {text('address_locality_tokens')}, name_normalized = '' as name_missing, address_normalized = '' as address_missing, country_normalized = '' as country_missing"),
        "block_exact": block("normalized_name_exact"), "block_name_tokens": block("name_token", "name_prefix"), "block_address_tokens": block("address_token"),
        "block_postal": block("postal_token"), "block_locality": block("locality_token"), "block_ngrams": block("name_ngram", "address_ngram"), "block_composite": block("country_name", "country_address"),
        "blocking_candidates": f"{cand} select {pair} from pairs", "blocking_topk": f"with {S.pairs(most=20)} select {pair} from pairs",
        "blocking_metrics": f"{cand}, {S.LINKS}, h as (select count(*) as t, count(p.candidate_entity_id) as h, count(distinct l.reference_entity_id) as r from links l left join pairs p using ({S.ID})), v as (select count(*) as n, count(distinct candidate_entity_id) as u from pairs) select round(coalesce(h / nullif(t, 0)::double, 1), 6) as candidate_recall, n::double as number_of_candidates, round(n / greatest(1, r)::double, 6) as average_candidates_per_reference, round(coalesce(1 - n / nullif(greatest(1, r) * u, 0)::double, 0), 6) as candidate_reduction_ratio from h cross join v",
        "blocking_by_method": f"{cand}, {S.LINKS}, m as (select {S.ID}, unnest(string_split(blocking_methods, ',')) as method from pairs) select method, count(l.candidate_entity_id) as hits, round(coalesce(count(l.candidate_entity_id) / nullif((select count(*) from links), 0)::double, 1), 6) as recall from m left join links l using ({S.ID}) group by 1",
        "blocking_by_country": f"{cand}, {S.LINKS} select r.country, count(*) as links, count(p.candidate_entity_id) as hits, round(count(p.candidate_entity_id) / count(*)::double, 6) as recall from links l join rec r on r.entity_id = l.reference_entity_id left join pairs p on p.reference_entity_id = l.reference_entity_id and p.candidate_entity_id = l.candidate_entity_id group by 1",
        "missed_links": f"with {S.pairs(most=20)}, {S.LINKS} select * from links where ({S.ID}) not in (select ({S.ID}) from pairs)",
        "candidates_per_reference": f"{cand}, {S.ENTITIES}, k as (select o.reference_entity_id, count(distinct candidate_entity_id) as n from own o left join pairs using (reference_entity_id) group by 1) select count(*) filter (n > 0) as references_with_candidates, round(avg(n), 6) as mean_candidates, median(n)::double as median_candidates, max(n) as max_candidates from k",
        "feat_jaccard": feats("name_token_jaccard", "address_token_jaccard", "address_locality_overlap", "name_address_similarity"), "feat_edit": feats("name_edit_similarity", "address_edit_similarity"),
        "feat_prefix_suffix": feats("name_prefix_similarity", "name_suffix_similarity"), "feat_length": feats("name_length_difference", "address_length_difference", "name_token_count_difference"),
        "feat_exact_flags": feats("name_exact", "address_exact", "country_exact", "country_compatible", "name_address_exact"), "feat_missing": feats("missing_name", "missing_address", "missing_country"),
        "feat_tfidf_cosine": _TFIDF, "pair_features": feats(*_PLAIN),
        "truth_links": f"{truth} select * from links", "label_pairs": f"{cand}, {S.LINKS} select {S.ID}, (l.reference_entity_id is not null)::int as target from pairs p left join links l using ({S.ID})",
        "split_sizes": f"{per_truth} select n > 0 as has_match, count(*) as entities, greatest(1, round_even(count(*) * 0.2, 0))::bigint as validation_entities from k group by 1",
        "per_entity_metrics": f"{ent} select reference_entity_id, p as predicted_match_count, t as true_match_count, h as true_positive_count, p - h as false_positive_count, t - h as false_negative_count, round(prec, 6) as precision, round(rec_, 6) as recall, round(f05, 6) as f05, single as is_singleton, single_ok as singleton_correct from ent",
        "macro_metrics": f"{ent} select count(*) as entities, round(avg(prec), 6) as macro_precision, round(avg(rec_), 6) as macro_recall, round(avg(f05), 6) as macro_f05, round(coalesce(sum(p - h) / nullif(sum(p), 0)::double, 0), 6) as false_merge_rate, round(coalesce(sum(single_ok::int) / nullif(sum(single::int), 0)::double, 1), 6) as singleton_accuracy from ent",
        "singleton_metrics": f"{ent} select count(*) as singletons, count(*) filter (single_ok) as correct, round(coalesce(count(*) filter (single_ok) / nullif(count(*), 0)::double, 1), 6) as singleton_accuracy from ent where single",
        "candidate_recall": f"{cand}, {S.LINKS} select round(coalesce(count(p.candidate_entity_id) / nullif(count(*), 0)::double, 1), 6) as candidate_recall from links l left join pairs p using ({S.ID})",
        "threshold_sweep": S.sweep(), "decided_pairs": f"{dec} select {S.ID}, score, predicted_match from decided", "match_lists": f"{lists} select * from m",
        "candidate_lists": f"{cand}, {S.ENTITIES} select o.reference_entity_id as {TRUTH_ID}, coalesce(string_agg(distinct p.candidate_entity_id, ',' order by p.candidate_entity_id), '') as candidate_entity_ids from own o left join pairs p using (reference_entity_id) group by 1",
        "check_duplicates": f"{bad} select 'repeated id' as rule, id as reference_entity_id, ids as detail from f where ids <> ''",
        "check_unknown_ids": f"{bad} select 'unknown id' as rule, id as reference_entity_id, t as detail from x where t not in (select entity_id from rec where source <> 'S1')",
        "check_prefix": f"{bad} select case when t like 'S1-%' then 'self match' else 'bad prefix' end as rule, id as reference_entity_id, t as detail from x where not (t like 'S2-%' or t like 'S3-%')",
        "check_coverage": f"{bad} select 'missing reference' as rule, entity_id as reference_entity_id, '' as detail from rec where entity_id not in (select id from f)",
        "check_subset": f"{bad} select 'not a candidate' as rule, id as reference_entity_id, t as detail from x where (id, t) not in (select (reference_entity_id, candidate_entity_id) from pairs)",
        "profile_columns": f"with {S.RECORDS} " + per_column(_COLUMNS, lambda c: f"select '{c}' as column_name, count(*) as row_count, count(*) filter ({c} is null) as null_count, count(*) filter ({c} = '') as empty_count, count(distinct {c}) + max(({c} is null)::int) as distinct_count, count(*) - count(distinct {c}) - max(({c} is null)::int) as duplicate_count from rec"),
        "profile_lengths": f"with {S.RECORDS} " + per_column(_COLUMNS[1:3], lambda c: f"select '{c}' as column_name, round(avg(length({c})), 6) as mean_length, median(length({c}))::double as median_length, round(quantile_cont(length({c}), 0.95), 6) as p95_length, round(avg({toks.format(c=c)}), 6) as mean_tokens, median({toks.format(c=c)})::double as median_tokens from rec"),
        "table_dimensions": f"with {S.RECORDS} select count(*) as row_count, 6 as column_count from rec",
        "duplicate_rows": f"with {S.RECORDS} select (count(*) - count(distinct (business_name, business_address, country)))::bigint as duplicate_rows from rec",
        "country_counts": f"with {S.RECORDS} select source, country, count(*) as records from rec group by all",
        "pattern_counts": f"with {S.RECORDS} " + per_column(_COLUMNS[1:3], lambda c: rf"select '{c}' as column_name, count(*) filter ({c} = '') as empty_values, count(*) filter (regexp_matches({c}, '[^\x00-\x7F]')) as non_ascii_values, count(*) filter (regexp_matches({c}, '[!-/:-@\[-`{{-~]')) as punctuated_values from rec"),
        "match_histogram": f"{per_truth} select n::int as match_count, count(*) as entities from k group by 1",
        "overlap_patterns": f"{per_truth} select case when s2 > 0 and s3 > 0 then 'both' when s2 > 0 then 's2 only' when s3 > 0 then 's3 only' else 'zero' end as pattern, count(*) as entities, round(count(*) / (select count(*) from k)::double, 6) as share from k group by 1",
        "country_pivot": f"with {S.RECORDS} select country, " + ", ".join(f"count(*) filter (source = '{s}') as \"{s}\"" for s in ("S1", "S2", "S3")) + " from rec group by 1",
        "length_histogram": f"with {S.RECORDS}, l as (select length(business_name) as n from rec), e as (select min(n) as lo, greatest((max(n) - min(n)) / 30.0::double, 1e-9) as w from l), b as (select least(floor((n - lo) / w), 29)::int as bin, lo, w from l cross join e) select bin, round(lo + bin * w, 6) as lowest, count(*) as values from b group by all",
        "normalization_collisions": f"with {S.RECORDS}, s as ({collisions}), k as (select strategy, norm, count(distinct raw) as n from s group by all) select strategy, (select count(distinct business_name) from rec) as unique_raw, count(*) as unique_normalized, count(*) filter (n > 1) as collision_groups, round(coalesce(count(*) filter (n > 1) / nullif(count(*), 0)::double, 0), 6) as collision_rate from k group by 1",
        "name_overlap": f"with {S.PREPARED} " + " union all ".join(f"select '{a}' as left_source, '{b}' as right_source, (select count(*) from (select name_normalized from prep where source = '{a}' intersect select name_normalized from prep where source = '{b}')) as shared_values" for a, b in (("S1", "S2"), ("S1", "S3"), ("S2", "S3"))),
        "variations": f"with {S.PREPARED} select distinct business_name, name_normalized from prep where business_name <> name_normalized order by encode(business_name), name_normalized limit 20",
        "feature_summary": f"{cand}, {S.JOINED}, {S.LINKS}, q as (select {', '.join(f'{S.FEATURES[f]} as {f}' for f in _LABELLED)}, (l.reference_entity_id is not null)::int as target from looked p left join links l using ({S.ID})) {summary}",
        "strategy_comparison": f"{compared} select * replace (round(collision_rate, 6) as collision_rate) from comparison",
        "strategy_summary": f"{compared} select strategy, round(avg(unique_change), 6) as unique_change, round(avg(collision_rate), 6) as collision_rate, sum(collision_groups)::bigint as collision_groups from comparison group by 1",
        "singletons_with_candidates": f"{cand}, {S.LINKS}, {S.ENTITIES}, alone as (select * from own where reference_entity_id not in (select reference_entity_id from links)) select (select count(*) from alone) as singletons, (select count(*) from alone where reference_entity_id in (select reference_entity_id from pairs)) as singletons_with_candidates",
    }
    return found


HEADLINE = (
    "prepared_records", "blocking_candidates", "blocking_topk", "blocking_metrics", "feat_jaccard", "macro_metrics", "threshold_sweep", "match_lists",
    "profile_columns", "normalization_collisions",
)
