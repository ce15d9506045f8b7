"""Pair features: exact, token, edit and character similarities, and TF-IDF cosines."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Features, Schema
from lodestar.functions import similarity as S
from lodestar.operators.blocking import PAIR

# All features, in their stated order.
ALL_FEATURES = (
    "name_exact", "name_token_jaccard", "name_character_similarity", "name_edit_similarity", "name_tfidf_cosine", "name_token_overlap",
    "name_length_difference", "name_token_count_difference", "name_prefix_similarity", "name_suffix_similarity", "name_order_insensitive_similarity",
    "address_exact", "address_token_jaccard", "address_character_similarity", "address_edit_similarity", "address_tfidf_cosine",
    "address_token_overlap", "address_length_difference", "address_postal_agreement", "address_locality_overlap",
    "country_exact", "country_compatible", "name_address_exact", "name_address_similarity", "reference_source", "candidate_source",
    "missing_name", "missing_address", "missing_country",
)
# What stands for a whole family in the settings, and how its names begin or end.
_FAMILIES = {"name": "^name_", "address": "^address_", "country": "^country_", "combined": "^name_address", "missingness": "^missing_", "source": "_source$"}
#: Pairs have text columns of these names, so the features are columns of others.
_COLUMNS = {"reference_source": "reference_source_code", "candidate_source": "candidate_source_code"}
FIELDS = ("name_normalized", "address_normalized", "country_normalized", "name_tokens", "address_tokens", "address_postal_tokens", "address_locality_tokens")


def _digest(text: Column) -> Column:
    """Half a SHA-256; that of an empty text is empty."""
    return F.when(text == "", F.lit(b"")).otherwise(F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


# Short columns that some features need no more of a record than, and the field that each is made of.
_SUMMARIES = {
    "name_digest": ("name_normalized", _digest), "address_digest": ("address_normalized", _digest),
    "name_length": ("name_normalized", F.length), "address_length": ("address_normalized", F.length), "name_token_count": ("name_tokens", F.size),
}
# What a feature reads of a record, if not both the normalised texts.
_READS = {
    "name_exact": ("name_digest",), "address_exact": ("address_digest",), "name_address_exact": ("name_digest", "address_digest"),
    "country_exact": ("country_normalized",), "country_compatible": ("country_normalized",), "missing_country": ("country_normalized",),
    "name_length_difference": ("name_length",), "address_length_difference": ("address_length",), "name_token_count_difference": ("name_token_count",),
    "missing_name": ("name_length",), "missing_address": ("address_length",), "name_token_jaccard": ("name_tokens",), "name_token_overlap": ("name_tokens",), "name_order_insensitive_similarity": ("name_tokens",),
    "address_token_jaccard": ("address_tokens",), "address_token_overlap": ("address_tokens",), "name_address_similarity": ("name_tokens", "address_tokens"),
    "address_postal_agreement": ("address_postal_tokens",), "address_locality_overlap": ("address_locality_tokens",),
}


def fields_read(names: Sequence[str]) -> list[str]:
    """The columns of ``summarised`` records that these features read. Where a field is read itself, no summary of it is."""
    read = {c for f in names for c in _READS.get(f, ("name_normalized", "address_normalized"))}
    return [c for c in FIELDS if c in read] + [c for c, (field, _) in _SUMMARIES.items() if c in read and field not in read]


def summarised(records: DataFrame) -> DataFrame:
    """Prepared records with the short columns."""
    return records.withColumns({c: of(F.col(field)) for c, (field, of) in _SUMMARIES.items()})


def feature_names(config: Features = Features()) -> list[str]:
    """Names that are enabled themselves or by their family, in their order, then the whole name or address family if any of its names is enabled.

    All names if nothing is enabled, or nothing that is enabled is known.
    """
    def of(family: str) -> list[str]:
        return [f for f in ALL_FEATURES if re.search(_FAMILIES[family], f)]

    asked = {f for e in config.enabled for f in (of(e) if e in _FAMILIES else [e])}
    chosen = [f for f in ALL_FEATURES if f in asked]
    for family in ("name", "address"):
        if any(e.startswith(f"{family}_") for e in config.enabled):
            chosen += of(family)
    return list(dict.fromkeys(chosen)) or list(ALL_FEATURES)


def feature_columns(names: Sequence[str]) -> list[str]:
    """The columns that hold these features."""
    return [_COLUMNS.get(f, f) for f in names]


@dataclass(frozen=True)
class Idf:
    """Fitted n-gram weights of names and addresses: tables (ngram, idf)."""

    name: DataFrame
    address: DataFrame


def character_ngrams(text: DataFrame, config: Features = Features()) -> DataFrame:
    """(text, ngram, tf) of each distinct text, runs of white space taken as one blank."""
    lo, hi = config.ngram_range
    x = F.regexp_replace("text", r"\s\s+", " ")
    of_size = lambda n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = text.select("text", F.explode(F.flatten(F.array(*[of_size(n) for n in range(lo, hi + 1)]))).alias("ngram"))
    return grams.groupBy("text", "ngram").agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(text: DataFrame, config: Features = Features()) -> DataFrame:
    """(ngram, idf) over the distinct values of the only column: ln((1 + n) / (1 + df)) + 1 for the most frequent n-grams."""
    text = text.select(F.coalesce(F.col(text.columns[0]), F.lit("")).alias("text")).distinct()
    n = text.agg(F.count(F.lit(1)).alias("n_texts"))
    by = character_ngrams(text, config).groupBy("ngram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    top = by.orderBy(F.desc("total"), "ngram").limit(config.max_ngrams)
    return top.crossJoin(F.broadcast(n)).select("ngram", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf"))


def fit_feature_transformers(records: DataFrame, config: Features = Features()) -> Idf:
    return Idf(fit_idf(records.select("name_normalized"), config), fit_idf(records.select("address_normalized"), config))


def vectors(text: DataFrame, idf: DataFrame, config: Features = Features()) -> DataFrame:
    """(text, ngram, weight): unit-length TF-IDF vectors; n-grams that weren't fitted are left out."""
    weighed = character_ngrams(text.select(F.col(text.columns[0]).alias("text")).distinct(), config).join(idf, "ngram")
    norms = weighed.groupBy("text").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    return weighed.join(norms, "text").select("text", "ngram", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def tfidf_cosine(pairs: DataFrame, left: str, right: str, idf: DataFrame, out: str, config: Features = Features()) -> DataFrame:
    """Add the cosine of two text columns; computed once for each distinct pair of texts that differ."""
    texts = pairs.select(F.col(left).alias("text")).union(pairs.select(F.col(right).alias("text")))
    v = vectors(texts, idf, config)
    distinct = pairs.where(F.col(left) != F.col(right)).select(F.col(left).alias("a"), F.col(right).alias("b")).distinct()
    a, b = v.select(F.col("text").alias("a"), "ngram", F.col("weight").alias("wa")), v.select(F.col("text").alias("b"), "ngram", F.col("weight").alias("wb"))
    dots = distinct.join(a, "a").join(b, ["b", "ngram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    own = v.groupBy("text").agg(F.sum(F.col("weight") ** 2).alias("self"))
    joined = pairs.join(dots.select(F.col("a").alias(left), F.col("b").alias(right), "dot"), [left, right], "left")
    joined = joined.join(own.select(F.col("text").alias(left), "self"), left, "left")
    value = F.when(F.col(left) == F.col(right), F.coalesce("self", F.lit(0.0))).otherwise(F.coalesce("dot", F.lit(0.0)))
    return joined.withColumn(out, value).drop("dot", "self")


def looked_up(pairs: DataFrame, records: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """Pairs with the fields of both records as l_ and r_ columns; those of an unknown record are empty. Pairs that have them stay as they are."""
    if {f"l_{f}" for f in (*FIELDS, *_SUMMARIES)} & set(pairs.columns):
        return pairs
    base = records.select("source", F.col(schema.entity_id).alias("id"), *FIELDS)
    out = pairs
    for side, (s, i) in (("l", PAIR[:2]), ("r", PAIR[2:])):
        own = base.select(F.col("source").alias(s), F.col("id").alias(i), *[F.col(f).alias(f"{side}_{f}") for f in FIELDS])
        out = out.join(own, [s, i], "left")
    empty = lambda c: F.array().cast("array<string>") if c.endswith("tokens") else F.lit("")
    return out.withColumns({f"{side}_{f}": F.coalesce(f"{side}_{f}", empty(f)) for side in "lr" for f in FIELDS})


def pair_features(
    pairs: DataFrame, records: DataFrame, idf: Idf | None, config: Features = Features(), schema: Schema = Schema(),
    sources: Sequence[str] = (), names: Sequence[str] | None = None,
) -> DataFrame:
    """Pairs with the chosen features as doubles. ``sources``: all source names, whose order gives the source codes."""
    names = feature_columns(feature_names(config) if names is None else names)
    df = looked_up(pairs, records, schema)
    for field in ("name", "address"):
        if f"{field}_tfidf_cosine" in names:
            if idf is None:
                raise ValueError("TF-IDF features need fitted weights")
            df = tfidf_cosine(df, f"l_{field}_normalized", f"r_{field}_normalized", getattr(idf, field), f"{field}_tfidf_cosine", config)
    L = lambda f: F.col(f"l_{f}")
    R = lambda f: F.col(f"r_{f}")
    has = lambda f: f"l_{f}" in df.columns
    digests = {f"{field}_normalized": f"{field}_digest" for field in ("name", "address") if has(f"{field}_digest")}

    def exact(f: str) -> Column:
        d = digests.get(f, f)
        return (L(d) != F.lit(b"" if d != f else "")) & (L(d) == R(d))

    number = lambda c: c.cast("double")
    n, a, c = "name_normalized", "address_normalized", "country_normalized"

    def both(summary: str) -> tuple[Column, Column]:
        field, of = _SUMMARIES[summary]
        return (L(summary), R(summary)) if has(summary) else (of(L(field)), of(R(field)))

    no_text = lambda summary: number(reduce(lambda x, y: (x == 0) | (y == 0), both(summary)))
    name_j, address_j = (S.jaccard_of_sets(L(t), R(t)) for t in ("name_tokens", "address_tokens"))
    order = F.array(*[F.lit(s) for s in sorted(sources)]) if sources else F.array().cast("array<string>")
    code = lambda s: (F.coalesce(F.array_position(order, F.col(s)), F.lit(0)) - 1).cast("double")
    made = {
        "name_exact": number(exact(n)), "name_token_jaccard": name_j, "name_character_similarity": S.character_similarity(L(n), R(n)),
        "name_edit_similarity": S.edit_similarity(L(n), R(n)), "name_token_overlap": S.overlap(L("name_tokens"), R("name_tokens")),
        "name_length_difference": S.difference(*both("name_length")), "name_token_count_difference": number(F.abs(reduce(operator.sub, both("name_token_count")))),
        "name_prefix_similarity": S.prefix_similarity(L(n), R(n)), "name_suffix_similarity": S.suffix_similarity(L(n), R(n)),
        "name_order_insensitive_similarity": name_j,
        "address_exact": number(exact(a)), "address_token_jaccard": address_j, "address_character_similarity": S.character_similarity(L(a), R(a)),
        "address_edit_similarity": S.edit_similarity(L(a), R(a)), "address_token_overlap": S.overlap(L("address_tokens"), R("address_tokens")),
        "address_length_difference": S.difference(*both("address_length")), "address_postal_agreement": S.overlap(L("address_postal_tokens"), R("address_postal_tokens")),
        "address_locality_overlap": S.jaccard_of_sets(L("address_locality_tokens"), R("address_locality_tokens")),
        "country_exact": number(exact(c)), "country_compatible": number((L(c) == "") | (R(c) == "") | (L(c) == R(c))),
        "name_address_exact": number(exact(n) & exact(a)), "name_address_similarity": (name_j + address_j) / 2,
        "reference_source_code": code(PAIR[0]), "candidate_source_code": code(PAIR[2]),
        "missing_name": no_text("name_length"), "missing_address": no_text("address_length"), "missing_country": number((L(c) == "") | (R(c) == "")),
    }
    finite = lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x)
    looked = {f"{side}_{f}" for side in "lr" for f in (*FIELDS, *_SUMMARIES)}
    return df.select(*[c for c in pairs.columns if c not in looked], *[finite((made[f] if f in made else F.col(f)).cast("double")).alias(f) for f in names])


def feature_summary(df: DataFrame, names: Sequence[str], label: str = "target") -> DataFrame:
    """feature, minimum, maximum, mean, nulls, infinities, mean of positives and of negatives, and their difference."""
    def row(f: str) -> DataFrame:
        c = F.col(f)
        pos, neg = F.avg(F.when(F.col(label) == 1, c)), F.avg(F.when(F.col(label) == 0, c))
        return F.struct(
            F.lit(f).alias("feature"), F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("mean"), F.count_if(c.isNull()).alias("nulls"),
            F.count_if(F.abs(c) == float("inf")).alias("infinities"),
            pos.alias("mean_positive"), neg.alias("mean_negative"), (pos - neg).alias("difference"),
        )

    return df.agg(F.array(*[row(f) for f in names]).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def correlated(df: DataFrame, names: Sequence[str], least: float = 0.95) -> DataFrame:
    """Pairs of features whose ranks correlate by at least ``least``: (left, right, correlation)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(VectorAssembler(inputCols=list(names), outputCol="v").transform(df).select("v"), "v", "spearman").first()[0].toArray()
    rows = [(names[i], names[j], float(m[i][j])) for i in range(len(names)) for j in range(i) if abs(m[i][j]) >= least]
    return df.sparkSession.createDataFrame(rows, "left string, right string, correlation double")
