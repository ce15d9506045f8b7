"""Checks of match and candidate lists as tables of findings: (rule, reference_entity_id, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Config, Schema
from lodestar.functions.text import text_of
from lodestar.operators.blocking import CHUNK
from lodestar.operators.resolve import candidate_lists, match_lists
from lodestar.sources.tables import check_columns, load_table, write_delimited


class SubmissionValidationError(ValueError):
    """Output that breaks a rule; holds the first findings."""


def ids_of(c: str) -> Column:
    return F.filter(F.split(text_of(F.col(c)), ","), lambda x: x != "")


def _finding(rule: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), key.cast("string").alias("reference_entity_id"), detail.cast("string").alias("detail")]


def check_schema(df: DataFrame, expected: Sequence[str]) -> None:
    if list(df.columns) != list(expected):
        raise SubmissionValidationError(f"columns {df.columns}, not {list(expected)}")


def missing_rows(reference: DataFrame, lists: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """Reference ids without a row, and rows of unknown reference ids."""
    key, own = F.col(schema.truth_id), reference.select(F.col(schema.entity_id).alias(schema.truth_id))
    lost = own.join(lists, schema.truth_id, "left_anti").select(*_finding("missing reference", key, F.lit("")))
    extra = lists.join(own, schema.truth_id, "left_anti").select(*_finding("unexpected reference", key, F.lit("")))
    return lost.unionByName(extra)


def repeated_rows(lists: DataFrame, schema: Schema = Schema()) -> DataFrame:
    n = lists.groupBy(schema.truth_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.select(*_finding("repeated reference", F.col(schema.truth_id), F.col("n")))


def repeated_ids(lists: DataFrame, column: str, schema: Schema = Schema()) -> DataFrame:
    """Rows whose list is null or names an id more than once."""
    ids, key = ids_of(column), F.col(schema.truth_id)
    twice = lists.where(F.size(ids) != F.size(F.array_distinct(ids))).select(*_finding("repeated id", key, F.col(column)))
    return twice.unionByName(lists.where(F.col(column).isNull()).select(*_finding("null list", key, F.lit(""))))


def unknown_ids(lists: DataFrame, column: str, candidates: DataFrame, schema: Schema = Schema()) -> DataFrame:
    known = candidates.select(F.col(schema.entity_id).alias("id")).distinct()
    named = lists.select(schema.truth_id, F.explode(ids_of(column)).alias("id"))
    return named.join(known, "id", "left_anti").select(*_finding("unknown id", F.col(schema.truth_id), F.col("id")))


def bad_prefixes(lists: DataFrame, column: str, own: str = "S1-", others: Sequence[str] = ("S2-", "S3-"), schema: Schema = Schema()) -> DataFrame:
    """Listed ids of the reference source itself, or of no candidate source; an empty element between commas is one."""
    parts = F.when(text_of(F.col(column)) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))
    named = lists.select(schema.truth_id, F.explode(parts).alias("id"))
    known = F.lit(False)
    for p in others:
        known = known | F.col("id").startswith(p)
    rule = F.when(F.col("id").startswith(own), "self match").when(~known, "bad prefix")
    return named.withColumn("r", rule).where("r is not null").select(F.col("r").alias("rule"), F.col(schema.truth_id).alias("reference_entity_id"), F.col("id").alias("detail"))


def not_candidates(matches: DataFrame, candidates: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """Matches that aren't among the candidates of their reference record."""
    # lists of the same pairs meet where they lie
    by = [schema.truth_id, *[c for c in (CHUNK,) if c in matches.columns and c in candidates.columns]]
    m = matches.select(*by, ids_of(schema.truth_matches).alias("ids")).where(F.size("ids") > 0)
    # lists meet whole, one row for each reference record; the lists of a repeated one are taken together
    c = candidates.groupBy(*by).agg(F.flatten(F.collect_list(ids_of(schema.candidates))).alias("known"))
    known = F.coalesce("known", F.array().cast("array<string>"))
    odd = m.join(c, by, "left").select(schema.truth_id, "ids", known.alias("known"))
    odd = odd.select(schema.truth_id, F.explode(F.filter("ids", lambda x: ~F.array_contains("known", x))).alias("id"))
    return odd.select(*_finding("not a candidate", F.col(schema.truth_id), F.col("id")))


def out_of_order(reference: DataFrame, lists: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """Rows that follow a row of a later reference record; both tables have row_index."""
    from pyspark.sql import Window

    own = reference.select(F.col(schema.entity_id).alias(schema.truth_id), F.col("row_index").alias("want"))
    # neighbours are taken within blocks of rows, and at block edges, so that no task gets all of them
    rows = lists.join(own, schema.truth_id).withColumn("block", F.floor(F.col("row_index") / 100_000))
    w = Window.partitionBy("block").orderBy("row_index")
    inner = rows.withColumn("before", F.lag("want").over(w))
    edges = rows.groupBy("block").agg(F.max_by("want", "row_index").alias("last"))
    # one row per 100,000; the block before is the last that has rows, as row numbers of several files leave gaps
    edges = edges.select("block", F.lag("last").over(Window.orderBy("block")).alias("last"))
    joined = inner.join(edges, "block", "left").withColumn("before", F.coalesce("before", "last"))
    return joined.where(F.col("before") > F.col("want")).select(*_finding("out of order", F.col(schema.truth_id), F.lit("")))


def all_findings(reference: DataFrame, candidates: DataFrame, matches: DataFrame, pairs: DataFrame, schema: Schema = Schema()) -> DataFrame:
    check_schema(matches, (schema.truth_id, schema.truth_matches))
    check_schema(pairs, (schema.truth_id, schema.candidates))
    found = not_candidates(matches, pairs, schema)
    for lists, column in ((matches, schema.truth_matches), (pairs, schema.candidates)):
        for part in (missing_rows(reference, lists, schema), repeated_rows(lists, schema), repeated_ids(lists, column, schema), unknown_ids(lists, column, candidates, schema)):
            found = found.unionByName(part)
    return found


def check_reference(reference: DataFrame, schema: Schema = Schema()) -> None:
    """Reference ids must be filled and unique."""
    check_columns(reference.columns, [schema.entity_id])
    bad = reference.groupBy(schema.entity_id).count().where((F.col("count") > 1) | (F.coalesce(schema.entity_id, F.lit("")) == "")).take(5)
    if bad:
        raise SubmissionValidationError(f"empty or repeated reference ids: {[r[0] for r in bad]}")


def validate_outputs(reference: DataFrame, candidates: DataFrame, matches: DataFrame, pairs: DataFrame, schema: Schema = Schema()) -> None:
    check_reference(reference, schema)
    if found := all_findings(reference, candidates, matches, pairs, schema).take(5):
        raise SubmissionValidationError("; ".join(f"{r.rule}: {r.reference_entity_id} {r.detail}".strip() for r in found))


def generate_outputs(reference: DataFrame, candidates: DataFrame, pairs: DataFrame, decided: DataFrame, config: Config = Config()) -> dict[str, str]:
    """Build both lists, check them, and write them as one file each; returns the files.

    Where ``reference`` has row_index, the written rows are read again and must be in its order.
    """
    s = config.schema
    matches, listed = match_lists(reference, decided, s), candidate_lists(reference, pairs, s)
    validate_outputs(reference, candidates, matches, listed, s)
    folder = config.output.folder
    files = {name: write_delimited(df, f"{folder}/{name}") for name, df in ((config.output.matches, matches), (config.output.candidates, listed))}
    if "row_index" in reference.columns:
        for path in files.values():
            rows = load_table(reference.sparkSession, path).withColumn("row_index", F.monotonically_increasing_id())
            if late := out_of_order(reference, rows, s).take(5):
                raise SubmissionValidationError(f"{path}: out of order: {[r.reference_entity_id for r in late]}")
    return files
