"""A stand-alone check of two written list files, which reports all findings instead of stopping at one."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Schema
from lodestar.operators import outputs as O
from lodestar.sources.tables import files_matching

EXAMPLES = 5


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def add(self, findings: DataFrame, where: str, warn: bool = False) -> None:
        """One line per rule: how often it was broken, and the first examples by text."""
        text = F.trim(F.concat_ws(" ", "reference_entity_id", "detail"))
        rows = findings.withColumn("x", text).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("x")), 1, EXAMPLES).alias("first"))
        for r in rows.orderBy("rule").collect():
            (self.warnings if warn else self.errors).append(f"{where}: {r.rule}: {r.n} (e.g. {', '.join(r['first'])})")


def read_lists(spark: SparkSession, path: str, columns: tuple[str, str], report: Report) -> DataFrame | None:
    """The rows of a two-column file; faults of its header and lines go to the report. Of repeated ids the last row counts."""
    if not files_matching(spark, path):
        report.errors.append(f"{path}: missing")
        return None
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    first = lines.orderBy("n").head()
    if first is None:
        report.errors.append(f"{path}: empty")
        return None
    head = [h.strip().lower() for h in first.value.lstrip("﻿").split("\t")]
    if head != list(columns):
        hint = " (comma-separated?)" if len(head) == 1 and "," in head[0] else ""
        report.errors.append(f"{path}: the header is not {' <tab> '.join(columns)}{hint}")
        return None
    rows = lines.where((F.col("n") != first.n) & (F.trim("value") != ""))
    bad = rows.where(~F.contains("value", F.lit("\t")))
    report.add(bad.select(F.lit("row without a tab").alias("rule"), F.col("value").alias("reference_entity_id"), F.lit("").alias("detail")), path)
    parts = F.split("value", "\t")
    good = rows.where(F.contains("value", F.lit("\t"))).select(F.trim(parts[0]).alias(columns[0]), F.trim(parts[1]).alias(columns[1]), "n")
    report.add(O.repeated_rows(good, Schema(truth_id=columns[0])), path)
    return good.groupBy(columns[0]).agg(F.max_by(columns[1], "n").alias(columns[1]))


def validate(spark: SparkSession, reference: str, matches: str, candidates: str, universe: list[str] | None = None, schema: Schema = Schema()) -> Report:
    """``reference`` and ``universe``: delimited files whose first column is the id; ``universe`` turns on the check of ids."""
    report = Report()

    def ids(path: str) -> DataFrame:
        lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
        rows = lines.where(F.col("n") > 0).select(F.trim(F.split("value", "\t")[0]).alias(schema.entity_id))
        return rows.where(F.col(schema.entity_id) != "").distinct()

    own = ids(reference)
    known = None
    for path in universe or []:
        known = ids(path) if known is None else known.unionByName(ids(path))
    lists = {}
    for path, column in ((matches, schema.truth_matches), (candidates, schema.candidates)):
        df = lists[column] = read_lists(spark, path, (schema.truth_id, column), report)
        if df is None:
            continue
        for found in (O.missing_rows(own, df, schema), O.repeated_ids(df, column, schema), O.bad_prefixes(df, column, schema=schema)):
            report.add(found, path)
        if known is not None:
            report.add(O.unknown_ids(df, column, known, schema), path)
    if all(df is not None for df in lists.values()):
        report.add(O.not_candidates(lists[schema.truth_matches], lists[schema.candidates], schema), matches, warn=True)
    return report


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("reference", "matches", "candidates"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--check-ids", nargs="*", metavar="FILE")
    a = p.parse_args(args)
    try:
        report = validate(SparkSession.builder.getOrCreate(), a.reference, a.matches, a.candidates, a.check_ids)
    except (OSError, UnicodeDecodeError) as e:
        print(f"ERROR {e}")
        return 1
    for kind, lines in (("WARNING", report.warnings), ("ERROR", report.errors)):
        for line in lines:
            print(kind, line)
    return int(bool(report.errors))


if __name__ == "__main__":
    sys.exit(main())
