"""Small reports as JSON, CSV and Markdown files, on any file system that Spark writes to."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import write_delimited, write_text

#: A Markdown table takes a report's rows through the driver, so a longer table is an error there; CSV has no limit.
MAX_MARKDOWN_ROWS = 10_000


def write_json(spark: SparkSession, path: str, values: Mapping) -> str:
    return write_text(spark, path, json.dumps(values, indent=2, default=str))


def write_csv(df: DataFrame, path: str) -> str:
    return write_delimited(df, path, ",")


def markdown_table(df: DataFrame) -> str:
    """The rows as a Markdown table; nulls are empty, bars and line feeds within values are made harmless."""
    rows = df.take(MAX_MARKDOWN_ROWS + 1)
    if len(rows) > MAX_MARKDOWN_ROWS:
        raise ValueError(f"more than {MAX_MARKDOWN_ROWS} rows; write them as CSV")
    cell = lambda v: "" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def write_markdown(spark: SparkSession, path: str, title: str, notes: Sequence[str] = (), tables: Mapping[str, DataFrame] | None = None) -> str:
    """A title, a list of notes, and a section for each table."""
    parts = [f"# {title}"] + (["\n".join(f"- {n}" for n in notes)] if notes else [])
    parts += [f"## {name}\n\n{markdown_table(df)}" for name, df in (tables or {}).items()]
    return write_text(spark, path, "\n\n".join(parts) + "\n")
