"""Delimited and Parquet tables of records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import Config, Schema


class DataLoadingError(ValueError):
    """An input that is missing, empty or malformed."""


def check_columns(columns: Sequence[str], required: Sequence[str], table: str = "table") -> None:
    """Raise for no columns, blank or repeated names, or a required one that is missing."""
    faults = []
    if not columns:
        faults.append("no columns")
    if any(not c.strip() for c in columns):
        faults.append("a blank column name")
    if repeated := sorted({c for c in columns if list(columns).count(c) > 1}):
        faults.append(f"repeated columns {repeated}")
    if missing := sorted(set(required) - set(columns)):
        faults.append(f"missing columns {missing}")
    if faults:
        raise DataLoadingError(f"{table}: {'; '.join(faults)}")


def files_matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath()) for s in found or [])


def load_table(spark: SparkSession, path: str, required: Sequence[str] = (), separator: str = "\t", table: str | None = None) -> DataFrame:
    """A delimited file as strings. Empty fields are empty texts, not nulls; a row of another length is an error."""
    table = table or path
    if not files_matching(spark, path):
        raise DataLoadingError(f"{table}: no such file")
    head = spark.read.text(path).head(2)
    if not head:
        raise DataLoadingError(f"{table}: empty")
    names = [n.strip('"') for n in head[0][0].lstrip("﻿").split(separator)]
    check_columns(names, required, table)
    if len(head) < 2:
        raise DataLoadingError(f"{table}: no rows")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(sep=separator, header=True, mode="FAILFAST", quote='"', escape='"', enforceSchema=False).schema(schema).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def load_source(spark: SparkSession, path: str, source: str, schema: Schema = Schema(), separator: str = "\t") -> DataFrame:
    """Entity records of one source, with the columns source and row_index (increasing in file order)."""
    df = load_table(spark, path, schema.required, separator, source)
    return df.withColumns({"source": F.lit(source), "row_index": F.monotonically_increasing_id()})


def load_sources(spark: SparkSession, paths: Mapping[str, str], schema: Schema = Schema(), separator: str = "\t") -> DataFrame:
    """All sources as one table."""
    out = None
    for name, path in paths.items():
        df = load_source(spark, path, name, schema, separator)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise DataLoadingError("no sources")
    return out


def load_split(spark: SparkSession, config: Config, split: str) -> DataFrame:
    paths = {s: f"{config.dataset.root}/{split}/{split}_{s}.tsv" for s in config.dataset.sources}
    return load_sources(spark, paths, config.schema, config.dataset.separator)


def load_ground_truth(spark: SparkSession, config: Config) -> DataFrame:
    path = f"{config.dataset.root}/train/{config.dataset.ground_truth}"
    return load_table(spark, path, (config.schema.truth_id, config.schema.truth_matches), config.dataset.separator, "ground truth")


def records_from_documents(docs: DataFrame) -> DataFrame:
    """Three sources of records out of a table of documents: first sentence as name, second line as address."""
    k = 1 + F.try_to_number(F.expr("substr(source, 4)"), F.lit("999")).cast("int") % 3
    source = F.concat(F.lit("S"), k.cast("string"))
    part: Column = F.substr(F.split_part("text", F.lit("."), F.lit(1)), F.lit(1), F.lit(60))
    line: Column = F.substr(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit(1), F.lit(80))
    return docs.select(
        F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"),
        part.alias("business_name"), line.alias("business_address"), F.col("lang").alias("country"), F.col("text"),
    )


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file of this text, in place of one that is there."""
    p, fs = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def write_delimited(df: DataFrame, path: str, separator: str = "\t") -> str:
    """The file ``path`` with a header, rows in their order, quoted only where needed; returns ``path``.

    Tasks write the parts side by side; the driver's JVM then joins their bytes one buffer at a time, so that no task
    holds all rows. The file is moved to its name when it is whole; one that is there is replaced.
    """
    spark = df.sparkSession
    parts, whole = f"{path}.parts", f"{path}.whole"
    df.write.mode("overwrite").options(sep=separator, header=False, emptyValue="", quote='"', escape='"', lineSep="\n").csv(parts)
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in (separator, '"', "\n")) else c
    target, fs = _file_system(spark, path)
    temporary, _ = _file_system(spark, whole)
    out = fs.create(temporary, True)
    try:
        out.write(bytearray((separator.join(map(quoted, df.columns)) + "\n").encode()))
        for part in files_matching(spark, f"{parts}/part-*.csv"):
            source = fs.open(spark._jvm.org.apache.hadoop.fs.Path(part))
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(temporary, target)
    fs.delete(_file_system(spark, parts)[0], True)
    return path
