"""Incremental normalisation of record files as they arrive; everything else in the library works on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import Normalization, Schema
from lodestar.operators.records import prepare


def stream_records(spark: SparkSession, folder: str, source: str, schema: Schema = Schema(), config: Normalization = Normalization(), separator: str = "\t") -> DataFrame:
    """A stream of prepared records from delimited files put into ``folder``. Each row is prepared by itself, without state."""
    fields = T.StructType([T.StructField(c, T.StringType()) for c in schema.required])
    rows = spark.readStream.options(sep=separator, header=True, quote='"', escape='"').schema(fields).csv(folder)
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in schema.required], F.lit(source).alias("source"))
    return prepare(rows, schema, config)
