"""Normalised helper columns of entity records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Normalization, Schema
from lodestar.functions import text as T

HELPERS = (
    "name_normalized", "address_normalized", "country_normalized", "name_tokens", "name_tokens_sorted", "address_tokens",
    "address_tokens_sorted", "address_numeric_tokens", "address_postal_tokens", "address_locality_tokens",
    "name_missing", "address_missing", "country_missing",
)


def is_prepared(df: DataFrame) -> bool:
    return set(HELPERS) <= set(df.columns)


def prepare(df: DataFrame, schema: Schema = Schema(), config: Normalization = Normalization()) -> DataFrame:
    """Add the helper columns (token sets as arrays) once; raw values stay. Missing raw columns are an error."""
    if is_prepared(df):
        return df
    if missing := [c for c in (schema.name, schema.address, schema.country) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = df.withColumns({
        "name_normalized": T.normalize_name(F.col(schema.name), config),
        "address_normalized": T.normalize_address(F.col(schema.address), config),
        "country_normalized": T.normalize_country(F.col(schema.country), config),
        "address_locality_tokens": T.locality_tokens(F.col(schema.address), config),
    })
    name, address = F.col("name_normalized"), F.col("address_normalized")
    df = df.withColumns({
        "name_tokens": T.tokens(name), "name_tokens_sorted": T.tokens(name, sort=True),
        "address_tokens": T.tokens(address), "address_tokens_sorted": T.tokens(address, sort=True),
        "address_numeric_tokens": T.numeric_tokens(address), "address_postal_tokens": T.postal_tokens(address),
        "name_missing": name == "", "address_missing": address == "", "country_missing": F.col("country_normalized") == "",
    })
    return df.select(*[c for c in df.columns if c not in HELPERS], *HELPERS)


def check_prepared(df: DataFrame, helpers: bool = True) -> DataFrame:
    need = HELPERS if helpers else HELPERS[:3]
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"missing helper columns: {missing}")
    return df
