"""Written intermediate tables, and schemas of Arrow functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from lodestar.sources.shared import shared_folder, written

__all__ = ["schema_with", "shared_folder", "written"]


def schema_with(df: DataFrame, columns: Sequence[str], more: str) -> StructType:
    """The fields of ``df`` named in ``columns``, then those of the schema string ``more``."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(more)])
