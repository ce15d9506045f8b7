"""Similarities of two texts or token sets as column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens of all; 0 for two empty sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats, whose union needn't be made."""
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.lit(1), F.size(a) + F.size(b) - shared)


def overlap(a: Column, b: Column) -> Column:
    return (F.size(F.array_intersect(a, b)) > 0).cast("double")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def prefix_similarity(a: Column, b: Column) -> Column:
    """Length of the shared prefix, of the longer text."""
    most = F.least(F.length(a), F.length(b))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i)))
    return F.when(most == 0, 0.0).otherwise(shared / F.greatest(F.length(a), F.length(b), F.lit(1)))


def suffix_similarity(a: Column, b: Column) -> Column:
    return prefix_similarity(F.reverse(a), F.reverse(b))


def difference(a: Column, b: Column) -> Column:
    """Of two sizes, as a share of the larger one."""
    return F.abs(a - b) / F.greatest(F.lit(1), a, b)


@F.pandas_udf(T.DoubleType())
def _matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def character_similarity(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks, of both lengths. Equal and empty texts don't reach Python."""
    hard = (a != b) & (a != "") & (b != "")
    return F.when(hard, _matching_ratio(F.when(hard, a), F.when(hard, b))).when((a == b) & (a != ""), 1.0).otherwise(0.0)
