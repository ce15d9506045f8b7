"""Column expressions that normalise and tokenise names and addresses.

Token sets are arrays; ``spaced`` gives their text form. Only Unicode decomposition of non-ASCII values leaves the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.config import ADDRESS_SHORT_FORMS, Normalization

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}]+"


def decomposed(form: str):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return F.pandas_udf(run, T.StringType())


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def words(c: Column) -> Column:
    """The parts between single spaces; none of an empty text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def spaced(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _replaced(c: Column, forms: dict[str, str]) -> Column:
    if not forms:
        return c
    table = F.create_map(*[F.lit(x) for kv in sorted(forms.items()) for x in kv])
    return spaced(F.transform(words(c), lambda t: F.coalesce(F.try_element_at(table, t), t)))


def normalize(c: Column, config: Normalization = Normalization(), field: str = "generic") -> Column:
    """Decompose, drop what isn't ASCII, spell out &, lower the case, turn punctuation into spaces, shorten words."""
    x = text_of(c)
    other = x.rlike(r"[^\x00-\x7F]")
    x = F.when(other, decomposed(config.unicode_form)(F.when(other, x))).otherwise(x)
    if config.transliterate_ascii:
        x = F.regexp_replace(x, r"[^\x00-\x7F]", "")
    if config.normalize_ampersand:
        x = F.replace(x, F.lit("&"), F.lit(" and "))
    if config.lowercase:
        x = F.lower(x) if config.transliterate_ascii else F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    if config.strip_punctuation:
        x = F.regexp_replace(x, r"(?U)[^\w\s]", " ")
    x = clean_whitespace(x)
    if config.short_forms and field in ("name", "address"):
        own = config.name_short_forms if field == "name" else config.address_short_forms
        forms = {k.lower(): v.lower() for k, v in own.items()}
        x = _replaced(x, (ADDRESS_SHORT_FORMS if field == "address" else {}) | forms)
    return x


def normalize_name(c: Column, config: Normalization = Normalization()) -> Column:
    x = normalize(c, config, "name")
    if not config.remove_legal_suffixes:
        return x
    suffixes = F.array(*[F.lit(s) for s in config.legal_suffixes])
    return spaced(F.filter(words(x), lambda t: ~F.array_contains(suffixes, t)))


def normalize_address(c: Column, config: Normalization = Normalization()) -> Column:
    return normalize(c, config, "address")


def normalize_country(c: Column, config: Normalization = Normalization()) -> Column:
    return normalize(c, config, "country")


def word_tokens(c: Column) -> Column:
    """All runs of letters, digits and underscores."""
    return F.regexp_extract_all(text_of(c), F.lit(r"(?U)\w+"), 0)


def tokens(c: Column, sort: bool = False) -> Column:
    """Distinct tokens as first met, or by code point."""
    found = F.array_distinct(word_tokens(F.lower(text_of(c))))
    return F.array_sort(found) if sort else found


def numeric_tokens(c: Column) -> Column:
    """Tokens with a digit; repeats stay."""
    return F.filter(word_tokens(c), lambda t: t.rlike(r"(?U)\d"))


def postal_tokens(c: Column) -> Column:
    """Distinct whole runs of four to six digits."""
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(r"(?<!\d)\d{4,6}(?!\d)"), 0))


def locality_parts(raw: Column) -> Column:
    """The last two of three or more comma-separated parts of an address, else the last one, as one text."""
    parts = F.filter(F.transform(F.split(text_of(raw), ","), clean_whitespace), lambda p: p != "")
    return F.array_join(F.when(F.size(parts) >= 3, F.slice(parts, -2, 2)).when(F.size(parts) > 0, F.slice(parts, -1, 1)).otherwise(parts), " , ")


def locality_tokens(raw: Column, config: Normalization = Normalization()) -> Column:
    return tokens(normalize_address(locality_parts(raw), config), sort=True)


def ngrams(c: Column, size: int) -> Column:
    """Distinct character n-grams without white space; a text no longer than ``size`` is its own."""
    x = F.regexp_replace(text_of(c), _SPACE, "")
    n = F.length(x)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(x)).otherwise(F.array_distinct(grams))


# Digits of the phonetic code.
_CODES = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def phonetic(c: Column) -> Column:
    """A four-character sound code over all letters; every uncoded letter, H and W too, ends a run of equal codes."""
    letters = F.regexp_replace(F.upper(text_of(c)), r"(?U)[^\p{L}]", "")
    coded = F.translate(letters, "".join(_CODES), "".join(v * len(k) for k, v in _CODES.items()))
    coded = F.regexp_replace(coded, r"[^1-6]", "0")
    # the first letter stands for itself; a code counts where it differs from the one before
    later = F.regexp_replace(F.regexp_replace(coded, r"([1-6])\1+", "$1"), "^[0-6]", "")
    return F.when(letters == "", "").otherwise(F.substr(F.concat(F.left(letters, F.lit(1)), F.replace(later, F.lit("0"), F.lit("")), F.lit("000")), F.lit(1), F.lit(4)))


def simple_strategy(c: Column, punctuation: bool = True, sort_words: bool = False, remove_suffixes: bool = False) -> Column:
    """The normaliser of strategy comparisons, by flags."""
    x = normalize(c, Normalization(strip_punctuation=punctuation, short_forms=False))
    kept = words(x)
    if remove_suffixes:
        suffixes = F.array(*[F.lit(s) for s in Normalization().legal_suffixes])
        kept = F.filter(kept, lambda t: ~F.array_contains(suffixes, t))
    return spaced(F.array_sort(kept) if sort_words else kept)
