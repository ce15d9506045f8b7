import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import similarity as S
from lodestar.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def two(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("r")).first().r


@pytest.mark.parametrize("f, value, want", [
    (T.normalize_name, "Café & Sons Pvt. Ltd.", "cafe and sons"), (T.normalize_name, "Ltd", ""), (T.normalize_name, "Private Eye Limited", "eye"),
    (T.normalize_name, "O'Reilly_Co", "o reilly_co"), (T.normalize_name, None, ""), (T.normalize_name, "ﬁne ½", "fine 12"),
    (T.normalize_address, "12 Main Street, Saint Paul", "12 main st st paul"), (T.normalize_country, "Côte d'Ivoire", "cote d ivoire"),
    (T.tokens, "b a b", ["b", "a"]), (lambda c: T.tokens(c, sort=True), "b a b", ["a", "b"]), (T.numeric_tokens, "12b main 12b 7", ["12b", "12b", "7"]),
    (T.postal_tokens, "12 abc 560001 ab1234 12345678 4000 560001", ["560001", "1234", "4000"]),
    (T.locality_tokens, "5 MG Road, Indiranagar, Bangalore", ["bangalore", "indiranagar"]), (T.locality_tokens, "5 MG Road, Bangalore", ["bangalore"]),
    (T.locality_tokens, "", []), (T.locality_tokens, None, []), (T.locality_tokens, " , ,x", ["x"]),
    (lambda c: T.ngrams(c, 3), "ab cd", ["abc", "bcd"]), (lambda c: T.ngrams(c, 3), "ab", ["ab"]), (lambda c: T.ngrams(c, 3), "", []),
    (T.phonetic, "Ashcraft", "A226"), (T.phonetic, "Pfister", "P236"), (T.phonetic, "12", ""), (T.phonetic, "bob bb", "B100"), (T.phonetic, None, ""),
    (lambda c: T.simple_strategy(c, sort_words=True, remove_suffixes=True), "Zed Ltd & Abe", "abe and zed"),
])
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize("f, a, b, want", [
    (S.edit_similarity, "kitten", "sitting", 1 - 3 / 7), (S.edit_similarity, "", "", 0.0), (S.edit_similarity, "", "x", 0.0), (S.edit_similarity, "a", "a", 1.0),
    (S.prefix_similarity, "abcd", "abxde", 0.4), (S.suffix_similarity, "xxcd", "abcd", 0.5), (S.prefix_similarity, "", "a", 0.0),
    (S.length_difference, "ab", "abcd", 0.5), (S.length_difference, "", "", 0.0), (S.character_similarity, "acme foods", "acme food", 18 / 19),
    (S.character_similarity, "", "", 0.0), (S.character_similarity, "x", "x", 1.0), (S.character_similarity, "x", "", 0.0),
])
def test_similarity(spark, f, a, b, want):
    assert two(spark, a, b, f) == pytest.approx(want)


def test_jaccard(spark):
    df = spark.sql("select array() a, array() b union all select array('a', 'b'), array('b', 'c')").select(S.jaccard(F.col("a"), F.col("b")).alias("r"), S.overlap(F.col("a"), F.col("b")).alias("o"))
    assert [(round(r.r, 6), r.o) for r in df.collect()] == [(0.0, 0.0), (0.333333, 1.0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=12), min_size=1, max_size=20))
def test_against_plain_python(spark, values):
    """Normalisation keeps what a step by step version in Python keeps."""
    def plain(x):
        x = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().replace("&", " and ").lower()
        return " ".join("".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in x).split())

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.i: r.n for r in df.select("i", T.normalize(F.col("v")).alias("n")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}
    pairs = df.alias("x").join(df.alias("y"), F.col("x.i") + 1 == F.col("y.i"))
    for r in pairs.select(F.col("x.v").alias("a"), F.col("y.v").alias("b"), S.character_similarity(F.col("x.v"), F.col("y.v")).alias("s")).collect():
        want = 0.0 if not r.a or not r.b else SequenceMatcher(None, r.a, r.b, autojunk=False).ratio()
        assert r.s == pytest.approx(want)
