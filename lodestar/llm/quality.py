"""Document quality rules whose cutoffs come from quantile sketches per language and source.

Everything here is made of DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A group of fewer passing documents than this takes the cutoffs of its language, or of all documents.
MIN_GROUP = 30
SKETCH_ACCURACY = 10_000
#: Rows of the table of cutoffs up to which every task is sent a copy; a larger one is joined by shuffling.
BROADCAST_GROUPS = 50_000
#: A cutoff lies this many times as far beyond a group's trusted quantile as that lies from the group's median.
FENCE = 3.0
#: Standard errors: of the trusted quantile's rank in a group, and of what a document counts.
RANK_ERRORS = 1.0
COUNT_ERRORS = 3.1
#: signal: (what is counted, of how many, trusted share as a fraction of a power of two, step of the ranks above it,
#: whether few are a fault as well). Junk comes by the dozen, so of symbols and word lengths an eighth isn't trusted;
#: repeats are rare in most clean documents and many in a few.
SIGNALS = {
    "mean_word": ("word_chars", "n_words", 13 / 16, 1 / 64, True),
    "symbol_rate": ("n_symbols", "n_words", 13 / 16, 1 / 64, False),
    "dup_line_rate": ("n_dup_lines", "n_lines", 127 / 128, 1 / 1024, False),
    "repeat_rate": ("n_repeat_words", "n_words", 127 / 128, 1 / 1024, False),
}

# Words are maximal runs of other characters than 0x20 and 0x09-0x0D. A three-word window is compared by its 64-bit
# hash. Lambdas over a one-element array bind a value, so that it is computed once.
_MEASURES = r"""
transform(array(coalesce({text}, '')), t ->
transform(array(filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws ->
transform(array(filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), ls -> named_struct(
  'n_words', cast(size(ws) as bigint),
  'word_chars', cast(length(translate(t, '\t\n\u000B\u000C\r ', '')) as bigint),
  'n_symbols', cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint),
  'n_lines', cast(size(ls) as bigint),
  'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint),
  'n_repeat_words', cast(if(size(ws) < 4, 0, if(
    size(array_distinct(transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])))) = size(ws) - 2, 0,
    transform(array(array_sort(transform(sequence(0, size(ws) - 3),
      i -> named_struct('h', xxhash64(ws[i], ws[i + 1], ws[i + 2]), 'p', i)))), s ->
    transform(array(array_sort(filter(transform(s, (x, i) ->
      if(x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h, x.p, null)), p -> p is not null))), d ->
    if(size(d) = 0, 0, 3 + aggregate(
      zip_with(slice(d, 2, size(d)), slice(d, 1, size(d) - 1), (b, a) -> least(3, b - a)), 0, (a, x) -> a + x))
    )[0])[0])) as bigint)
))[0])[0])[0]
"""


def measures(text: str) -> Column:
    """struct(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a text column.

    n_lines: lines with a word. n_dup_lines: those equal to an earlier one. n_repeat_words: words that lie in a
    three-word window found at least twice in the text. A null text counts as empty.
    """
    return F.expr(_MEASURES.format(text=f"`{text}`"))


def base_failed() -> Column:
    return (F.col("__m.n_words") < MIN_WORDS) | (100 * F.col("__m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__m.n_words"))


def signals() -> dict[str, Column]:
    """The rates that have adaptive cutoffs; null where the text has no word or no line."""
    rate = lambda a, b: F.try_divide(F.col(f"__m.{a}").cast("double"), F.col(f"__m.{b}").cast("double"))
    return {k: rate(a, b) for k, (a, b, *_) in SIGNALS.items()}


def ladder(trusted: float, step: float) -> list[float]:
    """The trusted share and the ranks above it, up to the greatest value."""
    return [trusted + i * step for i in range(round((1 - trusted) / step) + 1)]


def cutoffs(measured: DataFrame) -> DataFrame:
    """One row per language and source: __lo_<signal> and __hi_<signal>, from the documents that pass the base rules.

    Quantiles come from mergeable sketches: each task sketches its own rows and only sketches are exchanged, so a
    source with a third of all rows costs no more than another. The trusted quantile is taken RANK_ERRORS standard
    errors of its rank further out, so a small group's is more generous. Null languages and sources form groups of
    their own.
    """
    s = signals()
    rows = measured.select("__lang", "__source", base_failed().alias("__failed"), *[c.alias(k) for k, c in s.items()])
    sketched = []
    for k, (_, _, trusted, step, two_sided) in SIGNALS.items():
        high = ladder(trusted, step)
        sketched.append(F.percentile_approx(F.when(~F.col("__failed"), F.col(k)), [0.5, *high, *[1 - x for x in high] * two_sided], SKETCH_ACCURACY).alias(k))
    n = F.count_if(~F.col("__failed")).alias("__n")
    levels = {
        "g": rows.groupBy("__lang", "__source").agg(n, *sketched),
        "l": rows.groupBy("__lang").agg(n, *sketched),
        "a": rows.agg(n, *sketched),
    }
    named = {
        at: df.select(*[c for c in ("__lang", "__source") if c in df.columns], F.struct("__n", *s).alias(at))
        for at, df in levels.items()
    }
    # the last has one row by construction
    joined = named["g"].join(named["l"], "__lang").crossJoin(F.broadcast(named["a"]))
    chosen = F.when(F.col("g.__n") >= MIN_GROUP, F.col("g")).when(F.col("l.__n") >= MIN_GROUP, F.col("l")).otherwise(F.col("a"))
    out = joined.select("__lang", "__source", chosen.alias("c"))
    cols = []
    for k, (_, _, trusted, step, two_sided) in SIGNALS.items():
        last = len(ladder(trusted, step)) - 1
        error = F.ceil(RANK_ERRORS * F.sqrt(trusted * (1 - trusted) / F.col("c.__n")) / step).cast("int")
        at = F.least(error, F.lit(last))
        middle, high, low = F.get(F.col(f"c.{k}"), F.lit(0)), F.get(F.col(f"c.{k}"), at + 1), F.get(F.col(f"c.{k}"), at + last + 2)
        cols += [(high + FENCE * (high - middle)).alias(f"__hi_{k}")] + [(low - FENCE * (middle - low)).alias(f"__lo_{k}")] * two_sided
    return out.select("__lang", "__source", *cols)


def judged(measured: DataFrame) -> DataFrame:
    """Add __failed and __kept to rows with their measures in the struct __m and their group in __lang and __source.

    ``measured`` is read twice (for the cutoffs, then for the verdicts), so it should be a written table. A document
    that passes the base rules is kept unless what it counts lies beyond its group's cutoff by more than COUNT_ERRORS
    standard errors of such a count, which a short text's may by chance; a missing cutoff rejects nothing.
    """
    limits = written(cutoffs(measured))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    beyond = F.lit(False)
    for k, (counted, of, _, _, two_sided) in SIGNALS.items():
        count, n = F.col(f"__m.{counted}"), F.col(f"__m.{of}")
        error = lambda x: COUNT_ERRORS * F.sqrt(x + COUNT_ERRORS * COUNT_ERRORS)
        most = F.col(f"__hi_{k}") * n
        beyond = beyond | F.coalesce(count > most + error(most), F.lit(False))
        if two_sided:
            fewest = F.greatest(F.col(f"__lo_{k}"), F.lit(0.0)) * n
            beyond = beyond | F.coalesce(count < fewest - error(fewest), F.lit(False))
    return (
        measured.join(limits, ["__lang", "__source"], "left").withColumn("__failed", base_failed())
        .withColumn("__kept", ~F.col("__failed") & ~beyond)
    )


def _measured(docs: DataFrame, carried: Column, text: str, lang: str, source: str) -> DataFrame:
    group = {"__lang": lang, "__source": source}
    return written(docs.select(carried.alias("__row"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(k) for k, c in group.items()], measures(text).alias("__m")))


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measures and verdict of every row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Rows with equal keys, and null keys, each get a row; null languages and
    sources count as empty ones; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(_measured(docs, F.col(f"`{key}`"), text, lang, source)).select(
        F.col("__row").alias(key), *[F.col(f"__m.{c}").alias(c) for c in names], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns and values, whatever their names.

    Null and empty texts have no words and go; of equal rows all pass or none; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return judged(_measured(docs, row, text, lang, source)).where("__kept").select("__row.*")
