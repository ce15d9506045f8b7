import re

from lodestar.llm import quality, queries
from tests.llm.helpers import EDGE, docs, oracle, prose


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 500 else None
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered))


def test_measures(spark):
    texts = [*EDGE, "a b c d a b c", "a a a a", "a b a b a b x", "# * $ %&|<> a b\n# * $ %&|<> a b\n", "x\ty\x0bz\x0c \r w", prose(60)]
    got = {r.doc_id: r.asDict() for r in quality.quality_report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4], t
        assert r["n_repeat_words"] == (r["n_words"] if want[4] is None else want[4]), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_oracle(spark, small):
    got = queries.op8_quality(spark, small)
    columns, want = oracle(queries.oracle_sql()["op8_quality"], small)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_cutoffs_follow_the_group(spark):
    plain = [prose(80, i) for i in range(120)]
    starred = [" ".join(w + "***" for w in t.split()) for t in plain[:4]]
    got = quality.quality_report(docs(spark, plain + starred)).collect()
    assert all(r.kept == (r.doc_id < 120) for r in got)
    # where most documents of a group hold symbols, symbols are no fault
    got = quality.quality_report(docs(spark, [" ".join(w + "***" for w in t.split()) for t in plain])).collect()
    assert all(r.kept for r in got)


def test_edges(spark):
    assert quality.quality_report(docs(spark, [])).count() == 0
    nulls = docs(spark, [prose(60), prose(61)]).selectExpr("cast(null as bigint) doc_id", "text", "cast(null as string) lang", "cast(null as string) source")
    assert [r.kept for r in quality.quality_report(nulls).collect()] == [True, True]
    clash = docs(spark, [prose(60), "short"]).selectExpr("*", "1 as n_words", "false as kept", "3 as base_failed", "4 as hi_mean_word", "5 as __m", "6 as __row", "7 as __lang", "8 as __kept")
    assert [tuple(r) for r in quality.keep_good(clash).collect()] == [tuple(clash.first())]
    assert quality.keep_good(clash).columns == clash.columns
    assert quality.quality_report(clash).count() == 2
    assert quality.keep_good(docs(spark, [])).count() == 0
    twice = docs(spark, [prose(60)]).unionByName(docs(spark, [prose(60), None, ""]))
    assert quality.keep_good(twice).count() == 2


def test_same_text_in_different_groups(spark):
    """What is usual in one source is a fault in another, for each signal."""
    import random

    rng = random.Random(3)
    words = [f"{w}" for w in prose(4000, 5).split()]
    plain = lambda: rng.sample(words, 150)
    lines = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))

    def starred():
        return " ".join(w + "*" if i % 3 == 0 else w for i, w in enumerate(plain()))

    def long_words():
        return " ".join(w * 2 for w in plain())

    def repeating():
        return lines([*(ws := plain()), *ws[:40]], 200)

    def lined():
        return lines(plain(), 3) + "\nnext page" * 40

    usual = [lines(plain(), 10) for _ in range(200)] * 3
    for make in (starred, long_words, repeating, lined):
        odd = [make() for _ in range(60)]
        rows = [(i, t, "en", "plain") for i, t in enumerate([*usual, odd[0]])] + [(1000 + i, t, "en", "odd") for i, t in enumerate(odd)]
        got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert all(got[i] for i in range(600)), make
        assert not got[600], make
        assert all(got[1000 + i] for i in range(60)), make
