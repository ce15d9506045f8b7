import re
import time

import numpy as np

from lodestar.llm import decontamination as d
from lodestar.llm import queries
from tests.llm.helpers import EDGE, docs, prose, table_rows


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute(doc, item):
    """Length of the longest aligned stretch with four of five tokens equal."""
    a, b = (re.findall(r"[^\W_]+", t.lower()) for t in (doc or "", item or ""))
    best = 0
    for shift in range(-len(b), len(a)):
        eq = [a[i + shift] == b[i] for i in range(max(0, -shift), min(len(b), len(a) - shift))]
        for x in range(len(eq)):
            for y in range(x + 1, len(eq) + 1):
                if sum(eq[x:y]) >= 0.8 * (y - x) and y - x > best:
                    best = y - x
    return best if len(b) >= d.MIN_ITEM and best >= min(d.MIN_OVERLAP, len(b)) else 0


def test_against_brute_force(spark):
    items = [prose(30, 1), prose(20, 2), prose(8, 3), "too short here", None, "", prose(30, 1).upper()]
    w = items[0].split()
    swapped = " ".join(x if i % 7 else "other" for i, x in enumerate(w))
    texts = [
        prose(40, 9) + " " + items[0] + " " + prose(10, 8), prose(5, 7) + " " + swapped, " ".join(w[:14]), " ".join(w[:9]), " ".join(w[20:]) + " " + items[2],
        items[2].replace(" ", ", ") + "!", prose(100, 5), items[1] + "\n" + items[0], "too short here", *EDGE[:6],
    ]
    got = {(r.doc_id, r.item_id): r.n_tokens for r in d.contaminations(docs(spark, texts), bench(spark, items)).collect()}
    want = {(i, j): brute(t, x) for i, t in enumerate(texts) for j, x in enumerate(items[:6]) if brute(t, x)}
    assert got == want and len(want) >= 7


def test_planted_passages(spark, small):
    found = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, small).collect()}
    items = table_rows(small, "benchmark")
    texts = table_rows(small, "documents")
    planted = {(t[0], i[0]) for t in texts for i in items if i[1] in t[1]}
    assert planted and planted <= found
    by_item, by_doc = dict(items), {t[0]: t[1] for t in texts}
    for a, b in found - planted:
        assert brute(by_doc[a], by_item[b])


def test_blocks_give_the_same(spark, small, monkeypatch):
    whole = sorted(map(tuple, queries.op2_decontamination(spark, small).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 2500)
    assert sorted(map(tuple, queries.op2_decontamination(spark, small).collect())) == whole


def test_edges(spark):
    empty = bench(spark, [])
    assert d.contaminations(docs(spark, EDGE), empty).count() == 0
    assert d.contaminations(docs(spark, []), bench(spark, [prose(20)])).count() == 0
    rows = docs(spark, [prose(20), prose(30, 4), None]).selectExpr("*", "1 as item_id", "2 as n_tokens")
    kept = d.drop_contaminated(rows.unionByName(rows), bench(spark, [prose(20)]))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 2]
    assert d.drop_contaminated(rows, empty).count() == 3
    nulls = rows.selectExpr("cast(null as bigint) doc_id", "text")
    assert d.contaminations(nulls, bench(spark, [prose(20)]).selectExpr("cast(null as bigint) item_id", "text")).count() == 1


def plain_overlaps(text, item):
    """The same search, with every meeting of two seeds listed."""
    hashes, _ = d.word_hashes([d.normalised(text)], d.WORD_BYTES)
    other, _ = d.word_hashes([d.normalised(item)], d.WORD_BYTES)
    shifts = set()
    for mask in d.MASKS:
        a, b = (dict(zip(*(x.tolist() for x in d.seeds(t, np.zeros(len(t), np.int64), mask)))) for t in (hashes, other))
        shifts |= {i - j for i, x in a.items() for j, y in b.items() if x == y}
    best = None
    for s in sorted(shifts):
        lo, hi = max(0, -s), min(len(other), len(hashes) - s)
        a, b, equal = d.longest_overlap(hashes[lo + s : hi + s] == other[lo:hi])
        if b - a >= min(d.MIN_OVERLAP, len(other)) and (best is None or b - a > best[2]):
            best = (lo + s + a, lo + a, b - a, equal)
    return best


def test_repeated_words(monkeypatch):
    texts = ["spam " * 400, "spam ham " * 150, "a b c " * 90 + "d " * 60, prose(50) + " spam" * 200, "spam " * 12, "x " + "spam ham eggs " * 70]
    items = ["spam " * 90, "spam ham " * 40, "a b c " * 30, "d " * 45, prose(30, 2) + " spam" * 30, "spam spam ham " * 25]
    for many in (d._MANY, 0, 1 << 40):
        monkeypatch.setattr(d, "_MANY", many)
        index = d.SeedIndex.of(list(enumerate(items)))
        got = {(t, i): tuple(x) for t, i, *x in index.overlaps([d.normalised(t) for t in texts])}
        want = {(t, i): x for t, a in enumerate(texts) for i, b in enumerate(items) if (x := plain_overlaps(a, b))}
        assert got == want


def test_hot_seeds_are_not_listed():
    for word in ("spam ", "spam ham "):
        index = d.SeedIndex.of([(0, word * 1000)])
        started = time.time()
        assert [x[4] for x in index.overlaps([(word * 20_000).encode()])] == [1000 * len(word.split())]
        assert time.time() - started < 3


def test_equal_items_in_blocks(spark, monkeypatch):
    text = prose(40)
    bench = spark.createDataFrame([(i, f"{text}{'.' * i}") for i in range(6)] + [(9, "too short")], "item_id long, text string")
    few = docs(spark, [prose(10, 3) + " " + text, "clean words", None, "too short"]).selectExpr("*", "1 as item_id", "2 as n_equal", "3 as tokens")
    for size in (d.BLOCK_BYTES, 100):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        assert [(r.doc_id, r.item_id) for r in d.contaminations(few, bench).collect()] == [(0, 0)]
        left = d.drop_contaminated(few, bench)
        assert left.columns == few.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert d.drop_contaminated(few, bench.limit(0)).count() == 4
