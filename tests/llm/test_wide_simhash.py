import random

import numpy as np

from lodestar.llm import wide_simhash
from tests.llm.helpers import EDGE, docs, prose, table_rows


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def shingles(text):
    return set(wide_simhash.shingle_hashes((text or "").encode()).tolist())


def components(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def changed(text, rate, rng):
    """Words replaced in one run, so that about ``rate`` of the shingles differ."""
    words = text.split()
    n = max(1, int(rate * len(words)) - 4)
    at = rng.randrange(len(words) - n)
    return " ".join([*words[:at], *(f"new{rng.random()}" for _ in range(n)), *words[at + n :]])


def test_near_copies_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for g in range(60):
        base = prose(120 + 5 * g, g)
        texts += [base, *(changed(base, rng.choice([0.03, 0.05, 0.08, 0.3, 0.5]), rng) for _ in range(4))]
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if a // 5 == b // 5]
    close = {(a, b): jaccard(sets[a], sets[b]) for a, b in pairs}
    got = {r.doc_id: r.component for r in wide_simhash.grouped(docs(spark, texts)).collect()}
    alike = [p for p, j in close.items() if j >= 0.8]
    found = [p for p in alike if got[p[0]] == got[p[1]]]
    assert len(alike) > 100 and len(found) >= 0.97 * len(alike)
    loose = components(len(texts), [p for p, j in close.items() if j >= 0.7])
    assert all(loose[i] == loose[got[i]] for i in got)


def test_whole_table_against_brute_force(spark, small):
    rows = {r[0]: r[1] for r in table_rows(small, "documents")}
    sets = {k: shingles(t) for k, t in rows.items()}
    got = {r.doc_id: r.component for r in wide_simhash.grouped(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert set(got) == set(rows)
    by_shingle = {}
    for k, s in sets.items():
        for h in s or (None,):
            by_shingle.setdefault(h, []).append(k)
    pairs = {(a, b) for ks in by_shingle.values() for a in ks for b in ks if a < b}
    close = {p: jaccard(sets[p[0]], sets[p[1]]) for p in pairs}
    alike = [p for p, j in close.items() if j >= 0.8]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.95 * len(alike)
    ids = sorted(rows)
    at = {k: i for i, k in enumerate(ids)}
    loose = components(len(ids), [(at[a], at[b]) for (a, b), j in close.items() if j >= 0.7])
    assert all(loose[at[k]] == loose[at[v]] for k, v in got.items())


def test_forest_of_a_large_key(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, (3, 2))
    heads = np.repeat(base, 40, axis=0)
    for row in heads:
        row[0] ^= np.int64(1 << int(rng.integers(62)))
    keys = np.zeros(len(heads), np.int64)
    for block in (256, 7):
        monkeypatch.setattr(wide_simhash, "BLOCK", block)
        a, b = wide_simhash.nearest_forest(keys, heads)
        assert len(a) == 117 and components(120, zip(a.tolist(), b.tolist())) == [i // 40 * 40 for i in range(120)]


def scattered(words, n, rng):
    """Words replaced at n places so far apart that each changes five shingles."""
    words = list(words)
    at = rng.choice(len(words) // 10, n, replace=False) * 10 + 5
    for i in at.tolist():
        words[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


def test_variants_of_one_original(spark):
    """Variants are similar to the original only; the closest heads are not always those of similar texts."""
    rng = np.random.default_rng(8)
    texts = []
    for g in range(2):
        words = [f"w{g}x{i}" for i in range(304)]
        texts += [" ".join(words), *(scattered(words, 6, rng) for _ in range(150))]
    sets = [shingles(t) for t in texts]
    assert all(jaccard(sets[0], s) > 0.8 for s in sets[:151]) and jaccard(sets[1], sets[2]) < 0.75
    got = {r.doc_id: r.component for r in wide_simhash.grouped(docs(spark, texts)).collect()}
    print("apart", sum(got[i] != i // 151 * 151 for i in got))
    fps = np.stack([wide_simhash.fingerprint(wide_simhash.shingle_hashes(t.encode())) for t in texts])
    met = {}
    for row, k in zip(*(x.tolist() for x in wide_simhash.fuzzy_keys(fps)), strict=True):
        met.setdefault(k, []).append(row)
    pairs = {(x, y) for rows in met.values() for x in rows for y in rows if x < y}
    far = lambda x, y: np.bitwise_count((fps[x, :2] ^ fps[y, :2]).view(np.uint64)).sum()
    links = [p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8 and far(*p) <= wide_simhash.HEAD_BITS]
    assert [got[i] for i in range(len(texts))] == components(len(texts), links)
    assert len(links) >= 0.94 * 300


def test_links_are_exact(spark):
    """Pairs just below the least similarity stay apart, those at it or above come together."""
    rng = np.random.default_rng(9)
    texts = []
    for g in range(60):
        words = [f"v{g}x{i}" for i in range(304)]
        texts += [" ".join(words), scattered(words, 7 if g % 2 else 5, rng)]
    sets = [shingles(t) for t in texts]
    close = [jaccard(sets[i], sets[i + 1]) for i in range(0, len(texts), 2)]
    assert all(0.78 < j < 0.8 if g % 2 else j > 0.84 for g, j in enumerate(close))
    got = {r.doc_id: r.component for r in wide_simhash.grouped(docs(spark, texts)).collect()}
    together = [got[2 * g] == got[2 * g + 1] for g in range(60)]
    assert not any(together[1::2]) and sum(together[::2]) >= 29


def test_pairs_of_crowded_keys(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, (3, 2))
    heads = np.repeat(base, 40, axis=0)
    for row in heads:
        row[0] ^= np.int64(1 << int(rng.integers(62)))
    keys = np.zeros(len(heads), np.int64)
    a, b, crowded = wide_simhash.first_pairs(keys, heads)
    assert len(a) == 117 and crowded.all()
    roots = np.arange(120) // 20
    across = {(x, y) for p, q in wide_simhash.pairs_across(keys, roots, heads) for x, y in zip(p.tolist(), q.tolist(), strict=True)}
    assert across == {(x, y) for x in range(120) for y in range(x + 1, 120) if x // 40 == y // 40 and x // 20 != y // 20}
    few = np.arange(120) // 4
    a, b, crowded = wide_simhash.first_pairs(few, heads)
    assert len(a) == 180 and not crowded.any()
    monkeypatch.setattr(wide_simhash, "BLOCK", 3)
    assert wide_simhash.first_pairs(few, heads)[2].all()


def test_edges(spark):
    texts = [*EDGE, "ONE two Three", prose(300), prose(300) + " tail"]
    got = {r.doc_id: r.component for r in wide_simhash.grouped(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 5, 11: 11, 12: 11}
    assert wide_simhash.grouped(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d", "e f g h"]).unionByName(docs(spark, ["a b c d"])).selectExpr("*", "1 as fp", "2 as component", "3 as node", "4 as n")
    assert wide_simhash.grouped(twice).count() == 3
    kept = wide_simhash.keep_one(twice)
    assert kept.columns == twice.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
    nulls = spark.createDataFrame([(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in wide_simhash.keep_one(nulls).collect()) == ["4", "5"]


def test_repeated_keys_keep_their_texts(spark):
    x, y = prose(80, 1), prose(80, 2)
    rows = docs(spark, []).sparkSession.createDataFrame([(1, x, 1), (1, y, 2), (2, x, 3), (3, y, 4), (1, x, 1), (None, y, 5), (None, prose(60, 3), 6)], "doc_id long, text string, node int")
    kept = wide_simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text == x, r.node) for r in kept.collect()) == [(0, False, 6), (1, False, 2), (1, True, 1)]
    assert sorted((r.doc_id or 0, r.component or 0) for r in wide_simhash.grouped(rows).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert wide_simhash.keep_one(rows.limit(0)).count() == 0
    clash = rows.selectExpr("*", "1 as __key", "2 as root", "3 as first", "4 as __times", "5 as __hash")
    assert wide_simhash.keep_one(clash).columns == clash.columns
