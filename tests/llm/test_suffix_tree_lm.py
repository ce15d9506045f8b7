import math
import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from lodestar.llm import queries
from lodestar.llm import suffix_tree_lm as lm
from tests.llm.helpers import EDGE, docs, prose, table_rows


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def base(texts, held):
    c = Counter(t for k, v in texts.items() if not held[k] for t in toks(v))
    n, v = sum(c.values()), len(c)
    return {k: (len(toks(t)), sum(w in c for w in toks(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))) for k, t in texts.items()}


def check(rows, texts):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    want = base(texts, held)
    assert len(rows) == len(texts)
    for r in rows:
        a = want[r.doc_id]
        assert r.held_out == held[r.doc_id] and (r.n_tokens, r.n_known, r.train_tokens) == a[:3]
        assert math.isclose(r.base_score, a[3], rel_tol=1e-9)
    return held


def brute_tree(texts):
    """Log10 probability of a text, with contexts kept by the same test, from plain counts."""
    seqs = [toks(t) for t in texts]
    uni = Counter(w for s in seqs for w in s)
    n, v = sum(uni.values()), len(uni)
    least = max(lm.MIN_COUNT, lm.MIN_SHARE * n)
    root = lambda w: (uni[w] + 1) / (n + v + 1)
    kept = {}

    def prob(ctx, w):
        if not ctx:
            return root(w)
        if ctx not in kept:
            return prob(ctx[1:], w)
        stored, back = kept[ctx]
        return stored[w] if w in stored else back * prob(ctx[1:], w)

    new = {(): None}
    depth = 0
    while new:
        depth += 1
        by, whole = {}, Counter()
        for s in seqs:
            for i in range(depth, len(s)):
                ctx = tuple(s[i - depth : i])
                if ctx[1:] in new:
                    by.setdefault(ctx, Counter())[s[i]] += 1
                    whole[ctx] += 1
        new = {}
        for ctx, nxt in by.items():
            nxt = {w: c for w, c in nxt.items() if c >= least}
            if not nxt:
                continue
            low = {w: prob(ctx[1:], w) for w in nxt}
            rest = 1 - sum(c / whole[ctx] for c in nxt.values())
            g = 2 * sum(c * math.log(c / whole[ctx] / low[w]) for w, c in nxt.items())
            if rest > 1e-9:
                g += 2 * whole[ctx] * rest * math.log(max(rest, 1e-12) / max(1 - sum(low.values()), 1e-12))
            if g >= lm.chi_square_cutoff(np.array([float(len(nxt))]))[0]:
                stored = {w: (c - 0.5) / whole[ctx] for w, c in nxt.items()}
                new[ctx] = (stored, max(1 - sum(stored.values()), 1e-12) / max(1 - sum(low.values()), 1e-12))
        kept.update(new)

    def longest(words):
        """The longest kept context, found from the next token backwards; growth went that way."""
        d = 0
        while d < len(words) and tuple(words[len(words) - d - 1 :]) in kept:
            d += 1
        return tuple(words[len(words) - d :])

    def score(text):
        s = toks(text)
        return sum(math.log10(prob(longest(s[max(0, i - 40) : i]), w)) for i, w in enumerate(s))

    return score, kept, prob


def test_whole_table(spark, small):
    texts = {r[0]: r[1] for r in table_rows(small, "documents")}
    rows = queries.op9_suffix_tree_lm(spark, small).collect()
    held = check(rows, texts)
    score, kept, _ = brute_tree([t for k, t in texts.items() if not held[k]])
    assert {len(c) for c in kept} >= {1, 2, 3}
    for r in rows:
        assert math.isclose(r.score, score(texts[r.doc_id]), rel_tol=1e-6), r.doc_id
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_chunks_and_buckets_give_the_same(spark, small, monkeypatch):
    whole = sorted((r.doc_id, round(r.score, 6)) for r in queries.op9_suffix_tree_lm(spark, small).collect())
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 5_000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 3_000)
    assert sorted((r.doc_id, round(r.score, 6)) for r in queries.op9_suffix_tree_lm(spark, small).collect()) == whole


def test_depth_follows_the_texts(spark):
    """Each word depends on the five before it; no depth is set anywhere."""
    rng = np.random.default_rng(5)
    chance = rng.dirichlet([0.3] * 2, 2**5)
    texts = []
    for _ in range(300):
        w = rng.integers(0, 2, 5).tolist()
        for _ in range(80):
            w.append(int(rng.random() < chance[int("".join(map(str, w[-5:])), 2)][1]))
        texts.append(" ".join("xy"[i] for i in w))
    rows = lm.scored(docs(spark, texts), held_out=F.lit(False)).collect()
    score, kept, _ = brute_tree(texts)
    assert max(map(len, kept)) >= 5
    for r in rows:
        assert math.isclose(r.score, score(texts[r.doc_id]), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    vocab = ["the", "cat", "dog", "sat", "ran"]
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(300):
        w = ["the"]
        for _ in range(12):
            w.append("cat" if w[-1] == "the" and rng.random() < 0.7 else vocab[rng.integers(5)])
        texts.append(" ".join(w))
    _, kept, prob = brute_tree(texts)
    assert kept
    for ctx in [(), *kept]:
        assert math.isclose(sum(prob(ctx, w) for w in [*vocab, None, "unseen"]), 1, rel_tol=1e-9)


def test_edges(spark):
    rows = lm.scored(docs(spark, EDGE)).collect()
    check(rows, dict(enumerate(EDGE)))
    assert lm.scored(docs(spark, [])).count() == 0
    twice = docs(spark, [prose(50), prose(50)]).unionByName(docs(spark, [prose(50)])).selectExpr("*", "1 as score", "2 as held_out", "3 as k", "4 as n")
    assert lm.scored(twice).count() == 3
    nulls = docs(spark, ["a b", None]).selectExpr("cast(null as bigint) doc_id", "text")
    assert sorted(r.n_tokens for r in lm.scored(nulls).collect()) == [1, 3]
    none = lm.scored(docs(spark, ["a b", ""]), held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0 for r in none)
