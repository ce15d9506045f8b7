import random
import re

import numpy as np
import xxhash

from lodestar.llm import queries, simhash
from tests.llm.helpers import EDGE, docs, prose, table_rows


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def check(rows, texts):
    fps = {k: brute(v) for k, v in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == components(fps)


def test_whole_table(spark, small):
    check(queries.op7_simhash(spark, small).collect(), {r[0]: r[1] for r in table_rows(small, "documents")})


def test_golay():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    code = words ^ simhash._errors()[simhash._syndromes(words)]
    assert not simhash._syndromes(code).any()
    assert int(np.bitwise_count(code ^ words).max()) <= 3


def test_two_bits_share_a_key():
    rng = random.Random(2)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(64), rng.choice([1, 2])):
            b[i] ^= np.uint64(1 << bit)
    keys = []
    for x in (a, b):
        rows, ks = simhash.fuzzy_keys(x.view(np.int64))
        own = [set() for _ in x]
        for r, k in zip(rows.tolist(), ks.tolist()):
            own[r].add(k)
        keys.append(own)
    assert all(p & q for p, q in zip(*keys))


def test_links_connect_all_close_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                x ^= 1 << rng.randrange(64)
    want = components(dict(zip(sorted(fps), sorted(fps))))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    for most in (256, 2):
        monkeypatch.setattr(simhash, "MAX_COMPARED", most)
        edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
        top = {x: x for x in fps}

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for e in edges:
            a, b = sorted((find(e.a % (1 << 64)), find(e.b % (1 << 64))))
            top[b] = a
        assert {x: find(x) for x in fps} == want


def test_edges(spark):
    texts = [*EDGE, "ONE two Three", prose(300), prose(300) + " tail"]
    found = simhash.clustered(docs(spark, texts))
    rows = [(r.doc_id, r.fp % (1 << 64), r.component) for r in found.collect()]
    fps = {i: brute(t) for i, t in enumerate(texts)}
    assert {a: b for a, b, _ in rows} == fps
    assert {a: c for a, _, c in rows} == components(fps)
    assert simhash.clustered(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b c d", "e f g h"]).unionByName(docs(spark, ["a b c d"])).selectExpr("*", "1 as fp", "2 as component", "3 as root")
    assert simhash.clustered(twice).count() == 3
    nulls = spark.createDataFrame([(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.clustered(nulls).count() == 3
