import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import queries
from lodestar.llm import substring_dedup as sd
from lodestar.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.helpers import EDGE, docs, prose, table_rows


def brute(texts):
    """By key: n_bytes, n_removed, n_spans, hash of what is left. Texts by (key, tie)."""
    seen, out = set(), {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(b[i : i + 100])
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def check(rows, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    want = brute(texts)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


@pytest.mark.parametrize("alphabet", [b"ab", b"\0a\xff", b"abcdefgh", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for n in (0, 1, 2, 9, 400, 1500):
        t = bytes(rng.choices(alphabet, k=n))
        t = (t[: n // 3] * 3)[:n] if n > 100 else t
        n = len(t)
        a = np.frombuffer(t, np.uint8)
        order = suffix_array(a)
        want = sorted(range(n), key=lambda i: t[i:])
        assert order.tolist() == want
        lcp = common_prefixes(a, order).tolist()
        for i in range(1, n):
            x, y = t[want[i - 1] :], t[want[i] :]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert lcp[i] == k


def mixed_texts(seed=0):
    rng = random.Random(seed)
    base = [prose(60, i) for i in range(12)]
    out = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(len(a)), rng.randrange(len(b))
        out.append(rng.choice([prose(30, 100 + i), a, a[:x] + b[y:], a[:x] + "é" + a[x + 1 :], a + "\n" + a, "z" * rng.randrange(300), "€" * 120, prose(20, i)[:99]]))
    return out


def in_one_process(texts, most):
    """The stages without Spark, in several buckets."""
    rows = [(i % 3, i, hash(t) & 0xFFFF, (t or "").encode()) for i, t in enumerate(texts)]
    tables = {b: pa.table({"__bucket": [r[0] for r in rows if r[0] == b], "__d": [r[1] for r in rows if r[0] == b], "__x": [r[2] for r in rows if r[0] == b],
                           "__body": pa.array([r[3] for r in rows if r[0] == b], pa.binary()), "doc_id": [r[1] for r in rows if r[0] == b]}) for b in range(3)}
    key = lambda b: (pa.scalar(b),)
    counts = pa.concat_tables([sd.gram_counts(key(b), t) for b, t in tables.items()]).sort_by("g")
    grams = pa.Table.from_batches(list(sd.repeated_grams(iter(counts.to_batches(max_chunksize=7)))))
    sent = pa.concat_tables([sd.segments(key(b), t, grams.filter(pa.compute.equal(grams["__bucket"], b))) for b, t in tables.items()]).sort_by("k")
    found = pa.Table.from_batches(list(sd.repeats(iter(sent.combine_chunks().to_batches(max_chunksize=5)), most)))
    out = {}
    for b, t in tables.items():
        for r in sd._finish("doc_id")(key(b), t, found.filter(pa.compute.equal(found["__bucket"], b))).to_pylist():
            out[r["doc_id"]] = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    return out


@pytest.mark.parametrize("most", [2 << 20, 3000, 200])
@pytest.mark.parametrize("common", [50_000, 3])
def test_shards_are_merged(monkeypatch, most, common):
    monkeypatch.setattr(sd, "COMMON", common)
    for seed in range(3):
        texts = mixed_texts(seed)
        want = brute(dict(enumerate(texts)))
        got = in_one_process(texts, most)
        assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 150)
    texts = mixed_texts(9) + [prose(400, 3), prose(400, 3)[37:]]
    assert in_one_process(texts, 5000) == brute(dict(enumerate(texts)))


def test_whole_table(spark, small):
    check(queries.op3_suffix_dedup(spark, small).collect(), {r[0]: r[1] for r in table_rows(small, "documents")})


def test_edges(spark):
    texts = [*EDGE, *mixed_texts(4)[:20]]
    check(sd.deduplicated(docs(spark, texts)).collect(), dict(enumerate(texts)))
    assert sd.deduplicated(docs(spark, [])).count() == 0
    twice = docs(spark, [prose(40), prose(40, 1)]).selectExpr("*", "1 as n_bytes", "2 as d", "3 as x", "4 as start", "5 as k")
    rows = sd.deduplicated(twice.unionByName(twice)).collect()
    assert len(rows) == 4 and all(r.n_removed == 0 for r in rows)
    nulls = spark.createDataFrame([(5, prose(40)), (None, prose(40)), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in sd.deduplicated(nulls).collect()}
    n = len(prose(40))
    assert got == {(5, n): n, (None, n): 0, (None, 0): 0}
