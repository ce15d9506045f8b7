import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm import packing, queries
from tests.llm.helpers import EDGE, docs, table_rows


def check(rows, texts, most=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*t.encode(v or "", add_special_tokens=False).ids, 1] for k, v in texts.items()}
    seqs, parts = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, v in parts.items():
        at = 0
        for start, length in sorted(v):
            assert start == at
            at += length
        assert at == len(ids[k])
    assert parts.keys() == texts.keys()
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= most
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs), sum(map(len, ids.values()))


def test_whole_table(spark, small):
    n, tokens = check(queries.op1_packing(spark, small).collect(), {r[0]: r[1] for r in table_rows(small, "documents")})
    assert n <= -(-tokens // 2048) * 1.02 + 1


def test_edges(spark):
    texts = [*EDGE, "a <|endoftext|> b", "<|endoftext|>"]
    check(packing.packed(docs(spark, texts)).collect(), dict(enumerate(texts)))
    assert packing.packed(docs(spark, [])).count() == 0
    repeated = packing.packed(docs(spark, ["x y"]).unionByName(docs(spark, ["x y"])).selectExpr("*", "1 as length", "2 as offset")).collect()
    assert sorted((r.doc_id, r.offset) for r in repeated) == [(0, 0), (0, 3)] and len({r.sequence_id for r in repeated}) == 1


def test_patterns():
    patterns = packing.shortest_pack_first({5: 3, 4: 2, 3: 5, 1: 4}, 8)
    placed = {}
    for n, parts in patterns:
        assert sum(parts) <= 8
        for p in parts:
            placed[p] = placed.get(p, 0) + n
    assert placed == {5: 3, 4: 2, 3: 5, 1: 4}
    assert sum(n for n, _ in patterns) == 6
    assert packing.shortest_pack_first({}, 8) == []
    # as many pieces of one length as there may be documents
    assert packing.shortest_pack_first({2: 10**12}, 8) == [(25 * 10**10, [2, 2, 2, 2])]
