import zlib

from lodestar.llm import queries, sharding
from tests.llm.helpers import EDGE, docs, table_rows


def test_whole_table(spark, small):
    rows = queries.op10_sharding(spark, small).collect()
    texts = {r[0]: r[1] for r in table_rows(small, "documents")}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_adding_a_shard_moves_rows_only_into_it(spark):
    many = docs(spark, ["x"] * 4000)
    before = {r.doc_id: r for r in sharding.shard_documents(many, [1.0, 2.0, 1.0], new_weight=2.0).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_documents(many, [1.0, 2.0, 1.0, 2.0]).collect()}
    assert all(before[k].grown_shard == after[k] for k in before)
    moved = sum(before[k].shard != after[k] for k in before)
    assert 0.28 < moved / 4000 < 0.39
    shares = [sum(r.shard == s for r in before.values()) / 4000 for s in range(3)]
    assert abs(shares[0] - 0.25) < 0.04 and abs(shares[1] - 0.5) < 0.04


def test_edges(spark):
    rows = sharding.shard_documents(docs(spark, EDGE).unionByName(docs(spark, EDGE)), [1.0] * 3).collect()
    assert len(rows) == 2 * len(EDGE)
    by_key = {}
    for r in rows:
        by_key.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(v) == 1 for v in by_key.values())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_documents(nulls, [1.0] * 3).collect()) == [0, 1, 2]
    clash = docs(spark, ["a", "b"]).selectExpr("*", "1 as shard", "'q' as slot", "2 as size", "3 as __bucket", "4 as law")
    assert sharding.shard_documents(clash, [1.0]).count() == 2
    assert sharding.shard_documents(docs(spark, []), [1.0]).count() == 0
