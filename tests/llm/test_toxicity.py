import numpy as np

from lodestar.llm import queries, toxicity
from tests.llm.helpers import EDGE, docs, prose

BAD = ["vile", "nasty", "rotten", "foul"]


def corpus(spark, n=240):
    texts, labels = [], []
    for i in range(n):
        w = prose(60, i).split()
        k = (i % 4 == 0) * (1 + i // 4 % 6)
        for j in range(k):
            w[5 + 7 * j] = BAD[(i // 4 + j) % 4]
        texts.append(" ".join(w))
        labels.append((i, None, int(k > 0)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), texts


def test_held_out(spark):
    d, labels, texts = corpus(spark)
    model = toxicity.train(d, labels.where("doc_id < 180"))
    assert len(model.words) == 4 and (np.diff(model.thresholds) > 0).all() and len(model.thresholds) > 1
    rows = {r.doc_id: r for r in toxicity.severity(d, model).collect()}
    assert all(rows[i].toxic == (i % 4 == 0) for i in range(180, 240))
    mild, severe = rows[216], rows[236]
    assert sum(texts[216].count(b) for b in BAD) < sum(texts[236].count(b) for b in BAD)
    assert mild.expected_severity < severe.expected_severity and mild.severity <= severe.severity
    assert all(0 <= r.expected_severity <= len(model.thresholds) for r in rows.values())


def test_shared_passage_makes_no_copies(spark):
    """Documents with a passage in common are no copies of each other, and all of them train the model."""
    d, labels, texts = corpus(spark)
    passage = prose(30, 999)
    d = docs(spark, [f"{t} {passage}" for t in texts])
    model = toxicity.train(d, labels)
    assert len(model.words) == 4
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in toxicity.severity(d, model).collect())


def test_copies():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [base, base[5:], base[:200], base[3:], base[:0], base[:0]]
    lowest = np.array([toxicity.lowest_hashes(s) for s in sets])
    assert toxicity.without_copies(lowest, [0, 0, 0, 1, 0, 0], dict(enumerate(sets))) == [0, 2, 3, 4]
    assert {0, 1, 3, 4, 5} <= set(toxicity.with_company(lowest).tolist())


def test_gradient_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grade = np.searchsorted([0.0, 1.5], 2 * x + rng.logistic(size=3000))
    m = toxicity.fit(np.arange(3000), np.zeros(3000, int), x, grade, np.zeros(1, np.uint64))
    assert abs(m.weights[0] - 2) < 0.25 and np.abs(m.thresholds - [0, 1.5]).max() < 0.2


def test_real_labels(spark):
    rows = queries.op4_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and len({r.doc_id for r in rows}) == 1000


def test_edges(spark):
    d, labels, _ = corpus(spark, 60)
    assert toxicity.severity(docs(spark, []), toxicity.train(d, labels)).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        rows = toxicity.severity(docs(spark, EDGE), toxicity.train(d, some)).collect()
        assert len(rows) == len(EDGE) and not any(r.toxic for r in rows)
    again = labels.unionByName(labels)
    clash = d.selectExpr("*", "1 as toxic", "2 as severity", "3 as key")
    a = toxicity.train(clash, again)
    b = toxicity.train(d, labels)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
