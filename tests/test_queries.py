import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.plans import queries as Q

SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, small, duck, name):
    df = Q.queries()[name](spark, small)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(map(str, map(tuple, df.select(*rel.columns).collect())))
    assert got == sorted(map(str, rel.fetchall()))


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert Q.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(Q.queries()) <= set(__spark_entry__.queries())


def test_links_deal_out_no_texts(spark, small):
    plan = Q.links(spark, small)._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Join"):
        plan = plan.children().head()
    sides = [plan.children().apply(i).schema().simpleString() for i in (0, 1)]
    assert all("t:binary" in s for s in sides)


def test_subset_check_finds_pairs_once_and_deals_out_no_lists(spark, small, monkeypatch):
    made = []
    chunked = Q.B.chunked_candidates
    monkeypatch.setattr(Q.B, "chunked_candidates", lambda *a, **b: made.append(a) or chunked(*a, **b))
    df = Q.queries()["check_subset"](spark, small)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert len(made) == 1 and Q.B.CHUNK in next(line for line in plan.splitlines() if "LeftOuter" in line)


def _fields_dealt(spark, small, name, monkeypatch):
    """What a query's pairs hold of the records: names and types."""
    made = []
    chunked = Q.B.chunked_candidates
    monkeypatch.setattr(Q.B, "chunked_candidates", lambda *a, **b: made.append(chunked(*a, **b)) or made[-1])
    Q.queries()[name](spark, small)
    return {c: t for c, t in made[0].dtypes if c[:2] in ("l_", "r_")}


def test_exact_flags_deal_out_digests(spark, small, monkeypatch):
    dealt = _fields_dealt(spark, small, "feat_exact_flags", monkeypatch)
    assert dealt == {f"{side}_{f}": t for side in "lr" for f, t in (("country_normalized", "string"), ("name_digest", "binary"), ("address_digest", "binary"))}


def test_lengths_are_dealt_out_alone(spark, small, monkeypatch):
    dealt = _fields_dealt(spark, small, "feat_length", monkeypatch)
    assert dealt == {f"{side}_{f}": "int" for side in "lr" for f in ("name_length", "address_length", "name_token_count")}


@pytest.mark.parametrize("names", [
    ["name_exact", "address_exact", "country_exact", "country_compatible", "name_address_exact"],
    ["name_length_difference", "address_length_difference", "name_token_count_difference", "missing_name", "missing_address", "missing_country"],
])
def test_features_of_summaries_are_those_of_texts(spark, names):
    texts = ["", "a", "a b", "b a", "x" * 70]
    rows = [("S1" if i % 2 else "S2", str(i), n, a, c, n.split(), a.split(), [], []) for i, (n, a, c) in enumerate((n, a, c) for n in texts for a in texts for c in ("", "en", "fr"))]
    kinds = ", ".join(f"{f} {'array<string>' if f.endswith('tokens') else 'string'}" for f in Q.Fe.FIELDS)
    df = spark.createDataFrame(rows, f"source string, entity_id string, {kinds}").coalesce(1)

    def of(fields):
        ref, cand = Q.sides(Q.Fe.summarised(df))
        sides = [x.select(F.col("source").alias(s), F.col("entity_id").alias(i), *[F.col(f).alias(f"{k}_{f}") for f in fields]) for x, k, s, i in ((ref, "l", *Q.B.PAIR[:2]), (cand, "r", *Q.B.PAIR[2:]))]
        return sorted(map(tuple, Q.Fe.pair_features(sides[0].crossJoin(sides[1]), df, None, names=names).select(*Q.B.PAIR, *names).collect()))

    short = Q.Fe.fields_read(names)
    assert not {"name_normalized", "address_normalized", "name_tokens"} & set(short) and of(short) == of(Q.Fe.FIELDS)
