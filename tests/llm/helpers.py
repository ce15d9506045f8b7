from __future__ import annotations

import duckdb

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(n, seed=0):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


EDGE = [None, "", " \n\t ", "one", "one two", "one two three", "a b c " * 4000, "a b c " * 4000, "x\n\nx\nx \ny", "café \U0001f600 été"]


def table_rows(sf, name):
    con = duckdb.connect()
    return con.sql(f"select * from read_parquet('{sf}/{name}.parquet')").fetchall()


def oracle(sql, sf):
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()
