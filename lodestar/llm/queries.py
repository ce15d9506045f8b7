"""The thin queries over the operators of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, licenses, packing, quality, secrets, sharding, simhash, substring_dedup, suffix_tree_lm, toxicity

N_SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognised(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clustered(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scored(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * N_SHARDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_decontamination, op3_suffix_dedup, op4_toxicity, op5_secrets, op6_licenses, op7_simhash, op8_quality, op9_suffix_tree_lm, op10_sharding]
    return {f.__name__: f for f in found}


_OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source,
    row_number() over () as r from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, unnest(range(1, len(ws) - 1)) as p, unnest(list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:])) as g from w where len(ws) >= 3),
twice as (select r, p from (select r, p, count(*) over (partition by r, g) as n from g) where n > 1),
rep as (select r, count(distinct p + k) as n_repeat_words from twice, (values (0), (1), (2)) v(k) group by r),
m as (select w.r, doc_id, lang, source, len(ws)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join rep on w.r = rep.r),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    word_chars / nullif(n_words, 0)::double as mean_word, n_symbols / nullif(n_words, 0)::double as symbol_rate,
    n_dup_lines / nullif(n_lines, 0)::double as dup_line_rate, n_repeat_words / nullif(n_words, 0)::double as repeat_rate from m),
q as (select lang, source, grouping(lang) as gl, grouping(source) as gs, count(*) as n,
    quantile_disc(mean_word, [0.5, {wide}, {low}]) as a, quantile_disc(symbol_rate, [0.5, {wide}]) as b,
    quantile_disc(dup_line_rate, [0.5, {narrow}]) as c, quantile_disc(repeat_rate, [0.5, {narrow}]) as e
    from s where not base_failed group by grouping sets ((lang, source), (lang), ())),
j as (select s.*, case when g.n >= 30 then g when l.n >= 30 then l else z end as k
    from s left join q g on g.gl = 0 and g.gs = 0 and g.lang = s.lang and g.source = s.source
    left join q l on l.gl = 0 and l.gs = 1 and l.lang = s.lang left join q z on z.gl = 1),
i as (select *, least(ceil(sqrt(0.15234375e0 / k.n) / 0.015625e0), 12)::int + 2 as iw,
    least(ceil(sqrt(0.00775146484375e0 / k.n) / 0.0009765625e0), 8)::int + 2 as nw from j),
x as (select *, (k.a[iw] + 3 * (k.a[iw] - k.a[1])) * n_words as ha, greatest(k.a[iw + 13] - 3 * (k.a[1] - k.a[iw + 13]), 0) * n_words as la,
    (k.b[iw] + 3 * (k.b[iw] - k.b[1])) * n_words as hb, (k.c[nw] + 3 * (k.c[nw] - k.c[1])) * n_lines as hc,
    (k.e[nw] + 3 * (k.e[nw] - k.e[1])) * n_words as he from i)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed
    and not coalesce(word_chars > ha + 3.1e0 * sqrt(ha + 3.1e0 * 3.1e0), false)
    and not coalesce(word_chars < la - 3.1e0 * sqrt(la + 3.1e0 * 3.1e0), false)
    and not coalesce(n_symbols > hb + 3.1e0 * sqrt(hb + 3.1e0 * 3.1e0), false)
    and not coalesce(n_dup_lines > hc + 3.1e0 * sqrt(hc + 3.1e0 * 3.1e0), false)
    and not coalesce(n_repeat_words > he + 3.1e0 * sqrt(he + 3.1e0 * 3.1e0), false) as kept
from x
"""


def oracle_sql() -> dict[str, str]:
    share = lambda n, of: ", ".join(f"{(n + i) / of}::double" for i in range(of - n + 1))
    low = ", ".join(f"{(12 - i) / 64}::double" for i in range(13))
    ladders = {"wide": share(52, 64), "low": low, "narrow": share(1016, 1024)}
    sql = _OP8_SQL
    for name, ranks in ladders.items():
        sql = sql.replace(f"{{{name}}}", ranks)
    return {"op8_quality": sql}
