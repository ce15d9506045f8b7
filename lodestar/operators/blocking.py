"""Candidate pairs by a union of equi-joins on blocking keys, and metrics of them."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Blocking, Schema
from lodestar.functions import text as T
from lodestar.sources.shared import written, written_dealt

PAIR = ("reference_source", "reference_entity_id", "candidate_source", "candidate_entity_id")
#: The chunk of a pair's reference id. Pairs that have it lie dealt by it, and are joined to other tables where they lie.
CHUNK = "chunk"
# The setting that switches a method on; the others need none.
_SWITCHES = {
    "normalized_name_exact": "use_exact_name", "name_token": "use_name_tokens", "name_prefix": "use_name_tokens", "address_token": "use_address_tokens",
    "name_ngram": "use_ngrams", "address_ngram": "use_ngrams", "name_phonetic": "use_phonetic", "country_name": "use_combined", "country_address": "use_combined",
}
#: Larger than any coded rank.
_NO_LIMIT = (1 << 63) - 1


def key_arrays(settings: Blocking = Blocking()) -> dict[str, Column]:
    """For each method, the keys of a prepared record."""
    long = lambda c: F.filter(F.col(c), lambda t: F.length(t) >= settings.minimum_token_length)
    none = F.array().cast("array<string>")
    one = lambda ok, key: F.when(ok, F.array(key)).otherwise(none)
    when = lambda flag, keys: keys if flag else none
    name, address, country = F.col("name_normalized"), F.col("address_normalized"), F.col("country_normalized")
    names = long("name_tokens")
    both = lambda x: one((country != "") & (x != ""), F.concat_ws("|", country, x))
    return {
        "normalized_name_exact": when(settings.use_exact_name, one(name != "", name)),
        "name_token": when(settings.use_name_tokens, names),
        "address_token": when(settings.use_address_tokens, long("address_tokens")),
        "postal_token": F.array_distinct(long("address_postal_tokens")),
        "locality_token": long("address_locality_tokens"),
        "name_prefix": when(settings.use_name_tokens, F.transform(F.slice(F.array_sort(names), 1, 1), lambda t: F.left(t, F.lit(settings.ngram_size)))),
        "name_ngram": when(settings.use_ngrams, T.ngrams(name, settings.ngram_size)),
        "address_ngram": when(settings.use_ngrams, T.ngrams(address, settings.ngram_size)),
        "name_phonetic": when(settings.use_phonetic, one(name != "", T.phonetic(name))),
        "country_name": when(settings.use_combined, both(name)),
        "country_address": when(settings.use_combined, both(address)),
    }


def block_keys(
    records: DataFrame, methods: Sequence[str], settings: Blocking = Blocking(), schema: Schema = Schema(), also: Sequence[str] = ()
) -> DataFrame:
    """One row per record, method and key: (method, key, source, entity_id, country), and the columns ``also``. Only these travel to the joins."""
    arrays = key_arrays(settings)

    def named(m: str) -> Column:
        return F.transform(arrays[m], lambda k: F.struct(F.lit(m).alias("method"), k.alias("key")))

    keyed = F.flatten(F.array(*[named(m) for m in methods]))
    return records.select(
        F.col("source"), T.text_of(F.col(schema.entity_id)).alias("entity_id"), F.col("country_normalized").alias("country"), *also, F.explode(keyed).alias("k")
    ).select("k.method", "k.key", "source", "entity_id", "country", *also)


def _gate(settings: Blocking) -> Column:
    """Countries rc and cc don't differ."""
    return (F.col("rc") == "") | (F.col("cc") == "") | (F.col("rc") == F.col("cc")) if settings.use_country else F.lit(True)


def block(
    reference: DataFrame, candidates: DataFrame, methods: Sequence[str], settings: Blocking = Blocking(), schema: Schema = Schema()
) -> DataFrame:
    """Pairs that share a key of a method, and (if asked for) don't name different countries; one row per pair and method."""
    left = block_keys(reference, methods, settings, schema).select(
        "method", "key", F.col("source").alias(PAIR[0]), F.col("entity_id").alias(PAIR[1]), F.col("country").alias("rc")
    )
    right = block_keys(candidates, methods, settings, schema).where(F.col("entity_id") != "").select(
        "method", "key", F.col("source").alias(PAIR[2]), F.col("entity_id").alias(PAIR[3]), F.col("country").alias("cc")
    )
    return left.join(right, ["method", "key"]).where(_gate(settings)).select(*PAIR, "method")


def block_by_exact_name(reference, candidates, settings=Blocking(), schema=Schema()):
    return block(reference, candidates, ["normalized_name_exact"], settings, schema)


def block_by_name_tokens(reference, candidates, settings=Blocking(), schema=Schema()):
    return block(reference, candidates, ["name_token", "name_prefix"], settings, schema)


def block_by_address_tokens(reference, candidates, settings=Blocking(), schema=Schema()):
    return block(reference, candidates, ["address_token"], settings, schema)


def block_by_ngrams(reference, candidates, settings=Blocking(use_ngrams=True), schema=Schema()):
    return block(reference, candidates, ["name_ngram", "address_ngram"], settings, schema)


def block_by_composite_keys(reference, candidates, settings=Blocking(), schema=Schema()):
    return block(reference, candidates, ["country_name", "country_address"], settings, schema)


def merged(pairs: DataFrame) -> DataFrame:
    """One row per pair with its methods, sorted."""
    return pairs.groupBy(*PAIR).agg(F.array_sort(F.collect_set("method")).alias("blocking_methods"))


def deduplicate_candidates(pairs: DataFrame) -> DataFrame:
    """The union of the methods of repeated pairs, by pair."""
    return pairs.groupBy(*PAIR).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocking_methods")))).alias("blocking_methods"))


def _spread(n: int) -> list[int]:
    """For each of n partitions an integer that Spark's hash partitioning (Murmur3, seed 42) deals to it."""
    def turned(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    def hashed(x: int) -> int:
        h = turned(42 ^ (turned(x * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(hashed(x) % n, x)
        x += 1
    return [found[i] for i in range(n)]


def _chunk(reference_id: str, n: int) -> Column:
    """One of n chunks by the reference id, each of which goes to a partition of its own."""
    return F.element_at(F.lit(_spread(n)), (F.pmod(F.xxhash64(reference_id), F.lit(n)) + 1).cast("int")).alias(CHUNK, metadata={"chunks": n})


def beside(pairs: DataFrame, other: DataFrame, reference_id: str = PAIR[1]) -> tuple[DataFrame, list[str]]:
    """``other`` dealt as ``pairs`` are, and what else to join them by; as it is if the pairs have no chunks."""
    if CHUNK not in pairs.columns:
        return other, []
    n = pairs.schema[CHUNK].metadata["chunks"]
    return other.withColumn(CHUNK, _chunk(reference_id, n)).repartition(n, CHUNK), [CHUNK]


def _first(k: int, bits: int):
    """For a chunk, the first k candidates of each reference record with the bits of all their methods.

    Of its keys (left) and the candidates of each key (right), as ranks followed by the bit of the method.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(CHUNK, pa.int32()), (PAIR[0], pa.string()), (PAIR[1], pa.string()), ("codes", pa.list_(pa.int64()))])
        lists: dict[tuple, list] = {}
        codes = right["codes"].combine_chunks() if right.num_rows else pa.array([], pa.list_(pa.int64()))
        flat, ends = codes.flatten().to_numpy(zero_copy_only=False), np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        for key, end in zip(zip(*(right[c].to_pylist() for c in ("of_method", "of_key", "of_rc"))), ends.tolist()):
            lists.setdefault(key, []).append(flat[start:end])
            start = end
        met: dict[tuple, tuple[int, list]] = {}
        for source, name, limit, *key in zip(*(left[c].to_pylist() for c in (PAIR[0], PAIR[1], "limit", "method", "key", "rc"))):
            if own := lists.get(tuple(key)):
                met.setdefault((source, name), (limit, []))[1].extend(own)
        out = []
        for limit, parts in met.values():
            c = np.concatenate(parts)
            c = np.sort(c[c < limit])
            rank = c >> bits
            at = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            out.append(((rank[at] << bits) | np.bitwise_or.reduceat(c & ((1 << bits) - 1), at))[:k])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        chunk = left[CHUNK][0].as_py() if left.num_rows else 0
        columns = [
            pa.array([chunk] * len(met), pa.int32()), pa.array([s for s, _ in met], pa.string()), pa.array([i for _, i in met], pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.array([], np.int64), pa.int64())),
        ]
        return pa.table(columns, schema=schema)

    return run


def _methods_of(mask: Column, methods: Sequence[str]) -> Column:
    """The names of the bits that are set; looked up, six bits at a time."""
    parts = []
    for at in range(0, len(methods), 6):
        own = methods[at : at + 6]
        names = [F.array(*[F.lit(m) for j, m in enumerate(own) if i >> j & 1]).cast("array<string>") for i in range(1 << len(own))]
        parts.append(F.element_at(F.array(*names), F.shiftright(mask, at).bitwiseAND(F.lit((1 << len(own)) - 1)).cast("int") + 1))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _joined_methods(mask: Column, methods: Sequence[str], separator: str) -> Column:
    """``_methods_of`` as text, in one look-up."""
    return F.element_at(F.lit([separator.join(m for j, m in enumerate(methods) if i >> j & 1) for i in range(1 << len(methods))]), mask.cast("int") + 1)


#: Pairs that a worker gathers before it hands them on.
_PAIRS_AT_ONCE = 200_000
#: A key of more than one in so many candidates is kept as a bit set.
_RARE = 128
#: Bits of a code below the number of its reference record.
_BELOW = 40
_MET = ("reference_sources", "reference_ids", "candidate_sources", "candidate_ids")


def _met(methods: int):
    """For each cell its candidate records, then its reference records: names of some of both, and the pairs that share a key.

    A pair is one number: of the reference record, of the candidate and the bits of the methods. Names are not repeated for it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.list_(pa.string())) for c in _MET] + [("codes", pa.list_(pa.int64()))])
        kind = np.uint8 if methods <= 8 else np.uint32
        cell, known, index, last, masks = None, [], None, None, None
        own: tuple[list, list, list] = ([], [], [])
        waiting = 0

        def one(values, of) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of))

        def indexed() -> tuple:
            names = dict.fromkeys((s, i) for s, i, _, _ in known)
            at = {name: j for j, name in enumerate(names)}
            group = np.array([at[s, i] for s, i, _, _ in known], np.int64)
            lists: list[dict[str, list]] = [{} for _ in range(methods)]
            for j, (_, _, _, keys) in enumerate(known):
                for of_key, text in zip(lists, keys):
                    for key in text.split("\n")[1:]:
                        of_key.setdefault(key, []).append(j)

            def kept(v: list) -> int | np.ndarray:
                if len(v) * _RARE <= len(known):
                    return np.array(v, np.int32)
                flags = np.zeros(len(known), np.uint8)
                flags[v] = 1
                return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

            lists = [{k: kept(v) for k, v in of_key.items()} for of_key in lists]
            countries = np.array([c for _, _, c, _ in known], object)
            sides = [one([x[i] for x in names], pa.string()) for i in (0, 1)]
            return lists, countries, group if len(names) < len(known) else None, len(names), sides, {}

        def shared(keys: list[str], country: str, gated: bool) -> np.ndarray:
            """For each candidate the bits of the methods that it shares a key of."""
            lists, countries, group, n, _, compatible = index
            mask = np.zeros(len(known), kind)
            for j, (of_key, text) in enumerate(zip(lists, keys)):
                common, rare = 0, []
                for key in text.split("\n")[1:]:
                    if (at := of_key.get(key)) is not None:
                        if type(at) is int:
                            common |= at
                        else:
                            rare.append(at)
                if common:
                    bits = np.frombuffer(common.to_bytes(len(known) + 7 >> 3, "little"), np.uint8)
                    mask |= np.unpackbits(bits, count=len(known), bitorder="little").astype(kind, copy=False) << kind(j)
                if rare:
                    mask[np.concatenate(rare)] |= kind(1 << j)
            if gated and country != "":
                if country not in compatible:
                    compatible[country] = ((countries == "") | (countries == country)).astype(kind)
                mask *= compatible[country]
            if group is not None:
                whole = np.zeros(n, kind)
                np.bitwise_or.at(whole, group, mask)
                mask = whole
            return mask

        def closed() -> int:
            """The last reference id is whole."""
            hits = np.flatnonzero(masks)
            if len(hits):
                own[2].append(hits << methods | masks[hits] | len(own[0]) << _BELOW)
                own[0].append(last[0])
                own[1].append(last[1])
            return len(hits)

        def flushed() -> pa.RecordBatch:
            columns = [one(own[0], pa.string()), one(own[1], pa.string()), *index[4], one(np.concatenate(own[2]), pa.int64())]
            for x in own:
                x.clear()
            return pa.record_batch(columns, schema=schema)

        for batch in batches:
            for c, side, gated, source, name, country, *keys in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if last is not None and (c != cell or side == 0 or (source, name) != last):
                    waiting += closed()
                    last = None
                    # a row has the names of all candidates of its cell, but is taken apart in one go
                    if own[0] and (c != cell or waiting >= min(_PAIRS_AT_ONCE, max(20_000, 2 * len(known)))):
                        yield flushed()
                        waiting = 0
                if c != cell:
                    cell, known, index = c, [], None
                if side == 0:
                    known.append((source, name, country, keys))
                    continue
                index = indexed() if index is None else index
                mask = shared(keys, country, gated)
                masks = mask if last is None else masks | mask
                last = (source, name)
        if last is not None:
            closed()
        if own[0]:
            yield flushed()

    return run


def blocked(
    reference: DataFrame, candidates: DataFrame, methods: Sequence[str], settings: Blocking = Blocking(), schema: Schema = Schema(), separator: str | None = None
) -> DataFrame:
    """``merged(block(...))``: all pairs that share a key of a method, with their methods (as text with a separator); no pair is dealt out.

    References and candidates are each dealt to so many slices by their ids, and every two slices meet in a task of
    their own. What is dealt out grows with the records and the square root of the partitions, however many pairs there are.
    """
    methods, arrays = sorted(methods), key_arrays(settings)
    side = max(1, math.ceil(math.sqrt(int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    cells = F.lit(_spread(side * side))

    def dealt(df: DataFrame, which: int) -> DataFrame:
        own = F.pmod(F.xxhash64("entity_id"), F.lit(side)).cast("int")
        cell = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda x: F.element_at(cells, (x * side + own if which == 0 else own * side + x) + 1))
        # every key stands behind a line feed, which no normalised text holds
        texts = [F.array_join(F.transform(arrays[m], lambda k: F.concat(F.lit("\n"), k)), "").alias(f"k{i}") for i, m in enumerate(methods)]
        rows = df.select("source", T.text_of(F.col(schema.entity_id)).alias("entity_id"), F.col("country_normalized").alias("country"), *texts)
        rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"k{i}") != "" for i in range(len(methods))]))
        return rows.select(F.explode(cell).alias("cell"), F.lit(which).alias("side"), F.lit(settings.use_country).alias("gated"), "*")

    rows = dealt(candidates, 0).where("entity_id <> ''").unionByName(dealt(reference, 1))
    rows = rows.repartition(side * side, "cell").sortWithinPartitions("cell", "side", "source", "entity_id")
    kinds = ", ".join(f"{c} array<string>" for c in _MET) + ", codes array<bigint>"
    pairs = rows.mapInArrow(_met(len(methods)), kinds).select(*_MET, F.explode("codes").alias("code"))
    l = F.shiftright("code", _BELOW).cast("int")
    r = F.shiftright(F.col("code").bitwiseAND(F.lit((1 << _BELOW) - 1)), len(methods)).cast("int")
    mask = F.col("code").bitwiseAND(F.lit((1 << len(methods)) - 1))
    names = [F.get(c, at).alias(name) for c, at, name in zip(_MET, (l, l, r, r), PAIR)]
    return pairs.select(*names, (_methods_of(mask, methods) if separator is None else _joined_methods(mask, methods, separator)).alias("blocking_methods"))


def _ranked(candidates: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """The ranks of candidates by (source, id), written, and the candidates with theirs."""
    # written, as ranks may come out otherwise when they are made again
    ids = [F.col("source"), T.text_of(F.col(schema.entity_id)).alias("entity_id")]
    ranks = written(candidates.select(*ids).where("entity_id <> ''").distinct().orderBy("source", "entity_id").withColumn("rank", F.monotonically_increasing_id()))
    own = ranks.select(F.col("source").alias("__s"), F.col("entity_id").alias("__e"), "rank")
    return ranks, candidates.join(own, F.col("source").eqNullSafe(F.col("__s")) & (T.text_of(F.col(schema.entity_id)) == F.col("__e"))).drop("__s", "__e")


def chunked_candidates(
    reference: DataFrame, candidates: DataFrame, settings: Blocking = Blocking(), schema: Schema = Schema(), fields: Sequence[str] = ()
) -> DataFrame:
    """The pairs of ``generate_candidates`` with CHUNK, and ``fields`` of both records as l_ and r_ columns.

    Pairs are never dealt out one by one. Candidates are ranked by (source, id); each method, key and country keeps its
    first ``max_candidates``, which is enough: a record that comes after so many others of a key it shares comes after
    them among all candidates too. Where a key of a reference record has that many, nothing after the last of them
    matters for any of its keys. Each chunk of reference records gets, once, what it needs of the candidates of its keys,
    finds the first ones of each record in one task, and gets the fields of each candidate once.
    ``reference`` and ``candidates`` are read several times, so they should be written ones.
    """
    spark, k = reference.sparkSession, settings.max_candidates
    # pairs that lie dealt by chunk are joined there; else Spark deals both sides out again by all columns of a join
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    methods, n = sorted(settings.probed), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits, ids = len(methods), [F.col("source"), T.text_of(F.col(schema.entity_id)).alias("entity_id")]
    ranks, ranked = _ranked(candidates, schema)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, 1 << i)]), F.col("method"))
    keyed = block_keys(ranked, methods, settings, schema, ["rank"]).select("method", "key", F.col("country").alias("cc"), (F.shiftleft("rank", bits) + bit).alias("code"))
    # a rank limit is applied before the exchange as well, so a common key sends few rows from each task
    order = Window.partitionBy("method", "key", "cc").orderBy("code")
    kept = keyed.withColumn("__n", F.dense_rank().over(order)).where(F.col("__n") <= k)
    posted = written(kept.groupBy("method", "key", "cc").agg(F.sort_array(F.collect_set("code")).alias("codes")))
    full = posted.where(F.size("codes") >= k).select("method", "key", "cc", F.shiftleft(F.shiftright(F.element_at("codes", -1), bits) + 1, bits).alias("limit"))
    asked = block_keys(reference, methods, settings, schema).select(
        _chunk("entity_id", n), F.col("source").alias(PAIR[0]), F.col("entity_id").alias(PAIR[1]), F.col("country").alias("rc"), "method", "key"
    )
    asked = written_dealt(asked.repartition(n, CHUNK), CHUNK, n)
    # each chunk asks once for the limits of a key
    of_key = [CHUNK, "rc", "method", "key"]
    limits = asked.select(*of_key).distinct().join(full, ["method", "key"]).where(_gate(settings)).groupBy(*of_key).agg(F.min("limit").alias("limit"))
    limits = limits.withColumnsRenamed({c: f"of_{c}" for c in of_key}).repartition(n, f"of_{CHUNK}").hint("shuffle_hash")
    limits = asked.join(limits, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"of_{c}") for c in of_key])).groupBy(CHUNK, *PAIR[:2]).agg(F.min("limit").alias("limit"))
    limits = limits.select(F.col(CHUNK).alias("__c"), F.col(PAIR[0]).alias("__s"), F.col(PAIR[1]).alias("__e"), "limit").hint("shuffle_hash")
    same = (F.col(CHUNK) == F.col("__c")) & F.col(PAIR[0]).eqNullSafe(F.col("__s")) & (F.col(PAIR[1]) == F.col("__e"))
    asked = asked.join(limits, same, "left").select(CHUNK, *PAIR[:2], "rc", "method", "key", F.coalesce("limit", F.lit(_NO_LIMIT)).alias("limit"))
    needed = asked.groupBy(*of_key).agg(F.max("limit").alias("limit"))
    lists = needed.join(posted, ["method", "key"]).where(_gate(settings)).select(CHUNK, "rc", "method", "key", F.filter("codes", lambda x: x < F.col("limit")).alias("codes"))
    lists = lists.where(F.size("codes") > 0).withColumnsRenamed({c: f"of_{c}" for c in (CHUNK, "rc", "method", "key")})
    lists = lists.repartition(n, f"of_{CHUNK}")
    grouped = asked.groupBy(CHUNK).cogroup(lists.groupBy(f"of_{CHUNK}")).applyInArrow(_first(k, bits), f"{CHUNK} int, {PAIR[0]} string, {PAIR[1]} string, codes array<bigint>")
    grouped = written_dealt(grouped, CHUNK, n).withColumn(CHUNK, F.col(CHUNK).alias(CHUNK, metadata={"chunks": n}))
    rank = F.shiftright("code", bits).alias("rank")
    needed = grouped.select(CHUNK, F.explode("codes").alias("code")).select(CHUNK, rank).distinct()
    known = ranked if fields else ranks
    known = known.select("rank", F.col("source").alias(PAIR[2]), (ids[1] if fields else F.col("entity_id")).alias(PAIR[3]), *[F.col(f).alias(f"r_{f}") for f in fields])
    known = needed.join(known, "rank").repartition(n, CHUNK).hint("shuffle_hash")
    rows = grouped
    if fields:
        mine = reference.select(F.col("source").alias("__s"), ids[1].alias("__e"), *[F.col(f).alias(f"l_{f}") for f in fields])
        mine = mine.withColumn("__c", _chunk("__e", n)).repartition(n, "__c").hint("shuffle_hash")
        rows = rows.join(mine, same).drop("__c", "__s", "__e")
    sides = [f"{s}_{f}" for s in "lr" for f in fields]
    rows = rows.select(CHUNK, *PAIR[:2], *sides[: len(fields)], F.explode("codes").alias("code")).withColumn("rank", rank)
    mask = F.col("code").bitwiseAND(F.lit((1 << bits) - 1))
    return rows.join(known, [CHUNK, "rank"]).select(*PAIR, _methods_of(mask, methods).alias("blocking_methods"), *sides, CHUNK)


def _first_of_runs(sets: Sequence[tuple[int, frozenset[str]]], k: int):
    """For a chunk and each run, by its number and methods, over the first k candidates of each reference record.

    n: pairs; seen: ranks of the candidates, once each; hit_ref, hit_rank: pairs that are links. Of the reference records with
    their keys, rank limits by run and linked ranks (left), and the ranks of each key (right).
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("run", pa.int32()), ("n", pa.int64()), ("seen", pa.list_(pa.int64())), ("hit_ref", pa.list_(pa.string())), ("hit_rank", pa.list_(pa.int64()))])
        lists: dict[tuple, list] = {}
        ranks = right["ranks"].combine_chunks() if right.num_rows else pa.array([], pa.list_(pa.int64()))
        flat, ends = ranks.flatten().to_numpy(zero_copy_only=False), np.cumsum(ranks.value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        for key, end in zip(zip(*(right[c].to_pylist() for c in ("of_method", "of_key", "of_rc"))), ends.tolist()):
            lists.setdefault(key, []).append(flat[start:end])
            start = end
        n, seen, waiting, hits = [0] * len(sets), [[] for _ in sets], [0] * len(sets), [([], []) for _ in sets]
        keys = left["keys"].combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.struct([(c, pa.string()) for c in ("method", "key", "rc")])))
        fields = list(zip(*(keys.flatten().field(c).to_pylist() for c in ("method", "key", "rc"))))
        start = 0
        for name, limits, linked, size in zip(left[PAIR[1]].to_pylist(), left["limits"].to_pylist(), left["linked"].to_pylist(), keys.value_lengths().to_pylist()):
            parts: dict[str, list] = {}
            for key in fields[start : start + size]:
                if own := lists.get(key):
                    parts.setdefault(key[0], []).extend(own)
            start += size
            for i, (_, methods) in enumerate(sets):
                if not (own := [x for m in methods if m in parts for x in parts[m]]):
                    continue
                c = np.concatenate(own)
                c = np.unique(c[c < limits[i]])[:k]
                n[i] += len(c)
                seen[i].append(c)
                waiting[i] += len(c)
                if waiting[i] > _PAIRS_AT_ONCE:
                    seen[i], waiting[i] = [np.unique(np.concatenate(seen[i]))], 0
                if linked:
                    met = np.intersect1d(c, linked)
                    hits[i][0].extend([name] * len(met))
                    hits[i][1].extend(met.tolist())
        whole = [np.unique(np.concatenate(x)) if x else np.array([], np.int64) for x in seen]
        return pa.table([[r for r, _ in sets], n, whole, [a for a, _ in hits], [b for _, b in hits]], schema=schema)

    return run


def compared(
    reference: DataFrame, candidates: DataFrame, links: DataFrame, runs: Sequence[Blocking], schema: Schema = Schema()
) -> tuple[DataFrame, DataFrame]:
    """What ``blocking_metrics`` needs of the candidates of each run, with no pair dealt out.

    First run, n, seen: the pairs of each run that has any, and the distinct ids of their candidates. Then run,
    reference_entity_id, candidate_entity_id: the links that each run finds, once each. Runs are numbers from 0. Runs that make the
    same keys of records share one pass: keys are made, ranked and dealt to chunks as ``chunked_candidates`` does, once for all.
    """
    spark, n = reference.sparkSession, int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    ranks, ranked = _ranked(candidates, schema)
    linked = links.select(F.col(PAIR[1]).alias("__e"), F.col(PAIR[3]).alias("entity_id")).join(ranks, "entity_id").groupBy("__e").agg(F.collect_set("rank").alias("linked"))
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(runs):
        alike.setdefault((s.ngram_size, s.minimum_token_length, s.use_country, s.max_candidates), []).append(i)
    rows = None
    for numbers in alike.values():
        settings = dataclasses.replace(runs[numbers[0]], **{s: True for s in _SWITCHES.values()})
        sets = [(i, frozenset(m for m in runs[i].probed if m not in _SWITCHES or getattr(runs[i], _SWITCHES[m]))) for i in numbers]
        methods, k = sorted(set().union(*(m for _, m in sets))), settings.max_candidates
        keyed = block_keys(ranked, methods, settings, schema, ["rank"]).select("method", "key", F.col("country").alias("cc"), "rank")
        kept = keyed.withColumn("__n", F.dense_rank().over(Window.partitionBy("method", "key", "cc").orderBy("rank"))).where(F.col("__n") <= k)
        posted = written(kept.groupBy("method", "key", "cc").agg(F.sort_array(F.collect_set("rank")).alias("ranks")))
        full = posted.where(F.size("ranks") >= k).select(F.col("method").alias("__m"), F.col("key").alias("__k"), "cc", (F.element_at("ranks", -1) + 1).alias("limit"))
        asked = block_keys(reference, methods, settings, schema).select(
            _chunk("entity_id", n), F.col("source").alias(PAIR[0]), F.col("entity_id").alias(PAIR[1]), F.col("country").alias("rc"), "method", "key"
        )
        asked = asked.join(full, (F.col("method") == F.col("__m")) & (F.col("key") == F.col("__k")) & _gate(settings), "left").repartition(n, CHUNK)
        least = [F.coalesce(F.min(F.when(F.col("method").isin(*m), F.col("limit"))), F.lit(_NO_LIMIT)) for _, m in sets]
        asked = asked.groupBy(CHUNK, *PAIR[:2]).agg(F.collect_set(F.struct("method", "key", "rc")).alias("keys"), F.array(*least).alias("limits"))
        asked = written(asked.join(linked, F.col(PAIR[1]) == F.col("__e"), "left").drop("__e"))
        most = [(m, F.greatest(*[F.col("limits")[i] for i, (_, own) in enumerate(sets) if m in own], F.lit(0))) for m in methods]
        limit = reduce(lambda c, x: c.when(F.col("k.method") == x[0], x[1]), most[1:], F.when(F.col("k.method") == most[0][0], most[0][1]))
        needed = asked.select(CHUNK, "limits", F.explode("keys").alias("k")).groupBy(CHUNK, "k.rc", "k.method", "k.key").agg(F.max(limit).alias("limit"))
        lists = needed.join(posted, ["method", "key"]).where(_gate(settings)).select(CHUNK, "rc", "method", "key", F.filter("ranks", lambda x: x < F.col("limit")).alias("ranks"))
        lists = lists.where(F.size("ranks") > 0).withColumnsRenamed({c: f"of_{c}" for c in (CHUNK, "rc", "method", "key")})
        own = asked.groupBy(CHUNK).cogroup(lists.groupBy(f"of_{CHUNK}")).applyInArrow(
            _first_of_runs(sets, k), "run int, n bigint, seen array<bigint>, hit_ref array<string>, hit_rank array<bigint>"
        )
        rows = own if rows is None else rows.unionByName(own)
    rows = written(rows)
    seen = rows.select("run", F.explode("seen").alias("rank")).distinct().join(ranks, "rank").groupBy("run").agg(F.count_distinct("entity_id").alias("seen"))
    hits = rows.select("run", F.explode(F.arrays_zip("hit_ref", "hit_rank")).alias("h")).select("run", F.col("h.hit_ref").alias(PAIR[1]), F.col("h.hit_rank").alias("rank"))
    found = hits.join(ranks, "rank").select("run", PAIR[1], F.col("entity_id").alias(PAIR[3])).distinct()
    return rows.groupBy("run").agg(F.sum("n").alias("n")).join(seen, "run"), written(found)


def generate_candidates(reference: DataFrame, candidates: DataFrame, settings: Blocking = Blocking(), schema: Schema = Schema()) -> DataFrame:
    """Pairs from all probed methods; each reference record keeps its first ``max_candidates`` by (source, id)."""
    return chunked_candidates(reference, candidates, settings, schema).drop(CHUNK)


def found_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The links that are among the pairs, once each."""
    links, more = beside(pairs, links.select(PAIR[1], PAIR[3]))
    ids = [PAIR[1], PAIR[3], *more]
    return pairs.select(*ids).join(links.hint("shuffle_hash") if more else links, ids, "left_semi").select(PAIR[1], PAIR[3]).distinct()


def truth_links(truth: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """One row per true link: (reference_entity_id, candidate_entity_id)."""
    ids = F.filter(F.split(T.text_of(F.col(schema.truth_matches)), ","), lambda x: x != "")
    return truth.select(F.col(schema.truth_id).alias(PAIR[1]), F.explode(ids).alias(PAIR[3])).distinct()


def blocking_metrics(pairs: DataFrame, links: DataFrame, n_references: int | None = None, universe: int | None = None) -> DataFrame:
    """One row: candidate_recall, number_of_candidates, average_candidates_per_reference, candidate_reduction_ratio.

    The ratio is of references times ``universe``, or times the distinct candidate ids met where that isn't given.
    """
    own = found_links(pairs, links).withColumn("hit", F.lit(1))
    recall = links.join(own, [PAIR[1], PAIR[3]], "left").agg(
        F.coalesce(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))), F.lit(1.0)).alias("candidate_recall"),
        F.count_distinct(PAIR[1]).alias("linked"),
    )
    volume = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(PAIR[3]).alias("seen"))
    refs = F.greatest(F.lit(1), F.lit(n_references) if n_references is not None else F.col("linked"))
    whole = refs * (F.lit(universe) if universe is not None else F.col("seen"))
    # two tables of one row each
    return recall.crossJoin(F.broadcast(volume)).select("candidate_recall", *volume_metrics(refs, whole))


def volume_metrics(refs: Column, whole: Column) -> list[Column]:
    """Of n pairs of so many references, out of so many possible pairs."""
    return [
        F.col("n").cast("double").alias("number_of_candidates"), (F.col("n") / refs).alias("average_candidates_per_reference"),
        F.coalesce(1 - F.try_divide(F.col("n"), whole), F.lit(0.0)).alias("candidate_reduction_ratio"),
    ]


def recall_by_method(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """method, hits, recall: the share of all links that each method alone finds."""
    total = links.agg(F.count(F.lit(1)).alias("total"))
    own, more = beside(pairs, links.select(PAIR[1], PAIR[3]))
    ids = [PAIR[1], PAIR[3], *more]
    met = pairs.select(*ids, "blocking_methods").join(own.hint("shuffle_hash") if more else own, ids, "left_semi")
    hits = met.select(*ids, F.explode("blocking_methods").alias("method")).distinct().groupBy("method").agg(F.count(F.lit(1)).alias("hits"))
    methods = pairs.select("blocking_methods").distinct().select(F.explode("blocking_methods").alias("method")).distinct()
    return methods.join(hits, "method", "left").crossJoin(F.broadcast(total)).select(
        "method", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), "total"), F.lit(1.0)).alias("recall")
    )


def missed_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(found_links(pairs, links), [PAIR[1], PAIR[3]], "left_anti")


def recall_by_country(pairs: DataFrame, links: DataFrame, reference: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """country, links, hits, recall by the reference record's country."""
    own = found_links(pairs, links).withColumn("hit", F.lit(1))
    country = reference.select(F.col(schema.entity_id).alias(PAIR[1]), F.col(schema.country).alias("country"))
    return (
        links.join(own, [PAIR[1], PAIR[3]], "left").join(country, PAIR[1]).groupBy("country")
        .agg(F.count(F.lit(1)).alias("links"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
        .withColumn("recall", F.col("hits") / F.col("links"))
    )


def singletons_with_candidates(pairs: DataFrame, links: DataFrame, reference: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """One row: reference records without a true link, and how many of them got candidates all the same."""
    alone = reference.select(F.col(schema.entity_id).alias(PAIR[1])).distinct().join(links, PAIR[1], "left_anti")
    met = pairs.select(PAIR[1]).distinct().withColumn("hit", F.lit(1))
    return alone.join(met, PAIR[1], "left").agg(F.count(F.lit(1)).alias("singletons"), F.count("hit").alias("singletons_with_candidates"))


def candidates_per_reference(pairs: DataFrame, reference: DataFrame, schema: Schema = Schema()) -> DataFrame:
    """One row: references with candidates, and the mean, median and most candidates of a reference record."""
    n = pairs.groupBy(PAIR[1]).agg(F.count_distinct(PAIR[3]).alias("n"))
    return reference.select(F.col(schema.entity_id).alias(PAIR[1])).join(n, PAIR[1], "left").agg(
        F.count("n").alias("references_with_candidates"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_candidates"),
        F.median(F.coalesce("n", F.lit(0))).alias("median_candidates"), F.max(F.coalesce("n", F.lit(0))).alias("max_candidates"),
    )
