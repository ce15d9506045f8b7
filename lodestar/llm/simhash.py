"""SimHash near-duplicates by fuzzy Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import attached, connected_components
from lodestar.llm.store import written

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: (first bit, bits) of the segments of a fingerprint; each is at most the length of a Golay codeword.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A key shared by more fingerprints than this is handled by one-bit neighbourhoods instead of comparisons.
MAX_COMPARED = 256
#: Generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the perfect binary code of length 23.
GENERATOR = 0b110001110101
_HASHED_AT_ONCE = 1 << 16


def fingerprint(text: bytes, n_words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n_words, len(words))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _HASHED_AT_ONCE):
        part = hashes[at : at + _HASHED_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp): the fingerprint of each row's whole text as a signed long. A null text counts as empty."""
    key_type = docs.schema[key].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(b or b"", n_words) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(hashed, f"`{key}` {key_type}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def _errors() -> np.ndarray:
    """For each syndrome the only error pattern of three bits or fewer that has it."""
    bits = 1 << np.arange(23)
    one, two = bits, (bits[:, None] | bits).ravel()
    three = (two[:, None] | bits).ravel()
    patterns = np.unique(np.concatenate(([0], one, two, three)))
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    return (words ^ _errors()[_syndromes(words)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: two fingerprints that differ in at most two bits share a key.

    Of three segments at most two are wrong. Each key joins the bits of one segment, taken as they are, to a codeword
    index of the next. If two wrong segments differ in one bit each, the third is exact and the one after it is one
    bit off; if one segment differs in two bits, some exact segment is followed by an exact one. Words one bit apart
    have an index in common among those of their one-bit neighbourhoods, which has one index or six.
    """
    parts = [(fps.view(np.uint64) >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    flips = np.concatenate(([0], 1 << np.arange(23)))
    rows, keys = [], []
    for i, exact in enumerate(parts):
        near = parts[(i + 1) % 3]
        n_bits = SEGMENTS[(i + 1) % 3][1]
        around = codeword_indices((near[:, None] ^ flips[: n_bits + 1]).ravel()).reshape(len(fps), -1)
        around.sort(axis=1)
        first = np.concatenate([np.ones((len(fps), 1), bool), around[:, 1:] != around[:, :-1]], axis=1)
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((np.int64(i) << 60) | (exact[row] << 12) | around[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs (a, b) over nodes 0 to n - 1."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def close_pairs(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs under one key that differ in ``max_bits`` or fewer; ``keys`` is sorted."""
    left, right, at, step = [], [], np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        hit = at[np.bitwise_count((fps[at] ^ fps[at + step]).view(np.uint64)) <= max_bits]
        left.append(hit)
        right.append(hit + step)
        step += 1
    return np.concatenate(left or [at]), np.concatenate(right or [at])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all that differ in at most ``MAX_BITS`` bits.

    ``distinct`` has one row per fingerprint (column fp). Under a key of at most ``MAX_COMPARED`` fingerprints all are
    compared and a spanning forest of the close ones is kept. A larger key would need too many comparisons; there each
    fingerprint is put under the 65 values within one bit of it. Two fingerprints are within two bits exactly if they
    share such a value, so all under one value are linked to its smallest: no pair is lost and none is listed.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                rows, keys = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["k", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batch: pa.Table) -> pa.RecordBatch:
            keys, fps = batch.column("k").to_numpy(), batch.column("fp").to_numpy()
            left, right = close_pairs(keys, fps)
            left, right = _forest(left, right, len(fps))
            return pa.RecordBatch.from_arrays([pa.array(fps[left]), pa.array(fps[right])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last key of a batch may go on in the next
            keys = batch.column("k").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    keyed = written(distinct.select("fp").mapInArrow(spread, "k long, fp long"))
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = keyed.join(sizes.where(F.col("n") <= MAX_COMPARED).select("k"), "k", "left_semi")
    few = few.repartition("k").sortWithinPartitions("k").mapInArrow(compared, "a long, b long")
    many = keyed.join(sizes.where(F.col("n") > MAX_COMPARED).select("k"), "k", "left_semi").select("fp").distinct()
    ball = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("w"))
    hubs = ball.groupBy("w").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "b")
    stars = ball.join(hubs, "w").select(F.col("fp").alias("a"), "b").where("a <> b")
    return few.unionByName(stars).distinct()


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, fp, component): component is the smallest key that a row reaches over links of two bits or fewer.

    Equal fingerprints are one node, made before any exchange, so a group of copies of any size costs one row. Rows
    with equal keys are each returned; texts without words all share fingerprint 0; a null key stands alone in no
    group's minimum. An empty table gives an empty result.
    """
    hashed = written(fingerprints(docs, key, text, n_words))
    nodes = written(hashed.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("times")))
    roots = connected_components(links(nodes))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped)
    best = written(grouped.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("nodes")))
    named = written(attached(grouped.select("fp", "times", "root"), best, "root", "nodes").select("fp", "times", "component"))
    return attached(hashed, named, "fp", "times").select(key, "fp", "component")
