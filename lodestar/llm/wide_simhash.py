"""Near-duplicates by five-word shingles: SimHash of 1,024 bits, candidates by fuzzy Golay-code keys of its segments.

At a similarity of 0.8 about one bit in seven differs, too many for the pigeonhole over 64 bits that ``simhash`` uses.
Here many independent segments each get their chance, the long fingerprint sorts out most candidates, and the shingle
sets of the others are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import attached, connected_components
from lodestar.llm.simhash import SEED, codeword_indices
from lodestar.llm.store import written

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
LANES = 16
#: Each table uses one segment's codeword indices and the first bits of the next segment. A key has 12 bits and these;
#: a much larger corpus wants more of them (one for each doubling), and more tables.
TABLES = 24
EXACT_BITS = 8
#: Differing bits among the first 128 up to which two fingerprints are candidates: 2.5 deviations above the mean at 0.8.
HEAD_BITS = 30
#: The forest of a crowded key is made of blocks of this many fingerprints, then of one of each group of every block.
BLOCK = 256
#: A key with over BLOCK fingerprints, or over this many close pairs for each, is crowded: its pairs are not listed at
#: once, but a forest of them is checked first, then every pair that the checked ones leave unconnected.
PAIRS_EACH = 2
#: Crowded keys of so many tables give forests, which is enough to connect copies of each other; those of the other
#: tables are looked at once the forests' pairs have been checked.
FOREST_TABLES = 3
_TABLE_BIT = 50
#: Pairs that a task holds before it hands them on.
_HELD = 200_000
#: The similarity is first read off the fingerprints, with a standard error of about 0.026; pairs that are short of the
#: minimum by no more than two and a half of these are compared by their shingle sets.
SLACK = 2.5 * 0.026
_CHUNK = 255 * 8
_FLIPS = np.concatenate(([0], 1 << np.arange(23)))


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """LANES well mixed words for each hash."""
    odd = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    z = (hashes[:, None] ^ (hashes >> np.uint64(32))[:, None]) * odd
    z ^= z >> np.uint64(32)
    z *= np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(29)
    return z


def shingle_hashes(text: bytes, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct XXH64 of the word shingles; fewer words than that make one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n_words, len(words))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES words of 64 bits, each bit set if it is set in over half of the shingles' mixed hashes."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(_lanes(hashes[at : at + _CHUNK]).view(np.uint8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of fingerprints (rows of LANES words): per table one key for each nearby codeword.

    Table t decodes 23 bits to the indices of all codewords that the word or one within one bit of it decodes to, so
    words within two bits mostly have an index in common, and joins them to the first bits of the next segment.
    """
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    rows, keys = [], []
    for t in range(TABLES):
        at = t * (23 + EXACT_BITS)
        near = bits[:, at : at + 23] @ (1 << np.arange(23))
        exact = bits[:, at + 23 : at + 23 + EXACT_BITS] @ (1 << np.arange(EXACT_BITS))
        around = codeword_indices((near[:, None] ^ _FLIPS).ravel()).reshape(len(fps), -1)
        around.sort(axis=1)
        first = np.concatenate([np.ones((len(fps), 1), bool), around[:, 1:] != around[:, :-1]], axis=1)
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((np.int64(t) << _TABLE_BIT) | (exact[row].astype(np.int64) << 12) | around[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _close_steps(keys: np.ndarray, heads: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distance of pairs under one key with close heads, in parts; ``keys`` is grouped.

    A position is compared with ``other`` (a position behind it) and all that follow under its key.
    """
    at = np.arange(len(keys))
    while len(at):
        inside = other < len(keys)
        at, other = at[inside], other[inside]
        same = keys[at] == keys[other]
        at, other = at[same], other[same]
        bits = np.bitwise_count((heads[at] ^ heads[other]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        hit = bits <= HEAD_BITS
        yield at[hit], other[hit], bits[hit]
        other = other + 1


def _close(keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distance of all pairs under one key with close heads; ``keys`` is grouped."""
    parts = list(_close_steps(keys, heads, np.arange(1, len(keys) + 1))) or [(np.empty(0, np.int64),) * 3]
    left, right, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    return left, right, far


def nearest_forest(keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of the close pairs under each key, the closest pairs first.

    A key with over BLOCK fingerprints is compared block by block; then the first member of every group found in a block
    is compared with those of the others. A path in the forest may use pairs that turn out not to be similar, so pairs
    that it leaves out must still be looked at where the checked ones do not connect them.
    """
    parent = np.arange(len(keys)).tolist()
    edges: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        order = np.argsort(far, kind="stable")
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((x, y))

    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    block = (np.arange(len(keys)) - start) // BLOCK
    begins = np.cumsum(new | np.concatenate(([True], block[1:] != block[:-1])))
    join(*_close(begins, heads))
    large = np.isin(start, np.unique(start[block > 0]))
    if large.any():
        tops = np.array([x for x in np.flatnonzero(large).tolist() if top(x) == x], np.int64)
        a, b, far = _close(start[tops], heads[tops])
        join(tops[a], tops[b], far)
    found = np.array(edges, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def first_pairs(keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (a, b) of all close pairs of keys that are not crowded and of a forest of the others, and which are of those.

    Of the crowded keys of all but FOREST_TABLES tables one pair each is given.
    """
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    crowded = size > BLOCK
    few = np.flatnonzero(~crowded[group])
    a, b, _ = _close(keys[few], heads[few])
    a, b = few[a], few[b]
    crowded |= np.bincount(group[a], minlength=len(size)) > PAIRS_EACH * size
    listed = ~crowded[group[a]]
    many = np.flatnonzero(crowded[group])
    if not len(many):
        return a, b, np.zeros(len(a), bool)
    c, d = nearest_forest(keys[many], heads[many])
    c, d = many[c], many[d]
    # a key of the other tables is only named, by one of its pairs
    c_keys = keys[c]
    named = np.zeros(len(c), bool)
    named[np.unique(c_keys, return_index=True)[1]] = True
    chosen = named | (c_keys >> _TABLE_BIT < FOREST_TABLES)
    c, d = c[chosen], d[chosen]
    return np.concatenate((a[listed], c)), np.concatenate((b[listed], d)), np.arange(listed.sum() + len(c)) >= listed.sum()


def pairs_across(keys: np.ndarray, roots: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), in parts, of every close pair under one key with different roots; rows are in order of key and root."""
    ends = np.flatnonzero((keys[1:] != keys[:-1]) | (roots[1:] != roots[:-1])) + 1
    behind = np.append(ends, len(keys))[np.searchsorted(ends, np.arange(len(keys)), side="right")]
    for a, b, _ in _close_steps(keys, heads, behind):
        yield a, b


def estimated(fps: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of shingle sets, from their fingerprints and sizes."""
    far = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    shared = np.cos(far * (np.pi / (64 * LANES))) * np.sqrt(sizes[a] * sizes[b].astype(float))
    return shared / (sizes[a] + sizes[b] - shared)


def at_first_key(keys: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs stand under the smallest key that both fingerprints have, so that a pair counts under one key only."""
    places, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    rows, own = fuzzy_keys(fps[places])
    own = own[np.lexsort((own, rows))]
    begins = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(places)))))
    sets = [own[x:y] for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    pairs = zip(where[: len(a)].tolist(), where[len(a) :].tolist(), strict=True)
    smallest = np.fromiter((np.intersect1d(sets[x], sets[y], assume_unique=True)[0] for x, y in pairs), np.int64, len(a))
    return keys[a] == smallest


def _keyed(nodes: DataFrame) -> DataFrame:
    """k, w0, w1 and root for every key of every node; ``nodes`` has columns fp and root."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, roots = batch.column(0).flatten().to_numpy().reshape(-1, LANES), batch.column(1).to_numpy()
            for at in range(0, len(fps), 4_000):
                part = fps[at : at + 4_000]
                rows, keys = fuzzy_keys(part)
                columns = [keys, part[rows, 0], part[rows, 1], roots[at : at + 4_000][rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "w0", "w1", "root"])

    return nodes.select("fp", "root").mapInArrow(spread, "k long, w0 long, w1 long, root long")


def _by_key(keyed: DataFrame, order: list[str], pairs: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """Nodes a and b of the pairs that ``pairs`` finds among the rows of whole keys, and k, the key where it says so."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, w0, w1 = (table.column(c).to_numpy() for c in ("k", "w0", "w1"))
            for a, b, crowded in pairs(table):
                ends = [w0[a], w1[a], w0[b], w1[b]]
                yield pa.RecordBatch.from_arrays([*(pa.array(e) for e in ends), pa.array(keys[a], mask=~crowded)], names=["a0", "a1", "b0", "b1", "k"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last key of a batch may go on in the next
            keys = batch.column("k").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(pa.Table.from_batches(held))

    found = keyed.repartition("k").sortWithinPartitions("k", *order).mapInArrow(compared, "a0 long, a1 long, b0 long, b1 long, k long")
    ids = found.select(F.xxhash64("a0", "a1").alias("x"), F.xxhash64("b0", "b1").alias("y"), "k")
    return ids.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "k")


def _heads(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("w0", "w1")], axis=1)


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs of nodes (a, b) to verify first, and for each the crowded keys that it was found under, or null.

    ``nodes`` has columns node and fp (array of LANES longs).
    """

    def listed(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield first_pairs(table.column("k").to_numpy(), _heads(table))

    keyed = _keyed(nodes.withColumn("root", F.col("node"))).select("k", "w0", "w1")
    return _by_key(keyed, ["w0", "w1"], listed).distinct()


def remaining(nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes with different roots that are likely similar, under the ``crowded`` keys (column k).

    ``nodes`` has columns node, fp, n and root.
    """

    def listed(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, n = [], 0
        fps = table.column("fp").combine_chunks().flatten().to_numpy().reshape(-1, LANES)
        sizes, keys = table.column("n").to_numpy(), table.column("k").to_numpy()
        for a, b in pairs_across(keys, table.column("root").to_numpy(), _heads(table)):
            for at in range(0, len(a), _HELD):
                x, y = a[at : at + _HELD], b[at : at + _HELD]
                alike = estimated(fps, sizes, x, y) >= MIN_SIMILARITY - SLACK
                x, y = x[alike], y[alike]
                # pairs whose first common key isn't crowded were all listed before
                once = at_first_key(keys, fps, x, y) if len(x) else alike[:0]
                held.append((x[once], y[once]))
                n += int(once.sum())
            if n >= _HELD:
                yield *(np.concatenate(x) for x in zip(*held, strict=True)), np.zeros(n, bool)
                held, n = [], 0
        if n:
            yield *(np.concatenate(x) for x in zip(*held, strict=True)), np.zeros(n, bool)

    # fingerprints are joined to the rows of crowded keys alone
    keyed = _keyed(nodes).join(crowded, "k", "left_semi").withColumn("node", F.xxhash64("w0", "w1"))
    return _by_key(keyed.join(nodes.select("node", "fp", "n"), "node"), ["root"], listed).select("a", "b").distinct()


def similarity(fa: str, na: str, fb: str, nb: str) -> F.Column:
    """Jaccard similarity of two shingle sets, estimated from their fingerprints and sizes."""
    far = F.expr(f"aggregate(zip_with({fa}, {fb}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    shared = F.cos(far * F.lit(math.pi / (64 * LANES))) * F.sqrt(F.col(na) * F.col(nb).cast("double"))
    return shared / (F.col(na) + F.col(nb) - shared)


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written rows (__key, __hash, node), one for each of ``docs``, and every node with its group's root.

    Texts are linked if the Jaccard similarity of their shingle sets is MIN_SIMILARITY or more. Those whose first 128
    fingerprint bits agree are one node, made before any exchange of keys, so copies of any number cost one; it is
    compared by the set of the text with the smallest key. Texts without words (and null ones) are copies of each other.
    """
    key_type = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), _text_hash(text).alias("__hash"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(b or b"") for b in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = pa.array([fingerprint(h) for h in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, sizes], names=["__key", "__hash", "fp", "n"])

    rows = keyed.mapInArrow(hashed, f"__key {key_type}, __hash long, fp array<long>, n long")
    rows = written(rows.withColumn("node", F.xxhash64(F.col("fp")[0], F.col("fp")[1])))
    nodes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.col("__key").isNull().alias("none"), "__key", "__hash", "n", "fp")).alias("s")).select("node", "times", "s.*"))
    worded = nodes.where("n > 0")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}"), F.col("n").alias(f"n{c}"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(b or b"") for b in batch.column(0).cast(pa.binary()).to_pylist()]
            heads = np.array([fingerprint(h)[:2] for h in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads[:, 0]), pa.array(heads[:, 1]), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["w0", "w1", "h"]
            )

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(side("a"), "a").join(side("b"), "b").where(similarity("fa", "na", "fb", "nb") >= MIN_SIMILARITY - SLACK).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
        # one text of each node, however many copies it has
        named = nodes.join(ends, "node", "left_semi").select(F.col("__key").alias("k"), F.col("__hash").alias("h"))
        texts = keyed.join(named, (F.col("__hash") == F.col("h")) & F.col("__key").eqNullSafe(F.col("k")), "left_semi").select("__text")
        sets = texts.mapInArrow(shingled, "w0 long, w1 long, h array<long>").groupBy(F.xxhash64("w0", "w1").alias("node")).agg(F.min("h").alias("h"))
        sets = written(sets)
        of = lambda c: sets.select(F.col("node").alias(c), F.col("h").alias(f"h{c}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
        share = F.col("shared") / (F.size("ha") + F.size("hb") - F.col("shared"))
        return written(both.where(share >= MIN_SIMILARITY).select("a", "b"))

    found = written(candidates(worded))
    alike = verified(likely(found.select("a", "b").distinct()))
    roots = connected_components(alike)
    crowded = written(found.where("k is not null").select("k").distinct())
    if not crowded.isEmpty():
        # a pair is left out only where pairs that were verified connect it
        split = worded.join(roots, "node", "left").select("node", "fp", "n", F.coalesce("root", "node").alias("root"))
        roots = connected_components(alike.unionByName(verified(remaining(split, crowded))))
    return rows.select("__key", "__hash", "node"), written(nodes.select("node", "times").join(roots, "node", "left").select("node", "times", F.coalesce("root", "node").alias("root")))


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """__key, __hash and the first (key, hash) of the row's group, for every row; a null key comes last."""
    order = F.struct(F.col("__key").isNull().alias("none"), "__key", "__hash")
    least = rows.groupBy("node").agg(F.min(order).alias("least"))
    tops = written(nodes.join(least, "node"))
    best = written(tops.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("nodes")))
    named = written(attached(tops.select("node", "times", "root"), best, "root", "nodes").select("node", "times", "first"))
    return attached(rows, named, "node", "times").select("__key", "__hash", "first")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): the smallest key that a row reaches over links of similar texts, for every row.

    Texts are linked if the Jaccard similarity of their sets of five-word shingles is MIN_SIMILARITY or more. Texts
    without words, empty and null ones are copies of each other. Rows with equal keys are each returned, and may be in
    different groups; a group of null keys alone has a null component. An empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    return _named(*_grouped(docs, key, text)).select(F.col("__key").alias(key), F.col("first.__key").alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with its own columns, whatever their names.

    It is the one with the smallest key, then the lowest text hash; null keys come last. Keys may repeat: what is
    chosen is a row, and other texts under its key are judged by their own groups. Of rows that share key and text
    any one stays. Empty and null texts are one group. An empty table gives an empty result.
    """
    chosen = F.col("__key").eqNullSafe(F.col("first.__key")) & (F.col("__hash") == F.col("first.__hash"))
    kept = written(_named(*_grouped(docs, key, text)).where(chosen).groupBy("__key", "__hash").agg(F.count(F.lit(1)).alias("__times")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{key}`").alias("__k"), _text_hash(text).alias("__h"), row.alias("__row"))
    rows = rows.join(kept, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__hash")))
    single = rows.where("__times = 1").select("__row")
    if not kept.where("__times > 1").isEmpty():
        single = single.unionByName(rows.where("__times > 1").groupBy("__k", "__h").agg(F.first("__row").alias("__row")).select("__row"))
    return single.select("__row.*")
