"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import schema_with, written
from lodestar.llm.tokens import WORD_BYTES, blocks, mixed, word_hashes

#: A seed takes the tokens under a 1 and ignores those under a 0, so a substituted token spoils only some seeds.
MASKS = ("111111", "11101011", "1101100011")
#: An overlap counts from this many tokens on, or over a whole shorter item.
MIN_OVERLAP = 13
MIN_IDENTITY = 0.8
#: Items of fewer tokens than the shortest mask carry too little evidence: common phrases of five words or fewer
#: would make any text that uses them look contaminated. They are not searched for.
MIN_ITEM = min(map(len, MASKS))
#: Benchmark text that is held by every task at once; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
#: A seed that meets itself more often than this in a text and the index is not listed meeting by meeting.
_MANY = 1 << 10


def normalised(text: str | None) -> bytes:
    return (text or "").lower().encode()


def seeds(hashes: np.ndarray, owners: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first position, hash) of each place where ``mask`` lies within one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for i, taken in enumerate(mask):
        if taken == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    at = np.flatnonzero(owners[:n] == owners[len(mask) - 1 :])
    return at, mixed(total[at])


@dataclass
class SeedIndex:
    """The seeds of a block of benchmark items, sorted by hash, and the items' tokens."""

    ids: list
    tokens: list[np.ndarray]
    seeds: np.ndarray
    items: np.ndarray
    places: np.ndarray
    present: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> SeedIndex:
        """``rows``: id and text of items that differ in their tokens."""
        named = [(item, word_hashes([normalised(text)], WORD_BYTES)[0]) for item, text in rows]
        ids, tokens = [i for i, x in named if len(x) >= MIN_ITEM], [x for _, x in named if len(x) >= MIN_ITEM]
        flat = np.concatenate([*tokens, np.zeros(0, np.uint64)])
        owners = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        first = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        found = [seeds(flat, owners, m) for m in MASKS]
        at, hashes = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(ids, tokens, hashes, owners[at], at - first[owners[at]], present)

    def diagonals(self, hashes: np.ndarray, owners: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, shifts) of each pair with a common seed: the distinct, sorted distances of a seed's two places.

        A seed that stands at many places of both is not listed pair by pair: the places of one are laid over the
        other, as a row of flags, once for each place that the other has.
        """
        few, many = [np.zeros((0, 3), np.int64)], {}
        for mask in MASKS:
            at, found = seeds(hashes, owners, mask)
            maybe = np.flatnonzero(self.present[found >> np.uint64(64 - _FILTER_BITS)])
            at, found = at[maybe], found[maybe]
            lo, hi = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
            hit = np.flatnonzero(hi > lo)
            hit = hit[np.lexsort((lo[hit], owners[at[hit]]))]
            at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
            text = owners[at]
            begins = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (lo[1:] != lo[:-1])))[: len(at)])
            size = np.diff(np.append(begins, len(at)))
            heavy = size * n[begins] > _MANY
            for a, m in zip(begins[heavy].tolist(), size[heavy].tolist(), strict=True):
                t, entries = int(text[a]), slice(int(lo[a]), int(lo[a] + n[a]))
                items, places = self.items[entries], self.places[entries]
                for item in np.unique(items).tolist():
                    many.setdefault((t, item), []).append((at[a : a + m] - first[t], places[items == item]))
            light = np.flatnonzero(~np.repeat(heavy, size))
            at, lo, n, text = at[light], lo[light], n[light], text[light]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at, text = np.repeat(at, n), np.repeat(text, n)
            few.append(np.unique(np.stack((text, self.items[entry], at - first[text] - self.places[entry]), axis=1), axis=0))
        listed = np.unique(np.concatenate(few), axis=0)
        begins = np.flatnonzero(np.concatenate(([True], (listed[1:, :2] != listed[:-1, :2]).any(axis=1)))[: len(listed)])
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(listed)][: len(begins)], strict=True):
            text, item = listed[a, :2].tolist()
            yield text, item, np.union1d(listed[a:b, 2], self._laid(many.pop((text, item), [])))
        for (text, item), pairs in many.items():
            yield text, item, self._laid(pairs)

    @staticmethod
    def _laid(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Distinct differences x - y of the places in each pair of arrays."""
        if not pairs:
            return np.zeros(0, np.int64)
        far, wide = max(int(x.max()) for x, _ in pairs), max(int(y.max()) for _, y in pairs)
        seen = np.zeros(far + wide + 1, bool)
        for x, y in pairs:
            if len(x) < len(y):
                row = np.zeros(wide + 1, bool)
                row[wide - y] = True
                for i in x.tolist():
                    seen[i : i + wide + 1] |= row
            else:
                row = np.zeros(far + 1, bool)
                row[x] = True
                for i in y.tolist():
                    seen[wide - i : wide - i + far + 1] |= row
        return np.flatnonzero(seen) - wide

    def overlaps(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, start in text, start in item, tokens, equal tokens) of each pair's longest sufficient overlap; the first of ties."""
        hashes, owners = word_hashes(texts, WORD_BYTES)
        first = np.searchsorted(owners, np.arange(len(texts) + 1))
        for text, item, shifts in self.diagonals(hashes, owners, first):
            own, other = hashes[first[text] : first[text + 1]], self.tokens[item]
            start, end = np.maximum(0, -shifts), np.minimum(len(other), len(own) - shifts)
            # those that may hold the longest come first; one that can't be longer, nor as long and earlier, is left out
            left = np.lexsort((shifts, start - end))
            best: tuple[int, int, int, int, int] | None = None
            least = min(MIN_OVERLAP, len(other))
            left = left[(end - start)[left] >= least]
            while len(left):
                i, left = left[0], left[1:]
                shift, a0, b0 = int(shifts[i]), int(start[i]), int(end[i])
                a, b, equal = longest_overlap(own[a0 + shift : b0 + shift] == other[a0:b0])
                if b - a >= least and (best is None or (b - a, -shift) > (best[2], -best[4])):
                    best = (a0 + shift + a, a0 + a, b - a, equal, shift)
                    room = (end - start)[left]
                    left = left[(room > best[2]) | ((room == best[2]) & (shifts[left] < shift))]
            if best:
                yield text, item, *best[:4]


def longest_overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the longest stretch of which at least MIN_IDENTITY is equal; the first of ties."""
    worth = np.concatenate(([0.0], np.cumsum(equal - MIN_IDENTITY))).round(6)
    lowest = np.minimum.accumulate(worth)
    starts = np.searchsorted(-lowest, -worth, side="left")
    end = int(np.argmax(np.arange(len(worth)) - starts))
    return int(starts[end]), end, int(equal[starts[end] : end].sum())


def distinct_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item and text, of each set of items with equal tokens the one with the smallest id, whatever their texts."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [word_hashes([normalised(t)], WORD_BYTES)[0].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], names=["item", "text", "tokens"])

    kept = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    rows = kept.mapInArrow(tokenised, schema_with(kept, ["item", "text"], "tokens binary"))
    return rows.groupBy("tokens").agg(F.min(F.struct(F.col("item").isNull(), "item", "text")).alias("s")).select("s.item", "s.text")


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[SeedIndex]:
    """Seed indexes that together cover the benchmark, each made of about BLOCK_BYTES of text at most."""
    rows = written(distinct_items(benchmark, item, text))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows
        yield SeedIndex.of(sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r)))


def _by_block(benchmark: DataFrame, item: str, text: str, step: Callable[[SeedIndex, DataFrame | None], DataFrame]) -> DataFrame:
    """Apply ``step`` to each block and the result so far. It is written before the next block, so that the driver and
    the tasks hold one block's index at a time."""
    found, blocks_left = None, benchmark_blocks(benchmark, item, text)
    index = next(blocks_left)
    while index is not None:
        found, index = step(index, found), next(blocks_left, None)
        if index is not None:
            found = written(found)
    return found


def contaminations(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that overlap: key, item, doc_start, item_start, n_tokens, n_equal.

    Tokens are runs of letters and digits, in lower case. Seeds of documents are looked up among the benchmark's, and
    around each hit the two texts are compared token by token: an overlap is the longest aligned stretch with at least
    MIN_IDENTITY equal tokens, and counts from MIN_OVERLAP tokens on (or over a whole shorter item). Starts count
    tokens. Every document's whole text is searched for every item; null and empty texts have no overlap; repeated
    rows each give their rows; items with equal tokens are reported under the smallest id; items of fewer than MIN_ITEM
    tokens are not searched for; an empty table on either side gives an empty result; other columns are not read,
    whatever their names. Only the benchmark is sent to the tasks, a block of bounded size at a time.
    """
    key_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (benchmark, item)))
    names = [key, item, "doc_start", "item_start", "n_tokens", "n_equal"]
    schema = f"`{key}` {key_type}, `{item}` {item_type}, doc_start long, item_start long, n_tokens long, n_equal long"
    arrow_item = benchmark.select(item).limit(0).toArrow().schema.field(0).type

    def search(index: SeedIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [normalised(t) for t in batch.column(1).to_pylist()]
                rows = [(at + x[0], index.ids[x[1]], *x[2:]) for at, to in blocks(texts) for x in index.overlaps(texts[at:to])]
                if rows:
                    at, items, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, arrow_item), *(pa.array(c, pa.int64()) for c in rest)], names=names
                    )

        return run

    def step(index: SeedIndex, found: DataFrame | None) -> DataFrame:
        part = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(search(index), schema)
        return part if found is None else found.unionByName(part)

    return _by_block(benchmark, item, text, step)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with their own columns, whatever their names.

    Null and empty texts stay; of equal rows all stay or none; an empty benchmark drops nothing.
    """

    def clean(index: SeedIndex, place: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [normalised(t) for t in batch.column(place).to_pylist()]
                keep = np.ones(len(texts), bool)
                for at, to in blocks(texts):
                    for x in index.overlaps(texts[at:to]):
                        keep[at + x[0]] = False
                yield batch.filter(pa.array(keep))

        return run

    def step(index: SeedIndex, found: DataFrame | None) -> DataFrame:
        return (docs if found is None else found).mapInArrow(clean(index, docs.columns.index(text)), docs.schema)

    return _by_block(benchmark, item, text, step)
