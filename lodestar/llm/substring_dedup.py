"""Removal of repeated byte strings by per-shard suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.suffix_array import common_prefixes, suffix_array
from lodestar.llm.tokens import Lookup, mixed, prefix_hashes, span_hashes

LENGTH = 100
#: A string of LENGTH bytes is placed by the lowest hash of the so long strings in it.
GRAM = 32
#: Text that is read together; the documents of a bucket are one group.
BUCKET_BYTES = 8 << 20
#: Text of a suffix array.
SHARD_BYTES = 1 << 20
#: Lowest grams found in more places than this are common: their strings are placed by their own hashes.
COMMON = 50_000
_PIECE = 1 << 20
_POSITION_BITS = 24
#: Not a byte of UTF-8.
_SEPARATOR = b"\xff"


class Pieces:
    """Texts cut into pieces of at most _PIECE string starts, and the runs of starts that share their lowest gram."""

    def __init__(self, texts: list[bytes]):
        parts = [(i, at, t[at : at + _PIECE + LENGTH - 1]) for i, t in enumerate(texts) for at in range(0, len(t) - LENGTH + 1, _PIECE)]
        self.texts, self.starts, self.sizes, self.grams = [], [], [], []
        at = 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and size + len(parts[to][2]) <= _PIECE + LENGTH or to == at:
                size += len(parts[to][2])
                to += 1
            self._add(parts[at:to])
            at = to
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        #: of each run: its text, first start, number of starts, and gram
        self.texts, self.starts, self.sizes, self.grams = join(self.texts, np.int64), join(self.starts, np.int64), join(self.sizes, np.int64), join(self.grams, np.uint64)

    def _add(self, parts: list[tuple[int, int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        lengths = np.array([len(p[2]) for p in parts])
        first = np.cumsum(lengths) - lengths
        n = len(data) - GRAM + 1
        at = np.arange(n)
        grams = span_hashes(prefix_hashes(data), at, at + GRAM)
        low = (grams >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64)
        want, width = LENGTH - GRAM + 1, 1
        while 2 * width <= want:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(data) - LENGTH + 1], low[want - width : want - width + len(data) - LENGTH + 1])
        place = (low & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(place))
        part = np.searchsorted(first, starts, side="right") - 1
        inside = starts + LENGTH <= first[part] + lengths[part]
        starts, place, part = starts[inside], place[inside], part[inside]
        head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])))[: len(place)])
        own = part[head]
        self.texts.append(np.array([p[0] for p in parts])[own])
        self.starts.append(starts[head] - first[own] + np.array([p[1] for p in parts])[own])
        self.sizes.append(np.diff(np.concatenate((head, [len(place)]))))
        self.grams.append(grams[place[head]])


def _bodies(table: pa.Table) -> list[bytes]:
    return [b or b"" for b in table["__body"].cast(pa.binary()).to_pylist()]


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by document and text hash, and which of them are the first of repeated rows."""
    table = table.sort_by([("__d", "ascending"), ("__x", "ascending")])
    d, x = table["__d"].to_numpy(), table["__x"].to_numpy()
    return table, np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))[: len(d)]


def gram_counts(key: tuple, table: pa.Table) -> pa.Table:
    """The lowest grams of a bucket and how many runs have them."""
    table, new = _distinct(table)
    runs = Pieces([b for b, n in zip(_bodies(table), new, strict=True) if n])
    grams, n = np.unique(runs.grams, return_counts=True)
    return pa.table({"g": grams.view(np.int64), "__bucket": pa.array(np.full(len(grams), key[0].as_py())), "n": n})


def repeated_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (g, bucket, n) by g, those of grams with more than one run, with whether they are common."""
    held: list[pa.RecordBatch] = []

    def chosen(table: pa.Table) -> pa.RecordBatch:
        g, n = table["g"].to_numpy(), table["n"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))[: len(g)])
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.concatenate((first, [len(g)]))))
        keep = total > 1
        return pa.RecordBatch.from_arrays(
            [table["__bucket"].combine_chunks().filter(pa.array(keep)), pa.array(g[keep]), pa.array(total[keep] > COMMON)], names=["__bucket", "g", "common"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1], side="left"))
        if cut:
            yield chosen(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield chosen(pa.Table.from_batches(held))


_SEGMENTS = "k long, body binary, __bucket long, d long, x long, start long, n long"


def segments(key: tuple, docs: pa.Table, grams: pa.Table) -> pa.Table:
    """The runs of a bucket whose lowest gram is repeated, with their text, for the shard of that gram.

    Of runs with equal text only the first is sent; the others are known to be repeated (rows without text).
    """
    docs, new = _distinct(docs)
    docs = docs.filter(pa.array(new))
    texts, d, x = _bodies(docs), docs["__d"].to_numpy(), docs["__x"].to_numpy()
    g = grams["g"].to_numpy().view(np.uint64)
    order = np.argsort(g)
    common = grams["common"].to_numpy()[order]
    runs = Pieces(texts)
    place = Lookup(g[order])(runs.grams)
    hit = np.flatnonzero(place >= 0)
    seen: set[bytes] = set()
    k, body, of, starts, sizes = [], [], [], [], []

    def add(route: int, text: bytes | None, i: int, start: int, n: int) -> None:
        k.append(route)
        body.append(text)
        of.append(i)
        starts.append(start)
        sizes.append(n)

    routes, is_common = runs.grams[hit].view(np.int64).tolist(), common[place[hit]].tolist()
    for route, wide, i, start, n in zip(routes, is_common, runs.texts[hit].tolist(), runs.starts[hit].tolist(), runs.sizes[hit].tolist(), strict=True):
        text = texts[i][start : start + n + LENGTH - 1]
        if text in seen:
            add(start * 31 + i, None, i, start, n)
            continue
        seen.add(text)
        if not wide:
            add(route, text, i, start, n)
            continue
        for j in range(n):
            one = text[j : j + LENGTH]
            if n > 1 and one in seen:
                add(start * 31 + i, None, i, start + j, 1)
            else:
                seen.add(one)
                add(hash_of(one), one, i, start + j, 1)
    of = np.array(of, np.int64)
    return pa.table({
        "k": pa.array(k, pa.int64()), "body": pa.array(body, pa.binary()), "__bucket": pa.array(np.full(len(k), key[0].as_py())),
        "d": d[of], "x": x[of], "start": pa.array(starts, pa.int64()), "n": pa.array(sizes, pa.int64()),
    })


def hash_of(text: bytes) -> int:
    """A 64-bit hash as a signed integer."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class Shard:
    """The suffix array of some segments: their strings of LENGTH bytes in order, equal ones together.

    Segments are by document, text hash and start, so that of equal strings the first in the text is the earliest.
    """

    def __init__(self, bodies: list[bytes]):
        self.text = np.frombuffer(_SEPARATOR.join([*bodies, b""]), np.uint8)
        lengths = np.array([len(b) + 1 for b in bodies])
        ends = np.cumsum(lengths) - 1
        order = suffix_array(self.text)
        shared = common_prefixes(self.text, order)
        segment = np.searchsorted(ends, order, side="left")
        whole = order + LENGTH <= ends[np.minimum(segment, len(ends) - 1)]
        # between two whole strings the shared prefix is the least of those on the way; a suffix that is not whole
        # shares less than LENGTH with any that is
        head = shared < LENGTH
        group = np.cumsum(head)[whole]
        self.at = order[whole]
        self.segment = segment[whole]
        new = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        self.group = np.cumsum(new) - 1
        self.first = np.minimum.reduceat(self.at, np.flatnonzero(new)) if len(group) else self.at
        self.offset = self.at - (ends - lengths + 1)[self.segment] if len(self.at) else self.at

    def strings(self, positions: np.ndarray) -> np.ndarray:
        """The strings of LENGTH bytes at these positions, as items that compare byte by byte."""
        rows = self.text[positions[:, None] + np.arange(LENGTH)]
        return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


#: Document, text hash, start and bucket of a segment.
Place = list[int]


class Merged:
    """Shards of one key, whose equal strings are found by binary search as each shard is added."""

    def __init__(self):
        self.past: list[tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]] = []

    def add(self, shard: Shard, strings: np.ndarray, places: list[tuple[int, int, int]], buckets: np.ndarray) -> tuple[list[int], list[tuple[int, ...]]]:
        """Numbers of the shard's strings that stand earlier in a past one, and (bucket, place) of past ones that stand earlier here."""
        late, overtaken = [], []
        for others, other_places, other_buckets in self.past:
            at = np.minimum(np.searchsorted(others, strings), len(others) - 1)
            for i in np.flatnonzero(others[at] == strings).tolist():
                j = int(at[i])
                if other_places[j] < places[i]:
                    late.append(i)
                else:
                    overtaken.append((int(other_buckets[j]), *other_places[j]))
        if len(strings):
            self.past.append((strings, places, buckets))
        return late, overtaken


_REPEATS = ["__bucket", "d", "x", "start", "n"]


def shard_repeats(held: dict[bytes, Place], merged: Merged | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of starts of the strings of some segments that stand earlier in them, or in the shards merged so far."""
    bodies = sorted(held, key=held.__getitem__)
    d, x, start, bucket = np.array([held[b] for b in bodies], np.int64).reshape(-1, 4).T
    shard = Shard(bodies)
    found = shard.at != shard.first[shard.group]
    if merged is not None and len(shard.at):
        firsts = np.flatnonzero(~found)
        firsts = firsts[np.argsort(shard.group[firsts])]
        seg = shard.segment[firsts]
        places = list(zip(d[seg].tolist(), x[seg].tolist(), (start[seg] + shard.offset[firsts]).tolist(), strict=True))
        late, overtaken = merged.add(shard, shard.strings(shard.first), places, bucket[seg])
        found[firsts[late]] = True
        if overtaken:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*overtaken, strict=True)), pa.array([1] * len(overtaken), pa.int64())], names=_REPEATS)
    rows = np.flatnonzero(found)
    rows = rows[np.lexsort((shard.offset[rows], shard.segment[rows]))]
    seg, off = shard.segment[rows], shard.offset[rows]
    new = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)))[: len(rows)])
    s = seg[new]
    n = np.diff(np.concatenate((new, [len(rows)])))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket[s], d[s], x[s], start[s] + off[new], n)], names=_REPEATS)


def repeats(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """From segments by k, the starts of repeated strings: rows bucket, d, x, start, n for runs of n starts.

    Of equal segments of a key the earliest goes on, and the others are repeated as a whole. A key with one segment
    left has no other repeats, since equal strings of one segment would have their lowest gram in one place. The
    segments of other keys are put together in shards of about ``most`` bytes; a key with more gets shards of its own.
    """
    done: dict[bytes, Place] = {}
    current: dict[bytes, Place] = {}
    earliest: dict[bytes, Place] = {}  # of the current key, in this shard and past ones
    done_size = current_size = 0
    last, merged = None, Merged()
    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = table["body"].is_null()
        if pa.compute.any(known).as_py():
            yield from table.filter(known).select(_REPEATS).combine_chunks().to_batches()
            table = table.filter(pa.compute.invert(known))
        again: list[tuple[int, ...]] = []
        for k, body, *place in zip(*(table[c].to_pylist() for c in ("k", "body", "d", "x", "start", "__bucket")), strict=True):
            if k != last:
                if merged.past:
                    if current:
                        yield from shard_repeats(current, merged)
                    merged = Merged()
                elif len(current) > 1:
                    done |= current
                    done_size += current_size
                    if done_size >= most:
                        yield from shard_repeats(done)
                        done, done_size = {}, 0
                current, earliest, current_size, last = {}, {}, 0, k
            other = earliest.setdefault(body, place)
            if other is not place:
                first, second = sorted((other, place))
                again.append((second[3], *second[:3], len(body) - LENGTH + 1))
                if first is other:
                    continue
                earliest[body] = place
            if body not in current:
                current_size += len(body)
            current[body] = place
            if current_size >= most:
                yield from shard_repeats(current, merged)
                current, current_size = {}, 0
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*again, strict=True)], names=_REPEATS)
    if merged.past and current:
        yield from shard_repeats(current, merged)
    elif len(current) > 1:
        done |= current
    if done:
        yield from shard_repeats(done)


def _finish(key_name: str):
    def finish(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        docs, _ = _distinct(docs)
        found = found.sort_by([("d", "ascending"), ("x", "ascending")])
        d, x, start, n = (found[c].to_numpy() for c in ("d", "x", "start", "n"))
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])))[: len(d)])
        of = {(int(d[i]), int(x[i])): (i, j) for i, j in zip(new, np.append(new, len(d))[1:], strict=True)}
        rows = []
        for b, own_d, own_x in zip(_bodies(docs), docs["__d"].to_pylist(), docs["__x"].to_pylist(), strict=True):
            i, j = of.get((own_d, own_x), (0, 0))
            if i == j:
                rows.append((len(b), 0, 0, hashlib.sha256(b).hexdigest()))
                continue
            step = np.zeros(len(b) + 1, np.int64)
            np.add.at(step, start[i:j], 1)
            np.add.at(step, start[i:j] + n[i:j] + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            rows.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([docs[key_name].combine_chunks(), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key_name, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return finish


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row, once each byte that lies in a repeated string is removed.

    A string of LENGTH bytes is repeated if it also starts earlier: in a document with a smaller key, or earlier in the
    same one. Texts are UTF-8; a null text is empty; a null key comes first. Rows with the same key and text are one
    document, and each gets its result; rows with the same key and different texts are ordered by a hash of the text.
    An empty table gives an empty result; other columns are not read.

    A string can only be equal to one with the same lowest gram. Strings whose lowest gram stands in no other place
    are left out; the rest go, with their text, to the shard of their gram, where a suffix array shows which are equal.
    A gram with more text than one shard is spread over several, and their ordered strings are merged by binary search.
    """
    rows = docs.select(
        F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__body"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("__d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__x"),
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets = max(1, -(-int(size) // BUCKET_BYTES))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__d"), F.lit(n_buckets)).cast("long"))
    by_bucket = rows.groupBy("__bucket")
    counts = by_bucket.applyInArrow(gram_counts, "g long, __bucket long, n long")
    again = counts.repartition("g").sortWithinPartitions("g").mapInArrow(repeated_grams, "__bucket long, g long, common boolean")
    sent = by_bucket.cogroup(again.groupBy("__bucket")).applyInArrow(segments, _SEGMENTS)
    found = sent.repartition("k").sortWithinPartitions("k").mapInArrow(repeats, "__bucket long, d long, x long, start long, n long")
    key_type = docs.schema[key].dataType.simpleString()
    return by_bucket.cogroup(found.groupBy("__bucket")).applyInArrow(
        _finish(key), f"`{key}` {key_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
