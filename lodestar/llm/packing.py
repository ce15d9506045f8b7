"""Packing of tokenised documents into fixed-length sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator, Mapping
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.ranking import gapless_rank
from lodestar.llm.store import written

MAX_TOKENS = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
_SHIFT = 1 << 48


class Encoder:
    """Token ids of the byte-level tokenizer file.

    The same vocabulary as merge ranks gives the same ids about five times faster; a text that holds the string of a
    special token goes through the tokenizer file itself.
    """

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        import tiktoken

        self.file = public_tokenizers.path(name)
        with open(self.file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def full(self):
        """The tokenizer file itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def encoder(name: str = TOKENIZER) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    return Encoder(name)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Cut each document's ids (its tokens, then ``END_ID``) every ``max_tokens``: key, start, length, ids_crc32, doc_tokens."""
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoder()
            rows: list[tuple[int, int, int, int, int]] = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(body or ""), END_ID], dtype="<u4")
                for start in range(0, len(ids), max_tokens):
                    part = ids[start : start + max_tokens]
                    rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if rows:
                at, *cols = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *cols], names=[key, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(key, text).mapInArrow(cut, f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: Mapping[int, int], capacity: int = MAX_TOKENS) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of sequences, lengths in order), from the number of pieces of each length.

    Lengths are placed longest first, each piece in the pack that holds least; a new pack is opened only if it fits
    in none. Packs with equal contents are one counted pattern, so the work depends on the number of lengths alone.
    """
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    spaces: list[int] = []

    def put(space: int, count: int, parts: list[int]) -> None:
        if space not in groups:
            groups[space] = []
            heapq.heappush(spaces, -space)
        groups[space].append((count, parts))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        left = histogram[length]
        while left:
            if spaces and -spaces[0] >= length:
                space = -spaces[0]
                count, parts = groups[space].pop()
                if not groups[space]:
                    heapq.heappop(spaces)
                    del groups[space]
                used = min(count, left)
                if count > used:
                    put(space, count - used, parts)
                put(space - length, used, [*parts, length])
                left -= used
            else:
                # as many as fit go into each new pack, since it stays the one that holds least
                fit = min(capacity // length, left)
                put(capacity - length * fit, left // fit, [length] * fit)
                left -= left // fit * fit
    return [g for space in sorted(groups) for g in groups[space]]


def placements(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, where its pieces go by rank: from rank ``start`` on, to sequences from ``sequence`` on, at ``offset``."""
    rows, seen, base = [], {}, 0
    for count, parts in patterns:
        offset = 0
        for length in parts:
            start = seen.get(length, 0)
            rows.append((length * _SHIFT + start, start, base, offset))
            seen[length] = start + count
            offset += length
        base += count
    rows.sort()
    return dict(zip(("key", "start", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T.copy(), strict=True))


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Every piece with its place: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids and the offsets in a sequence have no gaps. The driver holds the histogram, which has at most
    ``max_tokens`` lengths whatever the input, and the patterns made from it; a piece finds its place by its rank
    among the pieces of its length. A null or empty text is the end id alone. Rows with equal keys are each packed.
    An empty table gives an empty result; other columns are not read.
    """
    cut = written(pieces(docs, key, text, max_tokens))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    to = placements(shortest_pack_first(histogram, max_tokens))
    ranked = gapless_rank(cut, "length", [key, "start", "ids_crc32", "doc_tokens"], "__by_length", sum(histogram.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, length = batch.column("__by_length").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(to["key"], length * _SHIFT + rank, side="right") - 1
            cols = [batch.column(c) for c in (key, "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(to["sequence"][at] + rank - to["start"][at]), pa.array(to["offset"][at])],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    key_type = docs.schema[key].dataType.simpleString()
    return ranked.select(key, "start", "length", "ids_crc32", "doc_tokens", "__by_length").mapInArrow(
        place, f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
