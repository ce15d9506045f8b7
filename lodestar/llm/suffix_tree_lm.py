"""Language-model scores from a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import schema_with, written
from lodestar.llm.tokens import SPACES, Lookup, blocks, mixed, word_hashes

#: The token after the last word of a text, and its number.
END = np.uint64(0xE4D0F7E47E4D0F7E)
END_ID = 0
#: A context is looked at, and a next token stored with it, if the two together make up this share of the training
#: tokens. So at most 500,000 words have a number, each depth of the tree has at most 500,000 entries, whatever the
#: input, and what tasks are sent is bounded. Depth has no bound but the divergence test.
MIN_SHARE = 2e-6
MIN_COUNT = 4
#: A context stays if the chance of its next tokens being drawn from its suffix's distribution is below this.
SIGNIFICANCE_Z = 3.1
#: Tokens whose contexts are counted together before they are exchanged, and tokens for each bucket of the exchange.
CHUNK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 20
#: Numbers of words and states need no more bits than these (a share of 1e-6 gives a million).
_BITS = 20
_MASK = (1 << _BITS) - 1
#: Stands for all next tokens of a context together.
_TOTAL = _MASK
_WORDS = ~SPACES


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of each token: the words of the lower-cased texts (A to Z only), then one end each."""
    hashes, owners = word_hashes([t.lower() for t in texts], _WORDS)
    ends = np.searchsorted(owners, np.arange(len(texts)), side="right")
    return np.insert(hashes, ends, END), np.insert(owners, ends, np.arange(len(texts)))


def is_held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _token_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
    for at, to in blocks(texts):
        yield at, to, *tokens(texts[at:to])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, n): token hashes and their counts, for about CHUNK_TOKENS tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, n = summed(held)
        return pa.RecordBatch.from_arrays([_signed(keys), pa.array(n)], names=["k", "n"])

    size = 0
    for batch in batches:
        for _, _, hashes, _ in _token_blocks(batch.column(0)):
            held.append(np.unique(hashes, return_counts=True))
            size += len(hashes)
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Keys:
    """Positions of whole numbers in a sorted array without repeats."""

    def __init__(self, keys: np.ndarray):
        spread = mixed(keys.astype(np.uint64))
        self.order = np.argsort(spread)
        self.at = Lookup(spread[self.order])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        place = self.at(mixed(keys.astype(np.uint64)))
        return np.where(place >= 0, self.order[place], -1) if len(self.order) else place


@dataclass
class Depth:
    """The states of one depth: contexts by (word before, state of the suffix), and the next tokens that they store."""

    states: np.ndarray
    backoff: np.ndarray
    stored: np.ndarray
    logs: np.ndarray

    def prepare(self) -> Depth:
        """Make what finds places; it is made where it is used, not sent."""
        self.state_at, self.stored_at = Keys(self.states), Keys(self.stored)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("state_at", "stored_at")}


@dataclass
class SuffixTree:
    """Numbered words, the root's distribution over them, and the states of each depth.

    A token that a state doesn't store has the probability that the state's suffix gives it, times the state's
    back-off weight, which makes the distribution sum to one.
    """

    n_tokens: int
    n_distinct: int
    #: Hashes of the words with numbers 1, 2, ...
    words: np.ndarray
    #: Counts by number; the end of a text comes first.
    counts: np.ndarray
    depths: list[Depth] = field(default_factory=list)
    #: Frequent pairs: word number << _BITS | next number.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def unseen(self) -> float:
        return -float(np.log10(self.n_tokens + self.n_distinct + 1))

    def root(self) -> np.ndarray:
        return np.log10(self.counts + 1.0) + self.unseen()

    def least(self) -> float:
        return max(MIN_COUNT, MIN_SHARE * self.n_tokens)


def numbered(hashes: np.ndarray, at: Lookup) -> np.ndarray:
    """Numbers of tokens; -1 for those that have none."""
    place = at(hashes)
    return np.where(hashes == END, END_ID, np.where(place >= 0, place + 1, -1)).astype(np.int32)


def walked(ids: np.ndarray, depths: list[Depth]) -> Iterator[tuple[Depth, np.ndarray, np.ndarray]]:
    """For each depth: positions whose context of that depth is a state, and its number. Texts end with END_ID."""
    at = np.arange(1, len(ids))
    state = np.zeros(len(at), np.int64)
    for i, depth in enumerate(depths, 1):
        inside = at >= i
        at, state = at[inside], state[inside]
        word = ids[at - i].astype(np.int64)
        real = word > END_ID
        at, state, word = at[real], state[real], word[real]
        state = depth.state_at(word << _BITS | state)
        at, state = at[state >= 0], state[state >= 0]
        yield depth, at, state


def next_keys(ids: np.ndarray, depths: list[Depth], pairs: Keys) -> np.ndarray:
    """Keys (word before << 2 * _BITS | state of the suffix << _BITS | next) of the contexts one deeper than ``depths``.

    Every place of a context gives its key with _TOTAL, and one with the next token if the suffix stores that. A context
    whose first two words are no frequent pair is left out, as it can't be frequent. At depth one, where totals are the
    words' counts, both words of a pair have numbers.
    """
    if not depths:
        ok = (ids[:-1] > END_ID) & (ids[1:] >= 0)
        return ids[:-1][ok].astype(np.int64) << 2 * _BITS | ids[1:][ok]
    *_, (last, at, state) = walked(ids, depths)
    d = len(depths) + 1
    at, state = at[at >= d], state[at >= d]
    before, first = ids[at - d].astype(np.int64), ids[at - d + 1].astype(np.int64)
    real = before > END_ID
    real[real] = pairs(before[real] << _BITS | first[real]) >= 0
    at, state, before = at[real], state[real], before[real]
    context = before << 2 * _BITS | state << _BITS
    has = np.flatnonzero(ids[at] >= 0)
    nxt = ids[at[has]].astype(np.int64)
    stored = last.stored_at(state[has] << _BITS | nxt) >= 0
    return np.concatenate((context | _TOTAL, context[has[stored]] | nxt[stored]))


def chi_square_cutoff(df: np.ndarray) -> np.ndarray:
    """The quantile of chi-square that SIGNIFICANCE_Z stands for, by the cube-root normal approximation."""
    return df * (1 - 2 / (9 * df) + SIGNIFICANCE_Z * np.sqrt(2 / (9 * df))) ** 3


def tested(context: np.ndarray, token: np.ndarray, n: np.ndarray, whole: np.ndarray, lower: np.ndarray) -> Depth:
    """Keep the contexts whose next tokens differ from their suffix's by a likelihood-ratio test.

    One row for each context and stored next token; ``whole`` counts the context, ``lower`` is the suffix's log10
    probability of the token. The test has one cell for each stored next token and one for all others together.
    """
    states, group = np.unique(context, return_inverse=True)
    sums = lambda x: np.bincount(group, x, len(states))
    size = np.zeros(len(states))
    size[group] = whole
    here, below = (n - 0.5) / whole, 10.0**lower
    rest, rest_below = np.maximum(1 - sums(here), 1e-12), np.maximum(1 - sums(below), 1e-12)
    plain = np.minimum(n / whole, 1.0)
    others = np.maximum(1 - sums(plain), 0.0)
    others[others < 1e-9] = 0.0
    ratio = 2 * (sums(n * np.log(plain / below)) + size * np.where(others > 0, others * np.log(np.maximum(others, 1e-12) / rest_below), 0.0))
    good = ratio >= chi_square_cutoff(np.bincount(group, minlength=len(states)).astype(float)) if len(states) else np.zeros(0, bool)
    number = np.cumsum(good) - 1
    of_good = good[group] if len(states) else np.zeros(0, bool)
    stored = number[group[of_good]] << _BITS | token[of_good]
    order = np.argsort(stored)
    return Depth(states[good], np.log10(rest / rest_below)[good], stored[order], np.log10(here[of_good])[order])


def _codes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, numbers, lengths) of the texts of a batch, some CHUNK_TOKENS tokens at a time; numbers begin with an end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    values = np.frombuffer(data, np.int32, ends[-1]) if data else np.zeros(0, np.int32)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_TOKENS, side="right")) - 1)
        yield at, to, np.concatenate((np.array([END_ID], np.int32), values[ends[at] : ends[to]])), np.diff(ends[at : to + 1])
        at = to


def counted(coded: DataFrame, tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """The next depth's frequent keys and their counts over all texts of the only column of ``coded``, by key.

    Each chunk's distinct keys are exchanged as packed arrays by a hash of the key, so that neither a frequent context
    nor a frequent pair makes a bucket larger than the rest. Keys that reach the least count, of which there are at
    most 2 / MIN_SHARE, come to the driver.
    """
    n_buckets = max(1, -(-tree.n_tokens // BUCKET_TOKENS))
    depths, pair_keys, least = tree.depths, tree.pairs, tree.least()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for depth in depths:
            depth.prepare()
        pairs = Keys(pair_keys)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, n = summed(held)
            bucket = (mixed(keys.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
            rows = []
            for single in (True, False):
                at = np.flatnonzero((n == 1) == single)
                at = at[np.argsort(bucket[at], kind="stable")]
                begins = np.flatnonzero(np.diff(bucket[at], prepend=-1))
                for a, b in zip(begins.tolist(), np.append(begins, len(at))[1:].tolist(), strict=True):
                    rows.append((int(bucket[at[a]]), keys[at[a:b]].tobytes(), None if single else n[at[a:b]].tobytes()))
            types = (pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "keys", "n"])

        size = 0
        for batch in batches:
            for _, _, ids, _ in _codes(batch.column(0)):
                keys = next_keys(ids, depths, pairs)
                size += len(ids)
                if len(keys):
                    held.append(np.unique(keys, return_counts=True))
                if size >= CHUNK_TOKENS and held:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        parts = []
        for keys, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True):
            keys = np.frombuffer(keys, np.int64)
            parts.append((keys, np.ones(len(keys), np.int64) if n is None else np.frombuffer(n, np.int64)))
        keys, n = summed(parts)
        return pa.table({"k": keys[n >= least], "n": n[n >= least]})

    found = coded.mapInArrow(gather, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(total, "k long, n long").toArrow()
    keys, n = found["k"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several (keys, counts) and their sums."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def grown(tree: SuffixTree, coded: DataFrame) -> SuffixTree:
    """Add depth after depth until no longer context says more.

    Only a kept context is lengthened, so one that matters is not found where none of its own suffixes does.
    """
    while True:
        keys, n = counted(coded, tree)
        real = (keys & _MASK) != _TOTAL
        context, token = keys[real] >> _BITS, keys[real] & _MASK
        if not tree.depths:
            tree.pairs = (context >> _BITS) << _BITS | token
            whole, lower = tree.counts[context >> _BITS], tree.root()[token]
        else:
            last = tree.depths[-1].prepare()
            # a context is at least as frequent as any of its next tokens
            whole = n[np.searchsorted(keys, context << _BITS | _TOTAL)]
            lower = last.logs[last.stored_at((context & _MASK) << _BITS | token)]
        depth = tested(context, token, n[real], whole, lower)
        if not len(depth.states):
            return tree
        tree.depths.append(depth)


def numbers(words: DataFrame, total: int, distinct: int) -> SuffixTree:
    """A tree without states: words of a share of MIN_SHARE or more get numbers."""
    head = words.where(F.col("n") >= F.lit(max(2.0, MIN_SHARE * total))).toArrow()
    keys, n = head["k"].to_numpy().view(np.uint64), head["n"].to_numpy()
    end = words.where(F.col("k") == F.lit(int(END.view(np.int64)))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = np.argsort(keys)
    order = order[keys[order] != END]
    return SuffixTree(total, distinct, keys[order], np.concatenate(([end], n[order])).astype(np.int64))


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; log10 probabilities of whole texts.

    The model learns from the rows that are not held out. Words are compared by 64-bit hashes. A null or empty text
    is the end token alone; repeated rows each count and each get a row; without training rows every token is unseen.
    An empty table gives an empty result; other columns are not read.

    Texts are written once as numbers of frequent words, which every further pass reads: one for each depth of the
    tree, one for the scores. Every task of these holds the tree, which MIN_SHARE bounds. The rare words of a text are
    joined to the counts of all words; no context stores one of them.
    """
    rows = docs.select(F.col(text).alias("__text"), F.col(key), (is_held_out(F.col(key)) if held_out is None else held_out).alias("held_out"))
    words = written(rows.where(~F.col("held_out")).select("__text").mapInArrow(counted_words, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")))
    distinct, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    numbering = numbers(words, total, distinct)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_word, number = Lookup(numbering.words), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, to, hashes, owners in _token_blocks(batch.column(0)):
                n = to - at
                ids = numbered(hashes, at_word)
                ends = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(4 * ends), pa.py_buffer(ids)])
                rare = np.flatnonzero(ids < 0)
                order = rare[np.lexsort((hashes[rare], owners[rare]))]
                h, o = hashes[order], owners[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))[: len(h)])
                times = np.diff(np.concatenate((new, [len(h)]))).astype(np.int32)
                offsets = pa.array(np.searchsorted(o[new], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (_signed(h[new]), pa.array(times))]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, n) for c in batch.columns[1:]), pa.array(number + np.arange(n)), packed, *lists],
                    names=[key, "held_out", "__row", "__ids", "__rare", "__times"],
                )
                number += n

    more = "__row long, __ids binary, __rare array<long>, __times array<int>"
    coded = written(rows.mapInArrow(code, schema_with(rows, [key, "held_out"], more)))
    tree = grown(numbering, coded.where(~F.col("held_out")).select("__ids"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = tree.root()
        for depth in tree.depths:
            depth.prepare()
        for batch in batches:
            for at, to, ids, lengths in _codes(batch.column(0)):
                owners = np.repeat(np.arange(to - at), lengths)
                base = np.where(ids >= 0, root[ids], 0.0)
                log = base.copy()
                for depth, place, state in walked(ids, tree.depths):
                    found = np.where(ids[place] >= 0, depth.stored_at(state << _BITS | np.maximum(ids[place], 0)), -1)
                    log[place] = np.where(found >= 0, depth.logs[found], depth.backoff[state] + log[place])
                known = np.where(ids >= 0, tree.counts[ids] > 0, False)
                sums = [np.bincount(owners, x[1:], to - at) for x in (base, log)]
                ints = [np.bincount(owners, x[1:], to - at).astype(np.int64) for x in (np.ones(len(ids)), known)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, to - at) for c in batch.columns[1:]), *map(pa.array, ints), *map(pa.array, sums)],
                    names=[key, "held_out", "__row", "n_tokens", "n_known", "base_score", "score"],
                )

    out = coded.select("__ids", key, "held_out", "__row")
    out = out.mapInArrow(score, schema_with(out, [key, "held_out", "__row"], "n_tokens long, n_known long, base_score double, score double"))
    rare = coded.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("x")).select("__row", F.col("x.__rare").alias("k"), F.col("x.__times").alias("t"))
    unseen = tree.unseen()
    log = F.when(F.col("n").isNull(), F.lit(unseen)).otherwise(F.log10(F.col("n") + 1) + F.lit(unseen))
    sums = (
        rare.join(words, "k", "left").groupBy("__row")
        .agg(F.sum(F.col("t") * log).alias("__log"), F.sum(F.when(F.col("n").isNotNull(), F.col("t"))).alias("__known"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.join(sums, "__row", "left").select(
        key, "held_out", "n_tokens", (F.col("n_known") + zero("__known")).cast("long").alias("n_known"), F.lit(tree.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("__log")).alias("base_score"), (F.col("score") + zero("__log")).alias("score"),
    )
