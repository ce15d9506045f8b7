"""Secret scans: base patterns, and formats learned as probabilistic automata from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import schema_with, written

KINDS = ("assign", "access", "hex", "format")
#: Labelled credentials of each kind, and other strings, that automata are learned from: those that hash lowest.
MAX_LABELLED = 600
#: Longer strings are not learned from; they are scored like all others.
MAX_LEARNED_LENGTH = 200
#: Confidence of the state-merging test.
ALPHA = 0.05
#: Share of its own training strings that an automaton may find less likely than its cutoff.
CUTOFF_SHARE = 0.02
#: Least log-likelihood ratio (base e) of a credential automaton to that of other strings.
MIN_RATIO = 10.0
MIN_LENGTH = 16

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, value) of base matches, by start and kind; offsets are code points.

    Matches of a kind are leftmost and do not overlap. An assignment whose value is short is dropped after it has
    been matched, so nothing is looked for inside it; runs of the other kinds that are too short hold no longer one.
    """
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters that touch no base span."""
    starts = [x[0] for x in taken]
    # the furthest end of a span that starts no later; spans of different kinds may overlap
    furthest = list(accumulate((x[2] for x in taken), max))

    def touched(a: int, b: int) -> bool:
        n = bisect_left(starts, b)
        return n > 0 and furthest[n - 1] > a

    for m in _CANDIDATE.finditer(text):
        value = m[0].rstrip(".=-_/")
        a, b = m.start(), m.start() + len(value)
        if len(value) >= MIN_LENGTH and not touched(a, b):
            yield a, b, value


@dataclass
class Automaton:
    """A deterministic probabilistic automaton; state 0 is the first."""

    moves: list[dict[str, int]]
    logs: list[dict[str, float]]
    ends: list[float]
    unseen: list[float]
    cutoff: float = -math.inf

    def log_likelihood(self, value: str) -> float:
        at, total = 0, 0.0
        for c in value:
            total += self.logs[at].get(c, self.unseen[at])
            at = self.moves[at].get(c, at)
        return total + self.ends[at]


def infer(strings: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the strings' prefix tree.

    States are compatible if the shares of each next character, and of the end, differ by no more than chance allows,
    here and after each character. States are tried in breadth-first order; one that is compatible with none becomes
    a state of the automaton.
    """
    moves: list[dict[str, int]] = [{}]
    uses: list[Counter] = [Counter()]
    finals, totals = [0], [0]
    for s, n in sorted(Counter(strings).items()):
        at = 0
        totals[0] += n
        for c in s:
            if c not in moves[at]:
                moves[at][c] = len(moves)
                moves.append({})
                uses.append(Counter())
                finals.append(0)
                totals.append(0)
            uses[at][c] += n
            at = moves[at][c]
            totals[at] += n
        finals[at] += n
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = totals[a], totals[b]
            if not n or not m or width * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
                continue
            if differ(finals[a], n, finals[b], m) or any(differ(uses[a][c], n, uses[b][c], m) for c in uses[a].keys() | uses[b].keys()):
                return False
            todo += [(moves[a][c], moves[b][c]) for c in moves[a].keys() & moves[b].keys()]
        return True

    def fold(into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            totals[a] += totals[b]
            finals[a] += finals[b]
            uses[a].update(uses[b])
            for c, child in moves[b].items():
                if c in moves[a]:
                    todo.append((moves[a][c], child))
                else:
                    moves[a][c] = child

    settled = [0]
    fringe = deque((0, c) for c in sorted(moves[0]))
    while fringe:
        parent, c = fringe.popleft()
        state = moves[parent][c]
        if state in settled:
            continue
        for known in settled:
            if compatible(known, state):
                moves[parent][c] = known
                fold(known, state)
                fringe.extend((k, x) for k in settled for x in sorted(moves[k]) if moves[k][x] not in settled and (k, x) not in fringe)
                break
        else:
            settled.append(state)
            fringe.extend((state, x) for x in sorted(moves[state]))
    number = {s: i for i, s in enumerate(settled)}
    n_symbols = 96
    logs, ends, unseen = [], [], []
    for s in settled:
        whole = math.log(totals[s] + 0.05 * (n_symbols + 1))
        logs.append({c: math.log(n + 0.05) - whole for c, n in uses[s].items()})
        ends.append(math.log(finals[s] + 0.05) - whole)
        unseen.append(math.log(0.05) - whole)
    return Automaton([{c: number[x] for c, x in moves[s].items()} for s in settled], logs, ends, unseen)


def learned(labelled: dict[str, list[str]], other: list[str]) -> tuple[dict[str, Automaton], Automaton]:
    """An automaton for each kind of credential, with its cutoff, and one for other strings."""
    formats = {}
    for kind, values in sorted(labelled.items()):
        if values:
            a = infer(values)
            likely = sorted(a.log_likelihood(v) / (len(v) + 1) for v in values)
            a.cutoff = likely[int(CUTOFF_SHARE * len(likely))]
            formats[kind] = a
    return formats, infer(other or ["the"])


def has_format(value: str, formats: dict[str, Automaton], other: Automaton) -> bool:
    """Whether some credential automaton finds the value as likely as its own strings, and far likelier than other strings."""
    plain = other.log_likelihood(value)
    return any(
        (x := a.log_likelihood(value)) / (len(value) + 1) >= a.cutoff and x - plain >= MIN_RATIO for a in formats.values()
    )


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def ordinary(text: str, taken: list[tuple[int, int, int, str]]) -> set[str]:
    """Words outside the base spans."""
    parts, at = [], 0
    for a, _, b, _ in taken:
        if a >= at:
            parts.append(text[at:a])
        at = max(at, b)
    return set(" ".join([*parts, text[at:]]).split())


def place(value: str) -> int:
    """The hash by whose order strings are chosen: Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(value.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def lowest_words(words: set[str]) -> list[str]:
    """The MAX_LABELLED words that hash lowest, of those that are short enough and hold nothing that is to be scored."""
    out: list[str] = []
    for _, w in sorted((place(w), w) for w in words):
        if len(w) <= MAX_LEARNED_LENGTH and not _CANDIDATE.search(w):
            out.append(w)
            if len(out) == MAX_LABELLED:
                break
    return out


SCAN = "base array<struct<a:int,k:int,b:int,v:string>>, other array<struct<a:int,b:int,v:string>>, words array<string>"


def scanned(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with its base spans and its further candidates; words: ordinary ones to compare with.

    The first row of a batch holds the words that hash lowest among all words of the batch's whole texts, so the lowest
    of all batches are the lowest of all texts.
    """
    kept = docs.select(*columns, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32()), ("v", pa.string())]))
        other_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("v", pa.string())]))
        for batch in batches:
            base, other, seen = [], [], set()
            for t in batch.column(len(columns)).to_pylist():
                spans = base_spans(t or "")
                base.append([dict(zip("akbv", (a, k, b, v), strict=True)) for a, k, b, v in spans])
                other.append([dict(zip("abv", x, strict=True)) for x in candidates(t or "", spans)])
                seen |= ordinary(t or "", spans)
            words = [lowest_words(seen), *([[]] * (len(base) - 1))][: len(base)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(base, base_type), pa.array(other, other_type), pa.array(words, pa.list_(pa.string()))],
                names=[*columns, "base", "other", "words"],
            )

    return kept.mapInArrow(run, schema_with(docs, columns, SCAN))


def trained(found: DataFrame) -> tuple[dict[str, Automaton], Automaton]:
    """Automata from a scan's base values, by kind, and from ordinary words: at most MAX_LABELLED distinct ones of each."""

    def lowest(values: DataFrame) -> list[str]:
        rows = values.distinct().orderBy(F.xxhash64("v"), "v").limit(MAX_LABELLED)
        return [r["v"] for r in rows.collect()]

    base = found.select(F.explode("base").alias("x")).select("x.k", "x.v").where(F.length("v") <= MAX_LEARNED_LENGTH)
    labelled = {KINDS[k]: lowest(base.where(F.col("k") == k).select("v")) for k in range(3)}
    other = lowest(found.select(F.explode("words").alias("v")))
    return learned(labelled, other)


def secrets(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with base and added spans: base array<struct<a,k,b,v>>, added array<struct<a,b>>, for every row.

    Credentials are labelled by the base patterns; every further candidate of the whole text is scored. Null and empty
    texts have no spans; repeated rows each get a row; an empty table gives an empty result.
    """
    found = written(scanned(docs, columns, text))
    formats, other = trained(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            added = [
                [{"a": x["a"], "b": x["b"]} for x in row if has_format(x["v"], formats, other)]
                for row in batch.column(len(columns) + 1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns) + 1], pa.array(added, kind)], names=[*columns, "base", "added"])

    more = "base array<struct<a:int,k:int,b:int,v:string>>, added array<struct<a:int,b:int>>"
    return found.drop("words").mapInArrow(score, schema_with(docs, columns, more))


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_format for every row of ``docs``.

    Null and empty texts have no spans; repeated rows and null keys each get a row; an empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    found = secrets(docs, [key], text)
    key_type = docs.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [(x["a"], x["k"], x["b"]) for x in base]
                n = Counter(k for _, k, _ in own)
                sha = hashlib.sha256(joined(own).encode()).hexdigest()
                rows.append((n[0], n[1], n[2], sha, joined(own + [(x["a"], 3, x["b"]) for x in added]), len(added)))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return found.mapInArrow(digest, f"`{key}` {key_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


MASK = "[SECRET]"


def masked(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with each secret replaced by MASK (overlapping ones by one), and ``size`` brought up to date.

    Two passes over the text, since what the second adds is learned in the first; no row is dropped and none moves.
    Null and empty texts stay as they are; repeated rows are each masked; an empty table gives an empty result. Other
    columns keep their values, whatever their names; without a column ``size`` only the text changes.
    """
    found = written(scanned(docs, [], text))
    formats, other = trained(found)
    columns = docs.columns
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], batch.column(columns.index(size)).to_pylist() if size in columns else None
            for i, t in enumerate(batch.column(place).to_pylist()):
                spans = base_spans(t or "")
                pairs = sorted([(a, b) for a, _, b, _ in spans] + [(a, b) for a, b, v in candidates(t or "", spans) if has_format(v, formats, other)])
                parts, at = [], 0
                for j, (a, b) in enumerate(pairs):
                    if a >= at or not j:
                        parts += [t[at:a], MASK]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if pairs else t)
                if pairs and sizes:
                    sizes[i] = len(out[-1])
            arrays = list(batch.columns)
            arrays[place] = pa.array(out, batch.schema.field(place).type)
            if sizes is not None:
                at = columns.index(size)
                arrays[at] = pa.array(sizes, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return docs.mapInArrow(run, docs.schema)
