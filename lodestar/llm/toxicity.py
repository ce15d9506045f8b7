"""Toxicity severity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.store import written
from lodestar.llm.tokens import WORD_BYTES, blocks, mixed, word_hashes

#: Labelled documents that the model is fitted on: those whose ids hash lowest.
MAX_LABELLED = 20_000
MAX_FEATURES = 1024
MIN_DOCUMENTS = 4
#: Least likelihood-ratio statistic of a word's association with the label.
MIN_ASSOCIATION = 30.0
#: Toxic training documents are divided into so many grades, by the occurrences of words found almost only in them.
TOXIC_GRADES = 3
MARKER_SHARE = 0.8
PENALTY = 1e-3
STEPS = 400
TOXIC_FROM = 0.5
#: A labelled document counts as a copy of an earlier one with the same label from this Jaccard similarity of their
#: three-word shingles on. Compared are documents that agree in one of the first PLACES lowest hashes and in AGREE of all
#: N_LOWEST, four standard errors below what the similarity lets expect.
COPY_SIMILARITY = 0.8
N_LOWEST = 64
PLACES = 8
AGREE = 38


def counted(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct word hashes, counts) of each text."""
    for at, to in blocks(texts):
        hashes, owners = word_hashes(texts[at:to], WORD_BYTES)
        first = np.searchsorted(owners, np.arange(to - at + 1))
        for i in range(to - at):
            yield np.unique(hashes[first[i] : first[i + 1]], return_counts=True)


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(w.x - threshold_k): one weight per word, shared by all ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        hit = self.words[at] == hashes
        return at[hit], np.log1p(counts[hit])

    def exceeds(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, words: np.ndarray) -> OrdinalModel:
    """Maximum penalised likelihood by gradient ascent with momentum. Thresholds are kept in order by positive steps."""
    n, k = len(grade), int(grade.max(initial=0))
    if not n or not k:
        return OrdinalModel(words, np.zeros(len(words)), np.full(max(k, 1), 60.0))
    w, speed = np.zeros(len(words)), np.zeros(len(words) + k)
    shares = np.array([(grade >= i).mean() for i in range(1, k + 1)]).clip(1e-6, 1 - 1e-6)
    start = np.log(1 / shares - 1)
    gaps = np.concatenate((start[:1], np.log(np.diff(start).clip(min=0.05))))
    rate = 1.0 / (0.25 * (1 + np.bincount(row, value**2, n).max(initial=0.0)))
    for step in range(STEPS):
        ahead = step / (step + 3)
        w_at, gaps_at = w + ahead * speed[: len(w)], gaps + ahead * speed[len(w) :]
        thresholds = np.concatenate((gaps_at[:1], gaps_at[0] + np.cumsum(np.exp(gaps_at[1:]))))
        score = np.bincount(row, value * w_at[col], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -60, 60)))
        edges = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        hi, lo = edges[at, grade], edges[at, grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_threshold = np.zeros((n, k + 2))
        by_threshold[at, grade] -= d_hi
        by_threshold[at, grade + 1] += d_lo
        g_thresholds = by_threshold[:, 1 : k + 1].sum(axis=0) / n
        g_gaps = np.cumsum(g_thresholds[::-1])[::-1]
        g_gaps[1:] *= np.exp(gaps_at[1:])
        g_w = np.bincount(col, value * (d_hi - d_lo)[row], len(words)) / n - PENALTY * w_at
        new_w, new_gaps = w_at + rate * g_w * 4, gaps_at + 0.5 * g_gaps
        speed = np.concatenate((new_w - w, new_gaps - gaps))
        w, gaps = new_w, new_gaps
    return OrdinalModel(words, w, np.concatenate((gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:])))))


def association(toxic_with: np.ndarray, with_word: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Likelihood-ratio statistic of each word's two-by-two table."""
    cells = np.stack((toxic_with, with_word - toxic_with, toxic - toxic_with, total - with_word - toxic + toxic_with)).astype(float)
    rows = np.stack((with_word, with_word, total - with_word, total - with_word))
    cols = np.stack((np.full_like(with_word, toxic), np.full_like(with_word, total - toxic)) * 2)
    return 2 * (cells * np.log(np.where(cells > 0, cells * total / np.maximum(rows * cols, 1), 1.0))).sum(axis=0)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the three-word shingles (of the words, if there are fewer)."""
    return np.unique(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7) if len(words) > 2 else words)


def lowest_hashes(of: np.ndarray) -> list[int]:
    """The lowest hash of the shingles under each of N_LOWEST functions."""
    return [int(mixed(of ^ np.uint64(i)).min(initial=np.uint64((1 << 64) - 1)).view(np.int64)) for i in range(N_LOWEST)]


def with_company(lowest: np.ndarray) -> np.ndarray:
    """Positions of the rows that share one of the first PLACES hashes with another row."""
    shared = np.zeros(len(lowest), bool)
    for place in range(PLACES):
        _, at, n = np.unique(lowest[:, place], return_inverse=True, return_counts=True)
        shared |= n[at] > 1
    return np.flatnonzero(shared)


def without_copies(lowest: np.ndarray, labels: list[int], sets: dict[int, np.ndarray]) -> list[int]:
    """Positions of the rows that are no copy of a kept earlier row with the same label; ``sets`` are shingles by position."""
    kept: list[int] = []
    seen: dict[tuple[int, int, int], list[int]] = {}
    for row in range(len(lowest)):
        places = [(i, labels[row], x) for i, x in enumerate(lowest[row, :PLACES].tolist())]
        others = np.array(sorted({o for p in places for o in seen.get(p, ())}), np.int64)
        near = others[(lowest[others] == lowest[row]).sum(axis=1) >= AGREE].tolist() if len(others) else []
        for other in near:
            shared = len(np.intersect1d(sets[row], sets[other], assume_unique=True))
            if shared >= COPY_SIMILARITY * (len(sets[row]) + len(sets[other]) - shared):
                break
        else:
            kept.append(row)
            for p in places:
                seen.setdefault(p, []).append(row)
    return kept


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> OrdinalModel:
    """Fit on at most MAX_LABELLED labelled documents, of which near copies with the same label count once."""
    key_type = docs.schema[key].dataType.simpleString()
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__y"))
        .orderBy(F.xxhash64(key), key).limit(MAX_LABELLED)
    )

    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
            sets = []
            for at, to in blocks(texts):
                hashes, owners = word_hashes(texts[at:to], WORD_BYTES)
                first = np.searchsorted(owners, np.arange(to - at + 1))
                sets += [shingles(hashes[first[i] : first[i + 1]]) for i in range(to - at)]
            pairs = list(counted(texts))
            longs = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), longs([lowest_hashes(x) for x in sets]), longs([x.view(np.int64) for x in sets]),
                    longs([h.view(np.int64) for h, _ in pairs]), longs([c for _, c in pairs]),
                ],
                names=["key", "y", "lowest", "shingles", "words", "counts"],
            )

    # at most MAX_LABELLED rows of a key and a label
    sample = docs.join(F.broadcast(chosen), key).select(key, text, "__y").mapInArrow(
        featurised, f"key {key_type}, y int, lowest array<long>, shingles array<long>, words array<long>, counts array<long>"
    )
    sample = written(sample.groupBy("key").agg(F.min(F.struct("lowest", "y", "shingles", "words", "counts")).alias("s")).select("key", "s.*"))
    heads = sample.select("key", "y", "lowest").toArrow().to_pylist()
    heads.sort(key=lambda r: r["key"])
    lowest = np.array([r["lowest"] for r in heads], np.int64).reshape(-1, N_LOWEST)

    def named(positions: list[int]) -> DataFrame:
        rows = [(heads[i]["key"], i) for i in positions]
        return F.broadcast(docs.sparkSession.createDataFrame(rows, StructType([StructField("key", docs.schema[key].dataType), StructField("at", LongType())])))

    # the shingles of at most MAX_LABELLED documents
    compared = sample.join(named(with_company(lowest).tolist()), "key").select("at", "shingles").toArrow()
    sets = {at: x.values.to_numpy().view(np.uint64) for at, x in zip(compared.column("at").to_pylist(), compared.column("shingles"), strict=True)}
    kept = without_copies(lowest, [r["y"] for r in heads], sets)
    one = written(sample.join(named(kept), "key", "left_semi").select("y", "words", "counts"))
    total, toxic = (int(x or 0) for x in one.agg(F.count(F.lit(1)), F.sum(F.col("y").cast("boolean").cast("int"))).first())
    by_word = (
        one.select(F.explode("words").alias("w"), F.col("y").cast("boolean").cast("int").alias("t")).groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).where(F.col("n") >= MIN_DOCUMENTS)
    )
    # a word is looked at if it is more frequent in toxic documents, or at least a hundredth of all; most words are neither
    by_word = by_word.where((F.col("t") * F.lit(total) > F.col("n") * F.lit(2 * toxic)) | (F.col("n") * 100 > F.lit(total)))
    expected = F.col("n") * F.lit(toxic / max(total, 1))
    rough = (F.col("t") - expected) * (F.col("t") - expected) / F.greatest(expected, F.lit(1e-9))
    table = by_word.orderBy(F.desc(rough), "w").limit(4 * MAX_FEATURES).toPandas()
    stat = association(table["t"].to_numpy(np.int64), table["n"].to_numpy(np.int64), toxic, total)
    table = table[stat >= MIN_ASSOCIATION].assign(stat=stat[stat >= MIN_ASSOCIATION]).nlargest(MAX_FEATURES, "stat")
    words = np.sort(table["w"].to_numpy(np.int64).view(np.uint64))
    markers = np.sort(table.loc[table["t"] >= MARKER_SHARE * table["n"], "w"].to_numpy(np.int64).view(np.uint64))
    empty = OrdinalModel(words, np.zeros(len(words)), np.zeros(1))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, c = np.array(h, np.int64).view(np.uint64), np.array(c, np.int64)
                at, value = empty.features(h, c)
                out.append((y, int(c[np.isin(h, markers)].sum()), at.tolist(), value.tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], names=["y", "m", "at", "v"])

    rows = one.mapInArrow(selected, "y int, m long, at array<long>, v array<double>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["y"], r["m"], r["at"], r["v"]))
    y, m = np.array([r["y"] for r in rows], np.int64), np.array([r["m"] for r in rows], np.int64)
    if y.max(initial=0) <= 1 and (m[y > 0] > 0).any():
        # labels that say yes or no: grades follow the number of markers
        cuts = np.unique(np.quantile(m[(y > 0) & (m > 0)], np.arange(1, TOXIC_GRADES) / TOXIC_GRADES))
        y = np.where(y > 0, 1 + np.searchsorted(cuts, m, side="left"), 0)
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    col = np.array([x for r in rows for x in r["at"]], np.int64)
    value = np.array([x for r in rows for x in r["v"]], float)
    return fit(row, col, value, y, words)


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (the likeliest grade), expected_severity, toxic_probability (of a grade over 0) and toxic, for every row.

    The whole text is read. Null and empty texts get the grade of a text without any weighted word; repeated rows each
    get a row; an empty table gives an empty result. The model has at most MAX_FEATURES weights.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(1).to_pylist()]
            scores = np.zeros(len(texts))
            for at, to in blocks(texts):
                hashes, owners = word_hashes(texts[at:to], WORD_BYTES)
                if len(model.words) and len(hashes):
                    place = np.searchsorted(model.words, hashes).clip(max=len(model.words) - 1)
                    hit = np.flatnonzero(model.words[place] == hashes)
                    pairs, counts = np.unique(owners[hit] * len(model.words) + place[hit], return_counts=True)
                    scores[at:to] += np.bincount(pairs // len(model.words), np.log1p(counts) * model.weights[pairs % len(model.words)], to - at)
            above = model.exceeds(scores)
            grades = -np.diff(np.concatenate((np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grades.argmax(axis=1).astype(np.int32)), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= TOXIC_FROM)],
                names=[key, "severity", "expected_severity", "toxic_probability", "toxic"],
            )

    return docs.select(key, text).mapInArrow(score, f"`{key}` {key_type}, severity int, expected_severity double, toxic_probability double, toxic boolean")
