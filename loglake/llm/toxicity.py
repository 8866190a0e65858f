"""Toxicity from subword bags: hashed character n-grams of words, embedded, averaged, softmax on top.

A text's bag holds the n-grams of its distinct words; the mean of their vectors goes into a linear softmax. Vectors and softmax are
trained together in numpy (Adagrad). Misspellings share most n-grams with the words they come from, and a word counts
once however often a long text repeats its other words. Once trained, the softmax and the vectors fold into one weight per
n-gram, so scoring is a gather and a mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, crc_mod, in_small_batches, row_of, slices, split_words, spread

#: The fitted sample: at most so many labelled rows of each class, with their whole texts.
SAMPLE_PER_CLASS = 1200
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (4, 5, 6)
EPOCHS, RATE = 25, 1.0
#: The logit of a text without a word.
EMPTY = -6.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_HASH, _WORD = [Rolling(100 + n) for n in NGRAMS], Rolling(99)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets and the row of each, from the distinct words of every row, sorted by row.

    n-grams are bytes of one word with the break on either side of it, ASCII letters lower-case. A word shorter than all of them has none.
    """
    starts, ends, first = split_words(data, offsets)
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    lower, row = _LOWER[data], row_of(first)
    word = _WORD.spans(_WORD.prefix(lower), starts, ends)
    order = np.lexsort((word, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    kept = order[fresh]
    starts, row, length = starts[kept], row[kept], (ends - starts)[kept]
    # Words side by side with one break between any two.
    at = np.concatenate([[0], np.cumsum(length + 1)]) + 1
    line = np.full(at[-1], 0x20, np.uint8)
    line[spread(at[:-1], length)] = lower[spread(starts, length)]
    # Breaks up to each byte count its word; the break before a word belongs to the word before it.
    breaks = np.cumsum(line == 0x20, dtype=np.int32)
    row_at = row[np.minimum(breaks - 1, len(row) - 1)]
    grams, owner = [], []
    for n, rolling in zip(NGRAMS, _HASH, strict=True):
        h = rolling.windows(rolling.prefix(line), n)
        # All breaks of a window must be its first or last byte.
        good = np.flatnonzero(breaks[n - 2 : n - 2 + len(h)] == breaks[: len(h)])
        grams.append((h[good] & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(row_at[good])
    return np.concatenate(grams), np.concatenate(owner)


def logits(weights: np.ndarray, bias: float, grams: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    counts = np.bincount(owner, minlength=rows)
    return np.where(counts > 0, np.bincount(owner, weights[grams], minlength=rows) / np.maximum(counts, 1) + bias, EMPTY)


def train(made: list[np.ndarray], toxic: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Folded weight of each n-gram bucket and the bias, from the bags of texts. Without both classes every text gets the known share."""
    marks = np.asarray(toxic, np.int64)
    if not len(marks) or marks.min() == marks.max():
        return np.zeros(BUCKETS), float(-4.0 if not len(marks) or marks[0] == 0 else 4.0)
    # Each bucket once, with its share of the bag.
    made = [tuple(np.unique(g, return_counts=True)) for g in made]
    made = [(g, (n / max(n.sum(), 1)).astype(np.float32)) for g, n in made]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.normal(0, 0.1, DIM)
    bias, table_sq, soft_sq = np.zeros(2, np.float32), np.full(BUCKETS, 1e-4, np.float32), 1e-4
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(made)):
            grams, share = made[k]
            if not len(grams):
                continue
            bag = share @ table[grams]
            z = bag @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[marks[k]] -= 1
            step = soft @ p
            soft_sq += float((p**2).sum() * (bag**2).sum())
            soft -= rate / np.sqrt(soft_sq) * np.outer(bag, p)
            bias -= 0.02 * rate * p
            table_sq[grams] += share**2 * float((step**2).sum())
            table[grams] -= (rate * share / np.sqrt(table_sq[grams]))[:, None] * step
    weights, shift = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0])
    scores = np.array([float(share @ weights[g]) + shift if len(g) else EMPTY for g, share in made])
    return weights, shift - _cut(scores, marks)


def _cut(scores: np.ndarray, marks: np.ndarray) -> float:
    """The logit that separates the classes best, each class counting half, clean rows four times as dear."""
    order = np.argsort(scores)
    bad = np.concatenate([[0], np.cumsum(marks[order])]) / marks.sum()
    good = np.concatenate([[0], np.cumsum(1 - marks[order])]) / (1 - marks).sum()
    at = int(np.argmin(bad + 4 * (1 - good)))
    lo, hi = scores[order][max(at - 1, 0)], scores[order][min(at, len(order) - 1)]
    return float((lo + hi) / 2)


def _bag_rows(docs: DataFrame) -> DataFrame:
    """_y and grams, the bag of each row's whole text as 32-bit numbers in order: a few kilobytes, never lists of Python numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
                grams, owner = bags(data, offsets)
                order = np.lexsort((grams, owner))
                bounds = np.searchsorted(owner[order], np.arange(j - i + 1))
                grams = grams[order]
                own = [grams[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_y").slice(i, j - i), pa.array(own, pa.binary())], names=["_y", "grams"])

    return docs.select("_y", "text").mapInArrow(run, "_y bigint, grams binary")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Learns from rows that are not held out; the rows of lowest hash of each class, at most ``per_class`` of them.

    A row with null id, text or label is not learnt from; a document labelled more than once is toxic if any label says so. Bags are made
    where the rows are; of a text, the numbers of its distinct words' n-grams reach the driver.
    """
    known = labels.where(F.col("toxic").isNotNull()).where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.shiftrightunsigned("_h", 12) / F.lit(float(1 << 52))
    picked = None
    for y, n in sorted(counts.items()):
        part = known.where((F.col("_y") == y) & (unit < min(1.0, 1.2 * per_class / n + 16.0 / n))).orderBy("_h").limit(per_class)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return train([], [])
    # At most 2 * per_class ids: a bound of a few dozen kilobytes, so the broadcast is safe.
    rows = in_small_batches(docs).select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").select("text", F.col("_y").cast("long").alias("_y"))
    rows = _bag_rows(rows).collect()
    rows.sort(key=lambda r: (r["_y"], bytes(r["grams"])))
    return train([np.frombuffer(r["grams"], "<i4") for r in rows], [int(r["_y"] != 0) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score and predicted of every row, from its whole text. Texts without words, null ones too, get the logit ``EMPTY``."""
    weights, bias = model[0].astype(np.float32), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
                grams, owner = bags(data, offsets)
                p = 1 / (1 + np.exp(-np.clip(logits(weights, bias, grams, owner, j - i), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, trained on the rows outside the held-out fifth. A row without id is not held out."""
    return score(docs, fit(docs, labels)).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
