"""Suffix-array dedup: a distributed difference-cover algorithm over the repeated parts of all texts.

Anchors (see ``anchors``) bring together, losslessly, all windows that can be equal: each run of windows with one
repeated anchor travels as the bytes it spans, dealt by the anchor's hash. Every task then sorts the suffixes
of its spans by the difference cover of 3: triples at positions 1 and 2 modulo 3 are sorted and
named, names that repeat are sorted by recursion, the remaining suffixes follow from one byte and the name
after it, and a merge yields the suffix array. Adjacent suffixes that start a window are compared over the
window's bytes, so matches are exact.

Equal spans meet in a slice before they travel, and anchors with more than ``HOT`` occurrences do not
travel as spans: their windows get 128-bit names and are counted by name, so a hot passage
is spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Units, Windows, anchor_table, emitted, lists, octets, removed_units, settled, with_lists
from .common import drop_written, runs, slices, written

WINDOW, GRAM, HOT = 400, 256, 2048
#: Bytes of text handled at once in a task.
SLICE = 1 << 20
#: Bytes of spans that one suffix array holds at most, unless one anchor has more.
ARRAY = 1 << 20


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, dense rank from 1 of each element, rank in order) by the keys, the first one weighing most."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    if len(order):
        fresh[0] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    sorted_ = np.cumsum(fresh)
    rank = np.empty(len(order), np.int64)
    rank[order] = sorted_
    return order, rank, sorted_


def difference_cover_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of positive integers, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    wide = int(padded.max()) + 1
    # The sample: positions 1 mod 3, one past the end included if the length asks for it, then 2 mod 3.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if wide < 1 << 20:
        order, names, named = _ranks((padded[sample] * wide + padded[sample + 1]) * wide + padded[sample + 2])
    else:
        order, names, named = _ranks(padded[sample] * wide + padded[sample + 1], padded[sample + 2]) if wide < 1 << 31 else _ranks(padded[sample], padded[sample + 1], padded[sample + 2])
    if len(sample) and named[-1] < len(sample):
        order = difference_cover_array(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sample_order = sample[order]
    sample_order = sample_order[sample_order < n]
    # The remaining suffixes: a letter and the sampled suffix after it.
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], padded[rest]))]
    # The merge: each remaining suffix goes after the sampled ones that are smaller. A sampled suffix at 1 mod 3
    # compares by (letter, rank), one at 2 mod 3 by (letter, letter, rank).
    m = len(sample) + 2
    first = sample_order[sample_order % 3 == 1]
    second = sample_order[sample_order % 3 == 2]
    in_first = np.searchsorted(padded[first] * m + rank[first + 1], padded[rest] * m + rank[rest + 1])
    a_rank, b_rank = _pair_ranks(padded[second], padded[second + 1], rank[second + 2], padded[rest], padded[rest + 1], rank[rest + 2])
    in_second = np.searchsorted(a_rank, b_rank)
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + in_first + in_second
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sample_order
    return out


def _pair_ranks(a1: np.ndarray, a2: np.ndarray, a3: np.ndarray, b1: np.ndarray, b2: np.ndarray, b3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One integer for each triple of both lists, ordered as the triples are."""
    heads = np.concatenate([a1, b1]) * (int(max(a2.max(initial=0), b2.max(initial=0))) + 1) + np.concatenate([a2, b2])
    tails = np.concatenate([a3, b3])
    most = int(tails.max(initial=0)) + 1
    if len(heads) and int(heads.max()) < (1 << 62) // most:
        whole = heads * most + tails
    else:
        whole = _ranks(heads, tails)[1]
    return whole[: len(a1)], whole[len(a1) :]


def repeated_starts(spans: list[bytes], window: int) -> list[np.ndarray]:
    """For distinct spans, the offsets at which a window starts that starts elsewhere in them too."""
    size = np.array([len(s) for s in spans])
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(at[-1], np.int64)
    raw = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8)
    text[:] = raw
    text += 2
    text[at[1:] - 1] = 1
    is_start = np.zeros(len(text) + 1, np.int64)
    is_start[at[:-1]] += 1
    np.subtract.at(is_start, at[:-1] + np.maximum(size - window + 1, 0), 1)
    is_start = np.cumsum(is_start[:-1]) > 0
    order = difference_cover_array(text)
    order = order[is_start[order]]
    if not len(order):
        return [np.empty(0, np.int64) for _ in spans]
    views = np.lib.stride_tricks.sliding_window_view(raw, window)
    same = np.zeros(len(order), bool)
    for i in range(0, len(order) - 1, 8192):
        j = min(i + 8192, len(order) - 1)
        same[i:j] = (views[order[i:j]] == views[order[i + 1 : j + 1]]).all(axis=1)
    again = same.copy()
    again[1:] |= same[:-1]
    hit = np.sort(order[again])
    owner = np.searchsorted(at, hit, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(spans) + 1))
    return [hit[bounds[k] : bounds[k + 1]] - at[k] for k in range(len(spans))]


def _repeats(spans: list[tuple[int, bytes]], numbers: list[int]) -> list[np.ndarray]:
    """Offsets of repeated windows in each span. The same bytes under two anchors are two occurrences of no window: anchors differ."""
    texts: dict[bytes, int] = {}
    for _, span in spans:
        texts.setdefault(span, len(texts))
    found = repeated_starts(list(texts), WINDOW)
    return [found[texts[span]] for _, span in spans]


def remove_repeats(docs: DataFrame, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, its text as UTF-8 bytes.

    A byte goes if a window of ``WINDOW`` bytes over it starts anywhere else too, in the same row or another; every occurrence
    goes. Null and short texts lose nothing; whole copies lose everything from ``WINDOW`` bytes on.
    """
    windows = Windows(octets, WINDOW, gram, SLICE)
    table = written(anchor_table(docs, windows), "anchors")
    counts = table.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts.select("fp", (F.col("n") > hot).cast("int").alias("hot")), "counts")
    found = lists(table.join(counts, "fp"), "at hot")
    drop_written(table)
    drop_written(counts)

    def content(data: np.ndarray, u: Units, start: np.ndarray) -> Callable[[int, int], bytes]:
        whole = data.tobytes()
        return lambda a, b: whole[start[a] : start[b - 1] + WINDOW]

    met = settled(emitted(docs, found, windows, content), _repeats, ARRAY)
    met = met.groupBy("_d", "_h").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("_at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                gone = removed_units(batch, i, j, octets(data, offsets), WINDOW)
                out = []
                for r in range(j - i):
                    own, mask = data[offsets[r] : offsets[r + 1]], gone[offsets[r] : offsets[r + 1]]
                    out.append((len(own), int(mask.sum()), len(runs(mask)[0]), hashlib.sha256(own[~mask].tobytes()).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_lists(docs, met).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
