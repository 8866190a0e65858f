"""Quality rules: plain counts and repetition found with a suffix array.

Many short texts are sorted together: the first rank of a suffix holds its document, so no order or match
crosses documents. Ranks double in length until every suffix is unique; longest common prefixes come
from the kept ranks, and their intervals are the maximal repeated substrings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, covered, in_small_batches, row_of, slices, split_words

#: Base rule: fewer words fail; more than this share of words in repeated windows of eight fails.
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Verdict of the suffix array: repeats of at least so many words count; most covered percent; longest repeat in words.
MIN_REPEAT, MOST_COVERED, MOST_LONGEST = 10, 25, 150

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_array(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the longest common prefix of each with its predecessor.

    ``first`` holds dense ranks in which equal values are equal symbols of one document, and each
    document's values form a range of their own; a document's end is smaller than any symbol.
    """
    n = len(first)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    levels, rank, step = [], first.astype(np.int64) + 1, 1
    while True:
        levels.append(rank)
        counts = np.bincount(rank)
        open_ = np.flatnonzero(counts[rank] > 1)
        if not len(open_):
            break
        after = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)], 0)
        # A suffix that ends within its document meets the next document's ranks, which no equal suffix of
        # the same document can share unless it ends at the same place.
        key = rank[open_] * np.int64(n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        group = rank[open_][order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(order))
        begin = np.maximum.accumulate(np.where(head, at, 0))
        mine = np.maximum.accumulate(np.where(fresh, at, 0))
        # Ranks leave room: a class starts at the number of smaller suffixes plus one.
        below = np.cumsum(counts)[group - 1]
        new = np.empty(n, np.int64)
        new[:] = np.cumsum(counts)[rank - 1] + 1
        new[open_[order]] = below + (mine - begin) + 1
        if step >= n:
            break
        rank, step = new, step * 2
    order = np.argsort(levels[-1], kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        got += same << k
        a += same << k
        b += same << k
    lcp[1:] = got
    return order, lcp


def repeat_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the suffix order whose members share at least ``least`` symbols."""
    out, stack = [], []
    for i in [*np.flatnonzero(lcp >= least).tolist(), len(lcp)]:
        value = int(lcp[i]) if i < len(lcp) else 0
        start = i - 1
        if stack and stack[-1][2] != i - 1:  # a gap: shorter prefixes lie between
            while stack:
                length, left, last = stack.pop()
                out.append((length, left, last))
                if stack:
                    stack[-1] = (stack[-1][0], stack[-1][1], last)
        while stack and stack[-1][0] > value:
            length, left, last = stack.pop()
            out.append((length, left, last))
            start = left
            if stack:
                stack[-1] = (stack[-1][0], stack[-1][1], last)
        if i == len(lcp):
            break
        if stack and stack[-1][0] == value:
            stack[-1] = (value, stack[-1][1], i)
        else:
            stack.append((value, start, i))
    return out


_A = Rolling(11)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for the texts of one slice."""
    rows = len(offsets) - 1
    starts, ends, first = split_words(data, offsets)
    n_words, owner = np.diff(first), row_of(first)

    def per_row(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    in_word = covered(len(data), starts, ends)
    out = {"n_words": n_words, "word_chars": per_row(in_word & ((data & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[data])}
    sums = _A.prefix(data)
    # Lines: pieces between line feeds, of those with a word.
    cuts = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_row = np.searchsorted(offsets[1:], begin, "right")
    tail = begin >= len(data)
    if tail.any():
        begin, line_row = begin[~tail], line_row[~tail]
    stop = np.minimum(np.concatenate([begin[1:], [len(data)]]), offsets[np.minimum(line_row, rows - 1) + 1]) if len(begin) else begin
    ended = (stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(begin) else np.empty(0, bool)
    stop = stop - ended
    wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, line_row = begin[wordy], stop[wordy], line_row[wordy]
    line = np.stack([line_row.astype(np.uint64), _A.spans(sums, begin, stop), (stop - begin).astype(np.uint64)], 1)
    lone = np.unique(line, axis=0)[:, 0].astype(np.int64) if len(line) else np.empty(0, np.int64)
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows)[:rows] - np.bincount(lone, minlength=rows)[:rows]
    # Dense word ranks, by document.
    word = _A.spans(sums, starts, ends)
    order = np.lexsort((word, owner))
    if len(order):
        fresh = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
    else:
        rank = np.empty(0, np.int64)
    suffixes, lcp = suffix_array(rank)
    # A repeat never runs past its document: equal suffixes start with ranks of that document only.
    longest_here = np.zeros(len(rank), np.int64)
    if len(rank):
        best = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
        longest_here[suffixes] = best
    windows = np.flatnonzero(longest_here >= WINDOW)
    mask = covered(len(rank), windows, windows + WINDOW)
    out["n_repeat_words"] = np.bincount(owner[mask], minlength=rows)[:rows]
    # The deepest interval that holds a suffix has the greater of its two common prefixes for length: the longest repeat
    # there. Shorter intervals around it add nothing to the union, so each suffix gives one span.
    deep = np.flatnonzero(longest_here >= MIN_REPEAT)
    mask = covered(len(rank), deep, deep + longest_here[deep])
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, owner[deep], longest_here[deep])
    return out | {"n_covered": np.bincount(owner[mask], minlength=rows)[:rows], "longest_repeat": longest}


def maximal_repeats(text: str, least: int = MIN_REPEAT) -> list[tuple[int, int, str]]:
    """(words, occurrences, one occurrence with single spaces) of every interval of one text, the longest first."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = split_words(data, np.array([0, len(data)]))
    words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    names = {w: k for k, w in enumerate(sorted(set(words)))}
    suffixes, lcp = suffix_array(np.array([names[w] for w in words], np.int64))
    found = [(n, last - left + 1, b" ".join(words[suffixes[left] : suffixes[left] + n]).decode()) for n, left, last in repeat_intervals(lcp, least)]
    return sorted(found, key=lambda f: (-f[0], -f[1], f[2]))


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    return failed, ~failed & (100 * m["n_covered"] <= MOST_COVERED * m["n_words"]) & (m["longest_repeat"] <= MOST_LONGEST)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean"


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every text. A null text counts as one without words, and fails the base rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), 1 << 20):
                m = measure(data, offsets)
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *[pa.array(m[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(kept)],
                    names=["doc_id", *COUNTS, "base_failed", "kept"],
                )

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
