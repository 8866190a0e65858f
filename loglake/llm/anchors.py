"""Content-defined anchors: a lossless filter for repeated windows, and the joins around it.

Every window of ``window`` units (words or bytes) holds ``window - gram + 1`` grams; its anchor is the
leftmost gram of smallest hash among them. Equal windows have equal anchors at equal offsets, so a window whose
anchor occurs once in the corpus is unique and needs no further look. Few grams are anchors
(about two in ``window - gram + 2``), so counting them costs little.

Texts travel by the pair (doc_id, 64-bit hash of the text), so rows that share an id do not mix; rows
equal in both are equal texts and may. A null id travels as 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, in_small_batches, slices, sliding_min, split_words, written

_PLACE = np.uint64((1 << 26) - 1)
_FIRST, _SECOND, _GRAM = Rolling(1), Rolling(2), Rolling(3)


@dataclass
class Units:
    """The units of the texts of one slice: 64-bit values, the bounds of each row, and where units lie in the bytes."""

    values: np.ndarray
    first: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def words(data: np.ndarray, offsets: np.ndarray) -> Units:
    starts, ends, first = split_words(data, offsets)
    return Units(_FIRST.spans(_FIRST.prefix(data), starts, ends), first, starts, ends)


def octets(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(data, offsets)


@dataclass(frozen=True)
class Windows:
    unit: Callable[[np.ndarray, np.ndarray], Units]
    window: int
    gram: int
    #: Bytes of text handled at once in a task.
    slice: int

    def anchors(self, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of every window inside a row, position of its anchor, hash of every gram)."""
        grams = _GRAM.windows(_GRAM.prefix(u.values), self.gram)
        span = self.window - self.gram + 1
        if len(grams) < span:
            none = np.empty(0, np.int64)
            return none, none, grams
        place = np.arange(len(grams), dtype=np.uint64)
        low = sliding_min((grams & ~_PLACE) | (place & _PLACE), span)
        # Windows that run past their row are no windows.
        inside = np.ones(len(low), bool)
        for back in _blocks(u.first[1:], self.window - 1, len(low)):
            inside[back] = False
        start = np.flatnonzero(inside)
        at = (low[start] & _PLACE).astype(np.int64)
        # Beyond 2**26 units the low bits repeat; the anchor is the one within the window.
        at += (start - at + int(_PLACE)) >> 26 << 26
        return start, at, grams


def _blocks(ends: np.ndarray, n: int, limit: int) -> Iterator[slice]:
    for e in ends.tolist():
        if e - n < limit:
            yield slice(max(0, e - n), min(e, limit))


def key_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the key (_d, _h) of each row."""
    return docs.withColumns({"_d": F.coalesce(doc_id, F.lit(0)).cast("long"), "_h": F.xxhash64(text)})


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key, by which later joins move the texts."""
    return key_of(in_small_batches(docs).select("doc_id", "text"))


def anchor_table(docs: DataFrame, windows: Windows) -> DataFrame:
    """fp, _d, _h, at: every anchor of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), windows.slice):
                u = windows.unit(data, offsets)
                _, at, grams = windows.anchors(u)
                at = np.unique(at)
                row = np.searchsorted(u.first, at, "right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), batch.column("_d").take(take), batch.column("_h").take(take), pa.array((at - u.first[row]).astype(np.int32))], names=["fp", "_d", "_h", "at"]
                )

    return keyed(docs).select("text", "_d", "_h").mapInArrow(run, "fp bigint, _d bigint, _h bigint, at int")


def lists(places: DataFrame, columns: str) -> DataFrame:
    """_d, _h and the sorted list of their entries, written, as the tables it comes from are dropped then."""
    return written(places.groupBy("_d", "_h").agg(F.array_sort(F.collect_set(F.struct(*columns.split()))).alias("_at")), "places")


def with_lists(docs: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Every row of ``docs`` with its list, null if it has none, or only those with one. All uses in a query share one exchange of the texts."""
    return keyed(docs).join(found, ["_d", "_h"], how).select("doc_id", "text", "_d", "_h", "_at")


def lists_of(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows (from 0) and fields of the structs in rows i..j of a list column."""
    part = column.slice(i, j - i)
    if isinstance(part, pa.ChunkedArray):
        part = part.combine_chunks()
    counts = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
    flat = part.flatten()
    return np.repeat(np.arange(j - i), counts), {f.name: np.asarray(flat.field(k)) for k, f in enumerate(flat.type)}


def repeated_windows(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, Units, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice: (batch, first row, bytes, units, gram hashes, window starts whose anchor repeats, their anchors, the anchors' tags)."""
    for batch in batches:
        for i, j, data, offsets in slices(batch.column("text"), windows.slice):
            rows, fields = lists_of(batch.column("_at"), i, j)
            if not len(rows):
                continue
            u = windows.unit(data, offsets)
            start, at, grams = windows.anchors(u)
            tag = np.zeros(len(u.values) + 1, np.int8)
            tag[u.first[rows] + fields["at"]] = 1 + fields["hot"].astype(np.int8) if "hot" in fields else 1
            keep = tag[at] > 0
            start, at = start[keep], at[keep]
            if len(start):
                yield batch, i, data, u, grams, start, at, tag[at]


def names_of(u: Units, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of the windows of n units."""
    return tuple(r.spans(r.prefix(u.values), start, start + n) for r in (_SECOND, _GRAM))


def local_repeats(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows have a name that occurs again in this slice, one index for each distinct name)."""
    order = np.lexsort((b, a))
    fresh = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    group = np.cumsum(fresh) - 1
    many = np.bincount(group)[group] > 1
    again = np.zeros(len(a), bool)
    again[order] = many
    return again, order[fresh]


def start_runs(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and length of runs of consecutive positions."""
    if not len(start):
        return start, start
    head = np.flatnonzero(np.diff(start, prepend=-2) != 1)
    return start[head], np.diff([*head, len(start)])


#: Rows between tasks: one window (n = 1, len = 1), a name met twice (n = 2, len = 0), or a run of windows known to repeat.
ROWS = "h1 bigint, h2 bigint, n int, _d bigint, _h bigint, at int, len int"


def window_rows(batch: pa.RecordBatch, i: int, u: Units, start: np.ndarray, windows: Windows) -> pa.RecordBatch:
    """Rows of ``ROWS`` for one slice: windows are counted here first, so a name leaves a slice once however often it occurs."""
    a, b = names_of(u, start, windows.window)
    again, one = local_repeats(a, b)
    first, length = start_runs(start[again])
    met = one[again[one]]
    lone = np.flatnonzero(~again)
    row = np.searchsorted(u.first, np.concatenate([start[lone], start[met], first]), "right") - 1
    at = np.concatenate([start[lone], start[met], first]) - u.first[row]
    # A run of known repeats needs no partner; a name of its own spreads such rows evenly.
    h1 = np.concatenate([a[lone], a[met], a[np.searchsorted(start, first)] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(first), dtype=np.uint64) + np.uint64(1))])
    h2 = np.concatenate([b[lone], b[met], b[np.searchsorted(start, first)] ^ row[len(row) - len(first) :].astype(np.uint64)])
    n = np.concatenate([np.ones(len(lone)), np.full(len(met) + len(first), 2)]).astype(np.int32)
    size = np.concatenate([np.ones(len(lone)), np.zeros(len(met)), length]).astype(np.int32)
    take = pa.array(row + i)
    return pa.RecordBatch.from_arrays(
        [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n), batch.column("_d").take(take), batch.column("_h").take(take), pa.array(at.astype(np.int32)), pa.array(size)], names=["h1", "h2", "n", "_d", "_h", "at", "len"]
    )


SPANS = f"{ROWS}, span binary"
_SPAN_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_SPAN_NAMES = [c.split()[0] for c in SPANS.split(", ")]


def span_rows(batch: pa.RecordBatch, i: int, u: Units, grams: np.ndarray, start: np.ndarray, at: np.ndarray, content: Callable[[int, int], bytes]) -> pa.RecordBatch:
    """One row for each run of windows with one anchor, with ``content(first, end)`` of windows first..end of ``start``.

    Runs of equal content meet here: one row tells of them, and their windows are known to repeat.
    """
    head = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(at, prepend=-1) != 0))
    stop = np.concatenate([head[1:], [len(start)]])
    row = np.searchsorted(u.first, start[head], "right") - 1
    begin, length = (start[head] - u.first[row]).tolist(), (stop - head).tolist()
    take = pa.array(row + i)
    d, h = (batch.column(c).take(take).to_pylist() for c in ("_d", "_h"))
    names = grams[at[head]].view(np.int64).tolist()
    seen: dict[tuple[int, bytes], list[int]] = {}
    for k, (f, a, b) in enumerate(zip(names, head.tolist(), stop.tolist(), strict=True)):
        seen.setdefault((f, content(a, b)), []).append(k)
    rows: list[tuple] = []
    known = np.zeros(len(start), bool)
    for (f, span), all_k in seen.items():
        k = all_k[0]
        if len(all_k) == 1:
            rows.append((f, 0, 1, d[k], h[k], begin[k], length[k], span))
            continue
        rows.append((f, 0, 2, 0, 0, 0, 0, span))
        for k in all_k:
            known[head[k] : stop[k]] = True
    # Known windows only pass through, joined over anchors within a row; names of their own spread such rows evenly.
    at_row = np.searchsorted(u.first, start[known], "right") - 1
    cut = np.flatnonzero((np.diff(start[known], prepend=-2) != 1) | (np.diff(at_row, prepend=-1) != 0))
    first, size, at_row = start[known][cut], np.diff([*cut, int(known.sum())]), at_row[cut]
    take = pa.array(at_row + i)
    d, h = (batch.column(c).take(take).to_pylist() for c in ("_d", "_h"))
    rows += [(hash((d[k], h[k], a)) >> 1, k, 2, d[k], h[k], a, n, None) for k, (a, n) in enumerate(zip((first - u.first[at_row]).tolist(), size.tolist(), strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SPAN_KINDS, strict=True)], names=_SPAN_NAMES)


def emitted(docs: DataFrame, found: DataFrame, windows: Windows, content: Callable[[np.ndarray, Units, np.ndarray], Callable[[int, int], bytes]]) -> DataFrame:
    """Rows of ``SPANS`` for all windows whose anchor repeats; those of hot anchors by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, data, u, grams, start, at, tag in repeated_windows(batches, windows):
            cool = tag == 1
            if cool.any():
                yield span_rows(batch, i, u, grams, start[cool], at[cool], content(data, u, start[cool]))
            if not cool.all():
                made = window_rows(batch, i, u, start[~cool], windows)
                yield pa.RecordBatch.from_arrays([*made.columns, pa.nulls(made.num_rows, pa.binary())], names=_SPAN_NAMES)

    return with_lists(docs, found, "inner").mapInArrow(run, SPANS)


def settled(spans: DataFrame, repeats: Callable[[list[tuple[int, bytes]], list[int]], list[np.ndarray]], most: int = 1 << 20) -> DataFrame:
    """Runs (_d, _h, at, len) of repeated windows.

    All rows of an anchor or name meet in a task, which takes anchors together up to ``most`` bytes and passes names on as
    they come; ``repeats`` gets distinct (anchor, content) pairs with their numbers and returns the offsets of repeated windows.
    """

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["_d", "_h", "at", "len"])

    def settle(rows: list[tuple]) -> list[tuple]:
        by_span: dict[tuple[int, bytes], list[tuple]] = {}
        per_anchor: dict[int, int] = {}
        for r in rows:
            same = by_span.setdefault((r[0], r[7]), [])
            if not same:
                per_anchor[r[0]] = per_anchor.get(r[0], 0) + 1
            same.append(r)
        numbers = {key: sum(r[2] for r in same) for key, same in by_span.items()}
        out = [r[3:7] for key, same in by_span.items() if numbers[key] > 1 for r in same if r[6]]
        # Windows are equal only under one anchor, so an anchor with one content has nothing left to compare.
        open_ = [key for key in by_span if per_anchor[key[0]] > 1]
        found = repeats(open_, [numbers[key] for key in open_]) if open_ else []
        for key, offsets in zip(open_, found, strict=True):
            if numbers[key] == 1 and by_span[key][0][6] and len(offsets):
                d, h, at, _ = by_span[key][0][3:7]
                out += [(d, h, at + a, k) for a, k in zip(*(x.tolist() for x in start_runs(offsets)), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        size, last, name, total, lone = 0, None, None, 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[7] is None:
                    # A name's rows follow each other; only the first can be in doubt, so none are gathered.
                    if (r[0], r[1]) != name:
                        name, total, lone = (r[0], r[1]), 0, None
                    total += r[2]
                    if total > 1:
                        out += [x[3:7] for x in (lone, r) if x is not None and x[6]]
                        lone = None
                    else:
                        lone = r
                    continue
                if size >= most and r[0] != last:
                    out += settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[7]) + 32
                last = r[0]
            if len(out) > 20_000:
                yield made(out)
                out = []
        yield made(out + settle(held))

    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(n, "h1").sortWithinPartitions("h1", "h2").mapInArrow(run, "_d bigint, _h bigint, at int, len int")


def removed_units(batch: pa.RecordBatch, i: int, j: int, u: Units, window: int) -> np.ndarray:
    """Which units of a slice are covered by the windows whose runs (at, len) stand in the rows' lists."""
    rows, fields = lists_of(batch.column("_at"), i, j)
    n = len(u.values)
    if not len(rows):
        return np.zeros(n, bool)
    begin = u.first[rows] + fields["at"]
    end = begin + fields["len"] + window - 1
    delta = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(delta[:n]) > 0
