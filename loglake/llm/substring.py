"""Incremental substring dedup over a log-structured index of window fingerprints.

Fingerprints are the anchors of all windows (see ``anchors``), so the index grows with a tenth of the words. The index
consists of immutable runs, sorted by fingerprint, of where each one stands. A batch of documents becomes a new
run of level 0; the batch's fingerprints are merge-joined with the runs before it, and those known there, or met twice in the batch itself, are hits.
Texts with hits, of the batch and of the history, are read, and their windows are verified by names of the
whole word sequence: 64 bits among the windows of one fingerprint, itself 64 bits of some of their words, or
128 bits where a fingerprint is so frequent that its windows are counted apart. Runs of one level are compacted into one of the next.

An index lives in a folder and outlasts the session: which runs are live stands in numbered state files,
of which each is created once, so a lost driver leaves the last state that was complete.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Conflict
from ..operators.files import Store
from .anchors import Units, Windows, anchor_table, emitted, lists, names_of, removed_units, settled, with_lists, words
from .common import drop_written, shared_dir, slices, written

#: Words of a window, words of a fingerprinted gram, batches in which a whole table is indexed, runs of a level.
WINDOW, GRAM, BATCHES, FANOUT = 35, 12, 2, 2
#: Occurrences from which an anchor's windows are counted one by one, and bytes of text handled at once.
HOT, SLICE = 512, 2 << 20


class FingerprintIndex:
    """Sorted immutable runs of (fp, _d, _h, at) in a folder, by default a new one in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = FANOUT) -> None:
        self.store, self.fanout = Store(spark, root or f"{shared_dir(spark)}/loglake-{uuid.uuid4().hex}"), fanout

    def state(self) -> tuple[int, list[tuple[int, str]]]:
        """(version, runs as (level, name)), the oldest first."""
        known = [n for n, _ in self.store.list("state") if n.endswith(".json")]
        if not known:
            return 0, []
        return int(known[-1][:-5]), [(level, name) for level, name in json.loads(self.store.read(f"state/{known[-1]}"))]

    def _commit(self, version: int, runs: list[tuple[int, str]]) -> None:
        if not self.store.create(f"state/{version + 1:012d}.json", json.dumps(runs).encode()):
            raise Conflict("another writer changed the index")

    def _written(self, places: DataFrame, level: int) -> str:
        name = f"run-{level}-{uuid.uuid4().hex}"
        places.select("fp", "_d", "_h", "at").sortWithinPartitions("fp").write.parquet(self.store.full(name))
        return name

    def run(self, name: str) -> DataFrame:
        return self.store.spark.read.schema("fp bigint, _d bigint, _h bigint, at int").parquet(self.store.full(name))

    def places(self) -> DataFrame | None:
        """The entries of all runs, none of an empty index."""
        out = None
        for _, name in self.state()[1]:
            out = self.run(name) if out is None else out.union(self.run(name))
        return out

    def absorb(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of places as a run. Returns the hits, written: fp, n (in the batch and before)."""
        version, runs = self.state()
        name = self._written(batch, 0)
        hits = self.run(name).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        for _, old in runs:
            before = self.run(old).groupBy("fp").agg(F.count(F.lit(1)).alias("_n"))
            hits = hits.hint("merge").join(before, "fp", "left").select("fp", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        hits = written(hits.where("n > 1"), "hits")
        self._commit(version, [*runs, (0, name)])
        return hits

    def compact(self) -> None:
        """Merges the newest runs while ``fanout`` of one level follow each other; a state without them is committed before they go."""
        while True:
            version, runs = self.state()
            last = runs[-self.fanout :]
            if len(last) < self.fanout or len({level for level, _ in last}) > 1:
                return
            merged = self.run(last[0][1])
            for _, name in last[1:]:
                merged = merged.union(self.run(name))
            level = last[0][0] + 1
            self._commit(version, [*runs[: -self.fanout], (level, self._written(merged, level))])
            for _, name in last:
                self.store.delete(name)

    def drop(self) -> None:
        self.store.delete("")


def _known_names(spans: list[tuple[int, bytes]], numbers: list[int]) -> list[np.ndarray]:
    """For the window names of each span, those that occur again under its anchor."""
    length = np.array([len(s) // 8 for _, s in spans])
    name = np.frombuffer(b"".join(s for _, s in spans), np.uint64)
    anchor = np.repeat(np.array([a for a, _ in spans], np.int64), length)
    order = np.lexsort((name, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    group = np.cumsum(fresh) - 1
    again = np.zeros(len(order), bool)
    again[order] = np.bincount(group, np.repeat(np.array(numbers), length)[order])[group] > 1
    bounds = np.concatenate([[0], np.cumsum(length)])
    return [np.flatnonzero(again[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, hot: int = HOT, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``.

    A word goes if a window over it starts anywhere else too, in the same document or another; both
    sides of a repeat lose it. Null texts and texts under ``window`` words lose nothing; rows that repeat as a whole
    lose all their words if they have ``window`` of them. Rows that share an id are told apart by their texts, and null
    ids by these alone; other columns are not read.

    ``docs`` are indexed in ``batches`` parts, dealt by content. With an ``index``, ``history`` holds the documents (doc_id, text) it was built
    from: repeats of those count too, while only ``docs`` are returned; afterwards the index holds both.
    """
    windows = Windows(words, window, gram, SLICE)
    table = written(anchor_table(docs, windows), "anchors")
    own = index is None
    index = FingerprintIndex(docs.sparkSession) if own else index
    everything = docs.select("doc_id", "text") if history is None else docs.select("doc_id", "text").union(history.select("doc_id", "text"))

    def names(data: np.ndarray, u: Units, start: np.ndarray) -> Callable[[int, int], bytes]:
        own = names_of(u, start, window)[0]
        return lambda a, b: own[a:b].tobytes()

    met = None
    for k in range(batches):
        hits = index.absorb(table.where(F.pmod(F.xxhash64("_d", "_h"), F.lit(batches)) == k))
        found = lists(index.places().join(hits.select("fp", (F.col("n") > hot).cast("int").alias("hot")), "fp"), "at hot")
        drop_written(hits)
        index.compact()
        runs = settled(emitted(everything, found, windows, names), _known_names)
        met = runs if met is None else met.union(runs)
    drop_written(table)
    if own:
        index.drop()
    met = met.groupBy("_d", "_h").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("_at"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                u = words(data, offsets)
                gone = removed_units(batch, i, j, u, window)
                whole = data.tobytes()
                out: list[tuple] = []
                for r in range(j - i):
                    a, b = u.first[r], u.first[r + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join(whole[s:e] for s, e in zip(u.starts[stay].tolist(), u.ends[stay].tolist(), strict=True))
                    out.append((int(b - a), int(b - a - len(stay)), hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_lists(docs, met).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
