"""Near-duplicate documents by b-bit MinHash.

Each distinct shingle set gets ``BANDS * ROWS`` minima. Bands of whole minima are bucket keys; the low bits of all
minima, packed into longs, estimate the similarity of a candidate pair by counting equal bits and correcting for
chance collisions. Pairs that the estimate does not rule out are confirmed on their full sets. A pair at
similarity 0.75 misses all bands with probability (1 - 0.75^4)^32 = 5e-6, and the estimate rules it out at 5 standard errors.

Two exact bounds thin out the candidates of large groups of copies. A bit map of each set's shingles shows some that only
one side has. In large buckets, shingles that no other member has are counted; no intersection has
them, and the member with the smallest share of them leads its bucket, so that a large group falls together
in one round of comparisons with its least edited member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, drop_written, in_small_batches, mix, row_of, slices, split_words, written
from .linking import components, link

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 2
#: The estimate rules a pair out below this; the threshold less five standard errors.
LEAST_ESTIMATE = 0.50
#: Bucket size from which the shingles of its members are counted, and longs of a set's bit map.
LARGE, MAP = 32, 16
#: Bytes of text handled at once in a task.
SLICE = 1 << 19
_WORD, _SHINGLE = Rolling(21), Rolling(22)
_K = BANDS * ROWS
_FLIP = mix(np.arange(1, _K + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SCALE = mix(_FLIP) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LONGS = _K * BITS // 64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and the index of each row's first one."""
    starts, ends, first = split_words(data, offsets)
    rows, n = len(offsets) - 1, np.diff(first)
    word = _WORD.spans(_WORD.prefix(_LOWER[data]), starts, ends)
    sums = _SHINGLE.prefix(word)
    begin = np.arange(len(word))
    owner = row_of(first)
    stop = begin + SHINGLE
    short = (n[owner] < SHINGLE) & (begin == first[owner])
    stop = np.where(short, first[owner + 1], stop)
    keep = stop <= first[owner + 1]
    begin, stop, owner = begin[keep], stop[keep], owner[keep]
    h = _SHINGLE.spans(sums, begin, stop)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, packed low bits) of rows that all have shingles."""
    rows = len(first) - 1
    keys, packed = np.empty((rows, BANDS), np.uint64), np.zeros((rows, _LONGS), np.uint64)
    band = np.zeros(rows, np.uint64)
    for k in range(_K):
        low = np.minimum.reduceat((h ^ _FLIP[k]) * _SCALE[k], first[:-1])
        band = band * np.uint64(0x9E3779B97F4A7C15) + mix(low)
        packed[:, k * BITS // 64] |= (mix(low) & np.uint64((1 << BITS) - 1)) << np.uint64(k * BITS % 64)
        if k % ROWS == ROWS - 1:
            keys[:, k // ROWS] = mix(band ^ np.uint64(k))
            band = np.zeros(rows, np.uint64)
    return keys, packed


SIGNED = "doc_id bigint, n bigint, s1 bigint, s2 bigint, " + ", ".join(f"g{i} bigint" for i in range(_LONGS)) + ", keys array<bigint>"


def sign(docs: DataFrame) -> DataFrame:
    """One row per document: set size, two sums that name its set, packed low bits and bucket keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                h, first = shingles(data, offsets)
                n = np.diff(first)
                full = np.flatnonzero(n)
                names = []
                for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    sums = np.zeros(j - i, np.uint64)
                    if len(full):
                        sums[full] = np.add.reduceat(mix(h * np.uint64(salt)), first[:-1][full])
                    names.append(pa.array(sums.view(np.int64)))
                keys, packed = signatures(h, np.concatenate([first[:-1][full], first[-1:]])) if len(full) else (np.empty((0, BANDS), np.uint64), np.empty((0, _LONGS), np.uint64))
                bits = np.zeros((j - i, _LONGS), np.uint64)
                bits[full] = packed
                bounds = np.zeros(j - i + 1, np.int32)
                bounds[full + 1] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n), *names, *[pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(_LONGS)], lists],
                    names=["doc_id", "n", "s1", "s2", *[f"g{k}" for k in range(_LONGS)], "keys"],
                )

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, SIGNED)


def estimate(l: str, r: str) -> Column:  # noqa: E741
    """Collision-corrected similarity from the packed low bits of both sides."""
    odd = F.lit(0x5555555555555555)
    differ = F.lit(0)
    for k in range(_LONGS):
        x = F.col(f"{l}g{k}").bitwiseXOR(F.col(f"{r}g{k}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 0.5**BITS
    return ((1 - differ / F.lit(float(_K))) - chance) / (1 - chance)


def plausible(l: str, r: str) -> Column:  # noqa: E741
    a, b = F.col(f"{l}n"), F.col(f"{r}n")
    # The count of lone shingles is over members of large buckets, so it binds two of them only.
    both = F.when(F.col(f"{l}large") & F.col(f"{r}large"), F.least(a - F.col(f"{l}lone"), b - F.col(f"{r}lone"))).otherwise(F.least(a, b))
    near = (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (100 * both >= PERCENT * (a + b - both)) & (estimate(l, r) >= LEAST_ESTIMATE)
    only_a = only_b = F.lit(0)
    for k in range(MAP):
        x, y = F.col(f"{l}m{k}"), F.col(f"{r}m{k}")
        only_a = only_a + F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
        only_b = only_b + F.bit_count(y.bitwiseAND(F.bitwise_not(x)))
    most = F.least(a - only_a, b - only_b)
    return near & (100 * most >= PERCENT * (a + b - most))


def bit_maps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row ``MAP`` longs; a shingle sets the bit that its hash names."""
    rows = len(first) - 1
    bits = np.zeros((rows, 64 * MAP), np.uint8)
    bits[row_of(first), ((h >> np.uint64(20)) % np.uint64(64 * MAP)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, most, set (sorted hashes, 8 bytes each) and its bit map, of the wanted documents."""
    maps = [f"m{k}" for k in range(MAP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text"), SLICE):
                h, first = shingles(data, offsets)
                marks = bit_maps(h, first)
                own = pa.array([h[first[k] : first[k + 1]].tobytes() for k in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("node", "most")), own, *[pa.array(np.ascontiguousarray(marks[:, k])) for k in range(MAP)]], names=["node", "most", "set", *maps])

    # What is wanted grows with the corpus, so it is merged at every size.
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(wanted.hint("merge"), "node")
    return texts.select("node", "most", "text").mapInArrow(run, "node bigint, most bigint, set binary, " + ", ".join(f"{m} bigint" for m in maps))


def _lone(sets: DataFrame) -> DataFrame:
    """node, lone: how many shingles of each document in a large bucket no other such document has; none if all are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s in zip(batch.column("node").to_pylist(), batch.column("set"), strict=True):
                h = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node, np.int64)), pa.array(h)], names=["node", "h"])

    one = sets.where(F.col("most") > LARGE).select("node", "set").mapInArrow(run, "node bigint, h bigint")
    one = one.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("_other")).where("node = _other")
    return one.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))


def _confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or 100 * len(x) < PERCENT * len(y):
                    continue
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A row without words has an empty set and is linked with nothing. Rows that share an id are each grouped by
    their own text; a row without id has the component of its copies, if any has an id, and stays if none has.
    """
    signed = written(sign(docs), "signed")
    classes = written(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "classes")
    items = signed.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "s1", "s2", "n"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    items = written(items.withColumnRenamed("doc_id", "node"), "items")
    rows = items.select("node", F.posexplode("keys").alias("i", "key")).select("key", "i", "node")
    bits = [f"g{k}" for k in range(_LONGS)]
    sets: list[DataFrame] = []
    traits: list[DataFrame] = []

    def prepare(candidates: DataFrame) -> DataFrame:
        sets.append(written(_sets(docs, candidates), "sets"))
        lone = F.coalesce("lone", F.lit(0)).cast("long")
        maps = [f"m{k}" for k in range(MAP)]
        # A row's own set is the one of its size where documents share an id; more rows only mean more comparisons.
        known = items.select("node", "n", "keys", *bits).join(sets[0].select("node", "most", (F.length("set") / 8).cast("long").alias("n"), *maps), ["node", "n"]).join(_lone(sets[0]), "node", "left")
        traits.append(written(known.select("node", "n", (F.col("most") > LARGE).alias("large"), lone.alias("lone"), (lone / F.col("n")).alias("rank"), *bits, *maps, "keys"), "traits"))
        return traits[0]

    links = link(rows, prepare, plausible, lambda pairs: _confirm(sets[0], pairs))
    for table in (*sets, *traits, items):
        drop_written(table)
    labels = components(links)
    drop_written(links)
    # Exact copies hang on their class.
    own = signed.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left").join(labels, "node", "left")
    component = F.coalesce("comp", "node", "doc_id")
    out = own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = written(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "components")
    for table in (signed, classes, labels):
        drop_written(table)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged; of rows that share the kept id all stay."""
    kept = groups(docs).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
