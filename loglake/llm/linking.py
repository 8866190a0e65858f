"""Connected groups of similar items from shared bucket keys, without all pairs of a bucket.

First every item is compared with one leader of each of its buckets, the item of lowest rank. Most groups fall
together by that. What may be missing are links across groups within a bucket: there, the items outside the bucket's
largest group are compared with the rest of it. Where that is much work, both sides are cut into pieces and each
piece meets each of the other side's in a task of its own: whatever its size, no bucket loses a pair.
Comparisons are a cheap test inside the join, then an exact one.

Nothing is gathered by bucket or group: counts, minima and joins only, and adaptive execution splits skewed joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, written

#: Comparisons that two pieces of a bucket make, about; a bucket with more is cut into more pieces.
MOST_WORK = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of ``edges`` (a, b). Labels spread and jump until none changes."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("comp"), F.col("a").alias("was")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("_m")).withColumnRenamed("a", "node")
        spread = labels.select("node", F.col("comp").alias("was")).join(near, "node").select("node", F.least("was", "_m").alias("comp"), "was")
        # A label is itself a node: its own label before this step is as good as this one's or better.
        ahead = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_n"))
        old, labels = labels, written(spread.join(ahead, "comp", "left").select("node", F.least("comp", F.coalesce("_n", "comp")).alias("comp"), "was"), "labels")
        drop_written(old)
        if labels.where("comp <> was").isEmpty():
            drop_written(both)
            return labels.select("node", "comp")


def link(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], plausible: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """a, b: pairs that connect the groups of all items which share a bucket and pass both tests.

    ``rows`` has key, i (which of an item's keys) and node, perhaps own: then only pairs count of which one side or both have the
    key they share as their own. ``prepare`` gets the items that share a
    bucket (node, most: the size of their largest one) and returns node, rank, perhaps keys (all keys in order of i) and the
    columns that ``plausible`` reads with the given prefixes; ``verify`` returns those of the pairs (a, b) that are links.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mine = ["own"] if "own" in rows.columns else []
    shared = written(rows.join(sizes, "key").select("key", "i", "node", "m", *mine), "buckets")
    release(shared.sparkSession)
    items = prepare(shared.groupBy("node").agg(F.max("m").alias("most")))
    leaders = shared.join(items.select("node", "rank"), "node").groupBy("key").agg(F.min_by("node", F.struct("rank", "node")).alias("leader"))
    release(shared.sparkSession)
    led = shared.join(leaders, "key").where("node <> leader")
    star = written(led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "star")
    items = items.drop("rank")
    links = written(verify(_tested(star, items, plausible)), "edges")
    labels = components(links)
    release(shared.sparkSession)

    named = shared.join(labels, "node", "left").select("key", "i", "node", F.coalesce("comp", "node").alias("comp"), *mine)
    named = written(named, "named")
    mixed = _mixed(named)
    pairs = _across(named.join(mixed, "key"), items, plausible)
    pairs = pairs.distinct().join(star, ["a", "b"], "left_anti")
    # The groups so far are stars of their own, which say the same as the links and settle at once.
    stars = labels.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
    out = written(stars.union(verify(pairs)), "found")
    for table in (shared, star, links, labels, named, mixed):
        drop_written(table)
    return out


def _side(items: DataFrame, node: str, prefix: str) -> DataFrame:
    return items.select(*[F.col(c).alias(node if c == "node" else prefix + c) for c in items.columns])


def _tested(pairs: DataFrame, items: DataFrame, plausible: Callable[[str, str], Column]) -> DataFrame:
    items = items.drop("keys")
    return pairs.join(_side(items, "a", "l_"), "a").join(_side(items, "b", "r_"), "b").where(plausible("l_", "r_")).select("a", "b")


def _across(rows: DataFrame, items: DataFrame, plausible: Callable[[str, str], Column], home: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs of different groups in a bucket: each item outside the main group against all others, once.

    A pair that shares several buckets is made in the one of its first common key (by ``keys``, or where ``home`` holds), or in each. As all of them
    hold two groups, all are looked at. With own, rows that have it meet all others instead, those of the main group only the ones outside it.
    """
    pieces = F.ceil(F.sqrt(F.col("work") / F.lit(MOST_WORK))).cast("int")
    rows = rows.withColumns({"_all": F.sequence(F.lit(0), pieces - 1), "_own": F.pmod(F.xxhash64("node"), pieces).cast("int")}).join(items, "node")
    own = [c for c in items.columns if c != "node"]
    which = ["i"] if "keys" in own else []
    outside, left, right, side = F.col("comp") != F.col("main"), rows, rows, []
    if "own" in rows.columns:
        side = ["_side"]
        left = rows.where("own").withColumn("_side", F.explode(F.when(outside, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
        right = rows.withColumn("_side", outside)
    else:
        right = rows.where(outside)
    left = left.select("key", *which, *side, F.col("_own").alias("_p"), F.explode("_all").alias("_q"), F.col("node").alias("x"), F.col("comp").alias("xc"), "main", *[F.col(c).alias("l_" + c) for c in own])
    right = right.select("key", *side, F.explode("_all").alias("_p"), F.col("_own").alias("_q"), F.col("node").alias("y"), F.col("comp").alias("yc"), *["own" for _ in side], *[F.col(c).alias("r_" + c) for c in own])
    right = right.withColumnsRenamed({c: "_r" + c for c in ("key", "_p", "_q", *side)})
    cell = (F.col("key") == F.col("_rkey")) & (F.col("_p") == F.col("_r_p")) & (F.col("_q") == F.col("_r_q"))
    once = (F.col("xc") == F.col("main")) | (F.col("x") < F.col("y"))
    if side:
        cell, once = cell & (F.col("_side") == F.col("_r_side")), ~F.col("own") | (F.col("x") < F.col("y"))
    here = F.array_position(F.zip_with("l_keys", "r_keys", lambda a, b: a == b), True) == F.col("i") + 1 if which else home("l_", "r_") if home else F.lit(True)
    met = left.join(right, cell & (F.col("xc") != F.col("yc")) & once & plausible("l_", "r_") & here)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def grouped(rows: list[DataFrame], items: DataFrame, plausible: Callable[[str, str], Column], texts: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], home: Callable[[str, str], Column] | None = None, close: Callable[[str, str], Column] | None = None, near: Callable[[str, str], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """node, comp of every linked item, as ``components(link(...))``, for items whose texts are dear: those are read once.

    ``rows`` (key, with what tells parts of a signature apart in its high 32 bits; node; weight; in parts that are dealt one after the other) name the buckets, ``items`` has node and what
    ``plausible`` reads. Of each bucket the item of most weight leads. ``texts`` gets the items of plausible pairs (node), ``verify``
    the texts and pairs (a, b); ``home`` tells whether ``key`` is the one of several common keys in which a pair is to be made. Groups are first formed on trust, from the plausible pairs with leaders, and pairs between such groups are
    made. So every item of a plausible pair is known before any text is read: a pair within a group has both sides in a pair with
    a leader. Verified pairs then form the groups that hold, and pairs between those are made last. There the texts are known: ``close``, a test on
    the columns of ``items`` and of ``texts`` (node and more) that no link fails, decides inside that join, so pairs that are no links are not made.
    ``near``, a test that no plausible pair fails on further columns of ``rows``, keeps chance meetings with leaders from being made as pairs.
    ``known`` (a < b, first) are plausible pairs from buckets that are not among ``rows``: those marked first are verified with the first ones,
    of the others those that these leave in different groups and that pass ``close``, which then reads columns of ``texts`` only.
    """
    shared, lean = [], [c for c in rows[0].columns if c not in ("key", "node", "weight")]
    for part in rows:
        sizes = part.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("weight").alias("_top")).where("m > 1")
        shared.append(written(part.join(sizes, "key").select("key", "node", "m", (F.col("weight") == F.col("_top")).alias("first"), *lean), "buckets"))
        release(items.sparkSession)
    own = shared[0]
    for part in shared[1:]:
        own = own.union(part)
    leaders = own.where("first").groupBy("key").agg(F.min(F.struct("node", *lean)).alias("_of")).select("key", F.col("_of.node").alias("leader"), *[F.col(f"_of.{c}").alias("l_" + c) for c in lean])
    met = own.withColumnsRenamed({c: "r_" + c for c in lean}).join(leaders, "key").where("node <> leader")
    led = written(met.select("key", "node", "leader", "m", (near("l_", "r_") if near else F.lit(True)).alias("near")), "led")
    for part in shared:
        drop_written(part)
    release(items.sparkSession)
    pairs = led.where("near").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    star = written(_tested(pairs, items, plausible), "star")
    release(items.sparkSession)
    # Buckets of two are done; in others, leaders have met all.
    many = written(led.where("m > 2").select("key", "node"), "many")
    drop_written(led)
    trusted = components(star)
    far = _between(many, trusted, items, plausible, home, len(rows))
    pairs = written(reduce(DataFrame.union, [star, far, *([known.where("first").select("a", "b")] if known is not None else [])]).distinct(), "pairs")
    release(items.sparkSession)
    wanted = pairs if known is None else pairs.union(known.select("a", "b"))
    read = texts(wanted.select(F.col("a").alias("node")).union(wanted.select("b")).distinct())
    release(items.sparkSession)
    links = written(verify(read, pairs), "edges")
    release(items.sparkSession)
    labels = components(links)
    # Pairs of different groups on trust are done; within one, a bucket is the part of it in that group.
    trust = trusted.select("node", F.col("comp").alias("trust"))
    within = many.join(trust, "node").select(F.shiftleft(F.shiftrightunsigned("key", 32), 32).bitwiseOR(F.xxhash64("key", "trust").bitwiseAND(0xFFFFFFFF)).alias("key"), "node")
    both = written(read.join(items, "node"), "known") if close else items
    # The dear test comes last, so that a pair is put to it in one of its buckets only.
    here = (lambda l, r: (home(l, r) if home else F.lit(True)) & close(l, r)) if close else home
    late = between = _between(within, labels, both, plausible, here)
    release(items.sparkSession)
    if known is not None:
        label = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c"))
        rest = known.where("NOT first").select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
        rest = rest.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")
        if close:
            rest = rest.join(_side(read, "a", "l_"), "a").join(_side(read, "b", "r_"), "b").where(close("l_", "r_")).select("a", "b")
        late = between.union(rest).distinct()
    more = written(verify(read, late.join(pairs, ["a", "b"], "left_anti")), "edges")
    if not more.isEmpty():
        # The groups so far are stars of their own, which say the same as the links and settle at once.
        old, labels = labels, components(labels.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(more))
        drop_written(old)
    for table in (star, far, pairs, many, trusted, read, links, between, more, *([both] if close else [])):
        drop_written(table)
    return labels


def _between(rows: DataFrame, labels: DataFrame, items: DataFrame, plausible: Callable[[str, str], Column], home: Callable[[str, str], Column] | None, parts: int = 1) -> DataFrame:
    """Plausible pairs (a, b) of different groups that share a bucket of ``rows`` (key, node).

    With more ``parts``, the buckets' keys are dealt one part after the other, by their high 32 bits, and only one part's shuffle is on disks at a time.
    """
    named = written(rows.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "named")
    mixed = _mixed(named)
    release(rows.sparkSession)
    met = named.join(mixed, "key")
    crossed = []
    for p in range(parts):
        part = met.where(F.pmod(F.shiftrightunsigned("key", 32), F.lit(parts)) == p) if parts > 1 else met
        crossed.append(written(_across(part, items, plausible, home).distinct(), "crossed"))
        release(rows.sparkSession)
    drop_written(named)
    drop_written(mixed)
    out = crossed[0]
    for part in crossed[1:]:
        out = out.union(part)
    return out


def _mixed(named: DataFrame) -> DataFrame:
    """key, main and work of the buckets that hold more than one group: the largest of them, and how many pairs are to be looked at."""
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    by_key = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.count(F.lit(1)).alias("groups"))
    return written(by_key.where("groups > 1").select("key", "main", (F.col("m") * (F.col("m") - F.col("most"))).alias("work")), "mixed")
