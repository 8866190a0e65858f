"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate between 0 and ``CAP`` copies. Among all rates whose tokens meet the targets, the
balanced ones are least far, in relative entropy with that capacity, from one copy each; they are an
exponential tilt of the odds by document length, ``r / (CAP - r) = exp(lambda * size / mean) / (CAP - 1)``,
with one multiplier per source. The multipliers solve a smooth convex dual by Newton steps, each one
aggregation over the lengths of all documents. Rates become copies by a hash of the document against the
fractional part; the cut of each source is moved, over nested bins of all documents, until
the words taken meet its target. In the plan the one document on the cut takes part of its last copy; where rows are made, that part is
rounded to a whole copy or none, so no text is cut.

Only tables of one row per source, or per source and length or bin, are gathered anywhere; joins with
them are left to the optimizer, which broadcasts by measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps between two looks at the error, looks at most, and the relative error that ends them.
STEPS, LOOKS, TOLERANCE = 4, 12, 1e-9
#: Bins of a nested pass over the cut, as bits, and the number of passes.
BIN_BITS, PASSES = 12, 3
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash that orders documents at a cut, of id and source, and of the text where there is no id. A null text has size 0."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.lit("mix"), F.when(F.col("doc_id").isNull(), F.col("text"))), 12) / F.lit(float(1 << 52))).alias("unit"),
    )


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target: the weighted shares of all words, none above ``cap`` times its source.

    Sharing the excess by weight again and again ends at min(cap * size, level * weight); the level follows from
    the sources in order of cap / weight. Without words every target is 0.
    """
    rank = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(everything))
    return rows.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on source, nulls equal."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"])).drop("_source")


def _rate(z, cap: float):
    """The tilted rate; the exponent is bounded where the rate has long reached its limit."""
    e = F.exp(F.least(F.greatest(z, F.lit(-700.0)), F.lit(700.0)))
    return F.lit(float(cap)) / (F.lit(1.0) + F.lit(cap - 1.0) / e)


def solve(lengths: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """goals plus lam and mean: the multiplier of each source; null where every document is taken ``cap`` times.

    ``lengths`` has source, size, n. A Newton step that leaves the interval known to hold the root halves
    it instead, so the iteration ends for any targets within the capacity.
    """
    open_ = F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12))
    mean = lengths.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = _same(goals.where(open_), mean).select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("err"))
    state = written(state, "dual")
    for _ in range(LOOKS):
        nxt = state
        for _ in range(STEPS):
            rows = _same(lengths.where("size > 0"), nxt)
            x = F.col("size") / F.col("mean")
            r = _rate(F.col("lam") * x, cap)
            keys = [F.first(c).alias(c) for c in ("source_size", "target", "mean", "lam", "lo", "hi")]
            rows = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * r).alias("_g"), F.sum(F.col("n") * F.col("size") * x * r * (cap - r) / cap).alias("_h"), *keys)
            lo = F.when(F.col("_g") <= F.col("target"), F.col("lam")).otherwise(F.col("lo"))
            hi = F.when(F.col("_g") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
            step = F.col("lam") - (F.col("_g") - F.col("target")) / F.greatest(F.col("_h"), F.lit(1e-300))
            rows = rows.select("source", "source_size", "target", "mean", "lam", lo.alias("lo"), hi.alias("hi"), step.alias("_step"), (F.abs(F.col("_g") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("err"))
            halved = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(F.when(F.col("hi").isNull(), F.col("lo") + F.abs("lo") + 1).otherwise(F.col("hi") - F.abs("hi") - 1))
            fits = (F.col("lo").isNull() | (F.col("_step") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_step") < F.col("hi"))) & (F.abs(F.col("_step") - F.col("lam")) <= 4 * (1 + F.abs("lam")))
            nxt = rows.withColumn("lam", F.when(F.col("err") <= TOLERANCE, F.col("lam")).otherwise(F.when(fits, F.col("_step")).otherwise(halved))).drop("_step")
        old, state = state, written(nxt, "dual")
        drop_written(old)
        worst = state.agg(F.max("err").alias("e")).first()["e"]
        if worst is None or worst <= TOLERANCE:
            break
    state = state.select("source", "mean", "lam")
    all_goals = goals.withColumnRenamed("source", "_s")
    return all_goals.join(state, all_goals["_s"].eqNullSafe(state["source"]), "left").drop("source").withColumnRenamed("_s", "source")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row.

    Rows of one id and source tie at a cut and share it; a source without words takes nothing; an empty table
    gives an empty result. Runs agree: order at a cut is a hash of the row.
    """
    rows = written(sizes(docs), "sizes")
    used = [rows]
    lengths = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    goals = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, cap), "goals")
    duals = written(solve(lengths, goals, cap), "duals")
    used += [lengths, goals, duals]
    full = F.col("lam").isNull()
    rate = F.when(full, F.lit(float(cap))).otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean"), cap))
    base = F.when(full, F.lit(cap)).otherwise(F.least(F.floor(rate), F.lit(cap - 1)))
    top = 1 << (BIN_BITS * PASSES)
    place = F.floor((F.col("unit") - (rate - base) + 1) / 2 * F.lit(float(top)))
    rows = _same(rows, duals).select("doc_id", "source", "size", "source_size", "target", full.alias("full"), base.cast("long").alias("base"), F.least(place, F.lit(top - 1)).cast("long").alias("place"))
    # What whole copies leave open, and the place at which the rest is met.
    need = rows.where(~F.col("full")).groupBy("source").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    cut = need.select("source", F.lit(0).cast("long").alias("at"), "need", F.lit(0).cast("long").alias("held"))
    for k in range(1, PASSES + 1):
        own = F.shiftrightunsigned("place", BIN_BITS * (PASSES - k))
        inside = _same(rows.where(~F.col("full") & (F.col("size") > 0)), cut).where(F.shiftrightunsigned("place", BIN_BITS * (PASSES - k + 1)) == F.col("at"))
        bins = inside.groupBy("source", own.alias("bin")).agg(F.sum("size").alias("held"), F.first("need").alias("need"))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("_upto", F.sum("held").over(run))
        # The first bin that reaches the need; through rounding there may be none, and then the last one serves.
        reached = F.min_by(F.struct("bin", "held", "_upto"), F.struct((F.col("_upto") < F.col("need")).cast("int").alias("a"), F.when(F.col("_upto") < F.col("need"), -F.col("bin")).otherwise(F.col("bin")).alias("b")))
        cut = bins.groupBy("source").agg(reached.alias("_c"), F.first("need").alias("need")).select("source", F.col("_c.bin").alias("at"), F.greatest(F.lit(0.0), F.col("need") - (F.col("_c._upto") - F.col("_c.held"))).alias("need"), F.col("_c.held").alias("held"))
    cut = written(cut, "cut")
    used.append(cut)
    cut = cut.withColumnRenamed("source", "_s")
    rows = rows.join(cut, rows["source"].eqNullSafe(cut["_s"]), "left").drop("_s")
    part = F.least(F.col("size"), F.floor(F.col("size") * F.least(F.lit(1.0), F.col("need") / F.col("held")) + F.lit(0.5)))
    more = F.when(F.col("full") | (F.col("size") == 0) | F.col("at").isNull(), 0).when(F.col("place") < F.col("at"), F.col("size")).when(F.col("place") == F.col("at"), part).otherwise(0)
    out = written(rows.select("doc_id", "source", "size", "source_size", "target", (F.col("base") * F.col("size") + more).cast("long").alias("taken")), "plan")
    for table in used:
        drop_written(table)
    return out


def resample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``docs`` as mixed: each row as many times as it has copies; the part of a copy that a row on a cut takes is rounded to one or none.

    Rows keep their texts and all their columns, whatever these are called. Rows of equal id, source and size have equal
    copies. Rows without words are taken no time.
    """
    # Columns are numbered while they travel, so none clashes with the plan's.
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    copies = F.floor(F.max("taken") / F.first("size") + F.lit(0.5)).cast("int")
    plan = mix(docs, weights, cap).where("taken > 0").groupBy("doc_id", "source", "size").agg(copies.alias("copies")).where("copies > 0")
    rows = docs.toDF(*names)
    words = F.coalesce(F.regexp_count(at["text"], F.lit(WORD)), F.lit(0)).cast("long")
    on = [rows[at["doc_id"]].eqNullSafe(plan["doc_id"]), rows[at["source"]].eqNullSafe(plan["source"]), words == plan["size"]]
    rows = rows.join(plan, reduce(lambda a, b: a & b, on)).select(*names, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.select(*names).toDF(*docs.columns)
