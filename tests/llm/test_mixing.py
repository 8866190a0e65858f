import math
import random

import pytest

from loglake.llm import mixing

from .conftest import SCHEMA


def expect_targets(size_of, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(size_of.values()), set()
    while True:
        left = total - sum(cap * size_of[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > cap * size_of[s]}
        if not over:
            return {s: cap * size_of[s] if s in full else share[s] for s in names}
        full |= over


def documents(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "B", "é", "", None] + ["hot"] * 5)
        text = rng.choice([None, "", " w" * rng.randint(1, 60), "w " * rng.randint(1, 900), "\t x\n" * 3])
        rows.append((i, text, "en", source, 0))
    rows += [(1000, None, "en", "nothing", 0), (5, rows[5][1], "en", rows[5][3], 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [3, 4])
def test_mix(spark, seed):
    rows, docs = documents(spark, seed=seed)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").split())
    own = sorted((r[0], size(r[1])) for r in rows)
    assert sorted((r.doc_id, r["size"]) for r in out) == own
    size_of = {}
    for r in rows:
        size_of[r[3]] = size_of.get(r[3], 0) + size(r[1])
    goals = expect_targets(size_of)
    taken = dict.fromkeys(size_of, 0)
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.source_size == size_of[r.source]
        assert r.target == pytest.approx(goals[r.source])
        taken[r.source] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= max(2, 0.001 * goal), (s, taken[s], goal)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in out)


def test_rates_are_tilted_by_length(spark):
    """Among documents of one source the odds r / (3 - r) are exponential in length."""
    rows = [(i, "w " * (10 + i % 50), "en", s, 0) for i in range(600) for s in ("a", "b")]
    lengths = mixing.sizes(spark.createDataFrame(rows, SCHEMA)).groupBy("source", "size").count().withColumnRenamed("count", "n")
    goals = mixing.targets(lengths.selectExpr("source", "size * n as w").groupBy("source").agg({"w": "sum"}).withColumnRenamed("sum(w)", "source_size"))
    for r in mixing.solve(lengths, goals).collect():
        mine = [(x["size"], x.n) for x in lengths.collect() if x.source == r.source]
        got = sum(n * s * 3 / (1 + 2 * math.exp(-r.lam * s / r.mean)) for s, n in mine)
        assert got == pytest.approx(r.target, rel=1e-6)


def test_resample(spark):
    rows, docs = documents(spark)
    plan = {(r.doc_id, r.source): r for r in mixing.mix(docs).collect()}
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        key = (r.doc_id, r.source)
        got[key] = got.get(key, 0) + 1
    for key, r in plan.items():
        if key[0] != 5:
            assert got.get(key, 0) == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_taken_one_by_one(spark):
    """Every document's words: multipliers by bisection, copies and the cut by sorting."""
    _, docs = documents(spark)
    own = [r for r in mixing.sizes(docs).collect()]
    plan = {}
    for r in mixing.mix(docs).collect():
        plan.setdefault((r.doc_id, r.source, r.size), []).append(r.taken)
    goal = {r.source: r.target for r in mixing.mix(docs).collect()}
    total = {s: sum(r["size"] for r in own if r.source == s) for s in goal}
    for source, target in goal.items():
        mine = [r for r in own if r.source == source]
        if not total[source] or target >= 3 * total[source] * (1 - 1e-9):
            for r in mine:
                assert plan[r.doc_id, r.source, r["size"]].pop() == 3 * r["size"]
            continue
        mean = total[source] / sum(r["size"] > 0 for r in mine)
        rate = lambda r, lam: 3 / (1 + 2 * math.exp(max(-700.0, min(700.0, -lam * r["size"] / mean))))  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(r["size"] * rate(r, mid) for r in mine) < target else (lo, mid)
        base = [min(math.floor(rate(r, lo)), 2) for r in mine]
        place = [math.floor((r.unit - (rate(r, lo) - b) + 1) / 2 * 2**36) for r, b in zip(mine, base, strict=True)]
        need = target - sum(b * r["size"] for r, b in zip(mine, base, strict=True))
        for p in sorted(set(place)):
            here = [k for k, x in enumerate(place) if x == p]
            held = sum(mine[k]["size"] for k in here)
            for k in here:
                size = mine[k]["size"]
                more = min(size, math.floor(size * min(1, max(0.0, need) / held) + 0.5)) if held else 0
                taken = plan[mine[k].doc_id, source, size]
                # The word at which a cut falls may differ by rounding of the multiplier.
                near = min(taken, key=lambda t: abs(t - base[k] * size - more))  # noqa: B023
                assert abs(near - base[k] * size - more) <= 1
                taken.remove(near)
            need -= held


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.resample(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "en", None, 0)], SCHEMA)
    assert mixing.mix(none).collect()[0].taken == 0
