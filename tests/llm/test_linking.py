import pytest
from pyspark.sql import functions as F

from loglake.llm import linking


def linked(spark, keys, pair):
    """The links among items with the given keys (None: one of their own) where only ``pair`` is similar."""
    keys = {n: [k if k is not None else 1000 * (n + 1) + i for i, k in enumerate(own)] for n, own in keys.items()}
    rows = spark.createDataFrame([(k, i, n) for n, own in keys.items() for i, k in enumerate(own)], "key bigint, i int, node bigint")
    items = spark.createDataFrame([(n, float(n), own) for n, own in keys.items()], "node bigint, rank double, keys array<bigint>")
    out = linking.link(rows, lambda shared: items.join(shared.select("node"), "node", "left_semi"), lambda l, r: F.lit(True), lambda pairs: pairs.where((F.col("a") == pair[0]) & (F.col("b") == pair[1])))
    return {(r.a, r.b) for r in out.collect()}


@pytest.mark.parametrize("most_work", [1 << 20, 3])
def test_one_common_key_in_a_large_bucket(spark, monkeypatch, most_work):
    """Eight keys, as line dedup once had; a bucket of any size is compared as a whole."""
    monkeypatch.setattr(linking, "MOST_WORK", most_work)
    assert linked(spark, {n: [7] + [None] * 7 for n in range(12)}, (3, 8)) == {(3, 8)}


def test_first_common_key_in_a_large_bucket(spark, monkeypatch):
    """Thirty-two keys, as MinHash: the pair's other common key is far behind, in a small bucket with a leader of neither."""
    monkeypatch.setattr(linking, "MOST_WORK", 20)
    keys = {n: [7] + [None] * 31 for n in range(12)}
    for n in (1, 3, 8):
        keys[n][20] = 9
    assert linked(spark, keys, (3, 8)) == {(3, 8)}


@pytest.mark.parametrize("most_work", [1 << 20, 2])
def test_pairs_without_an_own_key(spark, monkeypatch, most_work):
    """With own, two items of which neither has the key as its own are no pair, inside the main group's reach or outside."""
    monkeypatch.setattr(linking, "MOST_WORK", most_work)
    rows = spark.createDataFrame([(7, 0, n, n in (2, 4)) for n in range(6)], "key bigint, i int, node bigint, own boolean")
    items = spark.createDataFrame([(n, n, n) for n in range(6)], "node bigint, rank int, id int")
    met = lambda l, r: (F.least(l + "id", r + "id") > 0) | (F.greatest(l + "id", r + "id") <= 2)
    out = linking.link(rows, lambda shared: items.join(shared.select("node"), "node", "left_semi"), met, lambda pairs: pairs)
    assert sorted((r.a, r.b) for r in out.collect()) == [(0, 1), (0, 2), (1, 4), (2, 3), (2, 4), (2, 5), (3, 4), (4, 5)]
