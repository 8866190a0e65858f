"""Work that must grow no faster than its input."""

import time
from dataclasses import replace

from pyspark.sql import functions as F

from loglake.api import LogLake
from loglake.config import Compaction, Config
from loglake.functions import shims, trigrams
from loglake.queries import lake as queries
from loglake.queries import services, surface
from loglake.sources import generate

BASE = 1_700_000_000_000


def by_hand(text):
    codes = [trigrams.ALPHABET.find(c) if c in trigrams.ALPHABET[:-1] else 36 for c in text.lower()]
    return sorted({(a * 37 + b) * 37 + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)})


def test_trigrams_of_a_long_text(spark):
    """Work in proportion to the length; it grew with its square, and this text took many minutes."""
    long = " ".join(f"{k * 2_654_435_761 % 1_000_003:x}" for k in range(8_000))
    texts = {0: long, 1: "ab", 2: "", 3: None, 4: "Abc\nabc", 5: "aéb_-9", 6: "aaaa"}
    rows = spark.createDataFrame(list(texts.items()), "k int, message string")
    began = time.monotonic()
    got = {r["k"]: r["t"] for r in rows.select("k", trigrams.ids(F.col("message")).alias("t")).collect()}
    assert time.monotonic() - began < 60
    assert {k: None if t is None else sorted(t) for k, t in got.items()} == {k: None if t is None else by_hand(t) for k, t in texts.items()}
    found = trigrams.sets(rows, ["k"], F.col("message"), short=True).groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("t"))
    assert {r["k"]: r["t"] for r in found.collect()} == {k: by_hand(t or "") for k, t in texts.items()}
    some = trigrams.sets(rows, ["k"], F.col("message"), term="abc a").collect()
    assert {(r["k"], r["t"]) for r in some} == {(k, t) for k, text in texts.items() for t in by_hand(text or "") if t in trigrams.term_ids("abc a")}


def test_small_files_are_small(spark, tmp_path):
    """Filters as large as the values need: a file of 200 records took over a megabyte for each unique column."""
    config = replace(Config(), ingest=replace(Config().ingest, row_group_rows=100))
    lake = LogLake(spark, str(tmp_path), config=config)
    lake.ingest(generate.generate(spark, 600, 1, BASE))
    assert max(r["bytes"] for r in lake.catalog.files().collect()) < 100_000


def test_every_small_file_is_pending(spark, tmp_path):
    """A last file that fills no bin is merged with the bin before, in one plan of several passes, told of once a tier."""
    lake = LogLake(spark, str(tmp_path))
    for seed in range(5):
        lake.ingest(generate.generate(spark, 60, seed, BASE + seed * 1_000_000))
    files = lake.catalog.files().collect()
    target = max(r["bytes"] for r in files) + 1  # two files fill a bin
    config = Compaction(trigger_files=2, target_bytes=target, files_per_pass=2)
    rows = sorted(map(str, lake.engine.scan(r["path"] for r in files).collect()))
    lake = LogLake(spark, str(tmp_path), config=replace(Config(), compaction=config))
    assert lake.compactor.pending() == {"hot": 5, "warm": 5, "cold": 5}
    reports = lake.compactor.maybe_compact()
    assert {r.tier: (r.files_before, r.files_after, r.files_merged) for r in reports} == dict.fromkeys(("hot", "warm", "cold"), (5, 2, 5)) and len(reports) == 3
    after = lake.catalog.files().collect()
    assert len(after) == 6 and sorted(map(str, lake.engine.scan(r["path"] for r in after).collect())) == rows


def test_one_object_a_tier(spark, tmp_path, monkeypatch):
    """The storage page's query merges a tier into one file even where that is larger than a compaction's target."""
    lake = LogLake(spark, str(tmp_path), config=replace(Config(), compaction=Compaction(trigger_files=2, target_bytes=1)))
    for seed in range(3):
        lake.ingest(generate.generate(spark, 60, seed, BASE + seed * 1_000_000))
    monkeypatch.setattr(queries, "filled", lambda *_: lake)
    assert {tuple(r) for r in queries._stored(spark, "").collect()} == {(t, 1, 0, 1) for t in ("hot", "warm", "cold")}


def test_range_frame_takes_running_sums(spark):
    """A frame that slides over the rows was summed anew for each of them; equal times, hours' ends, times before 1970 and null times as SQL has them."""
    times = [-3_600_001, -3_600_000, -1, 0, 0, 1, 1_799_999, 3_600_000, 3_600_000, 3_600_001, 7_200_000, 7_200_002, 14_400_000, None, None]
    shims.register(spark)
    rows = spark.createDataFrame([(k, "ERROR" if k % 5 else "INFO", ms) for k, ms in enumerate(times * 2)], "event_id long, level string, ms long")
    rows.select("event_id", "level", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts")).createOrReplaceTempView("logs")
    frame = spark.sql(surface.SPARK_SQL["win_range_frame"])
    plan = frame._jdf.queryExecution().executedPlan().toString().lower()
    assert "3600000 preceding" not in plan and "interval '01' hour" not in plan
    got = {r["event_id"]: r["last_hour"] for r in frame.collect()}
    known = {r["event_id"]: (r["level"], r["ms"]) for r in rows.collect()}
    within = lambda a, b: a[0] == b[0] and ((a[1] is None and b[1] is None) or (None not in (a[1], b[1]) and a[1] - 3_600_000 <= b[1] <= a[1]))
    assert got == {k: sum(within(a, b) for b in known.values()) for k, a in known.items()}


def test_quantile_is_exact(spark):
    """As percentile() has it, without one task holding a key's values."""
    rows = [(k % 3 if k % 7 else None, k * k % 99_991 - 500) for k in range(900)] + [(1, None), (5, 42)]
    rows = spark.createDataFrame(rows, "key int, v long")
    for share in (0.0, 0.37, 0.9, 1.0):
        got = {r["key"]: r["quantile"] for r in services._quantile(rows, "key", "v", share, 1_000).collect()}
        want = {r["key"]: r["p"] for r in rows.groupBy("key").agg(F.percentile("v", share).alias("p")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), share


def test_no_sketch_for_each_value(spark):
    """Estimates and a distinct count in one aggregation keep a sketch for every distinct value."""
    plan = services._approximate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    both = [line for line in plan.splitlines() if "approx_count_distinct" in line and "count(distinct" in line]
    assert "approx_count_distinct" in plan and "count(distinct" in plan and not both
