import pytest
from pyspark.sql import functions as F

from loglake.functions import trigrams
from loglake.model import BadQuery
from loglake.plans.dsl import Fact, is_sql, parse

COLUMNS = "ts, level, service, status, message, trace_id, attrs_json"


@pytest.mark.parametrize(
    ("query", "where"),
    [
        ("service:auth status >= 500 | last 1h", "service = 'auth' AND status >= 500 AND ts >= to_timestamp_millis(0)"),
        ("level:error", "level = 'ERROR'"),
        ("it's", "message ILIKE '%it''s%'"),
        ("latency=12ms", "attrs_json LIKE '%\"latency\":\"12ms\"%'"),
        ("a==b", "attrs_json LIKE '%\"a\":\"b\"%'"),
        (r"back\slash", r"message ILIKE '%back\\slash%'"),
    ],
)
def test_sql_text(query, where):
    assert parse(query, 3_600_000).sql("logs", 200) == f"SELECT {COLUMNS} FROM logs WHERE {where} ORDER BY ts DESC LIMIT 200"


def test_no_condition():
    assert parse("  ", 0).sql("logs") == f"SELECT {COLUMNS} FROM logs ORDER BY ts DESC LIMIT 200"


@pytest.mark.parametrize("query", ["status>=abc", "foo | last 5x", "foo | last", "foo | head 3", "service:", "=x", "latency>5", "ts>=3", "x | last 5é", "x | last -5s"])
def test_errors(query):
    with pytest.raises(BadQuery):
        parse(query, 0)


def test_sniffing():
    assert is_sql(" SELECT 1") and is_sql("with x as (select 1) select * from x")
    assert not is_sql("selective") and not is_sql("without") and not is_sql("EXPLAIN x")


def test_facts_and_window():
    s = parse("service:auth level=warn status=200 status!=3 service!=x time%out db | last 1h | last 30m", 7_200_000)
    assert s.facts == (Fact("service", "auth"), Fact("level", "WARN"), Fact("text", "db"))
    assert s.window == (5_400_000, None)
    assert parse("a\\b", 0).facts == ()


def test_dsl_runs(spark):
    rows = [("a\\b", None), ("100% sure", '{"k":"v"}'), ("ABC abc", '{"k":"vv"}'), (None, None)]
    logs = spark.createDataFrame([(m, a) for m, a in rows], "message string, attrs_json string").selectExpr("timestamp_ntz'2024-01-01' AS ts", "'INFO' AS level", "'' AS service", "CAST(NULL AS INT) AS status", "message", "CAST(NULL AS STRING) AS trace_id", "attrs_json")
    find = lambda q: sorted(r.message for r in parse(q, 0).apply(logs).collect())
    assert find(r"a\b") == ["a\\b"]
    assert find("aBc") == ["ABC abc"]
    assert find("k:v") == ["100% sure"]
    assert find("k:v%") == ["100% sure", "ABC abc"]
    assert find("status!=3") == []


def test_trigram_sets_have_no_false_negatives(spark):
    texts = ["connection timeout to db-primary", "Kelvin Kelvin", "ab", "", "naïve ÉCOLE", "a\nb c", "x" * 50, "日本語 text"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", "t", trigrams.ids(F.col("t")).alias("g")).collect()
    for r in rows:
        if r.t is None:
            assert r.g is None
            continue
        low = r.t.lower()
        for a in range(len(low)):
            for b in range(a + 3, min(len(low), a + 12) + 1):
                assert set(trigrams.term_ids(low[a:b])) <= set(r.g), (r.t, low[a:b])
    assert next(r for r in rows if r.t == "ab").g == []


def test_trigram_encoding():
    for members in ([], [0], [5, 50_652], list(range(0, 50_000, 7))):
        assert trigrams.decode(trigrams.encode(members)) == members
    for bad in (b"", b"\x02\x01\x00\x05\x00", b"\x01\x02\x00\x05\x00", b"\x01\x01\x00\xff\xff", None):
        assert trigrams.decode(bad) is None
