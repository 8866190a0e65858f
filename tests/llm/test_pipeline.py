import random
from collections import Counter

import corpus_pipeline
from loglake.llm import langid, lines, minhash, mixing

from .conftest import SCHEMA
from .test_texts import language_docs


def small(spark, tmp_path):
    rng = random.Random(4)
    rows, _ = language_docs(spark, 120)
    rows = [(d, t, lang, rng.choice(["x", "y", None]), n) for d, t, lang, _, n in rows]
    near = rows[3][1].split()
    rows += [(500 + k, " ".join([*near[: len(near) - k], "tail"]), rows[3][2], "x", 0) for k in range(3)]
    rows += [(600 + k, rows[5][1] + "\n" + rows[7][1], rows[5][2], "y", 0) for k in range(4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_pipeline(spark, tmp_path):
    rows = small(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "minhash_dedup", "source_mixing", "piece_encoding"]
    known = steps["language_id"](spark, docs, str(tmp_path)).cache()
    rejected = {r.doc_id for r in langid.identify(docs).where("rejected").collect()}
    assert known.columns == columns and {r.doc_id for r in known.collect()} == {r[0] for r in rows} - rejected and rejected
    clean = steps["line_dedup"](spark, known, str(tmp_path)).cache()
    lost = {r.doc_id: r for r in lines.dedup(known).collect()}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {d for d, r in lost.items() if r.n_lines > r.n_removed or not r.n_removed}
    single = steps["minhash_dedup"](spark, clean, str(tmp_path)).cache()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.doc_id for r in minhash.groups(clean).where("kept").collect()}
    mixed = steps["source_mixing"](spark, single, str(tmp_path)).cache()
    plan = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(single).collect() if r.size}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter(plan)
    whole = {r.doc_id: tuple(r) for r in single.collect()}
    assert all(tuple(r) == whole[r.doc_id] for r in mixed.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == mixed.count() and all(r.round_trip for r in out)
    assert sorted((r.doc_id, r.n_chars) for r in out) == sorted((r.doc_id, r.n_chars) for r in mixed.collect())


def test_odd_tables(spark, tmp_path):
    """An empty table, null ids and columns that the stages do not know."""
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    rows, _ = language_docs(spark, 60)
    rows = [(None if k % 7 == 0 else d, t, lang, src, n, k, "x") for k, (d, t, lang, src, n) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA + ", taken int, `_h, _at` string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "b"))
    assert {"taken", "_h, _at"} <= set(out.columns) and out.count() >= 50 and all(r.round_trip for r in out.collect())
