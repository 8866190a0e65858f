import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loglake.llm import substring, suffixes
from loglake.llm.common import sliding_min
from loglake.model import Conflict

from .conftest import SCHEMA, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(units, window):
    """Which units of each sequence lie in a window that starts twice."""
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def expect_words(texts, window):
    units = [WORD.findall(t or "") for t in texts]
    out = []
    for u, gone in zip(units, brute(units, window), strict=True):
        out.append((len(u), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(u, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def expect_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(((mask[1:] & ~mask[:-1]).sum() + mask[0]) if len(mask) else 0)
        out.append((len(r), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, mask, strict=True) if not g)).hexdigest()))
    return out


def test_words(spark, odd_texts):
    got = sorted(tuple(r) for r in substring.remove_repeats(make_docs(spark, odd_texts)).collect())
    assert [g[1:] for g in got] == expect_words(odd_texts, 35)


@pytest.mark.parametrize("hot", [2048, 1, 3])
def test_bytes(spark, odd_texts, hot):
    got = sorted(tuple(r) for r in suffixes.remove_repeats(make_docs(spark, odd_texts), hot=hot).collect())
    assert [g[1:] for g in got] == expect_bytes(odd_texts, 400)


def test_one_id_many_texts(spark, odd_texts):
    """Rows that share an id, or have none, stay apart."""
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), t, "en", None, 0) for t in odd_texts]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in substring.remove_repeats(docs).collect()), key=key)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expect_words(odd_texts, 35), strict=True)), key=key)
    got = sorted((tuple(r) for r in suffixes.remove_repeats(docs).collect()), key=key)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, expect_bytes(odd_texts, 400), strict=True)), key=key)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.remove_repeats(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, 6)], "doc_id bigint, text string, fp int, _at int")
    assert substring.remove_repeats(odd).count() == suffixes.remove_repeats(odd).count() == 1


def test_difference_cover():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = rng.integers(1, rng.choice([2, 3, 5, 300]), rng.integers(0, 60))
        assert suffixes.difference_cover_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 99, 57)
    for w in (1, 2, 5, 56, 57, 58):
        assert sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]


def test_index(spark, tmp_path):
    """Runs survive in their folder, hits count all runs, levels are merged, and a second writer of one version fails."""
    root = str(tmp_path / "index")
    batch = lambda *fps: spark.createDataFrame([(f, 1, 2, k) for k, f in enumerate(fps)], "fp bigint, _d bigint, _h bigint, at int")
    for k in range(4):
        index = substring.FingerprintIndex(spark, root)
        hits = index.absorb(batch(k, 7, 7, 100 if k in (0, 3) else 200 + k))
        assert {tuple(r) for r in hits.collect()} == {(7, 2 * k + 2)} | ({(100, 2)} if k == 3 else set())
        index.compact()
        assert [level for level, _ in index.state()[1]] == [[0], [1], [1, 0], [2]][k]
    assert sorted(r.fp for r in index.places().collect()) == sorted([0, 1, 2, 3, *[7] * 8, 100, 100, 201, 202])
    version, runs = index.state()
    index._commit(version, runs)
    with pytest.raises(Conflict):
        index._commit(version, runs)


def test_batches_over_time(spark, odd_texts, tmp_path):
    """Each call removes what repeats in its documents or in any before them."""
    index, seen = substring.FingerprintIndex(spark, str(tmp_path / "index")), []
    for part in (odd_texts[::3], odd_texts[1::3], odd_texts[2::3]):
        docs = spark.createDataFrame([(len(seen) + k, t) for k, t in enumerate(part)], "doc_id bigint, text string")
        history = spark.createDataFrame(list(enumerate(seen)), "doc_id bigint, text string")
        got = sorted(tuple(r) for r in substring.remove_repeats(docs, index=index, history=history, batches=1).collect())
        assert [g[1:] for g in got] == expect_words([*part, *seen], 35)[: len(part)]
        seen += part


def test_long_text(spark):
    """A text of some megabytes that repeats itself, beside short ones."""
    rng = random.Random(9)
    long = " ".join(str(rng.randint(0, 9)) for _ in range(400_000))
    texts = [long + " " + long[:5000], "short", None, "a " * 300_000]
    assert [tuple(r)[1:] for r in sorted(substring.remove_repeats(make_docs(spark, texts)).collect())] == expect_words(texts, 35)
    texts = [long + long[:5000], "short", None, "a" * 300_000]
    assert [tuple(r)[1:] for r in sorted(suffixes.remove_repeats(make_docs(spark, texts)).collect())] == expect_bytes(texts, 400)
