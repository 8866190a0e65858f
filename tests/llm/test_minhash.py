import random
import re

import pytest

from loglake.llm import minhash
from loglake.llm.linking import components

from .conftest import SCHEMA, make_docs, word_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, text, share):
    return " ".join("".join(rng.sample("abcdefgh", 4)) if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def texts(odd_texts):
    rng = random.Random(8)
    base = [word_text(rng, rng.randint(20, 150)) for _ in range(12)]
    out = list(odd_texts)
    for b in base:
        for _ in range(12):
            out.append(edited(rng, b, rng.choice([0, 0.01, 0.03, 0.05, 0.08])))
    chain = base[0].split()
    for k in range(30):  # neighbours are near, ends are not
        chain = chain[2:] + [f"n{k}", f"m{k}"]
        out.append(" ".join(chain))
    return out


def test_groups(spark, texts, monkeypatch):
    from loglake.llm import linking

    docs = make_docs(spark, texts)
    expect = brute(list(enumerate(texts)))
    assert sorted(map(tuple, minhash.groups(docs).collect())) == expect
    monkeypatch.setattr(linking, "MOST_WORK", 3)
    monkeypatch.setattr(minhash, "LARGE", 2)
    assert sorted(map(tuple, minhash.groups(docs).collect())) == expect


def test_keep_one_and_odd_rows(spark, texts):
    docs = make_docs(spark, texts[:60])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [e[0] for e in brute(list(enumerate(texts[:60]))) if e[3]]
    assert minhash.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", "en", "s", 0), (3, "a b c d e f", "en", "s", 0), (3, "other words here", "en", "s", 0), (4, None, "en", "s", 0)]
    got = sorted(map(str, minhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert len(got) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 110: 100, 120: 100}
