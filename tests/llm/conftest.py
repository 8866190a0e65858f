import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def word_text(rng, n, letters="abcdefghijklmnopqrstuvwxyzé"):
    return "".join(rng.choice([" ", " ", " ", "\n", "\t  "]) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, copies, shared passages, periodic and long texts."""
    rng = random.Random(5)
    passage, long = word_text(rng, 90), word_text(rng, 5000)
    texts = [None, "", " \n\t", None, "", "one", "a b c", passage, passage, passage + word_text(rng, 30), word_text(rng, 30) + passage]
    texts += [word_text(rng, rng.randint(1, 200)) for _ in range(30)]
    texts += [word_text(rng, 40) + passage[20:460] + word_text(rng, 40) for _ in range(12)]
    texts += ["ab " * 300, "ab " * 301, "x" * 3000, long, long[:9000] + " end " + long[9100:], "é" * 500, "é" * 500 + "z"]
    cut = texts[20].split(" ")
    texts += [" ".join(cut[: len(cut) // 2]) + passage[:300], "Z" + passage, passage.upper()]
    return texts
