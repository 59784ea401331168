import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with further columns under clashing names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], *(r[2:] + (None, None))[:2], len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "shard", "h", "fp", "key", "root", "part", "th", "line", "score", "c0", "count"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df
    return make


@pytest.fixture
def prose():
    """Random words of a language of its own."""
    def make(seed, n, letters="abcdefghij", length=5):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, length))) for _ in range(n))
    return make
