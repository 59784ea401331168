import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fcverify.llm import golay, overlap

from test_search_and_dedup import union


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rows, prose):
    """Texts with up to a few words exchanged, put in or taken out, around a similarity of 0.8."""
    rng = random.Random(3)
    out = list(rows)
    for i in range(len(out), len(out) + 90):
        words = prose(rng.randrange(4), rng.choice([6, 30, 120])).split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = rng.choice([[], ["Changed"], ["put", "in"]])
        out.append((i, " ".join(words)))
    shared = prose(70, 60)  # a passage that many different texts carry
    out += [(i, f"{prose(i, 40)} {shared}") for i in range(len(out), len(out) + 40)]
    n = len(out)
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b c d e f"), (n + 6, "a b c d e"),
                  (None, "one"), (None, "lone row"), (n + 7, prose(9, 20_000)), (n + 8, prose(9, 20_000) + " end")]


@pytest.mark.parametrize("held", [30_000, 1])
def test_components_equal_brute_force(docs, prose, monkeypatch, held):
    monkeypatch.setattr(overlap, "HELD", held)
    rows = edited([(i, prose(i, 60)) for i in range(10)], prose)
    sets = [plain_set(t) for _, t in rows]
    root = union([(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])], range(len(rows)))
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[root[i]] = min(doc, name.get(root[i], doc))
    want = sorted((rows[i][0] if rows[i][0] is not None else -1, name.get(root[i], -1)) for i in range(len(rows)))
    got = overlap.near_duplicates(docs(rows).repartition(5)).na.fill(-1).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == want


def test_stage_drops_a_near_copy_whose_fingerprint_is_far(spark, docs, prose):
    words = prose(5, 300).split()
    for at in (40, 120, 200, 260):
        words[at] = "changed"
    rows = [(1, prose(5, 300)), (2, " ".join(words)), (3, prose(6, 300)), (None, "Lone row"), (None, "lone ROW")]
    assert near(plain_set(rows[0][1]), plain_set(rows[1][1]))
    assert (golay.fingerprint(rows[0][1]) ^ golay.fingerprint(rows[1][1])).bit_count() > golay.MAX_BITS
    df = docs(rows)
    kept = corpus_pipeline.dedup_documents(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]


def test_the_bound_is_exact():
    a, b = np.arange(9, dtype="<u8"), np.arange(1, 10, dtype="<u8")
    assert overlap.near(a, b) and not overlap.near(a[:8], b[:8])
    assert [overlap.least(n) for n in (1, 4, 5, 6, 10)] == [1, 4, 4, 5, 8]


def test_shared_keys_across_batches():
    rng = np.random.default_rng(1)
    rows = sorted((int(k), int(rng.integers(90, 130)), 0) for k in rng.integers(0, 40, 120))
    rows = sorted({(k, n, 7 * n + 1 + k % 3) for k, n, _ in rows}) + [(50, 100, 1)] * 3
    rows = sorted(rows + rows[::4])  # copies from several tasks
    out = []
    for size in (1, 3, 11, 500):
        cut = [rows[i:i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["key", "n", "fp"]) for part in cut]
        out.append([tuple(r.values()) for b in overlap._shared(batches) for r in b.to_pylist()])
    assert all(o == out[0] for o in out)
    unique = sorted(set(rows))
    many = [r for r in unique if sum(r[0] == q[0] for q in unique) > 1]
    assert [r[:3] for r in out[0]] == many
    for (k, n, _, prev), before in zip(out[0][1:], out[0]):
        assert prev == (before[2] if before[0] == k and before[1] >= overlap.least(n) else None)


def test_duplicates_of_nothing(docs):
    assert overlap.near_duplicates(docs([])).collect() == []
