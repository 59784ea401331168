import math
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fcverify.llm import golay, linededup, mtree
from fcverify.llm.graph import components


def brute_top_k(rows, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = set()
    for q, v in fine.items():
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:  # several pages, leaves and query blocks
        for name, n in (("PAGE", 64), ("LEAF", 8), ("QUERIES", 3), ("ROUTES", 4)):
            monkeypatch.setattr(mtree, name, n)
        monkeypatch.setattr(mtree.Page.__init__, "__defaults__", (8,))
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (700, 8))
    x[300:500] = x[0]  # a hot vector: ties go to the smaller id
    x[500:600] *= 7
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows[10] = (10, None)
    rows[20] = (20, [None] + [0.0] * 7)
    rows[30] = (30, [float("nan")] * 8)
    rows[50] = (50, [float("inf")] * 8)
    rows[40] = (40, [])
    rows += [(700, [0.5, 0.5, 0.5]), (None, [0.1] * 8), (800, [1.0, 0.0, -1.0]), rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).withColumn("norm", F.lit("x"))
    got = [tuple(r) for r in mtree.search(df.repartition(6), F.col("vec_id") % 50 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top_k(rows)


def test_stored_bounds_save_computations():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (20, 16))
    v = np.concatenate([c + rng.integers(-20, 20, (200, 16)) for c in centres])
    most = float((v.astype(float) ** 2).sum(axis=1).max())
    page = mtree.Page(np.arange(len(v)), v, most, leaf=100)
    page.search(np.array([-1]), v[:1] + 1, most, np.array([-np.inf]), 5)
    assert page.computed < len(v) / 2


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.search(empty, F.col("vec_id") % 50 == 0).collect() == []


def test_large_integers_stay_exact():
    q = np.array([[2**30, -(2**30) + 1]])
    assert mtree.products(q, q[:, ::-1]).tolist() == [[2 * (2**30) * (-(2**30) + 1)]]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_a_key(a, bits):
    b = a ^ sum(1 << x for x in bits)
    keys = [set(golay.golay_keys(np.array([x], dtype=np.uint64))[0].tolist()) for x in (a, b)]
    assert keys[0] & keys[1]


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies(prose):
    long = prose(0, 900).split()
    rows = [(i, prose(i, 60)) for i in range(40)]
    for i in range(40, 110):  # one group of near copies
        words = list(long)
        words[i * 7] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(i, "copy of a copy " + long[0]) for i in range(110, 150)]
    return rows + [(150, None), (151, ""), (152, " \n"), (153, "one"), (154, "ONE"), (155, "two words"), (156, prose(9, 30_000)), (None, "one"),
                   (None, "lone row"), (157, "one")]


@pytest.mark.parametrize("block", [1024, 5])
def test_components_equal_brute_force(docs, prose, monkeypatch, block):
    monkeypatch.setattr(golay, "BLOCK", block)  # 5: hot keys go the way of block pairs
    rows = near_copies(prose)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in golay.near_duplicates(docs(rows).repartition(5)).collect()}
    fp = [plain_fingerprint(t) for _, t in rows]
    root = union([(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3], range(len(rows)))
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[root[i]] = min(doc, name.get(root[i], doc))
    want = {(rows[i][0], fp[i] - (fp[i] >> 63 << 64)): name.get(root[i]) for i in range(len(rows))}
    assert got == want


def test_one_document_of_each_group_stays(docs, prose):
    rows = near_copies(prose) + [(3, prose(3, 60))]
    df = docs(rows)
    kept = golay.keep_first(df)
    assert kept.columns == df.columns
    found = {(r["doc_id"], r["component_id"]) for r in golay.near_duplicates(df).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, c in found if d == c and d is not None})
    assert ids.count(None) == 1  # the lone row; the other row without id has namesakes


def test_duplicates_of_nothing(docs):
    assert golay.near_duplicates(docs([])).collect() == [] and golay.keep_first(docs([])).collect() == []


def test_runs_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(golay, "BLOCK", 10)
    rng = np.random.default_rng(0)
    key = np.sort(np.r_[rng.integers(0, 60, 200), np.full(57, 30)])
    fp = rng.integers(0, 8, len(key))
    for size in (1, 3, 11, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + size]), pa.array(fp[i:i + size])], names=["key", "fp"])
                   for i in range(0, len(key), size)]
        rows = [r for b in golay._scan_runs(batches) for r in b.to_pylist()]
        hot = [r for r in rows if r["kind"] == 1]
        assert sum(r["key"] == 30 for r in hot) == (key == 30).sum()
        assert all(n <= 10 for n in np.unique([r["block"] for r in hot if r["key"] == 30], return_counts=True)[1])


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(5, 5), (None, 3), (299, 301)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [*range(100, 300), 301]}}


WORDS = st.lists(st.sampled_from("ab"), max_size=7)


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_lines_within_the_bound_share_a_filter_hash_and_a_key(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    near = distance(a, b) <= 1
    assert linededup.within_one(a, b) == near
    if near and a and b:
        x, y = [w.encode() for w in a], [w.encode() for w in b]
        if len(x) < len(y):
            x, y = y, x
        hx, hy = linededup.halves(x), linededup.halves(y)
        shared = [a == b for a, b in zip(hx[:2], hy[:2] if len(x) == len(y) else hy[2:])]
        assert any(shared)
        known, no = np.array(shared + [False, False]), np.zeros(4, bool)
        keys = [{tuple(k) for k in linededup.line_keys(w, *m)[1].tolist()} for w, m in (
            ((x, (known, no)), (y, (known, no))) if len(x) == len(y) else ((x, (no, known)), (y, (no, np.array([False, False] + shared)))))]
        own = {tuple(linededup.variants(w).view(np.int64)[0].tolist()) for w in (x, y)}
        assert keys[0] & keys[1] - (own if len(x) == len(y) and x != y else set())


def brute_lines(rows):
    """Kept texts by comparing every line with every earlier one."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2], i))
    seen, out = [], {}
    for i in order:
        doc, text, _ = rows[i]
        kept = []
        mine = []
        for line in (text or "").split("\n"):
            words = line.encode().split()
            gone = bool(words) and any(words == s or (max(len(words), len(s)) >= 5 and min(len(words), len(s)) >= 4
                                                      and linededup.within_one(words, s)) for s in seen + mine)
            if words:
                mine.append(words)
            if not gone:
                kept.append(line)
        seen += mine
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark, docs, prose):
    rng = random.Random(4)
    base = [prose(i, n) for i, n in enumerate([1, 3, 4, 5, 5, 6, 9, 30, 80])]

    def edited(line):
        words = line.split()
        kind, at = rng.choice(["keep", "swap", "drop", "add", "two"]), rng.randrange(len(words))
        if kind in ("swap", "two"):
            words[at] = rng.choice("xyz")
        if kind == "two":
            words[rng.randrange(len(words))] = "q"
        if kind == "drop":
            del words[at]
        if kind == "add":
            words.insert(at, rng.choice("xyz"))
        return " ".join(words)

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.7 else prose(1000 + i * 9 + j, 7) for j in range(rng.randint(1, 7))))
            for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n  \n"), (203, prose(77, 20_000)), (204, prose(77, 20_000) + " end"), (None, base[7]), (205, base[8].replace(" ", "  "))]
    df = docs(rows)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(df.repartition(4)).collect()}
    placed = [(d, t, 0) for d, t in rows]
    want = {rows[i][0]: t for i, t in brute_lines(placed).items()}
    assert got == want


def test_repeated_rows_keep_their_lines_once(docs, prose):
    rows = [(1, prose(1, 10) + "\n" + prose(2, 10))] * 3
    out = linededup.dedup(docs(rows))
    assert out.columns[-3:] == ["kept_lines", "equal_lines", "near_lines"]
    assert sorted(r["text"] for r in out.collect()) == sorted(["", "", rows[0][1]])


def test_lines_of_nothing(docs):
    assert linededup.dedup(docs([])).collect() == []
