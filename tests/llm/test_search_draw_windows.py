import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from check import compare, oracle_connection
from fcverify.llm import blocking, importance, neighbours
from fcverify.llm.tokens import encoder
from fcverify.llm.words import term_blocks


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_blocked_search"])
def test_query_equals_oracle(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(entry.queries()[name](spark, sf_dir), oracle_connection(sf_dir), entry.oracle_sql()[name]) is None


def terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aBz09 .\n\t-_é文\x7f{`@/:"), max_size=80))
def test_terms(text):
    assert [w.decode() for part in term_blocks(text, 8) for w in part] == terms(text)


@pytest.fixture
def mixed_rows(prose):
    """Nulls, empty and very long texts, repeats, a hot text, rows without id."""
    rows = [(i, prose(i, random.Random(i).randint(1, 60), "abc", 3)) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " .,; "), (None, prose(1, 50)), (None, prose(1, 50)), (7, rows[7][1]), (7, prose(8, 30)),
             (503, "x" * 5000 + " é文 ABC"), (504, prose(2, 40_000, "abcdef", 4))]
    return rows


# --- importance resampling

def plain_features(text):
    w = terms(text)
    return [zlib.crc32(f.encode()) % importance.BUCKETS for f in w + [" ".join(p) for p in zip(w, w[1:])]]


def plain_draw(rows, target):
    found = [plain_features(t) for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in plain_features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + importance.BUCKETS) / ((s[b] + 1) * (big_t + importance.BUCKETS)))) for b in s}
    out = []
    for (doc, text), f in zip(rows, found):
        h = int(sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:25 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("group", [importance.GROUP, 64])
def test_draw_equals_brute_force(spark, docs, prose, mixed_rows, monkeypatch, group):
    monkeypatch.setattr(importance, "GROUP", group)
    target = [prose(3, 30, "abc", 3), None, "", "xé文"]
    aimed = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs(mixed_rows).repartition(5), aimed)
    rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(rows, key=key) == sorted(plain_draw(mixed_rows, target), key=key)


def test_long_texts_cross_blocks(monkeypatch, prose):
    monkeypatch.setattr("fcverify.llm.words.BLOCK", 64)
    monkeypatch.setattr(term_blocks, "__defaults__", (64,))
    monkeypatch.setattr(importance, "GROUP", 10)
    column = [prose(1, 500), None, "a" * 300 + " b", prose(2, 3)]
    found = defaultdict(list)
    for row, bucket in importance._blocks(column, importance.BUCKETS):
        for r, b in zip(row.tolist(), bucket.tolist()):
            found[r].append(b)
    assert all(sorted(found[i]) == sorted(plain_features(t)) for i, t in enumerate(column))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30))
def test_checksums_by_columns(parts):
    data, size = np.frombuffer(b"".join(parts), dtype=np.uint8), np.array([len(p) for p in parts], dtype=np.int64)
    assert importance.crc_slices(data, np.cumsum(size) - size, size).tolist() == [zlib.crc32(p) for p in parts]


def test_draw_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs([]), none).collect() == []
    got = importance.resample(docs([(1, "a b"), (2, None)]), none).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(3, None), (0, None)]


def test_drawn_documents_keep_their_columns(spark, docs, prose):
    rows = [(i, prose(i, 40)) for i in range(40)]
    table, aimed = docs(rows), spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    out = importance.drawn_documents(table, aimed)
    assert out.columns == table.columns
    ranked = importance.resample(table, aimed).filter("rank is not null").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in ranked) and len(ranked) == 10


# --- retrieval packing

def check_windows(rows, got, window):
    encode = encoder(neighbours.TOKENIZER)
    whole = Counter()
    for doc, text in rows:
        whole[(doc, np.append(encode.whole.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4").tobytes())] += 1
    by_sequence = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding
    # pieces of one document follow each other; copies of one id and text are told apart by nothing but their number
    for (doc, ids), n in whole.items():
        own = [r for r in got if r["doc_id"] == doc and r["doc_tokens"] == len(ids) // 4
               and ids[4 * r["start"]:4 * (r["start"] + r["length"])] == np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()]
        covered = Counter(p for r in own for p in range(r["start"], r["start"] + r["length"]))
        assert sorted(covered) == list(range(len(ids) // 4)) and min(covered.values()) >= n
    assert sum(r["length"] for r in got) == sum(len(ids) // 4 * n for (_, ids), n in whole.items())


@pytest.mark.parametrize("window,shard", [(1024, 1024), (64, 16)])
def test_windows(docs, mixed_rows, window, shard):
    got = neighbours.packed_documents(docs(mixed_rows).repartition(4), window=window, shard=shard).collect()
    check_windows(mixed_rows, got, window)


def test_windows_of_nothing(docs):
    assert neighbours.packed_documents(docs([])).collect() == []
    got = neighbours.packed_documents(docs([(1, None), (2, "")])).collect()
    assert sum(r["length"] for r in got) == 2


def test_windows_hold_neighbours():
    rng = np.random.default_rng(3)
    subjects = [rng.integers(100 * s, 100 * s + 100, (24, 30)) for s in range(5)]
    ids = [np.append(x, 0) for x in np.concatenate(subjects)]
    rng.shuffle(ids)
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]))
    index = neighbours.Shard(ids, np.log(1 + (len(ids) - df + 0.5) / (df + 0.5)), 31.0)
    windows = list(neighbours.fill(index, [len(x) for x in ids], 124))
    pure = [len({ids[x][0] // 100 for x, _, _ in w}) == 1 for w in windows]
    assert len(windows) == 30 and sum(pure) >= 25


# --- blocked search

def plain_search(rows, items, k=blocking.K):
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        scores = []
        for d, c, n in held:
            m = 50 + 50 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in own if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, docs, prose, mixed_rows, monkeypatch, small):
    if small:  # several shards and query blocks, first bounds from a part of the documents
        for name, n in (("DOCS", 40), ("BLOCK", 4), ("DRAWN", 60), ("QUERIES", 3)):
            monkeypatch.setattr(blocking, name, n)
    items = [(i, prose(50 + i, 12, "abc", 3)) for i in range(6)] + [(6, None), (7, ""), (8, "ABC é文 nowhere"), (None, "a"), (9, "a a b"),
                                                                    (9, "c"), (10, mixed_rows[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in blocking.search(docs(mixed_rows).repartition(3), table).collect()]
    assert sorted(got, key=key) == sorted(plain_search(mixed_rows, items), key=key)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert blocking.search(docs([]), items).collect() == []
    assert blocking.search(docs([(1, "b"), (2, None)]), items).collect() == []
    assert blocking.search(docs([(1, "a")]), items.limit(0)).collect() == []


def test_blocks_save_scores():
    """Documents of twenty subjects: a query of one subject scores few of the others'."""
    rng = np.random.default_rng(2)
    size = np.full(2000, 21)
    subject = np.repeat(np.arange(20), 100)
    term = np.concatenate([np.r_[0, 1 + s * 100 + np.sort(rng.choice(100, 20, replace=False))] for s in subject])
    shard = blocking.Shard(size, term, np.where(term == 0, 50, rng.integers(100, 200, len(term))), 2001)
    asked = np.zeros(2001, dtype=bool)
    own = np.r_[0, 1 + np.arange(30)]
    asked[own] = True
    best = blocking.Best([1], 5)
    shard.search(own, asked, 1, lambda d, s: best.offer(0, s, np.zeros(len(d), np.int64), d))
    exact = shard.scores(np.arange(2000), asked)
    assert best.rows[0][0].tolist() == sorted(exact, reverse=True)[:5] and shard.scored - 2000 < 200
