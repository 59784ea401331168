import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, oracle_connection
from fcverify.llm import langid, mixing, packing, quality, sharding
from fcverify.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "éèüößñçà"}


@pytest.mark.parametrize("name", ["op1_mtree_top_k", "op7_line_dedup", "op8_source_mix"])
def test_query_equals_oracle(spark, name):
    assert compare(entry.queries()[name](spark, SF), oracle_connection(SF), entry.oracle_sql()[name]) is None


def tongues(prose, n=40):
    return [(i, prose(i, 80, LETTERS[lang]), lang) for i, lang in enumerate(sorted(LETTERS) * n)]


def test_languages_are_told_apart(spark, docs, prose):
    rows = tongues(prose) + [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", None), (903, prose(3, 20_000, LETTERS["cc"]), None),
                             (None, prose(4, 50, LETTERS["aa"]), "bb"), (0, prose(0, 80, LETTERS["aa"]), "aa")]
    df = docs(rows)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df.repartition(5), model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - 3
    again = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df.repartition(3))).collect()}
    assert again == got


def test_held_out_rows_teach_nothing(spark, docs, prose):
    rows = tongues(prose)
    wrong = [(i, t, "zz") if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t, lang) for i, t, lang in rows]
    assert "zz" not in langid.fit(docs(wrong)).languages
    held = {r["doc_id"] for r in docs(rows).filter(langid.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_rare_languages_are_learned_too(docs, prose):
    """More languages than a small sample has room for; the rarest has two rows."""
    rows = [(i, prose(i, 40, "abcdefg"), "common") for i in range(300)]
    rows += [(1000 + 10 * k + i, prose(k, 5, "xyz"), f"rare{k}") for k in range(30) for i in range(2 + k % 2)]
    model = langid.fit(docs(rows), per_language=50, in_all=60, epochs=1)
    learned = {lang for doc, _, lang in rows if zlib.crc32(str(doc).encode()) % 3 != 1}
    assert set(model.languages) == learned and len(learned) > 25


def test_no_language_to_learn(docs):
    model = langid.fit(docs([(1, "abc", None)]))
    assert [(r["lang_pred"], r["rejected"]) for r in langid.identify(docs([(1, "abc"), (2, None)]), model).collect()] == [("und", False), ("und", True)]
    assert langid.identify(docs([]), model).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = entry.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)


def plain_counts(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_equal_plain_ones(spark, docs, prose):
    rows = [(i, prose(i, 10 * (i % 12), "ab" if i % 2 else "abcdefgh", 2 if i % 3 else 5).replace(" a ", "\n#| ")) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\x1c\xa0\t x"), (93, prose(1, 40_000)), (None, "x y z " * 40), (94, "a b\n a b\na b\n\n"), (94, "a b\n a b\na b\n\n")]
    got = sorted(tuple(r)[:7] for r in quality.judge(docs(rows), quality.QualityModel(None)).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *plain_counts(t)) for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_repeated_words(numbers):
    text = " ".join("abcd"[i] for i in numbers)
    assert quality.repeated_words(quality.word_numbers(text.encode())[0]) == plain_counts(text)[4]


def test_classifier_learns_and_keeps_good_text(spark, docs, prose):
    rows = [(i, prose(i, 90, "abcdefgh" if i % 3 else "ABC!$%|", 9)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(1, 0, 0), (1, 1, 0), (3, None, 1), (None, 1, 0), (0, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(docs(rows), labels)
    out = {r["doc_id"]: r for r in quality.judge(docs(rows), model).collect()}
    assert all(out[i]["kept"] == (i % 3 > 0) for i, _ in rows)
    assert all(0 <= r["quality"] <= 1 for r in out.values())
    nothing = quality.fit(docs(rows), labels.limit(0))
    assert nothing.weight is None and quality.judge(docs([]), nothing).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(names)}
    total, done = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in done]
        left, w = total - sum(done.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > most * sizes[s]]
        if not over:
            return {s: float(done.get(s, left * weight[s] / w if w else 0)) for s in names}
        done |= {s: Fraction(most * sizes[s]) for s in over}


def mix_rows(prose):
    rows = [(i, prose(i, 1 + i * 13 % 90), "en", None if i % 11 == 0 else "zéb0"[i % 4] if i % 3 else "hot") for i in range(400)]
    return rows + [(500, None, "en", "hot"), (501, "", "en", "empty"), (502, prose(5, 9000), "en", "b"), (None, "x y", "en", "b"),
                   (None, "x y", "en", "b"), (7, "again", "en", "é"), (7, "again", "en", "é")]


def test_mix_meets_its_targets(spark, docs, prose):
    rows = mix_rows(prose)
    df = docs(rows)
    got = mixing.mix(mixing.sized(df)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want, taken, largest, members = plain_targets(sizes), Counter(), Counter(), defaultdict(list)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in [r["size"] * i for i in range(4)]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        members[r["source"]].append(r)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1
        rounds = {r["taken"] // r["size"] for r in members[source] if r["size"]}
        assert len(rounds) <= 2 and max(rounds or {0}) - min(rounds or {0}) <= 1
        if len(rounds) == 2:  # one threshold: rows below it are taken once more
            assert max(r["h"] for r in members[source] if r["size"] and r["taken"] // r["size"] == max(rounds)) < min(
                r["h"] for r in members[source] if r["size"] and r["taken"] // r["size"] == min(rounds))
    a = md5(b"-:x y").hexdigest()[:15]
    assert {r["h"] for r in got if r["doc_id"] is None} == {int(a, 16)}
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mixed(df).collect())


def test_taken_rows_are_the_mix(spark, docs, prose):
    rows = [r for r in mix_rows(prose) if r[0] is not None]
    df = docs(rows).dropDuplicates(["doc_id"])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mixed(df).collect() if r["size"]}
    out = mixing.take_mix(df)
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in taken.items() if n})
    assert mixing.take_mix(docs([])).collect() == [] and mixing.mixed(docs([])).collect() == []


def test_mix_of_sources_without_words(docs):
    assert [tuple(r) for r in mixing.mixed(docs([(1, None, "en", "a"), (2, "", "en", None)])).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def check_shards(rows, got, spread=0.1):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, size, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(size.values()) / 16
    assert all(abs(size[s] - fair) <= spread * fair for s in range(16))
    return where


def test_shards_are_even_and_keep_groups(docs, prose):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(4000)]
    rows += [(5000 + i, prose(1, 60)) for i in range(40)] + [(None, None), (6000, ""), (6001, prose(2, 2000)), (0, prose(0, 5))]
    where = check_shards(rows, sharding.shard(docs(rows).repartition(6)).collect())
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_text_is_spread(docs, prose):
    rows = [(i, prose(i, 5 + i % 40)) for i in range(2000)] + [(9000 + i, prose(1, 60)) for i in range(900)]
    where = check_shards(rows, sharding.shard(docs(rows)).collect())
    assert sorted(len(s) for s in where.values())[-2:][0] == 1


def test_a_group_stays_whole_while_a_shard_has_room():
    unit = lambda part, piece, size: {"part": part, "piece": piece, "bytes": size, "n": 1, "single": True}
    groups = [[unit(p, k, 10) for k in range(7)] for p in range(6)]  # six groups of 70 bytes for four shards of 105
    placed = sharding.deal([u for g in groups for u in g], 4)
    spread = [len({placed[u["part"], u["piece"]] for u in g}) for g in groups]
    filled = Counter()
    for (part, piece), to in placed.items():
        filled[to] += 10
    assert spread.count(1) == 4 and max(filled.values()) <= 110 and sum(filled.values()) == 420


def test_shards_of_few_rows(docs):
    assert sharding.shard(docs([])).collect() == []
    got = sharding.shard(docs([(1, None), (1, None), (2, "x" * 1000)])).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1001]


LENGTHS = st.lists(st.integers(1, 100), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None)
@given(LENGTHS)
def test_best_fit_decreasing(lengths):
    bins = []
    for x in sorted(lengths, reverse=True):  # the plain algorithm
        fits = [b for b in range(len(bins)) if bins[b] + x <= 100]
        if fits:
            bins[max(fits, key=lambda b: bins[b])] += x
        else:
            bins.append(x)
    own, offset, n = packing.best_fit_decreasing(np.array(lengths), 100)
    assert n == len(bins)
    used = defaultdict(list)
    for b, o, x in zip(own, offset, lengths):
        used[b].append((o, x))
    assert len(used) == n
    for items in used.values():
        end = 0
        for o, x in sorted(items):
            assert o == end
            end += x
        assert end <= 100
    assert packing.lower_bound(np.bincount(lengths, minlength=101)) <= n


def test_bounds_that_volume_does_not_see():
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101)) == 10
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101)) == 5


def check_packing(rows, got):
    whole = encoder(packing.TOKENIZER).whole
    want = Counter()
    for doc, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        first = len(ids) % packing.CAPACITY or min(len(ids), packing.CAPACITY)
        cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
        want.update((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r)[:5] for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in used.values():
        end = 0
        for o, x in sorted(items):
            assert o == end
            end += x
        assert end <= packing.CAPACITY
    return len(used)


def test_packed_documents(docs, prose):
    rows = [(i, prose(i, 3 + i * 37 % 900)) for i in range(150)] + [(500, None), (501, ""), (502, prose(3, 20_000)), (None, "x"), (1, prose(1, 40)), (1, prose(1, 40))]
    got = packing.packed_documents(docs(rows).repartition(3)).collect()
    n = check_packing(rows, got)
    assert n <= packing.lower_bound(np.bincount([r["length"] for r in got], minlength=packing.CAPACITY + 1)) + 2
    assert packing.packed_documents(docs([])).collect() == []


def test_partitions_with_gaps_exchange(spark):
    lengths = np.random.default_rng(3).integers(250, 900, 240).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")

    def bins(rounds):
        out = packing.pack(rows, per_part=20, rounds=rounds).collect()
        assert len(out) == 240 and len({(r["part"], r["bin"], r["offset"]) for r in out}) == 240
        load = Counter()
        for r in out:
            load[r["part"], r["bin"]] += r["length"]
        assert max(load.values()) <= packing.CAPACITY
        return len(load)

    assert bins(3) < bins(0)


def test_pipeline_stages(spark, docs, prose, tmp_path):
    rows = tongues(prose, 30)
    rows += [(300, "12 34 !!", "aa"), (301, None, "aa"), (302, rows[0][1], "aa"), (303, rows[0][1] + "\n" + prose(999, 70, LETTERS["aa"]), "aa")]
    df = docs([(*r[:3], "one" if r[0] % 2 else "two") for r in rows])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    state, seen = df, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        state = spark.createDataFrame(state.collect(), state.schema)
        seen[name] = state
        if name != "packing":
            assert state.columns == df.columns
    ids = {name: Counter(r["doc_id"] for r in out.collect()) for name, out in seen.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows} - {300, 301}
    text = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert text[302] == "" and text[303] == prose(999, 70, LETTERS["aa"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].collect())
    assert set(ids["simhash_dedup"].values()) == {1} and set(ids["source_mix"]) <= set(ids["simhash_dedup"])
    out = [tuple(r) for r in seen["packing"].collect()]
    check_packing([(r["doc_id"], r["text"]) for r in seen["source_mix"].collect()], seen["packing"].collect())
    assert {r[:5] for r in map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())} == {r[:5] for r in out}


def test_stages_take_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs([]), SF)
        assert out.collect() == [] and (name == "packing" or out.columns == docs([]).columns)
