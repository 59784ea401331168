import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fcverify.llm import chat, planes, words
from fcverify.llm.tokens import encoder

PIECES = st.lists(st.sampled_from(["\\", "<turn user>\n", "</turn>", "</turn>\n", ">", "\n", "a", "### Assistant:", "é", "\\<", "<"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES.map("".join), PIECES.map("".join)), max_size=4))
def test_formatted_turns_read_back(turns):
    made = [chat.format_turn(r, t) for r, t in turns]
    assert chat.parse("".join(m[0] for m in made)) == turns
    for (role, text), (out, a, b) in zip(turns, made):
        assert chat.unescape(out[a:b]) == (text if role == "assistant" else "")


def test_broken_text_is_no_turn():
    for text in ("x", "<turn user>\nhello", "<turn user"):
        with pytest.raises(ValueError):
            chat.parse(text)


LAYOUTS = [
    ({"conv_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
    ({"conv_id": 3, "prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"conv_id": 4, "instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"conv_id": 5, "instruction": "i", "input": "x", "output": "o"}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"conv_id": 6, "system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
]


def test_layouts_become_canonical_turns(spark):
    records = spark.createDataFrame([(json.dumps(r), 1) for r, _ in LAYOUTS] + [(None, 2)], "record string, conv_id int")
    rows = chat.canonical_turns(records).orderBy("conv_id", "turn", "item").collect()
    got = {}
    for r in rows:
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {r["conv_id"]: t for r, t in LAYOUTS}


ODD = [
    ({"conv_id": 1, "messages": []}, []),
    ({"conv_id": 2, "messages": [None, {"role": "user", "content": "a"}, "b", 3]}, [("", ""), ("user", "a"), ("", "b"), ("", "3")]),
    ({"conv_id": 3, "prompt": "p", "response": "r", "score": {"a": [1]}}, [("user", "p"), ("assistant", "r")]),
    ({"conv_id": "4", "turn": 0, "role": "human", "text": "x"}, [("human", "x")]),
    ({"conv_id": "none", "turn": None, "role": "bot", "text": None, "more": 1}, [("bot", "")]),
    ({"conv_id": 6, "conversations": [{"from": "bot", "value": "x"}, {"from": "model", "value": "y", "extra": 1}]}, [("assistant", "x"), ("assistant", "y")]),
    ({"conv_id": 7, "messages": None}, []),
]


def test_odd_records_are_kept(spark):
    for record, want in ODD:
        got = chat.canonical_turns(spark.createDataFrame([(json.dumps(record),)], "record string")).orderBy("item").collect()
        assert [(r["role"], r["text"]) for r in got] == want
        assert {r["conv_id"] for r in got} <= {None if record["conv_id"] == "none" else int(record["conv_id"])}


@pytest.mark.parametrize("line", ["[1]", "{", "3", '"x"'])
def test_other_text_fails_loudly(spark, line):
    with pytest.raises(Exception, match="no JSON object"):
        chat.canonical_turns(spark.createDataFrame([(line,)], "record string")).collect()


def test_unknown_layout_fails_loudly(spark):
    with pytest.raises(Exception, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([('{"a": 1}',)], "record string")).collect()


def test_digests_match_plain_python(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "x</turn>\n", "\\", "long " * 5000, "é<turn user>"]))
            for c in [None, *range(30)] for t in range(rng.randint(1, 6))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted_turns(chat.canonical_turns(records))).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, *chat.format_turn(role or "", text or ""), role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[4] == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{t[4]}\n{t[5]}\n" for t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == sum(len(t[1]) for t in turns)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "record string")
    assert chat.digests(chat.formatted_turns(chat.canonical_turns(empty))).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([1, 7, 8, 64]), st.integers(0, 5))
def test_chunks_read_back(ids, block, docs):
    cuts = sorted(random.Random(len(ids)).randint(0, len(ids)) for _ in range(docs))
    lengths = np.diff([0, *cuts, len(ids)]).tolist()
    got, own = planes.read_chunk(planes.write_chunk(np.array(ids, dtype="<u4"), lengths, block))
    assert got.tolist() == ids and own.tolist() == lengths


def test_other_bytes_are_no_chunk():
    for data in (b"", b"PAR1" + bytes(40)):
        with pytest.raises(ValueError):
            planes.read_chunk(data)


def test_planes_match_the_tokenizer(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(planes, "CHUNK", 500)
    rows = [(i, prose(i, 40 * (i % 7)).capitalize() + ".\nÀ  b\t<|endoftext|>, x") for i in range(60)]
    rows += [(None, "no id"), (70, None), (71, ""), (5, "again"), (5, "again"), (80, prose(1, 30_000))]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                 for r in planes.read_documents(planes.write_ids(docs(rows).repartition(4))).collect())
    whole = encoder(planes.TOKENIZER).whole
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, planes.END], dtype="<u4")
        want.append((start, doc, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_planes_of_nothing(docs):
    assert planes.read_documents(planes.write_ids(docs([]))).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab Zé\n\t,.'s!ßÏİΣ0_\0́\x1c　한", max_size=30), st.sampled_from(["word_bpe_49k.json", "byte_bpe_50k.json"]))
def test_pieces_give_the_ids_of_the_whole(text, name):
    own = encoder(name)
    assert own.ids(text).tolist() == own.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 20))
def test_word_blocks_are_the_words(data, size):
    assert [w for block in words.word_blocks(data, size) for w in block] == data.split()


def test_gram_counts_do_not_depend_on_blocks(monkeypatch, prose):
    data = prose(2, 500).encode()
    whole = words.gram_counts(data, 1 << 10, (2, 3, 4))
    assert whole.sum() == sum(len(data) + 2 - n + 1 for n in (2, 3, 4))
    monkeypatch.setattr(words, "BLOCK", 97)
    assert (words.gram_counts(data, 1 << 10, (2, 3, 4)) == whole).all()
