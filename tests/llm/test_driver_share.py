import numpy as np
from pyspark.sql import functions as F

from fcverify.llm import langid, linededup, overlap, store
from fcverify.llm.words import gram_counts, utf8


def test_a_filter_comes_to_the_driver_by_its_set_bits(spark):
    size = linededup.FILTER_BITS
    bits = spark.range(2000).select(F.pmod(F.col("id") * 7_654_321, F.lit(size)).alias("bit")).distinct()
    slices = store.bit_slices(bits)
    assert sum(map(len, slices.values())) < size // 8 // 50
    whole = np.unpackbits(np.frombuffer(store.whole_filter(slices, size), np.uint8))
    assert sorted(np.flatnonzero(whole)) == sorted({i * 7_654_321 % size for i in range(2000)})


def test_filters_of_lines_and_texts_are_sent_packed(spark, docs, prose):
    lines = linededup.line_table(docs([(1, prose(1, 30)), (2, prose(1, 30) + " more"), (3, prose(2, 30))]))
    sent = linededup._filter(lines)
    assert sent and sum(map(len, sent.values())) < 1 << 16
    codes = spark.createDataFrame([(5,), (-1,)], "fp long")
    own = store.whole_filter(overlap._marked(codes, 1 << 16), 1 << 16)
    assert np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8))).tolist() == [5, 65535]
    assert not any(store.whole_filter({}, 1 << 16))


def test_bags_of_grams_come_back_as_they_were(prose):
    for text in ("", "a", "ñandú 漢字 \x00", prose(3, 2000), "x" * 100_000):
        counts = gram_counts(utf8(text), langid.BUCKETS, langid.SIZES)
        used = np.flatnonzero(counts)
        at, n = langid.unpacked(langid.packed(text))
        assert at.dtype == np.int32 and n.dtype == np.float32
        assert at.tolist() == used.tolist() and n.tolist() == counts[used].tolist()
    long = prose(4, 3000, letters="abcdefghijklmnopqrstuvwxyz")
    assert len(langid.packed(long)) < 4 * np.count_nonzero(gram_counts(utf8(long), langid.BUCKETS, langid.SIZES))
