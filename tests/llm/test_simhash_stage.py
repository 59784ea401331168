import corpus_pipeline
from fcverify.llm import golay, overlap


def test_stage_drops_a_copy_that_only_its_fingerprint_shows(spark, docs):
    phrase = "one two three four five six seven eight nine ten eleven"
    rows = [(1, " ".join([phrase] * 60)), (2, " ".join([phrase] * 60) + " and a tail of quite other words that occur here once only")]
    a, b = (overlap.shingle_set(t) for _, t in rows)
    assert not overlap.near(a, b)
    assert (golay.fingerprint(rows[0][1]) ^ golay.fingerprint(rows[1][1])).bit_count() <= golay.MAX_BITS
    kept = corpus_pipeline.dedup_documents(spark, docs(rows), "")
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_filter_grows_with_the_texts_up_to_its_bound():
    assert overlap.filter_bits(0) == overlap._SLICE
    assert 64_000 <= overlap.filter_bits(1000) <= 128_000
    assert overlap.filter_bits(10**9) == overlap.FILTER_BITS
