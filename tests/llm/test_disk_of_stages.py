"""What the stages of the pipeline leave on disk."""

import pathlib
import time

import corpus_pipeline
from fcverify.llm.store import freed, ready, stored
from fcverify.session import checkpoint_folder


def _tables(spark):
    return {p.name for p in pathlib.Path(checkpoint_folder(spark).removeprefix("file:")).iterdir()}


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_stage_keeps_only_the_tables_its_result_reads(spark, docs, prose):
    rows = []
    for i in range(40):
        words = prose(i, 120).split()
        for copy in range(2):
            rows.append((2 * i + copy, "\n".join(" ".join(words[k:k + 12]) for k in range(0, 120, 12)), "en", "web"))
            words[60] = "changed"
    table = docs(rows, extra=False)
    before = _tables(spark)
    rest = stored(corpus_pipeline.dedup_lines(spark, table, ""), "deduped")
    assert rest.count() == len(rows)
    assert {n[:-33] for n in _tables(spark) - before} == {"gone", "deduped"}
    before = _tables(spark)
    assert corpus_pipeline.dedup_documents(spark, table, "").count() == 40
    left = [n[:-33] for n in _tables(spark) - before]
    assert not {"chained", "crossed", "rooted", "sets", "shared"} & set(left)
    assert left.count("edges") == 3  # of the SimHash step, of the first links and of all links the last one each


def test_shuffle_files_go_with_their_query(spark):
    ready(spark)
    before = _shuffle_files(spark)
    table = stored(spark.range(1000).repartition(5, "id").groupBy("id").count(), "shuffled")
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    # a plan whose shuffle files are gone runs again
    again = spark.range(1000).repartition(5, "id").groupBy("id").count()
    assert len(again.collect()) == len(again.collect()) == 1000
    freed(table)
