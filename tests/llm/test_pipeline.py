import corpus_pipeline
import pytest

import __spark_entry__ as entry
from alertloom.llm import catalog


def test_stages_run_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, out.count()))
        assert set(names) <= set(out.columns)
        docs = out
    assert [n for n, _ in seen] == ["quality", "near_dedup", "decontaminate", "mix", "shard"] and all(n > 0 for _, n in seen)
    assert docs.groupBy("shard", "slot").count().where("count > 1").count() == 0


def test_stages_on_awkward_rows(spark, sf_dir):
    text = "Plain words make a sentence here, and one more follows it at once, so it stays in the table. "
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, None, None, None), (None, "", "x", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
            now = spark.createDataFrame(now.collect(), now.schema)
        assert now.count() == (0 if table is not docs else now.count())
    kept = corpus_pipeline.dedup(spark, corpus_pipeline.clean(spark, docs, sf_dir), sf_dir)
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_cleaned_texts_reach_the_next_stage(spark, sf_dir):
    good = "A line of plain prose stays in the text, as it should in the end. "
    docs = spark.createDataFrame([(1, good + "\nhome | news | shop | help", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = corpus_pipeline.clean(spark, docs, sf_dir).first()
    assert r["text"] == good and r["n_chars"] == len(good)


def test_every_operator_is_registered():
    names = [n for n in catalog.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) | {"pipeline"} <= set(entry.queries()) and set(catalog.ORACLE) <= set(names)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, sf_dir, name):
    import check

    ok, said = check.compare(spark, check.oracle(sf_dir), sf_dir, name, catalog.QUERIES[name], catalog.ORACLE[name])
    assert ok, said
