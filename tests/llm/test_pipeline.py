"""The stages in turn on the smallest tables: columns, decisions, and the last stage's pieces."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import langid, omh, suffix_dedup, tiling
from pathloom.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == columns and 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            assert omh.classes(docs).where("class_size > 1").count() == 0
        if name == "suffix_dedup":
            gone = suffix_dedup.report(before, length=corpus_pipeline.STRING_BYTES).where("n_bytes = n_removed and n_bytes > 0").count()
            assert docs.count() == before.count() - gone
        if name == "decontamination":
            assert tiling.coverage(docs, table(spark, SF, "benchmark")).count() == 0
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


def test_texts_are_cut_once(spark):
    """The filter on what is left of a text isn't moved below the cut, which would then run twice in a task."""
    made = corpus_pipeline.repeated_strings(spark, table(spark, SF, "documents"), SF)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [kept(") == 1


@pytest.fixture(scope="module")
def odd(spark):
    """Given documents with null and empty texts, one of 40,000 words, repeats, null ids and languages, and columns named like those the operators use."""
    docs = table(spark, SF, "documents")
    first = docs.orderBy("doc_id").first()
    n = len(first.text)
    rows = [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, " \n ", None, None, 3), (9004, "the words of it " * 10_000, "en", "s", 160_000), (None, first.text, None, "s", n), (first.doc_id, *first[1:])]
    more = spark.createDataFrame(rows, docs.schema)
    clash = ("node", "row", "key", "text_hash", "h", "bucket", "root", "parts", "ord", "rank", "_place", "ids", "n")
    return docs.union(more).withColumns({c: F.lit(1) for c in clash}).cache()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    """All columns stay, also in an empty table; what a stage decides follows its docstring."""
    got = saved(stage(spark, odd, SF), name)
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").distinct().collect())
    if name == "packing":
        assert ids(got) == ids(odd)  # every row has its last token at least
    else:
        assert got.columns == odd.columns and got.count() <= odd.count()
    if name == "language_id":
        assert not {"9001", "9002", "9003"} & set(ids(got)) and "None" in ids(got)
    if name == "near_duplicates":
        assert got.where("doc_id = 9001 or doc_id = 9002").count() == 1 and got.where("doc_id is null").count() == 0
        assert got.groupBy("text").count().where("count > 1").count() == 0
    if name == "suffix_dedup":
        assert got.where("doc_id = 9001 and text is null").count() == 1 and got.where("doc_id = 9002").count() == 0 and got.where("doc_id = 9003").count() == 1
        assert got.where("n_chars <> length(text)").count() == 0
    if name == "decontamination":
        assert {"9001", "9002", "9003", "9004"} <= set(ids(got))
    none = stage(spark, odd.limit(0), SF)
    assert none.count() == 0 and (name == "packing" or none.columns == odd.columns)
