"""A corpus pipeline of five stages, each a training-data operator over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import langid, omh, packing, suffix_dedup, tiling
from pathloom.llm.common import fold, saved, table, tune
from pathloom.llm.queries import tokenizer_path

#: Bytes of a string that may not repeat: some 25 to 30 words, so that passages of over 50 words hold several.
STRING_BYTES = 160
#: Phrases that such a string holds: two rounds of doubling.
PHRASES = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; learned from three quarters of the documents at hand.

    Null texts and those without letters have no language and go; a very long text is read whole; repeated rows and null ids are judged by their text; an empty table
    stays empty. All columns are kept, whatever their names.
    """
    tune(spark)
    return langid.keep_known(docs, langid.fit(docs, learn=fold("doc_id", 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the least id, of equal rows one.

    Null texts count as empty, and of empty ones one stays; texts without words are alike only if equal; very long texts are compared whole; a null id comes
    after all others; an empty table stays empty. All columns are kept.
    """
    tune(spark)
    return omh.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of STRING_BYTES bytes that repeat; n_chars follows, and texts of which nothing is left go.

    A null text stays null and its row stays; an empty text has nothing left; shorter texts lose nothing; repeated rows are copies of each other and lose
    what they share; very long texts are read in pieces; an empty table stays empty. All columns are kept.
    """
    tune(spark)
    cut = suffix_dedup.cleaned(docs, length=STRING_BYTES, run=PHRASES).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where((F.length("text") > 0) | F.col("text").isNull())


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of no benchmark item.

    Null and empty texts cover none and stay; very long texts are tiled whole; repeated rows and null ids are judged by their text; an empty table stays empty.
    All columns are kept.
    """
    tune(spark)
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with the sequence and offset of each.

    A null text counts as empty and has its end token only; a very long text has many pieces; repeated rows are packed each; an empty table has no pieces.
    """
    tune(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("suffix_dedup", repeated_strings), ("decontamination", decontaminated), ("packing", packed)]

#: SQL can't express these stages; tests hold each against its operator, and the operators against plain versions where they have one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
