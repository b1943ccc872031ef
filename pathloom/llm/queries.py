"""The thin queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_density, imatch, langid, licenses, omh, packing, quality, repair, sharding, suffix_dedup, tiling, warc
from .common import fold, table, tune


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of rows whose crc32 modulo 3 is not 1."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    said = quality.score(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document's sentences name or spell out."""
    tune(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses where strings of 400 bytes repeat."""
    tune(spark)
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows whose crc32 modulo 4 is not 2."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=fold("doc_id", 4) != 2)
    said = langid.predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back as one transaction."""
    tune(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    tune(spark)
    return html_density.extract(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    tune(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return imatch.compare(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: edit similarity 0.8 or more, found by order MinHash of five-word runs."""
    tune(spark)
    return omh.classes(table(spark, sf_dir, "documents")).drop("node")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more with tiles of five words or more."""
    tune(spark)
    return tiling.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults and the cheapest edits of every conversation, after damage."""
    tune(spark)
    return repair.checked(table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 40 shards whose counts differ by one at most."""
    tune(spark)
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that mark each."""
    tune(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence, "op11_structure_repair": op11_structure_repair, "op12_sharding": op12_sharding, "op2_license_scan": op2_license_scan, "op5_suffix_dedup": op5_suffix_dedup, "op3_warc": op3_warc, "op4_text_density": op4_text_density, "op7_packing": op7_packing, "op9_string_tiling": op9_string_tiling, "op8_imatch": op8_imatch, "op10_order_minhash": op10_order_minhash, "op1_quality": op1_quality, "op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {
    "op11_structure_repair": repair.oracle(),
    "op13_source_divergence": divergence.oracle(),
    "op2_license_scan": licenses.oracle(),
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
}
