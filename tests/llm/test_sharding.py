"""The shuffle into shards: exact sizes, round trip, the law of the draws, and repeated work."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import sharding


def plain_pmf(good, bad, drawn):
    from math import comb

    return np.array([comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(drawn + 1)])


def test_matrix_margins():
    counts, places = np.array([5, 0, 17, 1, 40]), np.array([21, 21, 0, 21])
    rows = np.array([sharding.matrix_row(counts, places, p, 7) for p in range(5)])
    assert (rows.sum(axis=1) == counts).all() and (rows.sum(axis=0) == places).all() and (rows >= 0).all()
    assert (rows == [sharding.matrix_row(counts, places, p, 7) for p in range(5)]).all()


def test_tree_has_the_hypergeometric_law():
    """An entry of the matrix over many seeds, against the exact law; likewise beyond numpy's limit, where the same function is used with a lower one."""
    counts, places = np.array([6, 6, 6, 6]), np.array([8, 16])
    got = np.bincount([sharding.matrix_row(counts, places, 2, s)[0] for s in range(4000)], minlength=7)
    want = 4000 * plain_pmf(8, 16, 6)
    assert ((got - want) ** 2 / want).sum() < 22.5  # chi square, 6 degrees: 0.1 %


def test_large_draws(monkeypatch):
    monkeypatch.setattr(sharding, "MOST", 0)
    r = np.random.default_rng(3)
    got = np.bincount([sharding.hypergeometric(r, 30, 50, 12) for _ in range(20_000)], minlength=13)
    want = 20_000 * plain_pmf(30, 50, 12)
    big = want > 5
    assert ((got - want)[big] ** 2 / want[big]).sum() < 30 and got[~big].sum() < 40
    good, bad, drawn = 4 * 10**11, 6 * 10**11, 10**10
    x = np.array([sharding.hypergeometric(r, good, bad, drawn) for _ in range(2000)], float)
    var = drawn * 0.24 * (1 - drawn / (good + bad))
    assert abs(x.mean() - drawn * 0.4) < 5 * (var / 2000) ** 0.5 and abs(x.var() / var - 1) < 0.2
    assert sharding.spread(r, np.array([3 * 10**9, 0, 5 * 10**9]), 10**9).sum() == 10**9


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} é") for i in range(983)] + [(1, "text 1 é"), (1, "text 1 é"), (None, None), (2000, ""), (2001, "x" * 300_000)] + [(5, "hot")] * 500
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("part", "place", "cell", "first", "size")}).repartition(5)


def test_exact_sizes_and_round_trip(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for cell in (sharding.CELL, 10):
        got = sharding.shuffled(docs, 40, cell=cell).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        sizes = [len(slots[s]) for s in range(40)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    got = sharding.assigned(docs)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = sorted((str(k), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got.collect()) == want
    assert got.where("law <> 'rows' or grown_shard is not null").count() == 0


def test_few_rows(docs):
    assert sharding.shuffled(docs.limit(0), 40).count() == 0
    assert sharding.shuffled(docs.limit(3), 40).select("shard").distinct().count() == 3


def test_uniform(spark):
    """First and last rows of the table land in every part of the shards, whatever the partition they come from."""
    docs = spark.range(4000).repartitionByRange(4, "id")
    got = sharding.shuffled(docs, 8, cell=50).toPandas()
    table = got.assign(q=got["id"] // 500).groupby(["q", "shard"]).size().unstack(fill_value=0).to_numpy()
    assert ((table - 62.5) ** 2 / 62.5).sum() < 90  # 49 degrees
    assert abs(np.corrcoef(got["id"], got["slot"])[0, 1]) < 0.06


def test_written(spark, docs, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
