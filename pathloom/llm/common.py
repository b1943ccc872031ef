"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.store import saved, scratch_path  # noqa: F401  the operators take them from here

U64 = np.uint64
#: An odd multiplier, so that it has an inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches: by rows for tables of long texts, by bytes for the longest. Shuffle files go when the action that wrote them ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % n


def bit_set(rows: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """2**bits bits with the low bits of a bigint column, packed. Its size is fixed; it only spares work, exact steps follow."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((max(1, 1 << (bits - 15)), 4096), np.uint8)
    for r in parts.collect():  # at most 2**(bits - 15) rows of 4 KB
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_set(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values.astype(np.int64) & (8 * len(packed) - 1)
    return packed[low >> 3] >> (low & 7).astype(np.uint8) & 1 == 1


def first_seen(done: set[bytes], key: bytes, most: int = 100_000) -> bool:
    """Whether the key is not in ``done``, which forgets all beyond ``most``: copies in a task cost no work twice, and some memory only."""
    if key in done:
        return False
    if len(done) >= most:
        done.clear()
    done.add(key)
    return True


def hash_share(*cols: str | Column) -> Column:
    """A number in [0, 1) from a hash of the columns, the same in every run."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_tables: dict[str, np.ndarray] = {}


def char_table(kind: str) -> np.ndarray:
    """A flag for every code point: letter, alnum or space."""
    if kind not in _tables:
        test = {"letter": str.isalpha, "alnum": str.isalnum, "space": str.isspace}[kind]
        _tables[kind] = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    return _tables[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 .. n-1, modulo 2**64."""
    name = "inverse" if inverse else "base"
    p = _powers.get(name)
    if p is None or len(p) < n:
        b = U64(pow(int(BASE), -1, 1 << 64)) if inverse else BASE
        p = np.full(max(n, 1 << 16, 2 * len(p) if p is not None else 0), b, U64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        _powers[name] = p
    return p[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix sums: H[i] = sum of values[j] * BASE**j over j < i. See span_hash."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end], equal for equal spans wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits in an array of code points."""
    flag = np.zeros(len(points) + 2, np.int8)
    flag[1:-1] = char_table("alnum")[points]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each lower-case word of letters and digits, in text order."""
    points = code_points(text.lower())
    starts, ends = word_spans(points)
    if not len(starts):
        return np.zeros(0, U64)
    h = span_hash(prefix_hash(points.astype(U64) + U64(1)), starts, ends)
    return mix(h ^ ((ends - starts).astype(U64) << U64(56)))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k words; for 1 to k-1 words, one hash of them all."""
    n = len(words)
    if not n:
        return words
    starts = np.arange(max(1, n - k + 1))
    return mix(span_hash(prefix_hash(words), starts, np.minimum(starts + k, n)))


def text_hash(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = 2_000_000) -> DataFrame:
    """The rows of docs whose (key, text hash) isn't in ``gone`` (columns key, text_hash), all columns kept.

    ``gone`` is broadcast where it has at most ``most`` rows (some 50 MB), else both sides are shuffled.
    """
    gone = gone.select(F.col(key).alias("_gone_key"), F.col("text_hash").alias("_gone_hash")).distinct()
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone_key"]) & (text_hash(docs[text]) == gone["_gone_hash"]), "left_anti")
