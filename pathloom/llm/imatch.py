"""I-Match document fingerprints, in DataFrame functions only.

A term is a lower-cased run of letters and digits, known by a 64-bit hash. The document frequency of every term is counted over all documents, and
the lexicon is the terms in a band of inverse document frequency. Its size is bounded whatever the number of documents: with D distinct terms in a
document on average, at most D / ``low`` terms are in a share ``low`` of them. It is kept as PROBES bits a term in a filter of some 2**ROOM bits a term, so that
of the terms outside the lexicon at most one in 60 passes, the same ones in every text.

A document's distinct lexicon terms are sorted and hashed, once whole and once for each of ``CHAINS * LEVELS`` randomised subsets of the lexicon: level j of a
chain keeps each term with chance 4**-j / 2, and what it keeps is in the levels below too, so that long texts and short ones both have subsets in
which a few terms decide. The bits of a term's hashes draw for all chains at once. Equal texts have equal fingerprints.

The likeness of two fingerprints is the share of chains that agree in the highest level at which either has terms; where neither has any, in the whole.

Defined results: a null text counts as empty; the whole-lexicon part of a text without lexicon terms is a hash of the text
(so it is never empty); in the order of documents, rows with a null id come last and equal ids are ordered by a hash of the text, descending; the
only row of a table is its own next document; repeated rows have rows of their own; a very long text takes memory in proportion to its words; an empty table gives no
rows. Only id and text are read, so other columns may have any name, and ids any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CHAINS, LEVELS, PROBES, ROOM, MOST_BITS = 16, 5, 2, 4, 26


def shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def places(term: Column, bits: int) -> list[Column]:
    """Where a term's bits are in a filter of 2**bits bits."""
    return [shift_right(term, F.lit(32 * p)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for p in range(PROBES)]


def lexicon(docs: DataFrame, *, text: str = "text", low: float = 2e-4, high: float = 0.1, least: int = 3) -> tuple[Column, int]:
    """The lexicon as a filter, a constant array of 2**bits / 64 words, and its bits: terms in ``least`` documents and a share ``low`` to ``high``."""
    n_docs = docs.count()
    frequency = docs.select(F.explode(terms(F.col(text))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    chosen = saved(frequency.where(F.col("n").between(max(least, int(low * n_docs)), max(least, int(high * n_docs)))).select("t"), "lexicon")
    bits = min(MOST_BITS, max(10, chosen.count().bit_length() + ROOM))
    at = chosen.select(F.explode(F.array(*places(F.col("t"), bits))).alias("place"))
    words = at.groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(shift_left(F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)))).alias("bits"))
    grid = docs.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"))
    full = grid.join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0)).alias("bits"))
    packed = full.groupBy(F.shiftright("w", 9).alias("part")).agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("words"))
    said = packed.orderBy("part").select(F.array_join(F.col("words.bits").cast("array<string>"), ",").alias("said")).collect()
    return F.split(F.lit(",".join(r["said"] for r in said)), ",").cast("array<bigint>"), bits  # 2**(MOST_BITS - 6) numbers at most


def with_parts(df: DataFrame, text: str, lex: tuple[Column, int], prefix: str) -> DataFrame:
    """Add ``{prefix}``: 32-bit hashes of the sorted lexicon terms and of each subset, 0 for an empty subset."""
    words, bits = lex

    def known(t: Column) -> Column:
        flags = [shift_right(F.element_at(words, F.shiftright(at, 6) + 1), at.bitwiseAND(F.lit(63))) for at in places(t, bits)]
        return reduce(Column.bitwiseAND, flags).bitwiseAND(F.lit(1)) == 1

    def drawn(t: Column) -> Column:
        """The term with a mask for each level: bit c is set where chain c keeps it, by chance 1/8 at the first level and 1/4 of that at each further one."""
        masks, seed = [], 0
        for level in range(LEVELS):
            for _ in range(2 if level else 3):
                masks.append(F.xxhash64(t, F.lit(seed)))
                seed += 1
        held = [reduce(Column.bitwiseAND, masks[: 3 + 2 * level]) for level in range(LEVELS)]
        return F.struct(t.alias("t"), *[h.alias(f"m{i + 1}") for i, h in enumerate(held)])

    def kept_by(chain: int, level: int) -> Callable[[Column], Column]:
        return lambda x: x[f"m{level}"].bitwiseAND(F.lit(1 << chain)) != 0

    df = df.withColumn("_found", F.array_sort(F.filter(terms(F.col(text)), known)))
    df = df.withColumn("_drawn", F.transform("_found", drawn))
    parts = [F.when(F.size("_found") > 0, F.hash("_found")).otherwise(F.hash(text))]
    last = {c: "_drawn" for c in range(CHAINS)}
    for level in range(1, LEVELS + 1):
        names = {c: f"_{level}_{c}" for c in last}
        df = df.withColumns({names[c]: F.filter(last[c], kept_by(c, level)) for c in last})
        parts += [F.when(F.size(names[c]) > 0, F.hash(F.lit(level * CHAINS + c), F.col(f"{names[c]}.t"))).otherwise(F.lit(0)) for c in last]
        last = names
    return df.withColumn(prefix, F.array(*parts)).select(*[c for c in df.columns if not c.startswith("_")], prefix)


def fingerprint(parts: str) -> Column:
    return F.array_join(F.transform(parts, lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), "-")


def likeness(a: str, b: str) -> Column:
    def agree(chain: int) -> Column:
        out = F.get(a, F.lit(0)) == F.get(b, F.lit(0))
        for level in range(LEVELS):  # the highest level comes out first
            x, y = (F.get(p, F.lit(1 + level * CHAINS + chain)) for p in (a, b))
            out = F.when((x != 0) | (y != 0), x == y).otherwise(out)
        return out.cast("int")

    return reduce(Column.__add__, [agree(c) for c in range(CHAINS)]) / CHAINS


def with_next(df: DataFrame, key: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    """Add next_{c} for text and carry: the row with the next smaller (key, hash of text); after the last row, the first.

    The narrow pairs are cut into ranges by sorting them; each range is ordered by a window, and its first row also goes to the range before it. Rows of one
    key, or of none, are cut by their texts' hashes; only rows equal in both stay together.
    """
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, int(ranges**0.5))
    order = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    dealt = df.select(order.alias("o")).repartitionByRange(side * side, "o").groupBy(F.spark_partition_id().alias("r"))
    heads = sorted((r["r"], r["o"]) for r in dealt.agg(F.max("o").alias("o")).collect())  # a row for each range that has rows
    if not heads:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in (text, *carry)])
    kind = df.schema[key].dataType
    said = [F.struct(F.lit(o["k"]).cast(kind).alias("k"), F.lit(o["h"]).cast("bigint").alias("h")) for _, o in heads]  # ascending; the largest of each range
    n = len(said)
    coarse = F.array(*said[side - 1 :: side]) if n >= side else F.array(said[-1])
    rank = F.size(F.filter(coarse, lambda b: b < F.col("_o"))) * side
    fine = F.slice(F.array(*said), rank + 1, F.lit(side))
    rows = df.withColumn("_o", order).withColumn("_r", rank + F.size(F.filter(fine, lambda b: b < F.col("_o"))))
    is_head = F.col("_o") == F.element_at(F.array(*said), F.col("_r") + 1)
    own = F.struct(F.col("_r").alias("r"), F.lit(0).alias("guest"))
    both = F.array(own, F.struct(((F.col("_r") + 1) % n).alias("r"), F.lit(1).alias("guest")))  # the range before, in descending order, is the next larger one
    rows = rows.withColumn("_at", F.explode(F.when(is_head, both).otherwise(F.array(own))))
    w = Window.partitionBy("_at.r").orderBy(F.col("_at.guest"), F.col("_o").desc())
    led = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in (text, *carry)})
    return led.where("_at.guest = 0").select(*df.columns, *[f"next_{c}" for c in (text, *carry)])


def compare(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **band: float) -> DataFrame:
    """Fingerprints of every text and of its half replaced by the next document's start, with their likeness."""
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = lexicon(docs, **band)
    rows = with_next(with_parts(docs, "text", words, "parts"), "key", "text", ("parts",))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "parts", "next_parts")
    rows = with_parts(rows, "edited", words, "edited_parts")
    return rows.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("parts").alias("fingerprint"),
        fingerprint("edited_parts").alias("edited_fingerprint"), likeness("parts", "edited_parts").alias("near_edited"), likeness("parts", "next_parts").alias("near_next"),
    )
