"""How far the sources of each language diverge in their terms: exact integer chi-square distances from dense tiles.

A language keeps the V terms that stand in at least LEAST_DOCS of its documents. With N a group's occurrences of kept terms, a term's share is
p = 1 + floor(10**9 * (count + 1) / (N + V)), and the distance of p from q is f = floor((p - q) * (p - q) / q).

1. Terms are counted in a batch of texts before any shuffle, then by (lang, source, term) and by (lang, term); sums combine in the tasks, so a
   source with a third of all documents is no load.
2. The kept counts and one row for each group are dealt by (lang, strip of groups, block of terms); a block holds the terms with one hash value, so many
   that its tile has some TILE numbers, and a strip so many groups that their rows of the pair matrix have some MATRIX numbers (one strip, up to 2,000 sources).
3. A task lays a block out as a numpy int64 matrix group x term, and broadcasts all pairs of groups over it, some rows of the matrix at a time.
   It adds up the pair sums of its blocks, and keeps the TOP best terms of each group in a heap; a partial matrix and heap leave the task for each language.
4. Spark sums the partial matrices and merges the heaps.

All arithmetic is exact for counts below 9 * 10**15 in a group: products are never formed whole. Sums of f stay below 2**63, as the shares of a group add up to
10**9 + V at most.

Defined results: null text, lang and source are empty ones; a group without terms has all counts 0; a language without kept terms has pair values 0 and no term
rows; a language with one source has no pair rows; repeated rows count each; ties go by the item's UTF-8 bytes; an empty table gives no rows. Only the
three columns are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE_STEPS, SCALE = 3, 1000  # 1000**3 = 10**9
LEAST_DOCS, TOP, TILE, MATRIX = 3, 200, 1 << 20, 1 << 22
#: Numbers that are broadcast at once: pairs x terms.
AT_ONCE = 1 << 21
#: UTF-8 bytes of terms as they are, A to Z in lower case; all other bytes are spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds before it passes them on.
HELD = 1_000_000


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term (null for a group's own row), n occurrences, in_docs documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        size = 0
        for b in batches:
            for a, s, t in zip(b["lang"], b["source"], b["text"]):
                new = (a, s) not in counts
                n, in_docs = counts.setdefault((a, s), (Counter(), Counter()))
                size -= len(n)
                found = t.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()
                n.update(found)
                in_docs.update(set(found))
                size += len(n) + new
                if size > HELD:
                    yield from frames(counts)
                    size = 0
        yield from frames(counts)

    def frames(counts: dict) -> Iterator[pd.DataFrame]:
        for (a, s), (n, in_docs) in counts.items():
            terms = [t.decode("utf-8", "surrogatepass") for t in n]
            yield pd.DataFrame({"lang": a, "source": s, "term": [None, *terms], "n": [0, *n.values()], "in_docs": [0, *map(in_docs.__getitem__, n)]})
        counts.clear()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    made = rows.mapInPandas(run, "lang string, source string, term string, n long, in_docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total) by long division."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE
        out = out * SCALE + rest // totals
        rest = rest % totals
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def best(heap: list[tuple], rows: list[tuple], top: int) -> list[tuple]:
    """The ``top`` of both by value descending and term ascending."""
    return sorted(heap + rows, key=lambda r: (-r[0], r[1].encode("utf-8", "surrogatepass")))[:top]


class Audit:
    """What a task has of a language's groups ``low`` to ``high``: partial pair sums and heaps."""

    def __init__(self, sources: list[str], totals: np.ndarray, kept: int, top: int, strip: int = 0, strips: int = 1):
        self.sources, self.totals, self.kept, self.top = sources, totals, kept, top
        self.low, self.high = (len(sources) * i // strips for i in (strip, strip + 1))
        self.pairs = np.zeros((self.high - self.low, len(sources)), np.int64)
        self.heaps: list[list[tuple]] = [[] for _ in self.pairs]

    def add(self, terms: list[str], tile: np.ndarray) -> None:
        if not terms:
            return
        p = shares(tile, (self.totals + self.kept)[:, None])
        rows = max(1, AT_ONCE // tile.size)
        q = shares(tile.sum(axis=0), self.totals.sum() + self.kept)
        own, tile = p[self.low : self.high], tile[self.low : self.high]
        for a in range(0, len(own), rows):
            self.pairs[a : a + rows] += distances(own[a : a + rows, None, :], p[None, :, :]).sum(axis=2)
        values = distances(own, q[None, :])
        for g, heap in enumerate(self.heaps):
            ok = np.flatnonzero((tile[g] > 0) & (own[g] > q))
            if len(ok) > self.top:  # all that tie with the last
                least = np.partition(values[g, ok], -self.top)[-self.top]
                ok = ok[values[g, ok] >= least]
            self.heaps[g] = best(heap, [(int(values[g, t]), terms[t]) for t in ok], self.top)

    def frame(self, lang: str) -> pd.DataFrame:
        a, b = np.nonzero(np.arange(self.low, self.high)[:, None] != np.arange(len(self.sources)))
        names = np.array(self.sources, object)
        own = names[self.low : self.high]
        terms = [(s, r[1], r[0]) for s, heap in zip(own, self.heaps) for r in heap]
        pairs = pd.DataFrame({"source": own[a], "part": "pair", "item": names[b], "value": self.pairs[a, b]})
        made = pd.DataFrame({"source": [t[0] for t in terms], "part": "term", "item": [t[1] for t in terms], "value": np.array([t[2] for t in terms], np.int64)})
        return pd.concat([pairs, made]).assign(lang=lang)[["lang", "source", "part", "item", "value"]]


def gathered(batches: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Batches of some ``rows`` rows of smaller ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def audited(batches: Iterator[pd.DataFrame], top: int) -> Iterator[pd.DataFrame]:
    """Partial results from rows sorted by lang, strip, block, and groups' own rows first; those have the source's total and the number of kept terms."""
    now, block, task, held, sources, totals, kept, strips = None, None, None, [], [], [], 0, 1

    def flush() -> None:
        nonlocal task, held, sources, totals
        if task is None:
            task = Audit(sources, np.array(totals, np.int64), kept, top, now[1], strips)
        if held:
            rows = pd.concat(held)
            where, terms = pd.factorize(rows["term"])
            tile = np.zeros((len(task.sources), len(terms)), np.int64)
            tile[pd.Index(task.sources).get_indexer(rows["source"]), where] = rows["n"].to_numpy(np.int64)
            task.add(list(terms), tile)
        held, sources, totals = [], [], []

    for b in gathered(batches):
        for (lang, strip, k), rows in b.groupby(["lang", "strip", "block"], sort=False):
            if block is not None and (lang, strip, k) != (*now, block):
                flush()
                if (lang, strip) != now:
                    yield task.frame(now[0])
                    task = None
            now, block = (lang, strip), k
            own = rows["term"].isna()
            if own.any():
                sources += rows.loc[own, "source"].tolist()
                totals += rows.loc[own, "n"].tolist()
                kept, strips = int(rows.loc[own, "kept"].iloc[0]), int(rows.loc[own, "strips"].iloc[0])
            held.append(rows.loc[~own, ["source", "term", "n"]])
    if block is not None:
        flush()
        yield task.frame(now[0])


def audit(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, matrix: int = MATRIX) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = saved(term_counts(docs, lang, source, text), "counts")
    of_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("in_docs").alias("d")).where(F.col("d") >= least).select("lang", "term")
    kept = saved(counts.where("term is not null").join(of_term, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept")
    groups = counts.where("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    size = of_term.groupBy("lang").agg(F.count("*").alias("kept"))
    width = groups.groupBy("lang").agg(F.count("*").alias("g"))
    langs = saved(width.join(size, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) * F.col("g") / tile)).cast("long").alias("blocks"), F.ceil(F.col("g") * F.col("g") / matrix).cast("long").alias("strips")), "langs")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = groups.join(langs, "lang").withColumn("block", each("blocks")).select("lang", "block", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), "kept", "strips")
    cells = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", "kept", "strips")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.union(cells).withColumn("strip", each("strips")).repartition(parts, "lang", "strip", "block").sortWithinPartitions("lang", "strip", "block", F.asc_nulls_first("term"), "source")
    partial = dealt.mapInPandas(lambda b: audited(b, top), "lang string, source string, part string, item string, value long")
    merged = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return merged.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle(least: int = LEAST_DOCS, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "(1 + 1000000000::HUGEINT * (n + 1) // (total + v))"
    f = "((p - q) * (p - q) // q)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
        found AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        terms AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT id) >= {least}),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        sizes AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN terms USING (lang) GROUP BY lang),
        counted AS (SELECT lang, source, term, count(*) AS n FROM found JOIN terms USING (lang, term) GROUP BY ALL),
        cells AS (SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n FROM groups g JOIN terms t USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
        shared AS (SELECT lang, source, term, n, {share} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM cells) JOIN sizes USING (lang)),
        whole AS (SELECT lang, term, {share} AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL)) JOIN sizes USING (lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shared x JOIN shared y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
            ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        rows_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, {f} FROM shared JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows_)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""
