"""The divergence audit against the SQL and plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import divergence
from pathloom.llm.common import table
from tests.test_queries import same

SF = "/root/testdata/sf0.001"


def brute(rows, top=200):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {a: sorted(t for t, n in c.items() if n >= 3) for a, c in docs.items()}
    share = lambda c, a: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept[a]) + len(kept[a])) for t in kept[a]}
    f = lambda p, q: (p - q) ** 2 // q
    p = {(a, s): share(c, a) for (a, s), c in found.items()}
    out = []
    for a, s in found:
        q = share(sum((c for (b, _), c in found.items() if b == a), Counter()), a)
        pair = [(sum(f(p[a, s][t], p[b, o][t]) for t in kept[a]), o) for b, o in found if b == a and o != s]
        term = [(f(p[a, s][t], q[t]), t) for t in kept[a] if found[a, s][t] and p[a, s][t] > q[t]]
        for part, got, most in (("pair", pair, None), ("term", term, top)):
            out += [(a, s, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(got, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def rows():
    r = random.Random(2)
    word = lambda: r.choice(["the", "The", "ÉTÉ", "été", "naïve", "x", "İ", "a-b", "c3d", "日本", "_", "12", "ſ", *(f"w{chr(97 + i)}" for i in range(20))])
    out = [(" ".join(word() for _ in range(r.randrange(30))), r.choice(["en", "fr", None]), r.choice(["a", "b", "é", "hot", "hot", "", None])) for _ in range(150)]
    return out + [("one two", "de", "alone"), (None, "es", "x"), ("", "es", "y"), ("solo", "en", "nothing kept"), ("the " * 50_000, "en", "long"), *[("same text", "en", "a")] * 4]


def test_against_plain(spark):
    data = rows()
    df = spark.createDataFrame(data, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "block", "kept", "rank")}).repartition(3)
    want = brute(data)
    for tile, matrix in ((divergence.TILE, divergence.MATRIX), (16, 10)):
        assert sorted(tuple(r) for r in divergence.audit(df, tile=tile, matrix=matrix).collect()) == want
    assert sorted(tuple(r) for r in divergence.audit(df, tile=16, top=3).collect()) == brute(data, 3)
    assert divergence.audit(df.limit(0)).count() == 0


def test_sql(spark):
    same(divergence.audit(table(spark, SF, "documents")), divergence.oracle())


def test_large_counts():
    """Shares of counts whose products don't fit 64 bits."""
    counts, total = [8 * 10**15, 0, 123_456_789_012_345, 5], 8_999_999_999_999_999
    assert divergence.shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_rows_at_once(monkeypatch):
    """Pairs in strips of one row, and heaps with ties at their end."""
    r = np.random.default_rng(1)
    tile, terms = r.integers(0, 4, (5, 60)), [f"t{i}" for i in range(60)]
    made = []
    for at_once in (divergence.AT_ONCE, 1):
        monkeypatch.setattr(divergence, "AT_ONCE", at_once)
        a = divergence.Audit(list("abcde"), tile.sum(axis=1), 60, 7)
        a.add(terms[:30], tile[:, :30])
        a.add(terms[30:], tile[:, 30:])
        made.append((a.pairs.tolist(), a.heaps))
    assert made[0] == made[1]
