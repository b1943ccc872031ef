"""Each operator on small tables with nulls, empty and long texts, ties, repeats and extra columns, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import common, html_density, imatch, langid, omh, packing, quality, suffix_dedup, tiling, warc
from pathloom.llm.queries import tokenizer_path

#: Names that the operators use inside.
CLASH = ("node", "row", "key", "text_hash", "h", "bucket")


def words(r, n, tag=""):
    return " ".join(f"{tag}{chr(97 + r.randrange(26))}{r.randrange(400)}" for _ in range(n))


def plainly_alike(a, b):
    """Edit distance by the textbook's table, after two bounds: lengths and words in common."""
    most = max(len(a), len(b))
    if (most - sum((Counter(a) & Counter(b)).values())) * 5 > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1] * 5 <= most


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    base, passage = words(r, 150), words(r, 120, "p")
    near = base.split()
    near[40], near[90] = "changed", "words"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, words(r, 60) + " " + passage), (5, passage + " " + words(r, 60)), (6, None), (7, ""), (8, "é"), (9, words(r, 4000)), (None, words(r, 30)), (10, "ab " * 400), (11, words(r, 3)), (12, words(r, 80)), (12, words(r, 80)), (13, base), (13, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in CLASH}).withColumn("lang", F.lit("en")).cache()


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = common.word_hashes(a), common.word_hashes(b)
            if len(x) and len(y) and plainly_alike(x.tolist(), y.tolist()):
                parent[root(a)] = root(b)
    groups = {}
    for k, t in rows:
        groups.setdefault(root(t or ""), []).append(k)
    least = {g: min([k for k in ks if k is not None], default=None) for g, ks in groups.items()}
    return sorted((str(k), str(least[root(t or "")]), len(groups[root(t or "")])) for k, t in rows)


def test_near_duplicates(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in omh.classes(docs).collect())
    assert got == brute_classes(rows)
    kept = omh.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 8, 9, None, 10, 11, 12], key=str)
    assert omh.classes(docs.limit(0)).count() == 0 and omh.one_of_each(docs.limit(0)).count() == 0


def test_near_duplicate_recall(spark):
    """Links of brute force over chains of edits: none may be lost."""
    r = random.Random(4)
    rows = []
    for g in range(12):
        at = words(r, 120).split()
        for i in range(6):
            rows.append((len(rows), " ".join(at)))
            at = list(at)
            for _ in range(3):
                at[r.randrange(len(at))] = f"n{r.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.class_id), x.class_size) for x in omh.classes(df).collect())
    assert got == brute_classes(rows)


def edited(r, at, share):
    """A copy with that share of the words replaced, all over the text."""
    at = list(at)
    for i in r.sample(range(len(at)), round(share * len(at))):
        at[i] = f"n{r.getrandbits(40)}"
    return at


def test_near_duplicate_recall_of_lone_pairs(spark):
    """Pairs with scattered edits and no third text that could join them, down to the edit similarity 0.8 itself."""
    r = random.Random(7)
    rows, pairs = [], {}
    for share in (0.2, 0.15, 0.1, 0.05):
        for n in [200, 600] * 50:
            at = words(r, n, f"p{len(rows)}x").split()
            pairs.setdefault(share, []).append(len(rows))
            rows += [(len(rows), " ".join(at)), (len(rows) + 1, " ".join(edited(r, at, share)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in omh.classes(df).collect()}
    met = {share: np.mean([got[i] == got[i + 1] == i for i in at]) for share, at in pairs.items()}
    assert met[0.2] >= 0.97 and met[0.15] >= 0.99 and met[0.1] == met[0.05] == 1, met


@pytest.mark.parametrize("block,cell", [(1000, 400), (60, 25)])
def test_near_duplicates_in_a_hot_passage(spark, block, cell):
    """Near copies among many texts that share a passage: each pair is linked, and nothing else."""
    r = random.Random(6)
    passage, rows = words(r, 200).split(), []
    for g in range(200):
        own = words(r, 90, f"g{g}x").split()
        at = own[:40] + passage + own[40:]
        rows += [(2 * g, " ".join(at)), (2 * g + 1, " ".join(edited(r, at, 0.08)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.class_id, x.class_size) for x in omh.classes(df, block=block, cell=cell).collect())
    assert got == [(i, i - i % 2, 2) for i in range(len(rows))]


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out.append((len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup(docs, length):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute_removed([t for _, t in rows], length)))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs, length=length).collect())
    assert got == want
    cleaned = suffix_dedup.cleaned(docs, length=length)
    assert cleaned.columns == docs.columns and cleaned.where("doc_id = 8 and text = 'é'").count() == 1 and cleaned.where("doc_id = 6 and text is null").count() == 1
    assert suffix_dedup.report(docs.limit(0)).count() == 0


def test_suffix_python_workers(spark, docs, request):
    """No task of the last stage needs two Python workers: the rows that lose nothing don't pass the cut."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is too large
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    for made in (suffix_dedup.cleaned(docs), suffix_dedup.report(docs)):
        most, above = 0, []  # (depth in the plan, Python steps in the task so far)
        for line in made._jdf.queryExecution().executedPlan().toString().splitlines():
            depth, name = (m := re.match(r"([ :+-]*)(?:\*\(\d+\) )?(\w*)", line)).end(1), m[2]
            above = [x for x in above if x[0] < depth]
            above.append((depth, 0 if "Exchange" in name else (above[-1][1] if above else 0) + bool(re.match("ArrowEvalPython|MapInPandas", name))))
            most = max(most, above[-1][1])
        assert most == 1


@pytest.mark.parametrize("run,offsets", [(2, [1]), (4, [1, 2]), (8, [1, 2, 4])])
def test_suffix_rounds(docs, monkeypatch, run, offsets):
    """Prefix doubling takes the offsets 1, 2, 4; each but the last gives ranks to pairs; fewer anchors are tied after each; the result is the same."""
    seen, pairs, tied = [], [], []
    ahead, ranked = suffix_dedup.with_ahead, suffix_dedup.ranked
    monkeypatch.setattr(suffix_dedup, "with_ahead", lambda rows, n: (seen.append(n), tied.append(rows.count()), ahead(rows, n))[2])
    monkeypatch.setattr(suffix_dedup, "ranked", lambda rows, *by: (pairs.append(by), ranked(rows, *by))[1])
    rows = [r.text for r in docs.collect()]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs, length=100, run=run).collect())
    assert got == sorted(map(tuple, brute_removed(rows, 100)))
    assert [1, *seen] == offsets  # the rank one ahead is known in the text
    assert pairs == [("rank", "ahead")] * (len(offsets) - 1) + [("s0", "s1")]
    assert tied == sorted(tied, reverse=True) and all(tied)


@pytest.mark.parametrize("hot", [0, 12])
def test_tiling_against_all_pairs(spark, hot):
    """Every pair tiled without any candidate step; ``hot`` words that all documents and items share, reordered and edited copies, short items."""
    r = random.Random(hot)
    shared = words(r, hot, "hot")
    items = [(i, f"{shared} {words(r, r.choice([3, 8, 20, 40]))}") for i in range(12)] + [(50, None), (51, ""), (51, "a b c d e"), (None, words(r, 15))]
    docs = []
    for d in range(60):
        w = r.choice(items[:12])[1].split()
        cut = r.randrange(len(w) + 1)
        some = w[cut:] + w[:cut] if d % 3 else w[: len(w) // 2 + d % 5]
        if d % 4 == 0:
            some[r.randrange(len(some))] = "changed"
        docs.append((d, f"{words(r, r.randrange(20))} {shared} {' '.join(some)} {words(r, 5)}"))
    docs += [(60, None), (61, ""), (None, docs[0][1]), (5, docs[5][1]), (62, shared * 50)]
    want = []
    for d, t in docs:
        for i, x in items:
            a, b = common.word_hashes(x or ""), common.word_hashes(t or "")
            found = tiling.tiles(a, b, 5)
            if len(a) and sum(n for *_, n in found) / len(a) >= 0.5:
                want.append((str(d), str(i), len(a), sum(n for *_, n in found), len(found), max(n for *_, n in found)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    got = tiling.coverage(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(x.doc_id), str(x.item_id), x.item_words, x.covered, x.n_tiles, x.longest) for x in got) == sorted(want) and want


def test_tiling(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    five = rows[5].split()
    items = spark.createDataFrame([(1, " ".join(five[60:100] + five[20:60])), (2, None), (3, ""), (4, "two words"), (5, words(random.Random(9), 40)), (1, " ".join(five[60:100] + five[20:60]))], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted((r.doc_id, r.item_id, r.covered, r.coverage, r.n_tiles) for r in tiling.coverage(docs, items).collect())
    assert got == sorted([(d, 1, 80, 1.0, 2) for d in (4, 5)] * 2)
    left = tiling.decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 2 and left.where("doc_id in (4, 5)").count() == 0
    assert tiling.coverage(docs, items.limit(0)).count() == 0 and tiling.coverage(docs.limit(0), items).count() == 0
    assert common.without(docs, spark.createDataFrame([(None, 1)], "doc_id long, text_hash long"), most=0).count() == docs.count()


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack(docs, tokenizer_path()).collect()
    want = sorted((str(k), len(ids := [*t.encode(x or "", add_special_tokens=False).ids, 1]), s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, x in rows for s in range(0, len(t.encode(x or "", add_special_tokens=False).ids) + 1, 2048))
    assert sorted((str(r.doc_id), r.doc_tokens, r.start, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
    odd = packing.pack(docs, tokenizer_path(), size=301).collect()  # not a whole number of units
    assert sum(r.length for r in odd) == sum(r.length for r in got)
    assert max(r.offset + r.length for r in odd) <= 301


def plain_imatch(spark, texts, low, high, least):
    """Parts of each text by sets and loops, with Spark's own hash functions for terms, masks and parts."""
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    words = {t: sorted({w for w in re.split(r"[^\w]|_", t.lower()) if w}) for t in set(texts)}
    terms = sorted({w for ws in words.values() for w in ws})
    seeds = 3 + 2 * (imatch.LEVELS - 1)
    rows = spark.createDataFrame([(w,) for w in terms], "w string").select("w", F.xxhash64("w").alias("t")).select("w", "t", F.array(*[F.xxhash64("t", F.lit(i)) for i in range(seeds)]).alias("m")).collect()
    hashed, masks = {r.w: r.t for r in rows}, {r.t: r.m for r in rows}
    docs_with = Counter(hashed[w] for t in texts for w in words[t])
    inside = {t for t, n in docs_with.items() if max(least, int(low * len(texts))) <= n <= max(least, int(high * len(texts)))}
    bits = min(imatch.MOST_BITS, max(10, len(inside).bit_length() + imatch.ROOM))
    at = lambda t: [(t & (1 << 64) - 1) >> 32 * p & (1 << bits) - 1 for p in range(imatch.PROBES)]
    flags = {x for t in inside for x in at(t)}
    asked, out = [], {}
    for text, ws in words.items():
        found = sorted(hashed[w] for w in ws if all(x in flags for x in at(hashed[w])))
        assert all(hashed[w] in found for w in ws if hashed[w] in inside)
        sets = [found]
        for level in range(imatch.LEVELS):
            for chain in range(imatch.CHAINS):
                sets.append([t for t in found if all(masks[t][i] >> chain & 1 for i in range(3 + 2 * level))])
        out[text] = sets
        asked += [(text, i, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(asked, "text string, i int, s array<bigint>")
    part = F.when(F.size("s") > 0, F.when(F.col("i") == 0, F.hash("s")).otherwise(F.hash(F.col("i") - 1 + imatch.CHAINS, "s"))).when(F.col("i") == 0, F.hash("text")).otherwise(0)
    parts = {text: [0] * (1 + imatch.CHAINS * imatch.LEVELS) for text in words}
    for r in df.select("text", "i", part.alias("p")).collect():
        parts[r.text][r.i] = r.p
    return parts


def plain_likeness(a, b):
    same = 0
    for c in range(imatch.CHAINS):
        levels = [i for i in (1 + level * imatch.CHAINS + c for level in range(imatch.LEVELS)) if a[i] or b[i]]
        i = levels[-1] if levels else 0
        same += a[i] == b[i]
    return same / imatch.CHAINS


def test_imatch(spark, docs):
    """Neighbours, edited texts, fingerprints and both likenesses against plain loops."""
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    hashes = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]), reverse=True)
    got = imatch.compare(docs, low=0.1, high=0.6, least=2).collect()
    pairs = []
    for i, (k, t) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        pairs.append((k, t, t[: len(t) - half] + nxt[:half], nxt))
    parts = plain_imatch(spark, [t for _, t in rows], 0.1, 0.6, 2)
    lexicon_of = lambda t: parts[t]
    text = lambda p: "-".join(f"{x & 0xFFFFFFFF:x}" for x in p)
    want = sorted((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), text(lexicon_of(t)), plain_likeness(parts[t], parts[n])) for k, t, e, n in pairs)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in got) == want
    edited = {(str(k), e): t for k, t, e, _ in pairs}
    by_edit = {(str(r.doc_id), r.edited_sha256): r for r in got}
    unchanged = [(k, e) for (k, e), t in edited.items() if e == t]
    assert unchanged and all(by_edit[k, hashlib.sha256(e.encode()).hexdigest()].near_edited == 1.0 for k, e in unchanged)
    unhex = lambda s: [int(x, 16) for x in s.split("-")]
    assert all(abs(r.near_edited - plain_likeness(unhex(r.fingerprint), unhex(r.edited_fingerprint))) < 1e-12 for r in got)
    one = {r.doc_id: r for r in got}
    assert one[1].fingerprint == one[2].fingerprint == one[13].fingerprint and one[1].fingerprint != one[9].fingerprint
    assert imatch.compare(docs.limit(0)).count() == 0
    assert imatch.compare(docs.where("doc_id = 1")).first().near_next == 1.0
    named = docs.select(F.concat(F.lit("id"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("doc_id"), "text")
    assert sorted(r.edited_sha256 for r in imatch.compare(named).collect()) == sorted(r.edited_sha256 for r in got)


def test_imatch_half_edited(spark):
    """Texts of which half stays are nearer to their edited texts than to the next document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    got = imatch.compare(docs).select("near_edited", "near_next").toPandas()
    assert got["near_edited"].mean() > 0.2 and (got["near_edited"] == 0).mean() < 0.05 and got["near_next"].mean() < 0.15


def test_warc(spark):
    rows = [(3, "http://a/\r\nx", "<p>é\r\n\r\nWARC/1.1</p>"), (1, None, "<p>é\r\n\r\nWARC/1.1</p>"), (2, "u", None), (4, "u", ""), (None, "n", ""), (5, "v", "own"), (5, "v", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("digest", F.lit(2))
    path = common.scratch_path(spark, "warc-test")
    got = warc.round_trip(pages, path=path).collect()
    import base64

    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(
        (str(k), len((t or "").encode()), sha(t), kind, str(to))
        for (k, _, t), kind, to in zip(rows, ["revisit", "response", "response", "revisit", "revisit", "response", "revisit"], [1, None, None, 2, 2, None, 5])
    )
    nested = warc.transactions(warc.read(spark, path)).collect()
    assert len(nested) == 7 and all(len(r.requests) == len(r.metadata) == 1 for r in nested)
    assert bytes(next(r for r in nested if r.capture.target_uri is None).capture.payload).decode() == rows[0][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_density.extract(pages).collect())
    assert got == [("1", "None", "", 0), ("1", "u", "x", 1), ("None", "v", "", 0)]
    assert html_density.extract(pages.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(2)
    make = lambda syllables: " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(60))
    kinds = {"aa": ["tha", "ing", "er"], "bb": ["eau", "oir", "çon"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "123 ?", "bb"), (None, make(kinds["aa"]), "aa"), (902, make(kinds["bb"]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in CLASH if c != "key"})
    model = langid.fit(df, learn=common.fold("doc_id", 4) != 2)
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    right = [got[i].lang_pred == k for i, _, k in rows if i is not None and i < 900]
    assert np.mean(right) > 0.97 and got[902].lang_pred == "bb"
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (900, 901)").count() == 0 and kept.where("doc_id < 900").count() >= 118
    none = langid.fit(df.limit(0))
    assert langid.predict(df, none).where("lang_pred <> 'und'").count() == 0


def test_language_labels_are_all_learned(spark):
    df = spark.createDataFrame([(i, f"text of the language {i}", f"l{i:03}") for i in range(510)], "doc_id long, text string, lang string")
    assert list(langid.fit(df, epochs=1).labels) == [f"l{i:03}" for i in range(510)]
    with pytest.raises(ValueError, match="more than 9 labels"):
        langid.fit(df, max_labels=9)


def test_quality(spark):
    r = random.Random(3)
    good = lambda: ". ".join(words(r, 12).capitalize() for _ in range(8)) + "."
    bad = lambda: "### $$$ ".join(words(r, 3).upper() for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (None, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(0)).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    model = quality.fit(df.drop("quality"), labels, learn=common.fold("doc_id", 3) != 1, epochs=60)
    got = {x.doc_id: x.score for x in quality.score(df.drop("score"), model).collect()}
    hits = [(got[i] >= 0.5) == (i % 3 > 0) for i in range(300)]
    assert np.mean(hits) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 303
    assert quality.fit(df.drop("quality"), labels.limit(0)) is None
