"""Small pieces against brute force, without Spark."""

import gzip
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import common, html_density, langid, omh, packing, quality, suffix_dedup, tiling, warc

small = settings(max_examples=60, deadline=None)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 14))
def test_banded_distance(a, b, limit):
    assert omh.banded_distance(a, b, limit) == min(edit_distance(a, b), limit + 1)


def test_order_counts_in_sketches():
    words = common.word_hashes(" ".join(f"w{i}" for i in range(60)))
    assert (omh.order_minhash(words, 1, 2, 64) != omh.order_minhash(words[::-1].copy(), 1, 2, 64)).all()
    assert (omh.order_minhash(words, 5, 2, 8) == omh.order_minhash(words.copy(), 5, 2, 8)).all()
    assert len(omh.order_minhash(words[:0], 5, 2, 8)) == 0 and len(omh.order_minhash(words[:1], 5, 2, 8)) == 8


def test_alike():
    r = random.Random(0)
    a = np.array([r.randrange(50) for _ in range(200)], np.uint32)
    for edits in (0, 10, 39, 45, 80):
        b = a.copy()
        b[r.sample(range(200), edits)] = 99
        assert omh.alike(a, b, 0.8) == (edit_distance(a.tolist(), b.tolist()) <= 40)


@small
@given(st.text(max_size=60))
def test_words(text):
    want = "".join(c if c.isalnum() else " " for c in text.lower()).split(" ")
    want = [w for w in want if w]
    got = common.word_hashes(text)
    assert len(got) == len(want)
    assert len({*got.tolist()}) == len({*want})


@small
@given(st.binary(max_size=80), st.integers(1, 20))
def test_span_hash(data, k):
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(values) >= k:
        p, at = common.prefix_hash(values), np.arange(len(values) - k + 1)
        h = common.span_hash(p, at, at + k)
        assert all((h[i] == h[j]) == (data[i : i + k] == data[j : j + k]) for i in at for j in at)


def greedy_tiles(item, doc, k):
    """Longest common unmarked match, again and again; only the number of covered words is unique."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return covered
        for x in range(n):
            used_i[i + x] = used_d[j + x] = True
        covered += n


def test_tiles():
    r = random.Random(5)
    item = [f"w{i}" for i in range(24)]
    for _ in range(30):
        parts = [item[s : s + r.randint(2, 9)] for s in (r.randrange(20) for _ in range(4))]
        doc = [w for p in parts for w in [*p, f"x{r.random()}"]]
        h = lambda ws: common.word_hashes(" ".join(w.replace(".", "") for w in ws))
        found = tiling.tiles(h(item), h(doc), 3)
        assert all(h(item)[s : s + n].tolist() == h(doc)[t : t + n].tolist() for s, t, n in found)
        assert sum(n for *_, n in found) == greedy_tiles(h(item).tolist(), h(doc).tolist(), 3)
    assert tiling.tiles(h(item[12:] + item[:12]), h(item), 5) != [] and sum(t[2] for t in tiling.tiles(h(item[12:] + item[:12]), h(item), 5)) == 24
    assert tiling.tiles(h(item[:3]), h(item), 5) == []


def test_patterns():
    r = np.random.default_rng(0)
    for n in (1, 30, 3000):
        demand = np.bincount(r.integers(0, 64, n), minlength=64)
        found = packing.patterns(demand, 64)
        assert (sum(p * c for p, c in found) == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 and c > 0 for p, c in found)
        used, needed = sum(c for _, c in found), (demand * np.arange(1, 65)).sum() / 64
        assert used <= needed * 1.02 + 8
    assert packing.patterns(np.zeros(8, int), 8) == []
    value, pattern = packing.knapsack(np.array([0.1, 0.5, 0.6]), 5)
    assert abs(value - 1.1) < 1e-12 and pattern.tolist() == [1, 2, 0] or abs(value - 1.1) < 1e-12


def test_tokenizer_agrees():
    from tokenizers import Tokenizer

    from pathloom.llm.queries import tokenizer_path

    t, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    for text in ("", " ", "Hello  world's\n\n\tÉté 日本語 12345 <|endoftext|> x", "a" * 500, "  \x00 ok"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), (None, ""), ("plain  text", "plain text"),
        ("<html><body><nav><a href=x>menu</a></nav><article><h1>T &amp; U</h1><p>One\n two <b>three</b>.<p>Four.</article><footer>f</footer></body></html>", "T & U\nOne two three.\nFour."),
        ("<body><div class='sidebar'>s</div><div><p>Long text here, many words.</p><p>More text.</p><form>q</form><div id=comments><p>c</p></div></div>", "Long text here, many words.\nMore text."),
        ("<article><p>a<script>var x='<p>no</p>';</script>b</p><!-- c --><style>p{}</style></article>", "ab"),
    ],
)
def test_html(page, want):
    assert html_density.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p class=notice>Cookies<p>Article one two.", "Article one two."),
        ("<ul><li class=share>x<li>y</ul><article><p>Text here.</p></article>", "y\nText here."),
        ("<body><div><aside>x</div><p>After.</p><p>More.</p></body>", "After.\nMore."),
        ("<body><ul><li><div class=ad>x</ul><p>After.</p></body>", "After."),
        ("<table><tr><td><form>f<label>l</td><td>Cell text</td></tr></table>", "Cell text"),
        ("<p>one<aside>x<div>y</p>z</div></aside><p>two", "one\ntwo"),
        ("<p>a</p><svg class=icon/><p>article</p><svg width=1><text>no</text></svg><p>z</p>", "a\narticle\nz"),
        ("<p>a</p><math/><p>b</p><math><mi>x</mi></math>", "a\nb"),
    ],
)
def test_html_dropped_node_ends(page, want):
    assert html_density.main_text(page) == want


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page-header-fixed", "search-results", "post social", "content-with-comments"])
def test_html_wrapper_names(name):
    inside = "<p>Long text here, many words.</p><p>More text.</p>"
    want = "Long text here, many words.\nMore text."
    side = "<div class='left sidebar'>s</div><div id=comments-area><p>c</p></div>"
    assert html_density.main_text(f"<body><div class='{name}'>{inside}{side}</div></body>") == want
    # also where the wrapper has less text than the rest of the page, unless the name is a whole one
    rest = "<div><p>" + "Other words stand here. " * 9 + "</p></div>"
    found = html_density.main_text(f"<body><div>{rest}<div class='{name}'>{inside}</div></div></body>")
    assert (want in found) == (name != "post social")


@pytest.mark.parametrize("name", ["sidebar", "main-nav", "site-footer", "cookie-notice", "ad-slot-3", "ad2", "social_share", "comment-list", "box related-posts", "SideBar"])
def test_html_boilerplate_names(name):
    assert html_density.boilerplate("div", f" class='{name}'") == "name"


def test_html_deep_and_broken():
    assert html_density.main_text("<div>" * 3000 + "deep" + "</p>" * 10) == "deep"
    assert html_density.main_text("<p <b a<<< text") is not None


def test_warc_parse():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: %d\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nA\r\n\r\nWARC/1.1\r\n\r\nB\xff"
    one = head % len(block) + block + b"\r\n\r\n"
    for data in (one * 2, gzip.compress(one) + gzip.compress(one), gzip.compress(one * 2)):
        rows = list(warc.parse(data, True))
        assert len(rows) == 2 and rows[1][-1] == b"A\r\n\r\nWARC/1.1\r\n\r\nB\xff"


def test_features_and_grams():
    for text in (None, "", " ", "a", "?" * 10, "Éa b\n\nç", "x" * 5000):
        x = quality.features(text)
        assert np.isfinite(x).all() and len(x) == len(quality.FEATURES)
        langid.gram_buckets(text, 16)
    assert len(langid.gram_buckets("123 !?", 16)) == 0 and len(langid.gram_buckets("ab", 16)) > 0


def test_class_prior():
    r = np.random.default_rng(1)
    make = lambda n, up: r.normal(2.0 if up else -2.0, 1.0, (n, len(quality.FEATURES)))
    pos, unl = make(800, True), np.concatenate([make(600, True), make(400, False)])
    assert abs(quality.class_prior(r.permutation(pos), r.permutation(unl), 3) - 0.6) < 0.12


def repeated_starts(data, length):
    seen = Counter(data[i : i + length] for i in range(len(data) - length + 1))
    return {i for i in range(len(data) - length + 1) if seen[data[i : i + length]] > 1}


@small
@given(st.lists(st.sampled_from([b"abcdefghijklmnopqrstuv", b"abcdefghijklmnopqrstuX", b"zz", b"q" * 7, bytes(range(200))]), max_size=14), st.sampled_from([1 << 20, 90]), st.sampled_from([2, 4, 8]))
def test_anchors_lose_no_string(parts, chunk, run):
    """Every start has an anchor, whatever the pieces; equal strings have the same phrases and core; those known from a period repeat."""
    data, length = b"".join(parts), 60
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, chunk
    try:
        found = suffix_dedup.whole(data, length, run)
        everything = np.full(1 << 23, 255, np.uint8)
        rows, known = suffix_dedup.tied_anchors(data, length, run, everything)
    finally:
        suffix_dedup.CHUNK = old
    if len(data) < length:
        assert found is None and not rows
        return
    at, end, first, last, phrase = found
    assert [s for a, b in zip(first, last) for s in range(a, b + 1)] == list(range(len(data) - length + 1))
    of = {}
    for i, (a, b) in enumerate(zip(first, last)):
        for s in range(a, b + 1):
            assert end[i + run - 1] <= s + length
            of.setdefault(data[s : s + length], set()).add((int(at[i]) - s, *phrase[i : i + run].tolist()))
    assert all(len(x) == 1 for x in of.values())
    want = repeated_starts(data, length)
    assert {s for a, b in known for s in range(a, b + 1)} <= want
    ranked = {s for a, b in zip(rows.get("first", ()), rows.get("last", ())) for s in range(a, b + 1)} | {s for a, b in known for s in range(a, b + 1)}
    assert want <= ranked


def neutral(page):
    """The page without the names that tell what its parts are."""
    page = re.sub(r"<(/?)(nav|footer|aside|header|article|main)\b", r"<\1div", page)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def in_divs(page):
    """The page with closed divs for its paragraphs."""
    ends = r"</?p\b|</article|</div|</main|<footer|<nav|<aside"
    page = re.sub(rf"(<p\b[^>]*>)((?:(?!{ends}).)*)(?=<p\b|</article|</div|</main|<footer|<nav|<aside)", r"\1\2</p>", page, flags=re.S)
    return re.sub(r"<(/?)p\b(?![a-z])", r"<\1div", page)


@pytest.mark.parametrize("change", [neutral, in_divs, lambda p: in_divs(neutral(p))])
def test_density_alone_finds_the_same_text(change):
    """Without names, without paragraph tags, and without both."""
    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    same = sum(html_density.main_text(p) == html_density.main_text(change(p)) for p in pages)
    assert same >= 0.98 * len(pages)


MENU = "<div><a href=/>Home</a> <a href=/about>About</a></div>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div id=content>Long text of an article.<br><br>More of its long text.</div>{MENU}", "Long text of an article.\nMore of its long text."),
        (f"<body>{MENU}<div><p>First words of it.</p><div>Bare words in a div.</div><section>And in a section.</section><p>Last words of it.</p></div></body>", "First words of it.\nBare words in a div.\nAnd in a section.\nLast words of it."),
        (f"<body>{MENU}<div>One.<p>Two, a paragraph.</p>Three <b>bold</b>.<ul><li>Four</ul>Five.</div></body>", "One.\nTwo, a paragraph.\nThree bold.\nFour\nFive."),
        (f"<body>{MENU}<span><div>Words in a block.</div><div>Inside a span.</div></span></body>", "Words in a block.\nInside a span."),
        (f"<body>{MENU}<div><section><p>Part one has words.</p><p>And more words.</p></section><section><p>Part two has words.</p><p>And still more.</p></section></div></body>", "Part one has words.\nAnd more words.\nPart two has words.\nAnd still more."),
    ],
)
def test_own_text_counts(page, want):
    assert html_density.main_text(page) == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<b>" * 30_000 + "<p>x" * 30_000, "<!--" * 200_000, "<a x' " * 150_000 + ">", "<svg>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, '<a "' * 200_000 + ">", "<div class='ad'>x" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_density.main_text(page)
    assert time.time() - began < 5


@small
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=40))
def test_matches_followed_place_by_place(a, b):
    """The same maximal matches as a list of all gives."""
    a, b, k = np.array(a, np.uint64), np.array(b, np.uint64), 3
    if len(a) < k or len(b) < k:
        return
    want = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= k and not (i and j and a[i - 1] == b[j - 1]):
                want.add((n, i, j))
    x, y = common.gram_hashes(a, k), common.gram_hashes(b, k)
    order = np.argsort(y, kind="stable")
    got = tiling._followed(np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right"), order, k)
    assert set(zip(*(g.tolist() for g in got))) == want


def test_tiles_of_repetitive_texts():
    began = time.time()
    found = tiling.tiles(np.full(500, 7, np.uint64), np.full(20_000, 7, np.uint64), 5)
    assert found == [(0, 0, 500)] or sum(t[2] for t in found) == 500
    assert time.time() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    from pathloom.llm.queries import tokenizer_path

    text = text.encode("utf-8", "ignore").decode()
    if "slow" not in globals():
        globals()["slow"] = Tokenizer.from_file(tokenizer_path())
    assert list(packing.encoder(tokenizer_path())(text)) == slow.encode(text, add_special_tokens=False).ids  # noqa: F821
