"""Tokens, fingerprints, licences, page text."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortspark.llm import bpe, html, licenses, merkle

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PEER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = [bpe.Codec(RANKS, public_tokenizers.PATTERN, leaf, short) for leaf, short in ((1, 2), (3, 4), (7, 48), (8192, 48))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'", "s", "'ll", "re", "é", "ß", "😀", "1", ".", "ing", "aaaaaaaa", "　", "x" * 60]), max_size=40))
def test_ids_equal_the_tiktoken_library(parts):
    text = "".join(parts)
    want = PEER.encode_ordinary(text)
    for codec in SMALL:
        assert codec.encode(text) == want and codec.decode(want) == text.encode()


def test_join_is_associative():
    rnd = random.Random(3)
    codec = SMALL[0]
    for _ in range(200):
        text = "".join(rnd.choice(["ab", " ", "'re", "\n ", "q", "é1"]) for _ in range(30))
        a, b = sorted(rnd.sample(range(1, len(text)), 2))
        x, y, z = (codec.encode_span(text, *p) for p in ((0, a), (a, b), (b, len(text))))
        assert codec.join(text, codec.join(text, x, y), z).ids == codec.join(text, x, codec.join(text, y, z)).ids == PEER.encode_ordinary(text)


def test_long_pieces():
    for piece in ("a" * 5001, "abcdefghij" * 300, "".join(random.Random(1).choices("etaoin", k=4000))):
        assert SMALL[3].encode(piece) == PEER.encode_ordinary(piece)


def test_codecs_go_by_content():
    """A second vocabulary under the same address or pattern never gets the first one's ids."""

    class Shared:
        def __init__(self, value):
            self.value = value

    one, two = {bytes([b]): b for b in range(256)}, {bytes([b]): 255 - b for b in range(256)}
    names = [bpe._digest(v, ".+") for v in (one, two, dict(reversed(one.items())))]
    assert names[0] == names[2] != names[1] != bpe._digest(two, ".")
    for name, ranks in zip(names, (one, two)):
        assert bpe._codec(name, Shared(ranks), ".+").encode("ab") == [ranks[b"a"], ranks[b"b"]]


def test_bpe_query_and_tables(odd_docs, no_docs):
    got = bpe.round_trip(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    ids = lambda t: np.asarray(PEER.encode_ordinary(t), "<u4").tobytes()
    want = [(r.doc_id, len(ids(r.text or "")) // 4, hashlib.sha256(ids(r.text or "")).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect()]
    assert Counter(map(tuple, got)) == Counter(want)
    tokens = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect())
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def edited(rows):
    """doc_id -> digest of the edited text, for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        out[i] = hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
    return out


def test_fingerprints(spark, texts):
    rows = merkle.op8_merkle_fingerprints(spark, "/root/testdata/sf0.001").collect()
    want = edited([(i, t or "") for i, t in texts.items()])
    assert {r.doc_id: r.edited_sha256 for r in rows} == want
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint and r.n_chars == len(texts[r.doc_id])
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    assert np.median([r.near_edited for r in rows]) > 0.5 > 0.2 > np.median([r.near_next for r in rows])


def test_fingerprints_differ_by_white_space_only(spark):
    x = spark.createDataFrame([("a b\nc",), ("a  b\nc",), ("a b\n\nc",), ("a b c",), ("",)], "t string")
    assert x.select(merkle.fingerprint(F.col("t"))).distinct().count() == 5


def test_fingerprint_cases(spark, odd_docs, no_docs):
    rows = merkle.fingerprints(odd_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert merkle.fingerprints(no_docs).collect() == []
    one = merkle.fingerprints(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    wide = [(i * 10**14 - 5 * 10**17, f"text {i} " * (i % 5)) for i in range(300)]
    got = merkle.fingerprints(spark.createDataFrame(wide, "doc_id long, text string")).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == edited(wide)


def passages_brute(text):
    white, out, words, at = " \t\n\x0b\x0c\r", "", [], 0
    text = text.encode().decode("latin-1")
    for i in range(1, len(text)):
        gap = text[i - 1] in white and text[i] not in white
        run = i >= 16 and ord(text[i - 1]) % 16 == 7 and not set(text[i - 16 : i]) & set(white)
        if gap or run:
            words.append(text[at:i])
            at = i
    for w in [*words, text[at:]]:
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        h -= (1 << 64) * (h >> 63)
        out += w + ("\0\0" if w[-1:] not in white or h % merkle.PASSAGE_WORDS == 0 else "")
    return {xxhash.xxh64(p.encode(), seed=42).intdigest() % (1 << 32) for p in out.replace("\n", "\0\0").split("\0\0")} - {xxhash.xxh64(b"", seed=42).intdigest() % (1 << 32)}


def test_exact_likeness(spark, texts):
    han = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(300))
    one = "\n".join(f"tok{i}e" for i in range(60))
    pairs = [(t, u) for t, u in zip(list(texts.values())[:80], list(texts.values())[1:81])]
    pairs = [(t or "", (t or "")[: len(t or "") // 2] + (u or "")[:300]) for t, u in pairs] + [(t or "", u or "") for t, u in pairs]
    pairs += [("", "x"), ("", ""), ("one", "two"), ("a. ", "b. "), (han, han[:200] + "x" + han[200:]), (one, one.replace("tok9e", "new"))]
    rows = spark.createDataFrame(pairs, "t string, u string")
    got = rows.select("t", "u", merkle.likeness(merkle.fingerprint(F.col("t")), merkle.fingerprint(F.col("u"))).alias("s")).collect()
    for r in got:
        a, b = passages_brute(r.t), passages_brute(r.u)
        assert r.s == (1.0 if r.t == r.u else len(a & b) / max(len(a), len(b))), (r.t, r.u)
    share = {(r.t, r.u): r.s for r in got}
    assert share["one", "two"] == share["a. ", "b. "] == share["", "x"] == 0
    assert share[pairs[-2]] > 0.8 and share[pairs[-1]] > 0.9


def test_disjoint_texts_are_not_near(spark):
    rows = [(2, "alpha beta"), (1, "gamma\ndelta epsilon, zeta")]
    assert [r.near_next for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]


def test_successors_over_many_blocks(spark):
    ids = [3, 9, 10, 11, 500, 10**6, -4, merkle.NO_ID]
    for blocks in (1, 3, 20):
        got = {r.key: r.next_key for r in merkle.successors(spark.createDataFrame([(i,) for i in [*ids, 3, 9]], "key long"), blocks).collect()}
        order = sorted(ids, reverse=True)
        assert got == dict(zip(order, order[1:] + order[:1]))


def test_successor_blocks_stay_even_with_an_outlier(spark):
    """20,000 dense ids and one far away: no block holds more than twice the mean."""
    ids = spark.range(20_000).select(F.col("id").alias("key")).union(spark.sql("SELECT 4611686018427387904L AS key"))
    found = merkle.successors(ids, 8)
    assert found.filter("next_key <> key - 1").count() == 2  # below the outlier, and round again
    blocks = [r["count"] for r in ids.distinct().repartitionByRange(8, "key").groupBy(F.spark_partition_id()).count().collect()]
    assert max(blocks) <= 2 * 20_001 / 8


def test_differing_branches(spark):
    x = spark.createDataFrame([("a\nb\nc", "a\nX\nc")], "t string, u string")
    got = x.select(merkle.changed_paragraphs(merkle.paragraph_digests(F.col("t")), merkle.paragraph_digests(F.col("u"))).alias("i")).first()
    assert got.i == [1]
    tree = merkle.tree(x, "t").first().merkle
    assert len(tree.paragraphs) == 3 and tree.paragraphs[0] == hashlib.sha256(b"a").hexdigest()


def unlike_brute(a, b):
    """(at of a, at of b) of sequences of (digest, at)."""
    rest_a, rest_b = Counter(d for d, _ in a) - Counter(d for d, _ in b), Counter(d for d, _ in b) - Counter(d for d, _ in a)

    def split(side, rest):
        lone, kept, left = [], [], {d: n for d, n in Counter(d for d, _ in side).items()}
        for d, at in reversed(side):  # the last copies are those without a partner
            if rest[d] > 0:
                rest[d] -= 1
                lone.append(at)
            else:
                kept.append((d, at))
        return lone, kept[::-1]

    (lone_a, kept_a), (lone_b, kept_b) = split(a, rest_a), split(b, rest_b)
    off = [(x[1], y[1]) for x, y in zip(kept_a, kept_b) if x[0] != y[0]]
    return sorted(lone_a + [x for x, _ in off]), sorted(lone_b + [y for _, y in off])


def branches_brute(t, u):
    def tree(text):
        parts, leaves = [[]], [hashlib.sha256(p.encode()).hexdigest() for p in text.split("\n")]
        for i, d in enumerate(leaves):
            parts[-1].append((d, i))
            if d[0] in "0123" and i < len(leaves) - 1:
                parts.append([])
        return parts

    x, y = tree(t), tree(u)
    whole = lambda parts: [(tuple(d for d, _ in p), i) for i, p in enumerate(parts)]
    s, v = unlike_brute(whole(x), whole(y))
    p, q = unlike_brute([e for i in s for e in x[i]], [e for i in v for e in y[i]])
    return s, p, v, q


def test_branches_against_brute_force(spark, texts):
    rnd = random.Random(4)
    pairs = [("a\nb\nc", "a\nX\nc"), ("a\nb", "b\na"), ("a\na\nb", "a\nb"), ("a\nb", "a\nb\nb"), ("a\nb\nc", "a\nc"), ("", ""), ("", "\n"), ("x", "")]
    for _ in range(300):
        lines = [rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(1, 25))]
        other = list(lines)
        for _ in range(rnd.randrange(4)):
            i, j = rnd.randrange(len(other) + 1), rnd.randrange(len(other) + 1)
            other = rnd.choice([other[:i] + other[i + 1 :], other[:i] + ["new"] + other[i:], other[:i] + other[j : j + 3] + other[i:], other[::-1] if i == j else other])
        pairs.append(("\n".join(lines), "\n".join(other)))
    pairs += [(t or "", (u or "")[:500] + (t or "")) for t, u in zip(list(texts.values())[:30], list(texts.values())[1:31])]
    rows = spark.createDataFrame(pairs, "t string, u string")
    both = merkle.differing_branches(merkle.paragraph_digests(F.col("t")), merkle.paragraph_digests(F.col("u"))).alias("d")
    for r in rows.select("t", "u", both).collect():
        d = r.d
        assert (d.a_sections, d.a_paragraphs, d.b_sections, d.b_paragraphs) == branches_brute(r.t, r.u), (r.t, r.u)
        assert (r.t == r.u) == (not d.a_paragraphs + d.b_paragraphs) == (not d.a_sections + d.b_sections)


def test_query_gives_branches(spark):
    rows = merkle.fingerprints(spark.createDataFrame([(2, "a\nb\nc\nd\ne\nf"), (1, "x\ny\nz\n\n\n")], "doc_id long, text string")).collect()
    for r in rows:
        assert r.differing.a_paragraphs + r.differing.b_paragraphs and r.fingerprint != r.edited_fingerprint
        assert min(r.differing.a_paragraphs) >= 3  # the kept two thirds do not differ


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_brute(text):
    words = WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "General", "Public", "License", "apache", "MIT", "mit", "CC", "by", "é", "\n", " ", "-", ", ", "_", "x"]), max_size=40))
def test_base_places(parts):
    text = "".join(parts) + " " + " ".join(parts)
    got = SCANNER.scan(text)
    want = base_brute(text)
    assert got[:5] == want and set(want[4].split(",")) <= set(got[5].split(",")) and 0 <= got[6] <= 1


SCANNER = licenses.Scanner()


def test_rules():
    assert len(SCANNER.rules) > 300
    assert SCANNER.scan("Licensed under the Apache License, Version 2.0.")[4:6] == ("apache", "apache,apache-2.0")
    assert SCANNER.scan("under CC BY-NC 4.0")[5] == "cc-by,cc-by-nc-4.0"
    assert SCANNER.scan("SPDX-License-Identifier: BSD-3-Clause")[5:] == ("bsd-3-clause", 1.0)
    assert SCANNER.scan("the zlib/libpng  license")[5] == "zlib"
    for rule in SCANNER.rules:  # a match always holds the keyword that gates it
        assert re.fullmatch(rb"[a-z0-9]+", rule.keyword)


@pytest.mark.parametrize(
    "name,label",
    [
        ("Creative Commons Attribution 4.0 International", "cc-by-4.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("Creative Commons Attribution-Share Alike 3.0 Unported", "cc-by-sa-3.0"),
        ("Creative Commons Attribution-NoDerivs 2.0 Generic", "cc-by-nd-2.0"),
        ("Creative Commons Attribution-NoDerivatives 4.0 International", "cc-by-nd-4.0"),
        ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc-4.0"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa-4.0"),
        ("Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported", "cc-by-nc-nd-3.0"),
        ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "cc-by-nc-nd-4.0"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("the Beerware License", "beerware"),
        ("THE BEER-WARE LICENSE", "beerware"),
        ("BigCode OpenRAIL-M", "bigcode-openrail-m"),
        ("BigScience Open RAIL-M License", "bigcode-openrail-m"),
    ],
)
def test_official_names(name, label):
    assert SCANNER.scan(f"See {name}.")[5] == label


def test_gate_hides_no_match():
    """Every rule, run on texts without the gate, finds nothing that the gate would miss."""
    texts = [n.replace("[sc]", "c") for line in licenses.SIGNATURES.splitlines() for n in licenses._fields(line)[1].split(";")]
    for text in texts:
        for variant in {re.sub(r"\([^()]*\)\?", "", text), re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", text), re.sub(r"\((?:[^()]*\|)?([^()|]*)\)\??", r"\1", text)}:
            low = re.sub(r"(.)\?", r"\1", variant).strip().encode()
            for rule in SCANNER.rules:
                assert not rule.pattern.search(low) or rule.keyword in low, (rule, low)


def test_suppression():
    found = [(0, 20, 3, "wide"), (5, 10, 3, "inner"), (5, 10, 4, "strong"), (15, 25, 3, "over"), (0, 20, 2, "weak")]
    assert [f[3] for f in licenses.survivors(found)] == ["wide", "strong", "over"]


def test_license_cases(odd_docs, no_docs):
    rows = licenses.license_scan(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base) for r in rows) == Counter((r.doc_id, *base_brute(r.text or "")[:2]) for r in odd_docs.collect())
    assert licenses.license_scan(no_docs).collect() == []


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(b for b in blocks if b)


def test_page_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = html.op10_max_subsequence_html(spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: r.text for r in rows} == {i: article(p) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


PAGE = """<html><head><title>x</title><body class="page"><header><a href=/>Home</a> Site</header><div id=cookie-notice>We use cookies</div>
<div class="sidebar"><p>side words here</p></div><div class=content><h2>Head &amp; line</h2><p>First  para<br>second line<p>More <b>bold</b>&nbsp;text
<ul><li>one<li>two</ul><form><input>name</form><div class="ad-box">buy</div><p>Last</div><section class="comments"><p>nice post by a reader yes</p></section>
<footer>c 2020</footer></body></html>"""


def test_region_without_article():
    assert html.extract(PAGE, dict(html.DEFAULT_WEIGHTS)) == "Head & line\nFirst para\nsecond line\nMore bold text\none\ntwo\nLast"


@pytest.mark.parametrize(
    "page,text",
    [("", ""), ("plain", "plain"), ("a < b", "a < b"), ("<script>x", ""), ("<p>a<script>var t='</p>';</script>b", "ab"), ("&lt;p&gt;", "<p>"), ("<p title='a>b'>hi</p", "hi"), ("<nav>only</nav>", ""), ("<!-- <p>x -->", "")],
)
def test_broken_pages(page, text):
    assert html.extract(page, dict(html.DEFAULT_WEIGHTS)) == text


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><p>Body text of the page goes on</p>",
        "<head><title>T</title><style>p {}</style>Body text of the page goes on",
        "<head><link rel=x><div><p>Body text of the page goes on</div>",
    ],
)
def test_unclosed_head_hides_nothing(page):
    assert html.extract(page, dict(html.DEFAULT_WEIGHTS)) == "Body text of the page goes on"


@pytest.mark.parametrize(
    "names,boiler",
    [
        ("social-science", False), ("menu-recipe", False), ("cookie-history", False), ("lead", False), ("market-share", False), ("adventure", False), ("", False),
        ("social-links", True), ("cookie-notice", True), ("ad ad-slot-3", True), ("siteHeader", True), ("post sidebar-left", True), ("comment-list", True), ("x newsletter", True),
    ],
)
def test_names_of_boilerplate(names, boiler):
    assert html.names_boiler(names) is boiler
    page = f"<article><p>First words of it</p><div class='{names}'><p>The inner paragraph</p></div><p>Last words of it</p></article>"
    assert html.extract(page, dict(html.DEFAULT_WEIGHTS)) == "First words of it\n" + "The inner paragraph\n" * (not boiler) + "Last words of it"


def test_unspaced_words():
    assert [html.n_words(t) for t in ("", "two words", "\u5929\u5730\u7384\u9ec4 a", "na\u00efve")] == [0, 2, 4, 1]


def test_class_names_are_learned(spark):
    """Pages that mark their article teach a class name of the rest; it then is cut out of unmarked pages, wherever its own sum is negative."""
    rest = "<div class=zq><p>outside words of little use</p></div>"
    marked = [(i, "u", f"<div class=wrap>{rest}<article><p>Story number {i} goes on</p><p class=lede>and on</p></article>{rest}</div>") for i in range(html.CLASS_PAGES)]
    few = [(100, "u", "<div class=rare><p>seen once</p></div><article><p>words</p></article>")]
    pages = spark.createDataFrame(marked + few, "page_id long, url string, html string")
    weights = html.fit_weights(pages)
    plain = html.weights_from(sum((html.labelled_counts(p[2]) for p in marked + few), Counter()))
    assert weights == {k: v for k, v in plain.items() if k != "c:rare"}
    assert weights["c:zq"] < -2 and "c:rare" not in weights and "c:lede" not in weights and abs(weights["c:wrap"]) < 0.2
    story = "<p>First words of the story itself</p>"
    page = f"<div class=wrap>{story}<div class=zq><p>to be cut here</p></div>{story}</div>"
    assert html.extract(page, weights) == "\n".join(["First words of the story itself"] * 2)
    # the name alone does not decide inside a marked article, nor over a marked article within
    assert "to be kept" in html.extract(f"<article>{story}<div class=zq><p>to be kept</p></div></article>", weights)
    assert html.extract(f"<div class=zq><article>{story}</article></div>", weights) == "First words of the story itself"


def test_cut_out_by_brute_force():
    """The nested sums against a recursive definition over random trees."""
    rnd = random.Random(5)
    weights = dict(html.DEFAULT_WEIGHTS, **{"c:a": -4.0, "c:b": -1.0, "c:c": 2.0})

    def make(depth: int) -> str:
        inner = "".join(make(depth - 1) if depth and rnd.random() < 0.5 else f"<p>{'w ' * rnd.randint(1, 6)}</p>" for _ in range(rnd.randint(1, 4)))
        return f"<div class={rnd.choice('abcd')}>{inner}</div>"

    for _ in range(60):
        parents = [0]
        parts = list(html.tokens(make(4), parents))

        def total(i: int) -> float:
            own = sum(html.score(t, weights) for t in parts if t.element == i)
            return own + sum(total(j) for j in range(1, len(parents)) if parents[j] == i and not gone(j))

        def gone(i: int) -> bool:
            return total(i) < 0 and any(weights.get(f"c:{n}", 0.0) < 0 for t in parts if t.element == i for n in t.classes)

        def dropped(i: int) -> bool:
            return i > 0 and (gone(i) or dropped(parents[i]))

        want = [dropped(t.element) for t in parts]
        html.cut_out(parts, parents, weights)
        assert [t.boiler for t in parts] == want


def test_best_region():
    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.randint(-5, 5) for _ in range(rnd.randint(0, 12))]
        lo, hi = html.best_region(s)
        assert sum(s[lo:hi]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_page_cases(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x y"), (3, "u", "<p>" * 3000 + "deep"), (4, "u", "<p>" + "w " * 50_000)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = html.main_text(pages, html.fit_weights(pages)).collect()
    assert Counter((r.page_id, r.n_chars) for r in got) == Counter({(1, 0): 2, (None, 3): 1, (3, 4): 1, (4, 99_999): 1})
    assert html.main_text(pages.limit(0), html.fit_weights(pages.limit(0))).collect() == []
