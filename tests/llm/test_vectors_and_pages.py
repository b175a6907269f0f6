"""Centroid clustering, importance resampling and page text against plain versions, on odd rows and on planted cases."""

import hashlib
import math
import random
import re
from html import unescape
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from plantlens.llm import centroids, common, html_text, resampling


# Centroids ----------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, salt="2:"):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e)]
    means = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(means)), key=lambda c: (far(v, means[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v), []).append(v)
        means = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(means)]
    return sorted(((i is None, i or 0), place(v), far(v, means[place(v)])) for i, v in kept), means


def got_clusters(df, k, rounds):
    rows, means = centroids.clustered(df, components=4, k=k, rounds=rounds)
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in rows.collect()), means


@pytest.mark.parametrize("k, rounds", [(5, 5), (40, 3), (3, 0)])
def test_centroids_equal_plain_rounds(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(4)]) for i in range(120)] + [(1000 + i, [0.5] * 4) for i in range(60)]
    assert got_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), k, rounds) == plain_clusters([(i, [common_float(x) for x in e]) for i, e in rows], k, rounds)


def common_float(x):
    import numpy as np

    return float(np.float32(x))


def test_centroids_of_odd_vectors(spark):
    ok = [0.5, 0.25, -0.125, 1.0]
    rows = [(1, ok), (1, ok), (2, None), (3, []), (4, ok[:3]), (5, [*ok[:3], None]), (6, [*ok[:3], float("nan")]), (7, [*ok[:3], float("inf")]), (None, ok), (8, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "dots", "cluster", "distance")})
    assert got_clusters(df, 40, 5) == plain_clusters(rows, 40, 5)
    assert centroids.report(df.limit(0)).count() == 0
    assert centroids.report(df.where("vec_id in (2, 3, 4)"), components=4).count() == 0
    text_ids = df.select(F.concat(F.lit("v"), F.col("vec_id")).alias("vec_id"), "embedding")
    assert {r["vec_id"] for r in centroids.report(text_ids, components=4).collect()} == {"v1", "v8", None}
    with pytest.raises(Exception, match="after scaling"):
        centroids.report(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>"), components=4).count()


def test_products_stay_exact_beyond_doubles():
    import numpy as np

    columns, change = np.array([[2.0**26, 3.0], [1.0, 2.0**26]]), np.array([2**27 + 1, 3], dtype=np.int64)
    assert centroids.exact_products(columns, 2**26, change).tolist() == [2**26 * (2**27 + 1) + 3, 3 * (2**27 + 1) + 3 * 2**26]
    small = np.array([[5.0, 3.0], [1.0, 7.0]])
    assert centroids.exact_products(small, 7, change).tolist() == centroids.exact_products(small, 2**40, change).tolist()


def test_only_moved_components_are_read():
    moves = centroids.changes([[1, 2, 3], [4, 5, 6]], [[1, 2, 3], [4, 7, 6]])
    assert [(c, j.tolist(), d.tolist()) for c, j, d in moves] == [(1, [1], [2])]


# Resampling ---------------------------------------------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def plain_grams(text, longest=2):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_prefix_crcs_give_every_gram(longest):
    rng = random.Random(longest)
    texts = [None, "", " .,!", "one", "One two", "É ñandú 漢字 x"] + [" ".join("".join(rng.choice("abcXYZ09éß") for _ in range(rng.choice([1, 3, 9, 300]))) for _ in range(rng.randrange(40))) for _ in range(30)]
    n, n_features, found = resampling.hashed(texts, longest, 10_000)
    assert n.tolist() == [len(plain_words(t)) for t in texts] and found.tolist() == [crc32(g.encode()) % 10_000 for t in texts for g in plain_grams(t, longest)]
    assert n_features.tolist() == [len(plain_grams(t, longest)) for t in texts]


def test_shift_is_the_crc_of_zero_bytes():
    import numpy as np

    for length in (0, 1, 7, 300, 70_000):
        a, b = b"some prefix", b"z" * length
        assert int(resampling.shifted(np.array([crc32(a)], dtype=np.uint32), np.array([length]))[0]) ^ crc32(b) == crc32(a + b)


def plain_resampling(docs, target):
    count = lambda texts: __import__("collections").Counter(crc32(g.encode()) % 10_000 for t in texts for g in plain_grams(t))
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in (crc32(g.encode()) % 10_000 for g in plain_grams(text))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    order = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 25 * len(order) // 100])}
    return sorted(((r[0] is not None, r[0] or 0), r[1], r[2], r[3], rank.get(id(r), 0)) for r in out)


def got_resampling(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in df.collect())


def test_resampling_equals_plain_version(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("red green blue Cyan pink grün x1 y2".split()) for _ in range(rng.randrange(45)))
    docs = [(i, text()) for i in range(150)] + [(200, None), (201, ""), (None, text()), (202, "w " * 5000), (203, "twice " * 30), (203, "twice " * 30), (204, "é" * 9000)]
    target = ["red Red green blue", None, "x1 y2 " * 9]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("n_words", "buckets", "weight", "score", "rank", "k0")})
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got_resampling(resampling.report(df, goal)) == plain_resampling(docs, target)
    assert resampling.report(df.limit(0), goal).count() == 0
    assert got_resampling(resampling.report(df, goal.limit(0))) == plain_resampling(docs, [])
    kept = resampling.resampled(df, goal)
    assert kept.columns == df.columns and kept.count() == sum(r[4] > 0 for r in plain_resampling(docs, target) if r[0][0])


def test_draw_prefers_the_target(spark):
    docs = [(i, ("apple pear plum " if i % 2 else "bolt screw nut ") * 10) for i in range(400)]
    goal = spark.createDataFrame([(1, "apple pear plum " * 400)], "item_id long, text string")
    got = resampling.report(spark.createDataFrame(docs, "doc_id long, text string"), goal).where("rank is not null").collect()
    assert len(got) == 100 and sum(r["doc_id"] % 2 for r in got) > 90 and sorted(r["rank"] for r in got) == list(range(1, 101))


# Page text ----------------------------------------------------------------------------------------------------------

SENTENCE = "This is a plain sentence of the article with quite a number of words in it. "


def page(body, attributes=""):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body {attributes}>{body}</body></html>"


def paragraphs(n):
    return [f"{k} {SENTENCE * 3}".strip() for k in range(n)]


def as_html(items):
    return "".join(f"<p>{x}</p>" for x in items)


BESIDE = {
    "menu": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>Other</a></ul></nav>",
    "menu by class": "<div class='main-menu'><a href=/a>Home</a> of the site</div>",
    "page header": "<header><h2>Site name</h2><p>Its motto, which is long enough to look like text of an article, at least a little.</p></header>",
    "footer": "<footer><p>All rights reserved by the people who wrote this page and own the site, since long ago.</p></footer>",
    "sidebar": f"<div id=sidebarLeft><p>{SENTENCE}</p></div>",
    "aside": f"<aside><p>{SENTENCE * 4}</p></aside>",
    "notice": f"<div role=alert><p>{SENTENCE}</p></div><div class=cookie-notice>{SENTENCE}</div>",
    "advert": f"<div class='box ad'>{SENTENCE}</div><p class=sponsored>{SENTENCE}</p>",
    "form": f"<form><p>{SENTENCE}</p><input><select><option>{SENTENCE}</select></form>",
    "script": "<script>if (a < b) { document.write('<p>no</p>') }</script><noscript>Switch it on</noscript>",
    "comments": f"<section id=comments>{as_html([SENTENCE * 8] * 4)}</section><div class=comment-list><article class=comment>{SENTENCE * 9}</article></div>",
    "hidden": f"<div style='display: none'>{SENTENCE}</div><p hidden>{SENTENCE}</p><!-- {SENTENCE} <p> -->",
    "links": "<div class=x><ul>" + "<li><a href=/x>A rather long link to some other story of the day</a></li>" * 8 + "</ul></div>",
}


@pytest.mark.parametrize("kind", sorted(BESIDE))
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<table><tr><td>{}</td></tr></table>"])
def test_what_is_beside_the_article_goes(kind, wrap):
    items = paragraphs(4)
    inner = "<h1>A title</h1>" + as_html(items)
    want = "\n\n".join(["A title", *items])
    assert html_text.main_text(page(BESIDE[kind] + wrap.format(inner), "class=has-sidebar")) == want
    assert html_text.main_text(page(wrap.format(inner) + BESIDE[kind])) == want
    if kind not in ("links", "page header"):
        assert html_text.main_text(page(wrap.format("<h1>A title</h1>" + as_html(items[:2]) + BESIDE[kind] + as_html(items[2:])))) == want


def test_blocks_and_references():
    got = html_text.main_text(page("<article><h1>A &amp; B</h1>  <p>x &lt;y&gt;\n\t z&nbsp;&eacute;&#233;&#x41; &bogus; <b>bo</b>ld<br>next<p>unclosed<ul><li>one<li>two <i>2</i></ul><table><tr><td>a<td>b<tr><th>c</table><pre>p\n  q</pre>tail<div>in</div>out</article>"))
    assert got.split("\n\n") == ["A & B", "x <y> z ééA &bogus; bold next", "unclosed", "one", "two 2", "a b", "c", "p q", "tail", "in", "out"]


def test_title_outside_the_densest_element_is_found():
    items = paragraphs(5)
    assert html_text.main_text(page(f"<div class=post><h1>A title</h1><div class=body>{as_html(items)}</div></div>")).split("\n\n") == ["A title", *items]


def test_branches_over_the_threshold_belong_to_the_article():
    items = paragraphs(6)
    short = "<div><p>A few</p><p>short</p><p>lines</p></div>"
    got = html_text.main_text(page(f"<div>{as_html(items[:4])}</div>{short}<div>{as_html(items[4:])}</div>")).split("\n\n")
    assert got == items


@pytest.mark.parametrize("html", [None, "", " \n", "<", "<p", "<!-- open", "<script>open", "<a href='open", "</p></div>", "<nav><p>only a menu</p></nav>", "<article></article>", "<html><head><title>t</title></head></html>"])
def test_pages_without_text(html):
    assert html_text.main_text(html) in ("", "<")


def test_broken_and_tiny_pages():
    assert html_text.main_text("a") == "a" and html_text.main_text("plain text") == "plain text"
    assert html_text.main_text('<p class="x>one</p><p>two</p>') == "one\n\ntwo"
    assert html_text.main_text("<p>a < b and c<d>e</p>") == "a < b and ce"


def plain_density(tree, share):
    """(density, characters, tags, link characters, link tags) of (name, children) or a text, by definition."""

    def walk(x, linked):
        if isinstance(x, str):
            c = len("".join(x.split()))
            return c, 0, c * linked, 0
        parts = [walk(y, linked or x[0] == "a") for y in x[1]]
        below = [sum(p[k] for p in parts) for k in range(4)]
        return below[0], below[1] + sum(not isinstance(y, str) for y in x[1]), below[2], below[3] + sum(not isinstance(y, str) and y[0] == "a" for y in x[1])

    def density(x, linked=False):
        c, t, lc, lt = walk(x, linked)
        if not c:
            return 0.0
        one = lambda n: n or 1
        return c / one(t) * math.log(c / one(lc) * one(t) / one(lt), math.log(c / one(c - lc) * one(lc) + share(walk) * c + math.e))

    return density


def test_densities_follow_the_definition():
    rng = random.Random(3)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 30))) + "z"
        return (rng.choice(["div", "b", "a", "section", "i"]), [y for k in range(rng.randrange(1, 4)) for y in ([made(depth - 1)] if k % 2 == 0 else [("b", ["x"])])])

    def written(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(written, x[1]))}</{x[0]}>"

    for _ in range(40):
        tree = ("html", [made(4), ("div", ["end"])])
        p = html_text.Page("".join(map(written, tree[1])))
        density, sums, chars = html_text.densities(p, [True] * len(p.names))
        total = lambda walk: (lambda w: w[2] / max(1, w[0]))(walk(tree, False))
        by_definition = plain_density(tree, total)
        flat, stack = [], [(tree, False)]
        while stack:
            x, linked = stack.pop()
            flat.append((x, linked))
            if not isinstance(x, str):
                stack += [(y, linked or x[0] == "a") for y in reversed(x[1])]
        assert len(flat) == len(density)
        for (x, linked), d, s in zip(flat, density, sums, strict=True):
            assert d == pytest.approx(by_definition(x, linked))
            if not isinstance(x, str):
                assert s == pytest.approx(sum(by_definition(y, linked or x[0] == "a") for y in x[1]))


def test_every_test_page_gives_its_article(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in html_text.report(pages).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_page_rows_are_whole(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x y</p>"), (2, "u", "<p>x y</p>"), (3, "u", "<p>long word</p>" * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "c0", "n_chars", "c")})
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.report(df).collect())
    assert [t for _, t in got] == ["", "", "x y", "x y", "\n\n".join(["long word"] * 30_000)]
    assert html_text.report(df.limit(0)).count() == 0
    assert html_text.extracted(df).columns == [c for c in df.columns if c != "text"] + ["text"]


@pytest.mark.parametrize("piece", ["<div>", '<a "', "<b><li>", '<p class="x', "<!--", "<script>", "</div>", "<", "<a b='c", "<p>x", "<p                              "])
def test_reading_takes_time_in_proportion(piece):
    import time

    def took(n):
        start = time.perf_counter()
        html_text.main_text(piece * n)
        return time.perf_counter() - start

    took(2000)
    assert took(64_000) < 60 * max(took(8000), 0.01)
