import collections
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import empty_like, messy_docs  # noqa: E402

from tidemark.llm import ann, html_extract, license_scan, quality, shard_pack, url_filter  # noqa: E402


# URL filter

def brute_verdict(url, rules, unwanted):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]

    def fits(key):
        h, p = key.split("/", 1)
        return host != "" and (host == h or host.endswith("." + h)) and path.startswith("/" + p)
    hit = sorted((k for k in rules if fits(k)), key=lambda k: (len(k), k))
    rule = hit[-1] if hit else None
    listed = any(fits(k) for k in unwanted)
    return host, path, rule, rules[rule] if rule else ("block" if listed else "allow")


URLS = [None, "", "no scheme", "http://", "http://net/", "http://a.net", "http://A.Example.NET/en/x?q=/de/", "x://example.net/en",
        "http://example.com/de/", "http://m.example.com/de/a#b", "http://example.com/deep/", "https://w.org/fr/", "http://org/fr",
        "http://notorg/fr/", "http://free-bets.example.com/x", "http://free-bets.example.com?x", "a://b://c.net/", "http://x.net/\nen",
        "http://.net/", "http://net./x", "HTTP://ÉX.org/fr/é", "http://" + "a." * 300 + "net/" + "y" * 5000]


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, 1, "k", "r") for i, u in enumerate(URLS + URLS[:4])],
                                  "page_id bigint, url string, key int, rule string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {i: brute_verdict(u, url_filter.RULES, url_filter.UNWANTED_HOSTS) for i, u in enumerate(URLS + URLS[:4])}
    assert url_filter.filter_urls(empty_like(pages)).count() == 0
    none = url_filter.filter_urls(pages, {}, ()).select("verdict").distinct().collect()
    assert [r[0] for r in none] == ["allow"]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.xxhash64("key") % 10 == 0)
    c = url_filter.build_cascade(listed, universe)
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()} and len(c.levels) >= 3
    assert sum(lv.bits for lv in c.levels) < 20 * listed.count()


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = url_filter.filter_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan and "Exchange" not in plan


# HTML

PAGES = [
    (None, ""), ("", ""), ("plain text", None), ("<p>", ""),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">"
     "Buy now.</div><article><h1>Head &amp; line</h1><p>First   part,<br>with <b>bold</b> text &lt;x&gt;.<p>Second\n part &copy; "
     "it.</article><footer>&copy; all</footer></body></html>", "Head & line First part, with bold text <x>. Second part © it."),
    ("<html><body><header><h1>Site name</h1></header><div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Real head"
     "</h1><p>Real text of the article, long enough to be read.</p><div class='ad banner'>Advert here</div><p>More of it.</p>"
     "<script>if (a < b) { x('</p>') }</script></article><aside class='sidebar'><p>Other links of the site.</p></aside>"
     "<section class='comments'><p>A reader wrote this comment.</p></section><form><label>Mail</label><button>Go</button></form>"
     "<footer>The end</footer></body></html>",
     "Real head Real text of the article, long enough to be read. More of it."),
]


def test_main_text_of_known_pages(spark):
    rows = [(i, f"http://x/{i}", h, 1, "n") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[4][0], 1, "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, block int, text string")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    for i, (_, want) in enumerate(PAGES):
        if want is not None:
            assert got[i] == want, i
    assert got[None] == PAGES[4][1] and len(got) == len(PAGES) + 1
    assert html_extract.extract_text(empty_like(pages)).count() == 0


def test_page_sample_is_bounded_and_one_of_each_id(spark):
    rows = [(i, f"<p>page {i}</p>") for i in range(60)]
    rows += [(7, f"<p>copy {i:03}</p>") for i in range(300)] + [(None, "<p>no id</p>"), (500, None), (501, "x" * 200_001)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").repartition(20)
    every = html_extract.sample_pages(pages, "page_id", "html", 100)
    assert sorted(every) == sorted(["<p>no id</p>", "<p>copy 000</p>", *[h for i, h in rows[:60] if i != 7]])
    few = html_extract.sample_pages(pages.repartition(3), "page_id", "html", 10)
    assert few == every[:10]
    assert html_extract.sample_pages(empty_like(pages), "page_id", "html") == []


def test_blocks_of_broken_markup():
    b = html_extract.blocks_of("<div>a<p>b<p>c</div>d<!-- x <p> --><script>y</script>e<ul><li>f<li>g")
    assert [x.text for x in b] == ["a", "b", "c", "de", "f", "g"]
    assert html_extract.blocks_of("<" * 5000 + "x")[0].text.endswith("x")
    assert len(html_extract.blocks_of("<p>w</p>" * 20_000)) == 20_000
    assert html_extract.blocks_of("<p a=\"" * 300)[0:1] is not None


def test_long_attribute_values_are_no_text():
    for q in "\"'":
        value = ("<p>leaked > words " * 6000)[:100_000]
        got = html_extract.blocks_of(f"<article data-x={q}{value}{q}><p>main words</p></article>")
        assert [b.text for b in got] == ["main words"]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    m = html_extract.BlockLabeller(rng)
    x, sizes = html_extract.pad([rng.normal(size=(n, m.p["We"].shape[0])) for n in (5, 3)])
    x = x.astype(np.float64)
    y = rng.integers(0, 2, x.shape[:2]).astype(float)
    grads, _ = m.gradients(x, sizes, y)
    for name in m.p:
        at = tuple(int(rng.integers(s)) for s in m.p[name].shape)
        old, eps = float(m.p[name][at]), 1e-5
        losses = []
        for d in (eps, -eps):
            m.p[name][at] = old + d
            losses.append(m.gradients(x, sizes, y)[1])
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * eps), rel=1e-3, abs=1e-7), name


# Sharding

def test_shards_are_even_and_gapless(spark):
    docs = messy_docs(spark)
    rows = shard_pack.shard_documents(docs, 4).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    src = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == src
    assert shard_pack.shard_documents(empty_like(docs), 4).count() == 0


def test_hot_group_is_split_and_others_stay_whole(spark):
    docs = spark.createDataFrame([(i, "same text " * 20 if i % 3 == 0 else f"own text {i // 2} " * 20) for i in range(6000)],
                                 "doc_id bigint, text string")
    rows = shard_pack.shard_documents(docs, 16).collect()
    size, shards = np.zeros(16), {}
    for r in rows:
        size[r.shard] += r.size
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert size.max() - size.min() <= 0.01 * size.mean()
    assert sum(len(s) > 1 for s in shards.values()) == 1


def test_place_follows_the_dot_product():
    v = np.array([[4.0, 1, 1], [1, 4, 1], [1, 1, 4], [3, 3, 3], [1, 1, 1], [1, 1, 1]])
    got = shard_pack.place(v, 2, (1, 1, 1))
    unit, left = v / (v.sum(0) / 2), np.ones((2, 3))
    for i in sorted(range(6), key=lambda i: (-unit[i].max(), i)):
        assert got[i] == np.argmax(left @ unit[i])
        left[got[i]] -= unit[i]


# Licences

MIT = license_scan.TEXTS[0][2]


def test_licences_found_in_texts_and_lines(spark):
    cases = [
        ("Copyright (c) 2020 Some One\n\n" + MIT.upper().replace("\n", "\n  * "), ["MIT"], "text"),
        ("some words\nLicensed under the Apache Licence, Version 2.0.\nmore words", ["Apache-2.0"], "line"),
        ("Released under the MIT License.", ["MIT"], "text"),
        ("x\nThis work is licensed under the GNU General Public License, v3\nLicensed under CC BY-NC 4.0", ["CC-BY-NC-4.0", "GPL-3.0"], "line"),
        ("Licensed under Creative Commons Attribution-NonCommercial 4.0.", ["CC-BY-NC-4.0"], "text"),
        ("the MIT License was spoken of here", [], None), (None, [], None), ("", [], None), ("!!! \n ...", [], None),
        ("word " * 30_000, [], None)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, (t, _, _) in enumerate(cases)] + [(2, cases[2][0], "a", "b")],
                                 "doc_id bigint, text string, license string, unit string")
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (list(r.licenses), r.unit) == cases[r.doc_id][1:], r.doc_id
    assert license_scan.scan_licenses(empty_like(docs)).count() == 0


def test_licences_of_whole_texts_and_headers(spark):
    folder = "/usr/share/common-licenses/"
    cases = [("x\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not", ["Apache-2.0"])]
    cases += [(text, [lic]) for lic, _, text in license_scan.HEADERS if lic in ("AGPL-3.0", "MPL-2.0")]
    for lic, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"),
                      ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(folder + name):
            with open(folder + name) as f:
                cases.append((f.read(), [lic]))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    for r in license_scan.scan_licenses(docs).collect():
        assert set(cases[r.doc_id][1]) <= set(r.licenses), r.doc_id
        assert r.unit == ("text" if r.doc_id else "line")


# Quality

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 40
    right = np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out])
    assert right >= 0.95
    for r in quality.score_quality(docs, labels).limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_of_awkward_rows(spark):
    docs = messy_docs(spark)
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (4, None, 0), (999, 1, 0), (None, 1, 0), (101, 1, 0), (102, 0, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] and by[4] == by[5]
    flat = quality.score_quality(docs, empty_like(labels)).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]
    assert quality.score_quality(empty_like(docs), labels).count() == 0
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_word_vectors_add_up_over_partitions(spark):
    docs = spark.createDataFrame([(i, f"a b c {i} d e f") for i in range(40)], "doc_id bigint, text string")
    one, many = quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs.repartition(7))
    assert np.allclose(one, many, atol=1e-5) and np.abs(one).sum() > 0


# Nearest neighbours

def brute_nearest(rows, k):
    """(query id, vector id) of every query row's best, counted: each row is searched among those of its length."""
    some = [(i, v) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = collections.Counter()
    for at, (q, v) in enumerate(some):
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), j) for n, (j, w) in enumerate(some) if n != at and len(w) == len(v))
            out.update((q, j) for _, j in near[:k])
    return out


def test_neighbours_on_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    big = 2 ** 60
    rows = [(i, rng.integers(-4, 5, 8).astype(float).tolist()) for i in range(300)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7),
             (380, [float("inf")] * 8), (400, [1.0] * 3), (401, [2.0, 0.0, 1.0]), (None, [1.0] * 8), (20, [9.0] * 8),
             (20, [9.0] * 8), (420, []), (440, [5.0]), (big + 1, [8.0] * 8), (big + 4, [7.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, id int, score double")
    found = ann.nearest(df, F.col("id") % 20 == 0, 20).collect()
    got, want = collections.Counter((r.query_id, r.vec_id) for r in found), brute_nearest(rows, 20)
    assert {q for q, _ in got} == {q for q, _ in want} and got.total() == want.total()
    assert (got & want).total() >= 0.99 * want.total()
    assert got[20, 20] >= 2 and got[400, 401] == 1 and (20, big + 1) in got
    assert ann.nearest(empty_like(df), F.col("id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), F.col("id") % 20 == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    ids = np.array(sorted(v))
    m = np.stack([v[i] for i in ids])
    hit, rows = 0, ann.nearest(df, F.col("id") % 20 == 0).collect()
    for q in ids[ids % 20 == 0]:
        s = m @ v[q]
        s[ids == q] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit += len(top & {r.vec_id for r in rows if r.query_id == q})
    assert hit / len(rows) >= 0.9
    for r in rows[:40]:
        assert r.score == pytest.approx(float(np.dot(v[r.query_id], v[r.vec_id])), rel=1e-12)


def test_error_bounds_hold():
    rng = np.random.default_rng(8)
    v, q = rng.normal(size=(2000, 64)), rng.normal(size=(40, 64))
    rot = ann.rotation(64)
    codes, length, fit = ann.encode(v, v.mean(0), rot)
    est, err = ann.estimate(q, codes, length, fit, v.mean(0), rot)
    assert np.mean(np.abs(est - q @ v.T) <= err) > 0.999
