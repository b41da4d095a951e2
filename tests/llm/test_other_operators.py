"""Pages, archives, mixtures, neighbours and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from codelore.llm import mixing, multiprobe, queries, style_tree, warc_zst
from codelore.llm.common import table
from test_text_operators import plain_components, plain_sets

DATA = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def chrome(i, body):
    return f"<html><head><title>t</title></head><body><div class='x1'><a href='/home'>Home</a> <a href='/all'>All pages</a></div><div class='x2'>{body}</div><div class='x3'>All rights kept by the site, always.</div></body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<body><nav>m</nav><article><h1>T &amp; x</h1><p>one<br>two <b>th</b>ree<p>four<aside>no</aside></article><footer>f</footer>", "T & x one two three four"),
        ("<div class='menu'>x</div><div>hello <i>w</i>orld</div><table><tr><td>a<td>b</table>", "hello world a b"),
        ("<article>a<script>b</script><style>c</style><!-- d -->e<form>f</form></article><div class='comments'><article>g</article></div>", "ae"),
        ("plain text &lt;b&gt; &#233;&nbsp;x", "plain text <b> é x"),
        ("<p>cut <b>short", "cut short"),
        ("<p>a<!-->b<!--->c<!-- > d --!>e<!-- f", "abce"),
        ("", ""), (None, ""), ("<", "<"),
    ],
)
def test_text_of_a_page(spark, html, want):
    row = style_tree.extract(spark.createDataFrame([(1, "http://h/1", html)], PAGES)).first()
    assert row["text"] == want


def test_repeated_branches_of_a_site_go(spark):
    rows = [(i, f"http://one.example/{i}", chrome(i, f"Story number {i} about matter {i * 7}.")) for i in range(30)]
    rows += [(100, "http://alone.example/", chrome(0, "A single page.")), (101, None, chrome(0, "No address.")), (None, "http://one.example/n", chrome(0, "No number.")), (0, "http://one.example/0", rows[0][2])]
    got = style_tree.extract(spark.createDataFrame(rows, PAGES).withColumn("key", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 100:
            assert r["text"] == f"Story number {r['page_id']} about matter {r['page_id'] * 7}."
    alone = next(r for r in got if r["page_id"] == 100)
    assert "A single page." in alone["text"] and "always" in alone["text"]  # nothing to compare it with


def test_the_tree_decides_inside_and_beside_articles(spark):
    """Repeats inside an article go, text beside it that varies stays; teasers of links don't."""
    def page(i):
        return f"<body><div class='y1'>Only on this site.</div><div class='y2'>Lead {i} of the story.</div><div class='y3'>Also <a href='/{i}'>another long story {i * 3}</a></div><article><div class='z1'>Written by our staff.</div><p>Story {i} begins.</p><p>Story {i} ends.</p></article></body>"

    got = style_tree.extract(spark.createDataFrame([(i, f"http://one.example/{i}", page(i)) for i in range(30)], PAGES)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Lead {i} of the story. Story {i} begins. Story {i} ends." for i in range(30)}


def test_long_bodies_stay(spark):
    """A container that all pages have alike stays for the sake of the texts in it."""
    for tag in ("div", "article"):
        rows = [(i, f"http://one.example/{i}", f"<body><{tag}>" + "".join(f"<h2>h {i} {k}</h2><p>text {i} {k}</p>" for k in range(20)) + f"</{tag}><div class='x3'>Always the same.</div></body>") for i in range(8)]
        got = style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()
        assert {r["page_id"]: r["text"] for r in got} == {i: " ".join(f"h {i} {k} text {i} {k}" for k in range(20)) for i in range(8)}


@pytest.mark.parametrize("copies", [2, 1000])
def test_copies_of_a_page_stay(spark, copies):
    """Copies count as one page, with or without other pages on the host, and whatever their chrome says."""
    body = "<h1>Head</h1><p>one</p><ul><li>two</li></ul><p>three</p><h2>four</h2><p>five</p>"
    rows = [(i, f"http://copies.example/{i}", f"<body>{body}</body>") for i in range(copies)]
    rows += [(2000 + i, f"http://mixed.example/{i}", f"<body><nav>{i}</nav>{body}</body>") for i in range(copies)]
    rows += [(4000 + i, f"http://mixed.example/o{i}", chrome(i, f"Story {i}.")) for i in range(10)]
    rows += [(5000 + i, f"http://article.example/{i}", f"<body><div class='x1'>{i}</div><article>{body}</article></body>") for i in range(copies)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(t == "Head one two three four five" for i, t in got.items() if i < 4000)
    assert all(t.endswith("Head one two three four five") for i, t in got.items() if i >= 5000)
    assert all(got[4000 + i] == f"Story {i}." for i in range(10))


def test_names_alone_cut_no_article(spark):
    """Words count as a whole class or its leading part; a doubtful name goes only where it repeats over the site."""
    cases = [
        ("<article class='post category-social tag-search has-comments'><p>a b</p></article>", "a b"),
        ("<main class='search'>a</main>", "a"), ("<article class='comment'>alone</article>", "alone"),
        ("<div id='search-results-study'><p>a b</p></div>", "a b"),
        ("<div class='has-sidebar'>a<div class='sidebar-left'>b</div><div class='ad-banner top'>c</div><ul class='nav2'>d</ul></div>", "a"),
        ("<article>a</article><ol class='comment-list'><article class='comment'>b</article></ol><article class='comment'>c</article>", "a"),
        ("<div><p>story</p></div><article class='comment'>c</article>", "story"),
        ("<div class='comments'><article>g</article></div>", ""),
        ("<article class='post'><header class='header'><h1>t</h1></header>a</article>", "t a"),
    ]
    rows = [(i, f"http://h{i}/", html) for i, (html, _) in enumerate(cases)]
    rows += [(100 + i, f"http://notes.example/{i}", f"<body><div class='notice-of-meeting'>Meeting {i}.</div><div class='share-price-ticker'>Prices <b>here</b>.</div></body>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert [got[100 + i] for i in range(9)] == [f"Meeting {i}." for i in range(9)]


def test_importance_by_hand(spark):
    """Two pages of three share the only text of an element: H = (ln 2 + 0) / 2 over ln 3."""
    html = ["<p>same</p>", "<p>same</p>", "<p>other</p>"]
    rows = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], PAGES)
    (node, _, _), *_ = [x for x in style_tree.name_nodes(style_tree.parsed(html[0]), "h") if x[0].tag == "p"]
    got = {r["key"]: r["importance"] for r in style_tree.style_counts(rows).collect()}
    assert math.isclose(got[node.key], 1 - math.log(2) / 2 / math.log(3), abs_tol=1e-8)


def plain_importance(pages):
    """Importance of the elements of these (url, html), by counting in plain Python; copies on a host count once."""
    seen, styles, contents = {}, {}, {}
    for url, html in pages:
        root = style_tree.parsed(html)
        style_tree._mark_articles(root)
        named = style_tree.name_nodes(root, style_tree.host_of(url))
        seen.setdefault(style_tree._payload(style_tree.host_of(url), html, named), named)
    for named in seen.values():
        for key, style in {(n.key, s) for n, s, _ in named}:
            styles.setdefault(key, Counter())[style] += 1
        for (key, x), n in Counter((n.key, x) for n, _, c in named for x in c).items():
            contents.setdefault(key, {}).setdefault(x, []).append(n)
    out = {}
    for key, kinds in styles.items():
        n = sum(kinds.values())
        if n > 1:
            entropy = lambda c: -sum(x / sum(c) * math.log(x / sum(c)) for x in c)
            own = [entropy(c) for c in contents.get(key, {}).values()]
            value = round(1 - min(1, sum(own) / len(own) / math.log(n)) if own else entropy(list(kinds.values())) / math.log(n), 9)
            if value < 1:
                out[key] = value, float(n)
    return out


def test_supplied_pages_by_a_plain_tree(spark):
    """The texts of the supplied pages, from importances counted in plain Python."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = pages.collect()
    weigh = plain_importance([(r["url"], r["html"]) for r in rows if r["html"] and style_tree.host_of(r["url"])])
    host = {r["page_id"]: style_tree.host_of(r["url"]) for r in rows}
    want = {r["page_id"]: style_tree.main_text(r["html"], host[r["page_id"]], weigh) if r["html"] else "" for r in rows}
    assert {r["page_id"]: r["text"] for r in style_tree.extract(pages).collect()} == want
    site = [(i, f"http://one.example/{i}", f"<body><div class='y1'>Only on this site.</div><article><div class='z1'>Written by our staff.</div><p>Story {i}.</p></article></body>") for i in range(30)]
    weigh = plain_importance([(u, h) for _, u, h in site])
    assert {style_tree.main_text(h, "one.example", weigh) for _, _, h in site} == {f"Story {i}." for i in range(30)}
    assert all(style_tree.main_text(h, "one.example", {}) != style_tree.main_text(h, "one.example", weigh) for _, _, h in site)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_supplied_pages_keep_their_documents(spark, sf):
    """A supplied page's article is its title and the document that its address names; all of it stays, and nothing else."""
    tables = f"/root/testdata/sf{sf}"
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    pages = style_tree.extract(table(spark, tables, "pages")).join(table(spark, tables, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("title"), F.regexp_extract("url", r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1).cast("long").alias("doc_id")), "page_id")
    rows = pages.join(table(spark, tables, "documents").select("doc_id", flat("text").alias("body")), "doc_id", "left").select("text", "title", "body").collect()
    assert rows and all(r["text"] == f"{' '.join(unescape(r['title']).split())} {r['body']}".strip() for r in rows)


def test_line_breaks_and_unclosed_tags_lose_no_text(spark):
    """An element without text doesn't lower the paragraph that holds it, nor a link the sentence that it stands in."""
    def page(i):
        return f"<body><article><div class='z1'><b>Written by<br>our staff.</b></div><h1>Head {i}</h1><p><b>Start {i}<br><p>Middle {i} <img src='/{i}.png'> end {i}<p>See <a href='/about'>our pages</a> for {i}</article></body>"

    got = style_tree.extract(spark.createDataFrame([(i, f"http://one.example/{i}", page(i)) for i in range(30)], PAGES)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Head {i} Start {i} Middle {i} end {i} See our pages for {i}" for i in range(30)}


def test_pages_of_many_elements(spark):
    """Time and memory grow with the page, however many elements lie side by side."""
    html = "<article><p>" + "<br>" * 100_000 + "<a>x</a>" * 50_000 + "</p>" + "<p>y</p>" * 50_000 + "</article>"
    assert style_tree.extract(spark.createDataFrame([(1, "http://h/1", html)], PAGES)).first()["text"] == "x" * 50_000 + " y" * 50_000


def test_an_article_under_many_titles_stays(spark):
    """What repeats as a whole is a copied article; only its title differs."""
    rows = [(i, f"http://one.example/{i}", f"<body><article><h1>Copy {i}</h1><p>one</p><p>two</p></article></body>") for i in range(30)]
    assert {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(rows, PAGES)).collect()} == {i: f"Copy {i} one two" for i in range(30)}


def test_archives(spark):
    big = "<html>" + "y" * 200_000
    rows = [(5, "http://a/5", "<p>" + "z" * 200), (2, "http://a/2", "<p>" + "z" * 200), (9, None, "<p>" + "z" * 200), (1, "http://a/1", "short"), (3, "http://a/3", "short"), (4, "http://a/ 4", None), (6, "u", big), (None, "n", big), (2, "http://a/2", "<p>" + "z" * 200)]
    pages = spark.createDataFrame(rows, PAGES)
    archives = warc_zst.write_archives(warc_zst.with_revisits(pages)).cache()
    got = warc_zst.read_archives(archives).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), None: ("response", None)}
    assert all(r["error"] is None for r in got)
    content = bytes(archives.first()["content"])
    for broken in (content[:-5], content[: len(content) // 2], b"", b"\x00" * 20, content[:4]):
        out = warc_zst.read_archives(spark.createDataFrame([("x", broken)], "archive string, content binary")).collect()
        assert all(r["error"] for r in out[-1:])
    assert warc_zst.write_archives(warc_zst.with_revisits(pages.limit(0))).count() == 0


def test_archive_files(spark, tmp_path):
    """Archives as files, read again by Spark; columns of clashing names don't matter, nor does writing twice."""
    rows = [(i, f"http://a/{i}", f"<p>page {i % 40} " + "word " * (i % 40 + 30)) for i in range(120)] + [(200, "http://a/200", "é" * 100_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("payload", "archive", "content", "error", "_digest", "record_type")}).repartition(3)
    archives = warc_zst.write_archives(warc_zst.with_revisits(pages))
    for _ in range(2):
        sizes = {r["archive"]: r["bytes"] for r in warc_zst.save_archives(archives, str(tmp_path / "warc")).collect()}
    names = sorted(p.name for p in (tmp_path / "warc").iterdir() if not p.name.startswith("."))
    assert names == sorted(sizes) and all((tmp_path / "warc" / n).stat().st_size == sizes[n] for n in names)
    files = spark.read.format("binaryFile").load(str(tmp_path / "warc"))
    got = warc_zst.read_archives(files, "path").collect()
    assert sorted((r["page_id"], r["payload_digest"], r["error"]) for r in got) == sorted((i, hashlib.sha256(h.encode()).hexdigest(), None) for i, _, h in rows)
    assert sum(r["record_type"] == "revisit" for r in got) == 80
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {h.encode() for _, _, h in rows}


def test_a_large_dictionary_is_read():
    import struct

    import zstandard

    raw = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(600_000))  # 19 MB, as they are
    held = zstandard.ZstdCompressor().compress(raw)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(b"record")
    assert list(warc_zst.frames(struct.pack("<II", warc_zst.SKIPPABLE, len(held)) + held + frame)) == [(b"record", "")]
    assert [e for _, e in warc_zst.frames(struct.pack("<II", warc_zst.SKIPPABLE, 100) + held[:100])] == ["broken dictionary"]


def test_bad_records_are_told():
    good = warc_zst.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc_zst.read_record(good)["error"] == ""
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r\n", b"paylaod\r\n"), good.replace(b"WARC-Date", b"X"), b""):
        assert warc_zst.read_record(bad)["error"]


def water(sizes, weights):
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        open_ = sum(w for i, w in enumerate(weights) if i not in full)
        share = [3 * s if i in full else rest * weights[i] / open_ for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in full and share[i] > 3 * sizes[i]}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("sizes", [[5, 7, 9], [1000, 1, 1, 1, 2], [0, 10, 10], [3], [0], [100, 1, 50, 2, 2, 2, 900, 0, 4]])
def test_targets(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = water(sizes, [i % 3 + 1 for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes)
    assert np.allclose([got[n] for n in names], want)


def test_mix(spark):
    draw = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(draw.integers(1, 60))), ["a", "b", "c", None][min(3, i % 7)]) for i in range(1500)] + [(None, "x y", "a"), (2000, None, "b"), (2001, "", "zero"), (2002, "é x\ty", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    for source in ("a", "b", "c", "zero", None):
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(0.01 * mine[0]["target"], 2)
    key = lambda r: (r["doc_id"] or -1, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rates_are_exponential(spark):
    """The multiplier solves the dual, compared with bisection."""
    sizes = np.array([1, 2, 3, 5, 8, 13, 40])
    docs = spark.createDataFrame([(int(s), 10) for s in sizes], "size long, n long").select(F.lit("a").alias("source"), "size", "n")
    total = int(sizes.sum() * 10)
    for target in (0.2 * total, 1.7 * total, 2.9 * total):
        goal = spark.createDataFrame([("a", total, float(target), 1, 70)], "source string, source_size long, target double, least long, docs long")
        row = mixing.multipliers(docs, goal).first()
        words = float((10 * sizes * np.minimum(3, np.exp(row["multiplier"] * sizes / row["unit"]))).sum())
        assert abs(words / target - 1) < 2e-3


def test_no_convergence_is_an_error(spark):
    histogram = spark.createDataFrame([("a", s, 10) for s in (1, 5, 40)], "source string, size long, n long")
    goal = spark.createDataFrame([("a", 460, 900.0, 1, 30)], "source string, source_size long, target double, least long, docs long")
    with pytest.raises(RuntimeError, match="no multipliers after 1 rounds for 1 sources"):
        mixing.multipliers(histogram, goal, 1)


def nearest(ids, x, q, k=20):
    """Brute force over distinct ids: the k best of query q, ties to the smaller id."""
    s = x @ x[ids == q][0]
    order = np.lexsort((ids, -np.round(s, 12)))
    return [int(i) for i in ids[order] if i != q][:k]


def recall(got, ids, x, queries):
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    assert set(by_query) == set(queries)
    for q in queries:
        mine, want = by_query[q], nearest(ids, x, q)
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1)) and len({r["vec_id"] for r in mine}) == len(mine)
        assert np.allclose([r["score"] for r in mine], [float(x[ids == r["vec_id"]][0] @ x[ids == q][0]) for r in mine], atol=1e-12)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(mine, mine[1:]))
        hits, total = hits + len({r["vec_id"] for r in mine} & set(want)), total + len(want)
    return hits / total


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_neighbours(spark, size):
    e = table(spark, f"/root/testdata/{size}", "embeddings").select("vec_id", "embedding")
    odd = spark.createDataFrame([(100001, None), (100002, [0.0] * 64), (100003, [float("nan")] * 64), (100005, [float("inf")] * 64), (None, [1.0] * 64), (100004, [1.0])], "vec_id long, embedding array<float>")
    got = multiprobe.search(e.unionByName(odd).withColumns({c: F.lit(1) for c in ("v", "h", "t", "key", "score", "rank", "query_id")})).collect()
    rows = e.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    assert recall(got, ids, x, ids[ids % 20 == 0].tolist()) >= 0.9
    if size == "sf0.001":
        assert multiprobe.search(e.limit(0)).count() == 0 and multiprobe.search(e.where("vec_id = 0")).count() == 0
        assert multiprobe.search(e.where("vec_id < 6")).count() == 5


def test_repeated_vectors_are_one_neighbour(spark):
    """Repeated candidates and queries, against brute force over the smallest vector of each id."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, x[i].tolist()) for i in range(0, 40) for _ in range(30)] + [(100, x[100].tolist())] * 3 + [(200, (np.abs(x[200]) + 9).tolist())]
    got = multiprobe.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert recall(got, np.arange(300), x, list(range(0, 300, 20))) >= 0.9


@pytest.mark.parametrize("block", [4096, 50])
def test_hashed_neighbours(spark, monkeypatch, block):
    """Neighbours in groups are found among few candidates; ties go to the smaller id; blocks split what is common."""
    monkeypatch.setattr(multiprobe, "BLOCK", block)
    monkeypatch.setattr(multiprobe, "ASKED", block)
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(60, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([centres[i % 60] + 0.03 * draw.normal(size=16) for i in range(3000)]).reshape(3000, 16)
    x[40:1040] = x[0]  # a third of all are equal
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, n = multiprobe.fit(multiprobe.usable(rows).dropDuplicates(["v"]))
    assert n == 2000 and index.share < 0.25 and index.recall >= 0.97
    got = multiprobe.search(rows, every=100).collect()
    assert recall(got, np.arange(3000), x, list(range(0, 3000, 100))) >= 0.9
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(40, 60))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [0, *range(40, 59)]


def test_a_query_whose_buckets_hold_too_few(spark, monkeypatch):
    """With one probe of narrow cells most queries meet fewer than k; they are compared with all, and lose nothing."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 8))
    narrow = multiprobe.Index(draw.standard_normal((1, 4, 9)), draw.random((1, 4)), multiprobe.probe_sets(4), 0.5, 1, float(np.linalg.norm(x, axis=1).max()) * 1.001, x[:10])
    monkeypatch.setattr(multiprobe, "fit", lambda rows, k, every: (narrow, 400))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(multiprobe.search(rows).collect(), np.arange(400), x, list(range(0, 400, 20))) == 1


def test_probe_sets():
    for cells in (1, 2, 4):
        sets = multiprobe.probe_sets(cells, 10_000)
        assert len({tuple(r) for r in sets.tolist()}) == len(sets) == 3**cells  # every step of every cell, once
        assert not (sets[:, :cells] * sets[:, ::-1][:, :cells]).any() and not sets[0].any()
    draw = np.random.default_rng(1)
    index = multiprobe.Index(draw.standard_normal((1, 3, 5)), draw.random((1, 3)), multiprobe.probe_sets(3), 0.7, 27, 1.0, np.zeros((0, 4)))
    q = index.asking(draw.normal(size=(5, 4)))
    cells = q @ index.planes[0].T / 0.7 + index.shifts[0]
    for i, keys in enumerate(index.probed(q, 0)):
        inside = cells[i] - np.floor(cells[i])
        steps = sorted(((s**2 * (np.array(w) < 0) + (1 - s) ** 2 * (np.array(w) > 0)).sum(), w) for s in [inside] for w in np.ndindex(3, 3, 3) for w in [tuple(np.array(w) - 1)])
        assert keys.tolist() == multiprobe._joined(np.array([np.floor(cells[i]) + w for _, w in steps]).astype(np.int64)).tolist()


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    out, ids = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, before, DATA).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti").isEmpty()
        if "mixing" not in name and "encoding" not in name:
            assert 0 < out.count() <= before.count() <= ids
    assert out.select("doc_id", "n_tokens").count() == before.count()
    assert corpus_pipeline.run(spark, DATA).count() == out.count()
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_pipeline_by_plain_stages(spark):
    """The rows of run() against brute force over what the two classifiers keep, which have tests of their own."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    good = docs.join(queries.quality(docs, labels).where("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    clean = queries.toxicity(good, labels).where("predicted = 0").select("doc_id", "text", "source").collect()
    ids = [r["doc_id"] for r in clean]
    first = plain_components(ids, plain_sets([r["text"] for r in clean]))
    kept = {r["doc_id"]: r for r in clean if first[r["doc_id"]] == r["doc_id"]}
    out = corpus_pipeline.run(spark, DATA).collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for i, r in kept.items()}
    names = sorted({r["source"] for r in kept.values()}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size[i] for i, r in kept.items() if r["source"] == s) for s in names]
    for s, n, goal in zip(names, sizes, water(sizes, [i % 3 + 1 for i in range(len(names))])):
        longest = max(size[i] for i, r in kept.items() if r["source"] == s)
        assert abs(sum(copies[i] * size[i] for i, r in kept.items() if r["source"] == s) - goal) <= max(0.02 * goal, longest), s
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.BPE_RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        own = library.encode_ordinary(kept[r["doc_id"]]["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())


def test_mixture_stage_takes_the_words_of_the_mix(spark):
    """Repeated and missing doc_ids with texts of different sizes, sources without a name, and columns called like those of the mix."""
    rows = [(i % 150 if i % 4 else None, "w " * (1 + i * 37 % 90), "en", [None, "a", "b", "a"][i % 4], i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.col("n_chars") for c in ("copies", "size", "of", "row", "key", "_id")})
    got = corpus_pipeline.mixture(spark, docs, "")
    assert got.columns == docs.columns
    words = got.select(F.sum(mixing.word_count("text"))).first()[0]
    mixed = mixing.mix(docs)
    assert words == mixed.agg(F.sum("taken")).first()[0] > 0
    want = Counter({(r["doc_id"], r["source"], r["size"]): r["n"] for r in mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect()})
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got.collect()) == want
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_queries_are_registered():
    assert len(queries.QUERIES) == 13 and all(n.startswith(f"op{i}_") for i, n in enumerate(queries.QUERIES, 1))
