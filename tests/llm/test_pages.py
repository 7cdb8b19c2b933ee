"""Main text of pages: markup, repeats across pages, and the suffix array against brute force."""
import html
import random
import re

import duckdb
import numpy as np
import pytest

from genoloom.llm import pages


def text_of(page):
    blocks = pages.blocks_of(page)
    return pages._main_text(blocks, np.zeros(sum(len(w) for _, w, _ in blocks), bool), 0.8)


@pytest.mark.parametrize("page, want", [
    ("", ""),
    ("plain words &amp; more", "plain words & more"),
    ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
    ("<article><h1>T&eacute;</h1><p><b>x<br>y<p>z</article><footer>f</footer>", "Té\nx y\nz"),
    ("<body><nav>n</nav><main>m<aside>s</aside> o</main><p>out</p>", "m\no"),
    ("<main><p>lead</p><article><header><h1>t</h1></header><p>a</p><section class='comments'>c</section><form>f</form><footer>g</footer></article></main>", "t\na"),
    ("<header>h</header><div class=\"ad top\">x</div><div id=cookie-notice>y</div><div role='navigation'>z</div><p hidden>q</p><p style='display: none'>r</p><p>t</p>", "t"),
    ("<article>a<!-- x <p> -->b<script>var t = '</p>';</script>c<style>p{}</style>d", "ab c d"),
    ("<article><p title='a > b'>in</p><p class=x>x</p>", "in\nx"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table>", "one\ntwo\n1\n2"),
    ("<article>1 < 2 &lt;b&gt; &#x41;&#66; &amp &unknown; \n\t x y</article>", "1 < 2 <b> AB & &unknown; x y"),
    ("<article>a<span class='ad'>b</span>c</article><!-- open", "a\nc"),
    ("<article>a<p 'broken", "a"),
    ("<ARTICLE>A</Article>b", "A"),
    ("<div></span></div></p></article>x</", "x</"),
    ("<head><title>t</title><meta charset=x><p>body without its tag</p>", "body without its tag"),
    ("<head><title>t</title></head><body class='with-sidebar'>x</body>", "x"),
])
def test_markup(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("seed", range(40))
def test_suffix_groups_and_coverage_equal_brute_force(seed):
    rng = random.Random(seed)
    length, least = rng.randint(1, 6), rng.randint(2, 3)
    streams = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
    owners = [rng.randrange(len(streams)) for _ in streams]
    got = pages.covered([np.array(s, np.int64) for s in streams], np.array(owners), length, least)
    holds = lambda s, w: any(s[i : i + length] == w for i in range(len(s) - length + 1))
    for s, mask in zip(streams, got, strict=True):
        want = [False] * len(s)
        for i in range(len(s) - length + 1):
            if len({o for t, o in zip(streams, owners, strict=True) if holds(t, s[i : i + length])}) >= least:
                want[i : i + length] = [True] * length
        assert mask.tolist() == want
    flat = np.array([x for s in streams for x in s] or [0])
    group = pages.suffix_groups(flat, length)
    first = [tuple(flat[i : i + length]) for i in range(len(flat))]
    assert all((group[i] == group[j]) == (first[i] == first[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert [first[i] for i in np.argsort(group, kind="stable")] == sorted(first)


def test_boilerplate_without_markup_is_found_by_repeats(spark):
    menu, foot = "<div>Home News Sport Weather Contact us</div>", "<div>All rights reserved by the people of this host</div>"
    body = ["The first story tells of one thing", "A second one is all about another matter", "And the third has nothing to do with them"]
    rows = [(i, f"http://A.example/{i}", f"{menu}<div>{t}</div>{foot}") for i, t in enumerate(body)]
    rows += [(10, "http://b.example/", f"{menu}<div>{body[0]}</div>"), (11, None, f"<div>{body[1]}</div>"), (12, "::no address", None), (None, "http://c.example", "")]
    rows += [(20, "http://d.example/1", f"<p>{body[2]}</p>"), (20, "http://d.example/1", f"<p>{body[2]}</p>")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS Text", "1 AS _pg_host")
    out = pages.extract(docs)
    assert out.columns == ["page_id", "url", "_pg_host", "text", "n_words", "n_repeated"]
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in out.collect())
    assert got == [(-1, ""), (0, body[0]), (1, body[1]), (2, body[2]), (10, f"Home News Sport Weather Contact us\n{body[0]}"), (11, body[1]), (12, ""), (20, body[2]), (20, body[2])]
    assert pages.extract(docs.filter("false")).collect() == []


def test_a_hot_host_is_dealt_to_volumes(spark):
    page = lambda i: f"<p>{'menu of this host that all pages have'}</p><p>{' '.join(f'w{i}x{j}' for j in range(30))}</p>"
    docs = spark.range(600).rdd.map(lambda r: (r[0], "http://hot.example/", page(r[0]))).toDF("page_id long, url string, html string")
    got = pages.extract(docs, volume=50).collect()
    assert len(got) == 600 and all(r["text"] == " ".join(f"w{r['page_id']}x{j}" for j in range(30)) and r["n_repeated"] == 8 for r in got)


def test_long_page():
    assert text_of("<article>" + "<p>some words<b>" * 100_000) == "\n".join(["some words"] * 100_000)
    assert text_of("<a href=\"" * 20_000 + "x") == ""


def test_query_equals_a_plain_parser(spark):
    sf_dir, want = "/root/testdata/sf0.01", {}
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[i] = "\n".join(b for b in blocks if b)
    rows = pages.query(spark, sf_dir).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["n_repeated"] for r in rows) > 0


@pytest.mark.parametrize("volume, least", [(2, 2), (2, 3), (5, 2), (5, 4)])
def test_passages_that_only_pages_of_different_volumes_share_are_found(spark, volume, least):
    rng, rows = random.Random(volume * 10 + least), []
    passages = [" ".join(f"p{k}x{j}" for j in range(5 + k % 3)) for k in range(12)]
    for i in range(60):
        own = [f"<p>{' '.join(f'w{i}x{j}y{n}' for j in range(6))}</p>" for n in range(2)]
        shared = [f"<p>{passages[k]}</p>" for k in range(12) if rng.random() < 0.05]
        rows.append((i, f"http://{'large' if i < 50 else f'small{i % 3}'}.example/{i}", "".join([own[0], *shared, own[1]])))
    rows += [(100 + i, *rows[k][1:]) for i, k in enumerate([0, 0, 1, 55])] + [(None, *rows[2][1:]), (3, "http://large.example/", None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7), volume=volume, min_pages=least).collect()
    # by hand: the five-word passages of each host and the distinct pages that hold them
    words = {r: [w for b in re.findall("<p>(.*?)</p>", r[2] or "") for w in b.split()] for r in set(rows)}
    host = lambda r: r[1].split("/")[2]
    holders = {}
    for r, own in words.items():
        for j in range(len(own) - 4):
            holders.setdefault((host(r), *own[j : j + 5]), set()).add(r[2])
    want = []
    for r in rows:
        own = words[r]
        mask = {j + d for j in range(len(own) - 4) if len(holders[host(r), *own[j : j + 5]]) >= least for d in range(5)}
        want.append((r[0] if r[0] is not None else -1, len(own), len(mask)))
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["n_words"], r["n_repeated"]) for r in got) == sorted(want)
    assert any(n for _, _, n in want)
