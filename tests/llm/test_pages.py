import html
import re
import time

import numpy as np
import pyarrow as pa

from quarry.llm import host_boilerplate as hb

SF = "/root/testdata/sf0.01"


def _article(page):
    """Text of the marked article of a generated page, by its known template."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


def test_pages_against_their_template(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in hb.extract_pages(pages).collect()}
    assert got == {r["page_id"]: _article(r["html"]) for r in pages.collect()}


def test_blocks():
    page = ('<title>t</title><div id="cookie-notice">We use</div><p>One <i>two</i>&nbsp;three &lt;b&gt;<p>four<ul><li>a<li>b</ul>'
            '<article><header><h1>T</h1></header><p>x &amp;amp; y<div class="comments">no</div>'
            '<script>if (a < b) { "</p>" }</script><!-- <p>gone</p> --><p>1 < 2<form>name</form></article>'
            '<footer>f</footer><p style="display:none">h</p>tail')
    kinds = [(t, k) for t, k in hb.blocks(page) if k != hb.CHROME]
    assert kinds == [("One two three <b>", hb.OTHER), ("four", hb.OTHER), ("a", hb.OTHER), ("b", hb.OTHER), ("T", hb.ARTICLE),
                     ("x &amp; y", hb.ARTICLE), ("1 < 2", hb.ARTICLE), ("tail", hb.OTHER)]
    for odd in (None, "", "   ", "<", "<p", "<!--", "plain", "<script>x", "</div></p>", "<a href='>'>q</a>", "&#xZZ; &bogus;"):
        hb.blocks(odd)
    assert hb.blocks("&bogus; a") == [("&bogus; a", hb.OTHER)]


def _table(pages):
    """(host, page, blocks) rows as the search reads them."""
    return pa.table([pa.array([h for h, _, _ in pages], pa.int64()), pa.array([p for _, p, _ in pages], pa.int64()),
                     pa.array([b for _, _, b in pages], pa.list_(pa.string()))], names=["host_code", "page_code", "blocks"])


def test_groups_against_brute_force():
    """Every group of equal runs of the suffix array, with its pages; choice set aside."""
    rng = np.random.default_rng(2)
    pages = [(int(rng.integers(2)), i // 2, [" ".join(rng.choice(list("abc"), rng.integers(0, 14))) for _ in range(4)]) for i in range(40)]
    pages += [(5, 77, []), (5, 78, ["", "  "]), (5, 79, ["x"]), (6, 80, ["x"]), (5, 81, ["x"])]
    stream = hb.Stream(_table(pages), 6)
    stream.chosen[:] = True
    run, host, page, n = stream.groups(6)
    want = {}
    for h, p, texts in pages:
        for text in texts:
            found = text.split()
            for i in range(max(len(found) - 5, 1) if found else 0):
                want.setdefault((h, tuple(found[i:i + 6])), set()).add(p)
    assert len(run) == len(set(run.tolist())) == len(want)
    got = sorted(zip(host.view(np.int64).tolist(), page.tolist(), n.tolist()))
    assert got == sorted((h, min(p), len(p)) for (h, _), p in want.items())


def test_short_stretches_of_other_parts_count(spark):
    """Blocks of which more than half of the runs are on a page of another part, in stretches of nine runs."""
    own, other = {}, []
    for part in range(2):
        rows = []
        for i in range(12):
            again = " ".join(" ".join(f"s{i}x{j}x{k}" for k in range(14)) + f" only{part}x{i}x{j}" for j in range(8))
            own[100 * part + i] = " ".join(f"own{part}x{i}x{k}" for k in range(150))
            rows.append((100 * part + i, "http://h.org/", f"<p>{own[100 * part + i]}</p><p>{again}</p>"))
        other.append(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    got = {r["page_id"]: r["text"] for r in hb.extract_pages(other[0].unionByName(other[1])).collect()}
    assert got == own


def test_packed_codes():
    rng = np.random.default_rng(4)
    for codes in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))):
        assert hb.unpacked(hb.packed(codes), len(codes)).tolist() == codes.tolist()


def test_equal_stretches_choose_equally():
    rng = np.random.default_rng(3)
    middle = " ".join(f"m{k}" for k in rng.integers(0, 500, 400))
    stream = hb.Stream(_table([(1, i, [" ".join(f"p{i}x{k}" for k in range(i)) + " " + middle + f" end{i}"]) for i in range(12)]), 6)
    chosen = [{int(r) for r in stream.run[(stream.block == i) & stream.chosen]} for i in range(12)]
    assert all(len(chosen[0] & c) >= 8 for c in chosen[1:])


def test_odd_markup_takes_linear_time():
    for page in ('<a "x ' * 60_000, "<div>" * 40_000 + "</p>" * 40_000, "<i>" * 40_000 + "<hr>" * 40_000, "<" * 300_000,
                 "<a b='" * 60_000, '<div class="ad">x' * 30_000, "<!--" * 60_000, "<li><div>" + "<i>" * 20_000 + "<li>" * 20_000,
                 "<p =" * 60_000, "<script>" * 30_000):
        began = time.process_time()
        hb.blocks(page)
        assert time.process_time() - began < 3


def _texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in hb.extract_pages(frame).collect()}


def test_copies_cards_and_notices(spark):
    story = [f"<p>{' '.join(f'w{i}x{k}' for k in range(40))}</p>" for i in range(30)]
    bare = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    # one article under two addresses, on a host with other pages, with and without marks
    rows = [(i, f"https://a.example/{i}", story[i]) for i in range(10)]
    rows += [(10, "https://a.example/report", story[10] + story[11]), (11, "https://a.example/report?print=1", story[10] + story[11])]
    rows += [(12, "https://b.example/x", f"<article>{story[12]}</article>"), (13, "https://b.example/y", f"<article>{story[12]}</article>")]
    # a card marked as an article beside the text
    rows += [(14, "https://c.example/x", f"<article>Teaser card</article><div>{story[13]}{story[14]}</div>")]
    # a notice that most articles of a host have
    notice = "<p>subscribe to our letter and get news on all days of the week</p>"
    rows += [(20 + i, f"https://d.example/{i}", f"<article>{story[15 + i]}{notice}</article>") for i in range(8)]
    # a line that some articles share is their text
    shared = "<p>this text may be used by all under the same terms</p>"
    rows += [(40 + i, f"https://e.example/{i}", f"<article>{story[i]}{shared * (i < 4)}</article>") for i in range(10)]
    got = _texts(spark, rows)
    assert got[10] == got[11] == bare[10] + "\n" + bare[11] and got[12] == got[13] == bare[12]
    assert bare[13] + "\n" + bare[14] in got[14]
    assert all(got[20 + i] == bare[15 + i] for i in range(8))
    assert all(got[40 + i] == bare[i] + "\nthis text may be used by all under the same terms" * (i < 4) for i in range(10))


def test_unmarked_pages_lose_what_repeats_on_their_host(spark):
    body = "<div>Home and all our other sections for you</div><p>{}</p><div>All rights are reserved by the owner</div>"
    rows = [(i, f"https://Site.example/{i}", body.format(f"story {i} tells something of its own {i * 7} times over"))
            for i in range(600)]
    rows += [(700, None, None), (701, "odd", ""), (702, "https://other.example/", body.format("only page here")),
             (5, "https://site.example/5", rows[5][2]), (None, "https://site.example/x", "<p>no key</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text")
    got = hb.extract_pages(frame).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[3] == "story 3 tells something of its own 21 times over"
    assert texts[700] == texts[701] == "" and texts[None] == "no key"
    assert texts[702].count("\n") == 2
    assert hb.extract_pages(frame.where("false")).count() == 0


def test_a_rare_notice_of_a_large_host_goes(spark):
    """Two carriers of a notice among thousands of pages, wherever they are."""
    notice = "<div>this shop closes early on all days before holidays</div>"
    rows = [(i, "https://large.example/", f"<p>page {i} has words {i * 3} and more {i * 5} of them {i * 7}</p>"
             + notice * (i in (3, 1700, 2999))) for i in range(3000)]
    rows.append((4000, "https://small.example/", f"<p>one page with the text of its own</p>{notice}"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    texts = {r["page_id"]: r["text"] for r in hb.extract_pages(frame).collect()}
    assert {i for i, t in texts.items() if "holidays" in t} == {4000}
    assert all(texts[i].startswith(f"page {i} has") for i in range(3000))


def test_names_that_mention_chrome_keep_the_text():
    story = "<h1>Title</h1><p>Text of the story</p>"
    want = [("Title", hb.ARTICLE), ("Text of the story", hb.ARTICLE)]
    for page in (f'<body class="has-sidebar widget"><main>{story}</main>', f'<main class="content with-sidebar">{story}</main>',
                 f'<article class="post comments-open ad">{story}</article>', f'<article class="sidebar">{story}</article>',
                 f'<div class="widget"><div id="related"><article>{story}</article></div></div>',
                 '<article><div class="article-header"><h1>Title</h1></div><p>Text of the story</p></article>'):
        assert [b for b in hb.blocks(page) if b[1] != hb.CHROME] == want
    page = f'<article>{story}<div class="comments"><article class="comment"><p>no</p></article></div></article><p class="ad">no</p>'
    assert [b for b in hb.blocks(page) if b[1] != hb.CHROME] == want
    for name in ("sidebar", "cookie-notice", "x sidebar", "ad_banner"):
        assert hb.blocks(f'<div class="{name}">no</div>') == [("no", hb.CHROME)]


def test_runs_meet_packed(spark):
    """Runs go between parts in a row for each part and slice, not one for each run, and come back with their pages."""
    texts = [[" ".join(f"w{i}x{k}" for k in range(60)) for i in range(j, j + 3)] for j in range(4)]
    rows = [(part, 5, 10 * part + i, texts[i]) for part in range(2) for i in range(4)] + [(2, 5, 30, [texts[0][0]]), (2, 6, 31, texts[0])]
    pages = spark.createDataFrame(rows, "part long, host_code long, page_code long, blocks array<string>")
    runs = hb.page_runs(pages, 6)
    assert runs.groupBy("of", "slice").count().where("count > 1").isEmpty() and 0 < runs.count() <= 3 * hb.SLICES
    back = {}
    for row in hb.repeated_runs(runs).collect():
        found = back.setdefault(row["of"], {})
        found.update(zip(hb.unpacked(row["codes"], row["n"]).tolist(), hb.uncompact(row["counts"], row["n"]).tolist()))
    for part in range(3):
        own = [r for r in rows if r[0] == part]
        stream = hb.Stream(_table([r[1:] for r in own]), 6)
        want = {}
        for run, block in zip(stream.run[stream.length > 0].tolist(), stream.block[stream.length > 0].tolist()):
            page = own[stream.page[block]]
            text = page[3][block - int(np.flatnonzero(stream.page == stream.page[block])[0])]
            on = {r[2] for r in rows if r[1] == page[1] and text in r[3]}
            if len(on) > 1:
                want[run] = len(on)
        assert back.get(part, {}) == want


def test_whole_numbers_in_few_bytes():
    for n in (np.zeros(0, np.int64), np.array([0]), np.array([1, 255]), np.array([7, 70_000, 1 << 40])):
        assert hb.uncompact(hb.compact(n), len(n)).tolist() == n.tolist()


def test_suffixes_against_brute_force():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 300):
        for width in (1, 2, 5, 6, 9):
            codes = rng.integers(0, 3, n).astype(np.uint64)
            order, rank = hb.suffix_array(codes, width)
            exact = [tuple(codes[i:i + width].tolist()) for i in range(n)]
            assert [exact[i] for i in order] == sorted(exact)
            assert all((rank[i] == rank[j]) == (exact[i] == exact[j]) for i in range(n) for j in range(n))
