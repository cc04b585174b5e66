import random

import pytest

from peakforge.llm import page_text as P
from peakforge.llm import warc as W
from peakforge.llm.queries import op2_page_differencing

from ..compare import DATA

ROWS = "page_id long, url string, html string, text string, host string"


def test_markup():
    page = """<html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body><header>top</header><nav><a>menu</a></nav>
    <div class="ad">buy</div><article><header><h1>Title &amp; more</h1></header><p>one <b>bo</b>ld<br>two&nbsp;&#x41;<p class="ad">advert<p>three<aside>side</aside>
    <form>f<input></form><div class="comments"><article>reader</article></div><!-- <p>no</p> --></article><div id="sidebar">s</div><footer>foot</footer></body></html>"""
    assert kept(page) == ["Title & more", "one bold", "two A", "three"]
    parts = [t for z, t in P.parse_page(page) if z == P.PART]
    assert parts == ["top", "menu", "buy", "advert", "side", "f", "reader", "s", "foot"]


def kept(page):
    return [t for z, t in P.parse_page(page) if z != P.PART]


def test_zones():
    page = "<main><h1>Title</h1><article>teaser</article><p>bo<br>dy</p>loose</main><div>beside</div><nav>menu</nav>"
    assert P.parse_page(page) == [(P.CONTENT, "Title"), (P.LOOSE, "teaser"), (P.CONTENT, "bo"), (P.CONTENT, "dy"), (P.LOOSE, "loose"), (P.NEUTRAL, "beside"), (P.PART, "menu")]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>x", "<!-- x", "<p title='>'>", "</p></p>", "<nav><p>x"])
def test_broken_markup_has_no_text(page):
    assert " ".join(kept(page)) in ("", "<", "<p")


def test_content_words_keep_a_part():
    assert kept('<div class="content-sidebar"><p>x</p></div><div class="sidebar-left">y</div><div class="post-comments">z</div><div hidden>h</div>') == ["x"]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 30])
def test_common_lines_against_dynamic_programming(bits, monkeypatch):
    monkeypatch.setattr(P, "_MOST_BITS", bits)
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        c = P.common_lines(a, b)
        assert len(c) == lcs(a, b) and all(a[i] == b[j] for i, j in c)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:]))


def test_shared_lines_go(spark):
    page = "<p>Menu</p><p>{}</p><p>Foot</p>"
    rows = [
        (1, "http://a.x/1", page.format("one"), "t", "h"),
        (2, "http://a.x/2", page.format("two"), "t", "h"),
        (2, "http://a.x/2", page.format("two"), "t", "h"),
        (3, "http://b.x/1", page.format("two"), "t", "h"),
        (4, "http://c.x/1", "<article><p>same</p></article>", "t", "h"),
        (5, "http://c.x/2", "<article><p>same</p></article>", "t", "h"),
        (6, "http://d.x/1", "<p>same</p>", "t", "h"),
        (7, "http://d.x/2", "<p>same</p>", "t", "h"),
        (None, None, None, None, None),
        (9, "zz", "", "t", "h"),
    ]
    out = sorted((r.page_id or 0, r.text) for r in P.extract_text(spark.createDataFrame(rows, ROWS)).collect())
    assert out == [(0, ""), (1, "one"), (2, "two"), (2, "two"), (3, "Menu two Foot"), (4, "same"), (5, "same"), (6, "same"), (7, "same"), (9, "")]


def test_neighbours_over_range_ends(spark):
    """Every inner page loses the lines it shares with its neighbours, however the order is dealt."""
    rows = [(i, f"http://a.x/{i:04d}", f"<p>Menu</p><p>page {i}</p>", None, None) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = P.extract_text(spark.createDataFrame(rows, ROWS).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.text == f"page {r.page_id}" for r in out)


def test_long_lines_stay_beside_one_near_copy(spark):
    """A near copy on one side does not take the content; boilerplate that both sides share goes, if it is long too."""
    long = " ".join(f"word{i}" for i in range(30))
    foot = " ".join(f"foot{i}" for i in range(30))
    page = lambda text: f"<p>Menu</p><p>{text}</p><p>{foot}</p>"
    bodies = ["first", f"{long}</p><p>old", f"{long}</p><p>new", "last"]
    rows = [(i, f"http://a.x/{i}", page(b), None, None) for i, b in enumerate(bodies)]
    out = {r.page_id: r.text for r in P.extract_text(spark.createDataFrame(rows, ROWS)).collect()}
    assert out[1] == f"{long} old" and out[2] == f"{long} new"


def test_boilerplate_inside_main_goes(spark):
    """Markup names no part here: neighbours alone decide, also inside the content element, but for its paragraphs."""
    page = "<main><div class='topbar'>Home About</div><p>Body {0} text</p><p>Aside</p><p>More {0}</p><div class='sitefoot'>Imprint</div></main><div>Call us</div>"
    rows = [(i, f"http://a.x/{i}", page.format(f"w{i}"), None, None) for i in range(5)] + [(9, "http://b.x/9", page.format("w9"), None, None)]
    out = {r.page_id: r.text for r in P.extract_text(spark.createDataFrame(rows, ROWS)).collect()}
    whole = "Home About Body {0} text Aside More {0} Imprint"
    assert [out[i] for i in (1, 2, 3)] == [f"Body w{i} text Aside More w{i}" for i in (1, 2, 3)]  # a paragraph
    assert [out[i] for i in (0, 4)] == [whole.format(f"w{i}") for i in (0, 4)]  # one neighbour
    assert out[9] == whole.format("w9") + " Call us"


def brute_text(rows):
    """page_id -> text, with every page's neighbours looked up in one sorted list."""
    from urllib.parse import urlsplit

    def place(url):
        m = urlsplit(url or "")
        return (m.netloc.lower(), m.path) if "://" in (url or "") else ("", "")

    nodes = sorted({(*place(u), h or "") for _, u, h in rows if P.parse_page(h)}, key=lambda n: (n[:2], order_key(n[2])))
    lines = {n: P.parse_page(n[2]) for n in nodes}
    text = {}
    for i, n in enumerate(nodes):
        shared = []
        for j in (i - 1, i + 1):
            other = nodes[j] if 0 <= j < len(nodes) and nodes[j][0] == n[0] else None
            a, b = [t for _, t in lines[n]], [t for _, t in lines[other]] if other else []
            shared.append(None if other is None else [x for x, _ in P.common_lines(a, b)] if j > i else [y for _, y in P.common_lines(b, a)])
        gone = P.removed_lines([4 * len(t.split(" ")) + z for z, t in lines[n]], *shared)
        text[n] = " ".join(t for k, (z, t) in enumerate(lines[n]) if z != P.PART and k not in gone)
    return {i: text.get((*place(u), h or ""), "") for i, u, h in rows}


def order_key(html):
    return HASHES[html]


HASHES = {}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_whole_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    HASHES.update({r[0] or "": r[1] for r in pages.selectExpr("html", "xxhash64(html)").collect()})
    rows = [tuple(r) for r in pages.collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in op2_page_differencing(spark, str(DATA)).collect()}
    assert got == {i: (t, len(t)) for i, t in brute_text(rows).items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_planted_boilerplate(spark):
    """Unmarked menus, notices and footers of each host, beside the articles and in them: what goes, and what must stay."""
    from pyspark.sql import functions as F

    from peakforge.llm.url_filter import url_host

    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    plain = {r.page_id: r.text for r in P.extract_text(pages).collect()}
    top = F.concat(F.lit("<div class='x1'><div>Start "), url_host(F.col("url")), F.lit("</div><div>All topics of ours</div></div>"))
    end = F.concat(F.lit("<div class='x2'>We use small files to remember you</div><div>Seen on "), url_host(F.col("url")), F.lit("</div>"))
    planted = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "PLANT_TOP<article>"), "</article>", "</article>PLANT_END"))
    planted = planted.withColumn("html", F.replace(F.replace("html", F.lit("PLANT_TOP"), top), F.lit("PLANT_END"), end))
    hosts = {r.h: r.n for r in pages.select(url_host(F.col("url")).alias("h"), "page_id").groupBy("h").agg(F.count("*").alias("n")).collect()}
    out = P.extract_text(planted.withColumn("h", url_host(F.col("url")))).filter(F.col("h").isin([h for h, n in hosts.items() if n > 1])).collect()
    assert len(out) > 20
    assert sum(r.text == plain[r.page_id] for r in out) >= 0.9 * len(out)
    assert all(set(plain[r.page_id].split()) <= set(r.text.split()) for r in out)  # nothing of the article goes


def test_clashing_names(spark):
    names = ["page_id", "url", "html", "text", "host", "path", "page", "__host", "__path", "__page", "__packed", "hashes", "removed"]
    rows = [tuple([i, f"http://a.x/{i}", f"<p>Menu</p><p>page {i}</p>", *[f"{i}{n}" for n in names[3:]]]) for i in range(3)]
    out = P.extract_text(spark.createDataFrame(rows, names))
    assert sorted(out.columns) == sorted(names)
    for r in out.collect():
        assert r.text == f"page {r.page_id}" and all(r[n] == f"{r.page_id}{n}" for n in names[4:])


def test_very_long_page(spark):
    rows = [(i, f"http://a.x/{i}", "<p>Menu</p>" + "".join(f"<p>line {i} {j}</p>" for j in range(30000)), None, None) for i in range(2)]
    out = {r.page_id: r.text for r in P.extract_text(spark.createDataFrame(rows, ROWS)).collect()}
    assert all(t == " ".join(f"line {i} {j}" for j in range(30000)) for i, t in out.items())


def test_no_pages(spark):
    empty = spark.createDataFrame([], ROWS)
    assert P.extract_text(empty).count() == 0
    assert W.archive_pages(spark, empty).count() == 0


def test_archives(spark):
    long = "é" * 80
    rows = [
        (5, "http://a.x/1", long, None, None), (3, "http://b.y/2", long, None, None), (7, None, long, None, None), (None, "http://a.x/9", long, None, None),
        (1, "http://a.x/1", "short", None, None), (2, "http://a.x/1", "short", None, None), (8, "no scheme\r\nX: y", None, None, None), (9, "http://a.x/1", "x\r\n\r\n" * 40, None, None),
        (9, "http://a.x/1", "x\r\n\r\n" * 40, None, None),
    ]
    out = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to) for r in W.archive_pages(spark, spark.createDataFrame(rows, ROWS)).collect())
    assert out == [(-1, 160, "revisit", 3), (1, 5, "response", None), (2, 5, "response", None), (3, 160, "response", None), (5, 160, "revisit", 3), (7, 160, "revisit", 3), (8, 0, "response", None), (9, 200, "response", None), (9, 200, "response", None)]


def test_lookup_in_many_blocks(spark, tmp_path):
    rows = [(f"com,a)/{i // 3:05d}", i, "response", "f", i, 1) for i in range(3000)]
    captures = spark.createDataFrame(rows, "key string, page_id long, kind string, file string, at long, size long")
    index = W.build_index(captures.repartition(3), f"file://{tmp_path}/cdx", lines=17)
    asked = captures.select("key", "page_id")
    assert {(r.key, r.page_id, r.at) for r in W.lookup(asked, index).collect()} == {(k, i, i) for k, i, *_ in rows}
    missing = spark.createDataFrame([("com,a)/00001", 999999), ("a", 1), ("zz", None)], "key string, page_id long")
    assert W.lookup(missing, index).count() == 0


def test_lookup_of_one_hot_url(spark, tmp_path):
    """Many captures of one URL: a lookup reads the blocks of its page alone, however many there are."""
    rows = [("com,a)/", i if i else None, "response", "f", i, 1) for i in range(5000)] + [("com,a)/", 77, "revisit", "g", k, 1) for k in range(40)]
    captures = spark.createDataFrame(rows, "key string, page_id long, kind string, file string, at long, size long")
    index = W.build_index(captures.repartition(3), f"file://{tmp_path}/cdx", lines=16)
    reader, reads = W._Reader(index), []
    block = reader.block
    reader.block = lambda s, b: reads.append((s, b)) or block(s, b)
    for i in (None, 1, 76, 78, 2500, 4999):
        reads.clear()
        assert [r[4] for r in reader.find("com,a)/", i)] == [i or 0] and len(reads) <= 4
    assert len(list(reader.find("com,a)/", 77))) == 41 and not list(reader.find("com,a)/", 5000)) and not list(reader.find("", None))


@pytest.mark.parametrize("few", [0, 100])
def test_many_equal_payloads(spark, few, monkeypatch):
    """Revisits by broadcast and by shuffle; empty and short payloads, null URLs and a very long one."""
    monkeypatch.setattr(W, "BROADCAST_FIRSTS", few)
    rows = [(i, None, "x" * 200, None, None) for i in range(300)] + [(i, f"http://a.x/{i % 3}", None, None, None) for i in range(300, 600)] + [(700, "http://b.x/", "z" * 5_000_000, None, None)]
    out = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in W.archive_pages(spark, spark.createDataFrame(rows, ROWS)).collect()}
    assert out == {i: ("revisit", 0, 200) if 0 < i < 300 else ("response", None, 0 if 300 <= i < 700 else 200 if i == 0 else 5_000_000) for i, *_ in rows}


def test_damaged_record_is_noticed():
    import hashlib

    good = W.record_bytes(1, "http://a/", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None)
    assert W.parse_record(good).payload == b"payload"
    with pytest.raises(ValueError):
        W.parse_record(good.replace(b"payload", b"PAYLOAD"))
