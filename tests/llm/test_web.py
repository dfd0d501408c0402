import re
from html import unescape

import pytest

from locusframe.llm import html_text, url_filter

LONG = " ".join(f"plain{i}" for i in range(60))
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu one</a></li></ul></nav><!-- ad --><div class="ad">buy this</div>
<article><h1>{title}</h1><p><b>First  part<br>of it<p>Fish &amp; chips &lt;3 &copy</p><p>""" + LONG + """</p><form>field</form>
<aside>side words</aside><script>x</script><p>Last.</p></article>
<div id="comments"><p>a reader says much about all of this</p></div><footer>&copy; foot</footer></body></html>"""
EXPECTED = "{title} First part of it Fish & chips <3 © " + LONG + " Last."


@pytest.fixture(scope="module")
def weights():
    total = sum((html_text.counted(PAGE.format(title=f"Title number {i}")) for i in range(9)), start=__import__("collections").Counter())
    return html_text.weights_of(total)


def test_main_text(weights):
    assert html_text.main_text(PAGE.format(title="A title"), weights) == EXPECTED.format(title="A title")
    for empty in (None, "", "<p></p>", "<nav>only a menu</nav>", "<!-- unclosed"):
        assert html_text.main_text(empty, weights) == ""
    assert html_text.main_text("plain words", weights) == "plain words"


@pytest.mark.parametrize("name", ["no-sidebar", "post with-sidebar", "content-area share-enabled", "entry comment-policy", "related-work", "Sidebar left"])
def test_class_names_around_the_article(weights, name):
    page = f'<div class="{name}"><p>before</p><article><h1>A</h1><p>{LONG}</p></article></div>'
    assert html_text.main_text(page, weights) == f"A {LONG}"
    # Beside the article, whole names mark a part that is none of it.
    beside = f'<article><p>{LONG}</p></article><div class="{name}"><article><p>{LONG}</p></article></div>'
    kept = name != "Sidebar left"
    assert html_text.main_text(beside, weights) == (f"{LONG} {LONG}" if kept else LONG)


def test_marks_inside_an_article(weights):
    page = f'''<article><h1 class="ad">A</h1><section id="related-work"><p class="notice">old work</p></section>
<div class="share">share it</div><div class="ad-box">buy</div><p>{LONG}</p><div class="cookie-notice">cookies</div></article>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section><article class="related"><p>next</p></article>'''
    assert html_text.main_text(page, weights) == f"A old work {LONG}"


def test_page_headers_are_left_out_and_article_headers_are_not(weights):
    page = f"<body><header><h1>Site name here</h1></header>{{}}<header><h2>Title</h2></header><p>{LONG}</p>{{}}</body>"
    for before, after in (("<article>", "</article>"), ("<div class=post>", "</div>"), ("<main>", "</main>")):
        assert html_text.main_text(page.format(before, after), weights) == f"Title {LONG}"
    for name in ("site-header", "page header", "masthead"):
        page = f'<div class="{name}"><p>Site name here</p></div><div><p>{LONG}</p></div>'
        assert html_text.main_text(page, weights) == LONG


def test_an_article_goes_on_behind_a_table_of_links(weights):
    cells = "".join(f"<tr><td><a href=/{i}>cell{i}</a></td></tr>" for i in range(40))
    page = f"<nav><a href=/>home</a></nav><article><p>{LONG}</p><table>{cells}</table><p>{LONG}</p></article>"
    assert html_text.main_text(page, weights) == f"{LONG} {' '.join(f'cell{i}' for i in range(40))} {LONG}"


def test_best_region_without_article(weights):
    page = "<div><a href=x>link</a></div>" * 8 + "<p>" + "real words here " * 30 + "</p>" + "<div><a>more</a></div>" * 8
    assert html_text.main_text(page, weights) == ("real words here " * 30).strip()


def test_whole_long_pages_are_read(weights):
    body = "".join(f"<p>block {i} has words</p>" for i in range(60_000))
    text = html_text.main_text(f"<article>{body}</article>", weights)
    assert text.startswith("block 0 has") and text.endswith("block 59999 has words") and len(text.split()) == 240_000


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = html_text.extract(pages, html_text.fit(pages)).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(found) == len(html)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", html[r.id], re.S)[1]
        plain = re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))
        assert r.text == " ".join(unescape(plain).split())


def test_page_rows(spark, weights):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>some words</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in html_text.extract(df, weights).collect()))) == sorted(
        map(str, [(1, "u", ""), (1, "u", ""), (None, None, "some words")])
    )
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).count() == 0


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_rules_equal_brute_force(spark):
    hosts = ["example.org", "a.example.org", "xexample.org", "COM", "x.com", "Ünix.COM", "org", ".org", "", "h.net:80"]
    paths = ["", "/", "/es/", "/es", "/en/12", "/fr/1?q=/de/", "/de/#f", "?x=/es/", "#/", "//", "/En/1"]
    urls = [None, "", "no scheme", "x:/", *(f"http://{h}{p}" for h in hosts for p in paths), "a://b://c/d", "\nhttp://x.com/de/\ny"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = url_filter.judge(df, RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, (rule, verdict) = brute(urls[r.id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_segmentation_and_scores():
    model = url_filter.Model(url_filter.BLOCKED, url_filter.ALLOWED)
    assert model.split("cheappills") == ("cheap", "pills")
    assert model.split("freebetsonline") == ("free", "bets", "online")
    assert model.split("theresbet") == ("theresbet",) and model.split("") == ()
    for host in ("casino-win.example.com", "www.cheappills.net", "blog.free-bets.org", "adult-x.example.net"):
        assert model.score(model.segments(host, "/en/1")) > 0
    for host in ("blog.therwh.example.com", "worldnews.example.com", "ththth.example.net", ""):
        assert model.score(model.segments(host, "/en/1")) <= 0


def test_held_out_names():
    """Every seventh labelled name held out: most are judged right from the words they share."""
    right = known = 0
    for fold in range(7):
        train = [[n for i, n in enumerate(names) if i % 7 != fold] for names in (url_filter.BLOCKED, url_filter.ALLOWED)]
        model = url_filter.Model(*train)
        for blocked, names in ((True, url_filter.BLOCKED), (False, url_filter.ALLOWED)):
            for name in names[fold::7]:
                score = model.score(model.segments(name.replace("-", ""), ""))
                if score:
                    known += 1
                    right += (score > 0) == blocked
    assert known > 20 and right >= 0.7 * known


@pytest.mark.parametrize(
    "html",
    ["<a '" * 100_000, "a > " + "<a <b " * 100_000, "<div>" * 60_000 + "x" + "</p>" * 60_000, "<nav>" * 60_000 + "</p>" * 60_000,
     "<p title=it's>w" * 50_000, "<!--" * 50_000, "</div>" * 60_000 + "x", "<script>" * 50_000],
)
def test_broken_markup_takes_linear_time(weights, html):
    import time

    start = time.process_time()
    assert isinstance(html_text.main_text(html, weights), str)
    assert time.process_time() - start < 15
