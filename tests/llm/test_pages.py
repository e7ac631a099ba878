"""Page extraction: layouts, hosts, and pages made to be slow."""

import time

import pytest

from scorelake.llm import webtext

WORDS = "word, more running text of the article. " * 8
ARTICLE = WORDS.strip()
P = f"<p>{WORDS}</p>"
NOTE = "<p>a short note outside of it all, here</p>"


def own(html):
    page = webtext.read(html)
    return webtext.under(page, webtext.best_of(webtext.containers(page)))


@pytest.mark.parametrize("layout", [
    '<div class="content has-sidebar">{}</div>', '<div class="content-with-sidebar">{}</div>', '<div class="post no-comments">{}</div>',
    '<section class="story side-story">{}</section>', '<div class="layout-sidebar-right"><main>{}</main></div>',
    '<div class="search-result-page"><article>{}</article></div>', '<form id="aspnetForm"><div>{}</div></form>',
    '<div class="article">{}<div class="post-comments">' + P * 3 + "</div><form>a form of some length, not needed</form></div>",
    '<article>{}<div class="sidebar-right">' + P * 2 + '</div><ul class="related-posts"><li>' + P + "</li></ul></article>",
    '<div class="post">{}</div><footer><main>' + P * 4 + "</main></footer>", '<div>{}</div><div class="site-footer">' + P * 3 + "</div>"])
def test_layouts_lose_no_text(layout):
    assert own(f"<html><body>{NOTE}{layout.format(P)}</body></html>") == ARTICLE
    assert own(f"<html><body>{layout.format(P)}</body></html>") == ARTICLE


def test_marks_of_names():
    marked = ["sidebar", "site-footer", "main-nav", "comment-list", "cookie_notice", "sidebar-left", "related-posts", "post-comments", "skip-link"]
    assert [webtext.name_mark(n) for n in marked] == [webtext.MARKED] * len(marked)
    plain = ["content", "has-sidebar", "no-comments", "with-ads", "story", "shareholders-report", "layout-sidebar-right"]
    assert [webtext.name_mark(n) for n in plain] == [webtext.PLAIN] * 6 + [webtext.PLAIN]
    assert {webtext.name_mark(n) for n in ("search-result-page", "side-story", "sidebar-content")} == {webtext.DOUBT}


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a " * 350_000 + ">", "<a '>" * 150_000, "<div>" * 100_000 + "x" + "</p>" * 100_000,
                                  "<div>some running text, long enough to count" * 20_000, "<b>" * 80_000 + "</i>" * 80_000])
def test_broken_pages_take_linear_time(html):
    start = time.time()
    own(html)
    assert time.time() - start < 6


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")


def test_host_votes(spark):
    """Slug ids don't split the votes, a small shared box doesn't win them, and other pages of the host follow its path."""
    box = '<div class="author"><p>About the author of this page, in some running words.</p></div>'
    rows = [(k, f"http://a.example/{k}", f'<body><div id="why-cats-sleep-{"abcdefghij"[k % 10]}x{k}" class="entry"><p>Text {k}. {WORDS}</p></div>{box}</body>') for k in range(300)]
    rows += [(1000 + k, f"http://b.example/{k}", f'<body><div class="per-page-q{chr(97 + k % 26)}{chr(97 + k // 26)}"><p>Text {k}. {WORDS}</p></div>{box}</body>') for k in range(300)]
    # This page's own best container would be the quoted one.
    rows.append((2000, "http://a.example/q", f'<body><div class="entry"><p>Own text. {WORDS}</p></div><div class="quoted"><p>{WORDS * 2}</p></div></body>'))
    rows += [(3000, None, f"<body><div>{P}</div></body>"), (3001, "http://a.example/", None), (3002, "http://a.example/", ""), (None, "http://a.example/", "<p>")]
    got = {r.page_id: r.text for r in webtext.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k in range(300):
        assert got[k] == got[1000 + k] == f"Text {k}. {ARTICLE}"
    assert got[2000] == f"Own text. {ARTICLE}"
    assert (got[3000], got[3001], got[3002], got[None]) == (ARTICLE, "", "", "")


def test_votes_equal_a_plain_count(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", f'<body><div class="{"ab"[k % 3 > 0]}">{P}</div><section><p>{"more words, " * (k % 5 * 4)}</p></section></body>') for k in range(40)]
    want: dict = {}
    for k, _, html in rows:
        scores = webtext.containers(webtext.read(html))
        whole = sum(s for s, _ in scores.values())
        for p, (s, _) in scores.items():
            want.setdefault(f"h{k % 2}.example", {}).setdefault(p, 0.0)
            want[f"h{k % 2}.example"][p] += s / whole
    got = {r.host: r.paths for r in webtext.votes(pages(spark, rows), "url", "html").collect()}
    for host, votes in want.items():
        most = max(votes.values())
        assert got[host] == sorted((p for p in votes if votes[p] * 10 >= most), key=lambda p: (-round(votes[p], 4), p))
