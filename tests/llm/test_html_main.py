import random
import time
from html import escape
from html.parser import HTMLParser

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.llm import html_main as h

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">A long advert text that would look like prose to a machine.</div>'
    "<article><h1>T &amp; t</h1><p><b>First  line<br><p>Sec&#111;nd\n line &lt;b&gt;.</p><div class='ad-box'><div>Buy</div> now</div><p>End.</p></article>"
    '<section class="comments"><p>Great read, thanks for sharing all of this with us, dear author of it.</p></section><footer>&copy; x</footer></body></html>'
)


def test_article():
    assert h.main_text(PAGE)[0] == "T & t\nFirst line\nSecond line <b>.\nEnd."


def test_cut_page():
    assert h.main_text(PAGE[: PAGE.index("<section")])[0] == "T & t\nFirst line\nSecond line <b>.\nEnd."
    assert h.main_text(PAGE[: PAGE.index("End.") + 2])[0].endswith("\nEn")


def test_no_article():
    long = "word " * 30
    page = f"<body><div><a href=x>one</a></div><div><a href=y>two</a></div><div>x</div><div></div><div></div><div></div><div></div><p>{long}</p><p>Short.</p><p>{long}</p><div></div><div></div><div></div><div></div><div>tail</div></body>"
    assert h.main_text(page)[0] == f"{long.strip()}\nShort.\n{long.strip()}"


def test_nothing():
    for page in (None, "", "<html></html>", "<!-- <p>x</p> ", "<script>a"):
        assert h.main_text(page) == ("", 0, 0)


def brute_stretches(sizes, threshold):
    """Surge: the first line with text whose window holds more than the threshold; dive: the next blank line whose
    window doesn't, or the next line whose window is empty."""
    window = [sum(sizes[k : k + h.WINDOW]) for k in range(len(sizes))]
    out, k = [], 0
    while True:
        surge = next((i for i in range(k, len(sizes)) if window[i] > threshold and sizes[i]), None)
        if surge is None:
            return out
        k = next((i for i in range(surge + 1, len(sizes)) if not sizes[i] and (window[i] <= threshold or not window[i])), len(sizes))
        out.append((surge, k))
        k += 1


def test_surge_and_dive():
    assert h.stretches([0, 0, 50, 50, 0, 0, 0, 0, 90], 80) == [(2, 4), (8, 9)]
    assert h.stretches([], 0) == [] and h.stretches([80, 0, 0], 80) == [] and h.stretches([81], 80) == [(0, 1)]
    assert h.stretches([90, 0, 90], 80) == [(0, 3)] and h.stretches([90, 0, 0, 0, 90], 80) == [(0, 1), (4, 5)]  # ties with the threshold, and joined stretches


@given(st.lists(st.sampled_from([0, 0, 0, 1, 30, 40, 80, 81, 200]), max_size=30), st.sampled_from([0, 80]))
def test_stretches_equal_brute(sizes, threshold):
    assert h.stretches(sizes, threshold) == brute_stretches(sizes, threshold)


def test_stretches_decide_what_is_kept():
    long, blank = "word " * 30, "<div></div>" * 4
    page = f"<div>By a writer</div>{blank}<p>{long}</p><p>Short.</p>{blank}<div>Elsewhere</div>{blank}<p>{long}</p>"
    assert h.main_text(page)[0] == f"{long.strip()}\nShort.\n{long.strip()}"  # lines far from text go
    assert [x[0] for x in h.lines_of(page) if x[0]] == ["By a writer", long.strip(), "Short.", "Elsewhere", long.strip()]


def test_names_in_the_middle_are_no_noise():
    text = "A paragraph of the article that goes on for a while. " * 6
    for name in ("elementor-widget-text-editor", "no-sidebar", "layout-menu-page", "x_share_y", "blog-post"):
        assert h.main_text(f"<div class='{name}'><p>{text}</p></div>")[0] == text.strip(), name
    for name in ("widget", "widget-area", "site-footer", "post comments-list", "top menu", "cookie-notice", "ad-box", "my_ad"):
        assert h.main_text(f"<article><p>One.</p><div class='{name}'>Two.</div></article>")[0] == "One.", name


def test_drawings_that_close_themselves():
    page = "<article><p>One.</p><svg class=a /><math/><p>Two.</p><svg><text>x</text></svg><p>Three.</p></article>"
    assert h.main_text(page)[0] == "One.\nTwo.\nThree."


def test_broken_pages_take_linear_time():
    for piece in ("<a ", "<svg ", "<!", "<a \"", "<p x='", "<!-- ", "<div class='menu' ", "&", "<script ", "</", "<a b=\"'"):
        took = []
        for n in (20_000, 80_000):
            start = time.process_time()
            h.main_text("<article>" + piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 12 * took[0] + 0.5, piece


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 2), (2, None, None, 3), (None, "v", "", 4)], "page_id long, url string, html string, n_chars int")
    rows = h.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, 38), (1, 38), (2, 0)]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert h.extract(pages.limit(0)).count() == 0


def test_all_sections_without_article():
    a, b = "a" * 300, "b" * 200
    page = f"<div><div><p>{a}</p></div></div><div><div><h2>Next</h2><p>{b}</p></div></div>"
    assert h.main_text(page)[0] == f"{a}\nNext\n{b}"
    many = "".join(f"<div><div><div><div><p>{c * 120}</p></div></div></div></div>" for c in "abcde")
    assert h.main_text(many)[0] == "\n".join(c * 120 for c in "abcde")


def test_wrapper_of_an_article_is_no_noise():
    text = "<article><h1>T</h1><p>One.</p></article>"
    for wrap in ('div class="page no-sidebar"', 'div id="has-sidebar"', "div class='with-left-sidebar'", 'div class="widget"', 'section class="sidebar-left social"', 'x-app class="banner"', 'form id="f"', "div hidden"):
        page = f"<body><nav>Menu</nav><{wrap}><div class='ad'>Buy</div>{text}<div class=comments><p>Nice.</p></div></{wrap.split()[0]}><p>After</p></body>"
        assert h.main_text(page)[0] == "T\nOne.", wrap
    page = f"<main><div class='menu-layout'>{text}</div></main>"
    assert h.main_text(page)[0] == "T\nOne."


def test_noise_stays_noise():
    text = "<article><p>One.</p></article>"
    reader = "<article><p>A long reply by a reader, longer than the article.</p></article>"
    for wrap in ("section class=comments", "aside class=related", "div id=related-posts", "div class='comment-list has-avatars'"):
        assert h.main_text(f"<body>{text}<{wrap}>{reader}</{wrap.split()[0]}></body>")[0] == "One.", wrap
    form = f"<form id=f>{text}<section class=comments>{reader}</section></form>"
    assert h.main_text(form)[0] == "One."
    only = f"<section class=comments>{reader}</section>"
    assert h.main_text(only)[0].startswith("A long reply")
    ad = "<div class='no-ads sidebar'>Buy this and that</div>"
    assert h.main_text(f"<article><p>One.</p>{ad}</article>")[0] == "One."
    assert h.main_text("<article><p>One.</p><div class=no-sidebar>Two.</div></article>")[0] == "One.\nTwo."


def test_names_of_what_a_text_is_about():
    text = "A paragraph of some length that stands in a part of an article and has to stay there. " * 3
    for part in ('div class="widget-text"', 'div class="post-share"', 'p class="alert-free"', 'section class="copyright-law"', 'section id="social-sciences"', 'section id="navigation-systems"'):
        for page in (f"<article><h1>T</h1><{part}>{text}</{part.split()[0]}></article>", f"<body><h1>T</h1><{part}>{text}</{part.split()[0]}></body>"):
            assert h.main_text(page)[0] == f"T\n{text.strip()}", page


def test_short_pages_are_not_lost():
    assert h.main_text("<body><p>Short page text.</p></body>")[0] == "Short page text."
    assert h.main_text("<body><nav><a href=x>Menu</a></nav><h1>T</h1><p>x</p><div><a href=y>More of it</a></div></body>")[0] == "T\nx"


def test_runs_of_links_in_an_article_are_menus():
    """Surge and dive decide inside a marked article as well: three lines of links make a dive, one or two don't."""
    links = "".join(f"<li><a href=/{k}>Another page of this site {k}</a></li>" for k in range(4))
    page = f"<article><h1>T</h1><p>One.</p><ul>{links}</ul><p>See <a href=x>this</a>.</p><p><a href=y>A source of it</a></p><p>End.</p><ul>{links}</ul></article>"
    assert h.main_text(page)[0] == "T\nOne.\nSee this.\nA source of it\nEnd."
    assert h.main_text("<article><p>One.</p><p><a href=y>A source</a></p><p><a href=z>Another</a></p></article>")[0] == "One.\nA source\nAnother"


def test_nested_wrappers_take_linear_time():
    took = []
    for n in (5_000, 20_000):
        start = time.process_time()
        assert h.main_text("<div class='menu'>" * n + "<article><p>One.</p></article>" + "</div>" * n)[0] == "One."
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_long_pages_are_whole():
    words = "word " * 400_000
    assert h.main_text(f"<article><p>{words}</p>" + "<p>x</p>" * 50_000 + "</article>")[0] == words.strip() + "\nx" * 50_000


class Tree(HTMLParser):
    """A plain version for well-formed pages with one marked article: its blocks, noisy elements left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks, self.stack = 0, 0, [""], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " "
            return
        noisy = tag in ("nav", "aside", "footer", "form", "script", "style") or dict(attrs).get("class") in ("ad", "comments", "site-footer", "cookie-notice")
        self.stack.append((tag, noisy))
        self.skip += noisy
        self.inside += tag == "article"
        if tag not in ("b", "a", "i"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "br":
            return
        found, noisy = self.stack.pop()
        self.skip -= noisy
        if tag not in ("b", "a", "i"):
            self.blocks.append("")
        self.inside -= found == "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


@pytest.mark.parametrize("seed", range(150))
def test_marked_pages_equal_a_plain_parser(seed):
    r = random.Random(seed)

    def words():
        return escape(" ".join(r.choice(["word", "ä  é", "a<b", "x&y", "\n", "end."]) for _ in range(r.randint(1, 6))))

    def part(depth=0):
        kind = r.random()
        if depth > 3 or kind < 0.5:
            return f"<p>{words()}<b>{words()}</b><br>{words()}</p>"
        if kind < 0.8:
            tag = r.choice(["div", "section", "blockquote", "ul"])
            return f"<{tag} class='{r.choice(['x', 'ad-hoc', 'lead', 'related-work', 'post'])}'>" + "".join(part(depth + 1) for _ in range(r.randint(0, 3))) + f"</{tag}>"
        tag, name = r.choice([("div", "ad"), ("section", "comments"), ("nav", ""), ("aside", "x"), ("form", ""), ("div", "site-footer"), ("div", "cookie-notice"), ("script", "")])
        return f"<{tag} class='{name}'>{'' if tag == 'script' else part(9)}</{tag}>"

    page = f"<html><body><nav><ul><li><a href=x>{words()}</a></li></ul></nav>{part()}<article><h1>{words()}</h1>{''.join(part() for _ in range(5))}</article>{part()}<footer>{words()}</footer></body></html>"
    tree = Tree()
    tree.feed(page)
    assert h.main_text(page)[0] == "\n".join(x for x in (" ".join(b.split()) for b in tree.blocks) if x)
