"""Main texts against an extractor of its own kind, names that only look like furniture, broken markup, and time that grows with the length."""

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
import pyarrow.parquet as pq

from tests.llm.test_text_operators import prose
from tidemark.llm.html import BLOCK, VOID, main_text, name_kind

P = "<p>Real article text, long enough, with commas, and more words to be counted here.</p>"
WANT = "Real article text, long enough, with commas, and more words to be counted here."


class Plain(HTMLParser):
    """Blocks within <article>, by the standard library's parser; nothing is scored."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.piece, self.silent = 0, [], [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.piece).split())
        self.piece = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("script", "style", "aside", "form"):
            self.silent += 1
        if tag == "br":
            self.piece.append(" ")
        elif tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if tag == "article":
            self.depth -= 1
        if tag in ("script", "style", "aside", "form"):
            self.silent -= 1

    def handle_data(self, data):
        if self.depth and not self.silent:
            self.piece.append(data)


def test_an_independent_extractor_agrees_on_the_pages():
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no test data")
    pages = pq.read_table(path)["html"].to_pylist()
    assert len(pages) > 100 and all(main_text(p) == "\n".join(Plain(p).blocks) for p in pages)


def test_an_independent_extractor_agrees_on_made_pages():
    rng = random.Random(5)
    for _ in range(100):
        parts = []
        for _ in range(rng.randint(3, 12)):
            text = prose(rng, rng.randint(3, 40))
            parts.append(rng.choice(["<p>%s</p>", "<h2 id=discussion>%s</h2>", "<ul><li>%s</li></ul>", "<p class='lead notice-of-war'>%s<br>and &amp; so</p>", "<div><p>%s</p></div>", "<aside>%s</aside>", "<form><p>%s</p><input></form>", "<blockquote>%s, said <b>who</b></blockquote>", "<table><tr><td>%s</td></tr></table>"]) % text)
        article = f"<article><h1>Title</h1>{P}{''.join(parts)}</article>"
        page = f"<body><nav><a href=/>x</a></nav><div class='cookie-notice'><p>{prose(rng, 60)}, yes, no</p></div>{article}<div id=comments><p>{prose(rng, 80)}, a, b, c</p></div><footer>f</footer></body>"
        assert main_text(page) == "\n".join(Plain(article).blocks)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p title="x>hello there</p>', "hello there"),
        (f'<nav><a>x</a></nav><div class="social-science">{P}{P}</div>', f"{WANT}\n{WANT}"),
        (f'<div class="entry" id="cookie-recipes">{P}</div><div class="cookie-notice"><p>We use them.</p></div>', WANT),
        (f'<article><h1>T</h1>{P}<h2 id="discussion">D</h2><p>One, two.</p><h2 id="feedback">F</h2><section id="related-work"><h2>RW</h2><p>b</p></section><section id="discussion"><p>Words of it.</p></section></article>', f"T\n{WANT}\nD\nOne, two.\nF\nRW\nb\nWords of it."),
        (f"<article><h1>T</h1>{P}</article><article><p>Part two, is short.</p></article>", f"T\n{WANT}\nPart two, is short."),
        (f"<main><h1>T</h1><p>Lead.</p><div><article>{P}</article></div></main>", f"T\nLead.\n{WANT}"),
        (f"<form id=page><div><h1>T</h1>{P}<input></div></form>", f"T\n{WANT}"),
        (f'<div class="content-sidebar-wrap"><div class=entry>{P}</div><div class="sidebar"><p>s, s, s</p></div></div>', WANT),
        (f'<article><div class="post-header"><h1>T</h1></div>{P}<div class="comment-list"><p>Great, post.</p></div></article>', f"T\n{WANT}"),
        (f"<article>{P}<p>an <a href=x>open link<p>and text", f"{WANT}\nan open link\nand text"),
        (f"<article><h1>T</h2>{P}<table><tr><td><p>a</div>b</table></article>", f"T\n{WANT}\nab"),
        (f"<article>{P}<p>1 < 2 &lt; 3 <3 </ p>x<!-->y--><!doctype z></article>", f"{WANT}\n1 < 2 < 3 <3 xy-->"),
        (f"<article><section class=replies><p>Nice, very nice.</p></section>{P}</article>", WANT),
    ],
)
def test_names_and_markup(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == want


def test_names():
    assert [name_kind(x) for x in ("comments", "commentList", "site-footer", "cookie_notice", "ad-slot-1", "replies", "commentary", "social-science", "entry-header", "with-sidebar", "content")] == [3, 3, 2, 2, 2, 1, 0, 0, 0, 0, 0]


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '\"", "<p x=\"", "<div>", "<b>", "<", "<!--", "<!-- --", "<p>a", "<li>x<ul>", "</div>", "<table><td>", "<a>x", "&", "<script></script ", "= \"", "x ", "<header><h1>", "<p a=", "</", "<article>", "<form>"])
def test_a_page_of_a_megabyte_takes_seconds(piece):
    page, start = piece * (1_000_000 // len(piece)), time.process_time()
    main_text(page + '"')
    assert time.process_time() - start < 12 and len(VOID) > 5
