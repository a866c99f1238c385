"""Main text of pages written by hand, in layouts the training pages are not drawn from: tables, bare wrappers, frames of links, odd names."""

import re
import time
from collections import Counter

import pytest

from numera.llm import html

# H, A, B, C stand for the heading and three paragraphs, L and M for two short points
LAYOUTS = [
    "<div id=page><div class=top><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div class=txt><h1>H</h1><p>A</p><p>B</p><ul><li>L</li><li>M</li></ul><p>C</p></div><div class=bottom><a href=/i>Imprint</a> 2019</div></div>",
    "<table width=100%><tr><td colspan=2><img src=logo.gif> <a href=/>Start</a></td></tr><tr><td valign=top><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><h1>H</h1><p>A<p>B<p>C</td></tr><tr><td colspan=2><font size=1><a href=/legal>Legal</a></font></td></tr></table>",
    "<div><h1>H</h1><p>A</p><p>B</p><p>C</p></div>",
    "<body><h1>H</h1><p>A</p><p>B</p><p>C</p></body>",
    "<section><header><h1>H</h1></header><p>A</p><p>B</p><blockquote>C</blockquote></section><footer><p>All rights reserved.</p></footer>",
    "<div class=wrapper><div class=row><div class=col-3><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a><li><a href=/g>Gamma</a></ul></div><div class=col-9><h2>H</h2><p>A</p><div><p>B</p></div><p>C</p></div></div></div>",
    "<article><h1>H</h1><p>A</p><div class='related-content'><h3>More of this</h3><ul><li><a href=/x>Another story</a></li><li><a href=/y>And one more</a></li></ul></div><p>B</p><p>C</p></article>",
    "<main><h1>H</h1><p>A</p><p>B</p><p>C</p></main><section id=comments><h3>2 comments</h3><div class=comment><p>I liked that a lot, thank you.</p></div><div class=comment><p>So did I, see you next week.</p></div></section>",
    "<div id=cookie-consent><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class='post-body'><h1>H</h1><p>A</p><p>B</p><p>C</p></div><aside><h4>Popular</h4><a href=/p>This week's most read story</a></aside>",
    "<center><table><tr><td><h1>H</h1></td></tr><tr><td><p>A</p><p>B</p></td></tr><tr><td><p>C</p></td></tr></table></center>",
    "<div><div><div><div><h1>H</h1></div><div><p>A</p><p>B</p><p>C</p></div></div></div></div><div><a href=/1>1</a> <a href=/2>2</a> <a href=/3>3</a></div>",
    "<nav><a href=/>Home</a></nav><div><h1>H</h1><p>A</p><div class='ad-slot advert'><p>Buy two, get one free, only today.</p></div><p>B</p><p>C</p></div><form action=/s><p>Search this site</p><input name=q></form>",
    "<div class=shell><div class=masthead>The Daily Paper</div><div class=story><h1>H</h1><p>A</p><p>B</p><h2>L</h2><p>C</p></div><div class=newsletter-signup><p>Get our letter every Monday by mail.</p></div></div>",
    "<div style='width:700px'><b><a href=/>Back</a></b><hr><h2>H</h2>\n<p>A\n<p>B\n<p>C\n<hr><a href=/prev>Previous</a> <a href=/next>Next</a></div>",
    "<div role=banner><a href=/>Site</a></div><div role=main><h1>H</h1><p>A</p><p>B</p><dl><dt>L</dt><dd>C</dd></dl></div><div role=contentinfo><p>Made by us in the north.</p></div>",
]
TEXTS = [
    {"H": "A bridge is planned", "A": "The committee met on Tuesday and discussed the plan for the new bridge at length.", "B": "Costs were weighed by three experts, none of whom agreed.", "C": "A vote is expected before the summer, when the river is low and work could begin.", "L": "Two lanes for cars", "M": "One path for bicycles"},
    {"H": "Wie man Brot backt", "A": "Zuerst wird das Mehl mit lauwarmem Wasser und etwas Salz zu einem festen Teig verknetet.", "B": "Dann ruht er.", "C": "Nach einer Stunde im heißen Ofen ist die Kruste braun, und das ganze Haus riecht nach frischem Brot!", "L": "Ein Pfund Mehl", "M": "Ein Löffel Salz"},
]


def pages():
    for layout in LAYOUTS:
        for t in TEXTS:
            want = [t[x] for x in re.findall(r"(?<![\w'/#])[HABCLM](?![\w'])", layout)]
            yield "<!doctype html><html><head><title>t</title></head>" + re.sub(r"(?<![\w'/#])([HABCLM])(?![\w'])", lambda m, t=t: t[m[1]], layout) + "</html>", want


def test_blocks_of_thirty_pages():
    sources, wanted = zip(*pages())
    assert len(sources) == 30
    found = [x.split("\n") if x else [] for x in html.extract_texts(list(sources), html.train())]
    hit = gave = asked = 0
    for got, want in zip(found, wanted):
        hit += sum((Counter(got) & Counter(want)).values())
        gave, asked = gave + len(got), asked + len(want)
        assert len(set(got) & set(want)) >= len(want) - 1, (got, want)
    assert 2 * hit / (gave + asked) >= 0.95, (hit, gave, asked)


@pytest.mark.parametrize("tag", ["div", "span", "ul", "td"])
def test_deep_pages_take_linear_time(tag):
    start = time.time()
    html.extract_texts([f"<{tag}>" * 5_000 + "x"], html.train())
    one = time.time() - start
    start = time.time()
    html.extract_texts([f"<{tag}>" * 40_000 + "x"], html.train())
    assert time.time() - start < 12 * one + 1
