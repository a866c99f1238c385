"""Main text of HTML pages by a tree-structured graphical model.

Every block element is a binary node (content or not).  A node has a potential
from its own features and one for the pair it forms with its parent; messages
passed from the leaves up and back down give exact marginals, for all pages of
a batch at once, one depth at a time.  The weights are trained by gradient
ascent on the likelihood of a table of labelled pages, which ``labelled_pages``
builds from a seed; the gradient uses the same marginals.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)|<[!?/]")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-label)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
RAW = frozenset("script style noscript template textarea title iframe svg math select object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var button".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
TAGS = "p h1 h2 h3 h4 h5 h6 li ul ol div section article main nav header footer aside form table tr td blockquote pre figure figcaption body html head dl dt dd".split()
WORDS = {
    "chrome": "nav menu navbar breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot copyright sitemap skip site",
    "side": "sidebar side aside widget related recommended popular trending teaser promo rail",
    "notice": "cookie cookies consent notice banner alert gdpr popup modal overlay message disclaimer",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promotion dfp adslot advertorial",
    "form": "form login signup subscribe newsletter search register contact",
    "comment": "comment comments reply replies respond disqus discussion reader readers feedback",
    "share": "share social sharing tags meta byline author follow",
    "body": "content article post entry story main body text articlebody maincontent prose",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
FEATURES = ["bias", *(f"tag_{t}" for t in TAGS), "tag_other", *(f"word_{g}" for g in WORDS), "hidden", "no_text", "short", "long", "links", "some_links", "in_article", "in_body", "in_other"]
#: What the text itself and its surroundings say, whatever names a page uses.
FEATURES += ["sentence", "no_sentence", "in_prose", "prose_beside", "heading_beside", "parent_links", "most_text", "no_marks", "own_marks", "before_all", "behind_all"]
AT = {f: i for i, f in enumerate(FEATURES)}
#: Elements whose descendants are marked as lying inside something other than the article.
OTHER_TAGS = frozenset("nav footer aside form head".split())
#: The stop of a sentence.
STOP = re.compile("[.!?\u2026\u3002][\"')\u201d\u00bb]*(?=\\s|$)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_MARKS = frozenset(AT[f"word_{g}"] for g in ("chrome", "side", "notice", "advert", "form", "comment", "share")) | {AT["hidden"]}


class Page:
    """Block nodes of one page in page order, and their own text."""

    __slots__ = ("parent", "depth", "tag", "attrs", "text", "linked", "raw", "blocks")

    def __init__(self) -> None:
        self.parent, self.depth, self.tag, self.attrs, self.text, self.linked, self.raw = [], [], [], [], [], [], []
        #: (node, text pieces) of each stretch of text between block boundaries
        self.blocks: list[tuple[int, list[str]]] = []

    def add(self, parent: int, tag: str, attrs: str, raw: bool = False) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(0)
        self.linked.append(0)
        self.raw.append(raw)
        return len(self.parent) - 1


class Tags:
    """Comments, declarations and tags of a page, in one pass from the right and one from the left, whatever the markup.

    A tag ends at the first ``>`` outside quotes or, where a quote stays open to
    the end of the page, at the first ``>``; without any ``>`` behind it ``<`` is
    text.
    """

    def __init__(self, source: str):
        self.source = source
        self.at = [m.start() for m in SPECIAL.finditer(source)]
        n = len(self.at)
        #: where a tag ends whose attributes go on at each special character, and the next ``>``; -1 where there is none
        self.end, self.bracket = [-1] * (n + 1), [-1] * (n + 1)
        quote = {'"': n, "'": n}
        for i in range(n - 1, -1, -1):
            c = source[self.at[i]]
            if c == ">":
                self.end[i] = self.bracket[i] = self.at[i]
            else:
                self.bracket[i] = self.bracket[i + 1]
                self.end[i] = self.end[quote[c] + 1] if quote[c] < n else -1
                quote[c] = i

    def close(self, at: int, quoted: bool) -> int:
        """Where a tag that has reached ``at`` ends; -1 if it doesn't."""
        i = bisect_left(self.at, at)
        return self.end[i] if quoted and self.end[i] >= 0 else self.bracket[i]

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, stop, "/" of a closing tag, name, attributes) of the next one from ``at``; comments and declarations have no name."""
        source = self.source
        m = OPENING.search(source, at)
        if not m:
            return None
        if m[0] != "<!--":
            stop = self.close(m.end(), bool(m[2]))
            if stop >= 0:
                return m.start(), stop + 1, m[1] or "", (m[2] or "").lower(), source[m.end() : stop] if m[2] else ""
            # no bracket follows, so only a comment can
            start = source.find("<!--", m.start() + 1)
            if start < 0:
                return None
        else:
            start = m.start()
        stop = source.find("-->", start + 4)
        return start, stop + 3 if stop >= 0 else len(source), "", "", ""


def parse(source: str) -> Page:
    """A tolerant tree of block elements; inline markup, comments and raw elements leave no nodes."""
    page = Page()
    stack: list[tuple[str, int]] = [("", page.add(-1, "html", ""))]
    links, run, at, n = 0, None, 0, len(source)
    tags, opened = Tags(source), Counter()

    def leave(k: int) -> None:
        opened.subtract(name for name, _ in stack[k:])
        del stack[k:]

    while at <= n:
        m = tags.next(at)
        text = source[at : m[0] if m else n]
        if text:
            node = stack[-1][1]
            if run is None or run[0] != node:
                run = (node, [])
                page.blocks.append(run)
            run[1].append(text)
            size = len(text.strip())
            page.text[node] += size
            page.linked[node] += size if links else 0
        if not m:
            break
        _, at, close, name, attrs = m
        if not name:
            continue
        if name in RAW:
            if not close and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(source, at)
                end = tags.close(end.end(), False) if end else -1
                at = end + 1 if end >= 0 else n
                if name in ("noscript", "textarea", "select", "title"):
                    run = None
            continue
        if name == "a":
            links = 0 if close else 1
            continue
        if name in INLINE:
            continue
        if name in VOID:
            if name == "br" and run is not None:
                run[1].append(" ")
            elif name == "hr":
                run = None
            continue
        run = None
        if close:
            for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    leave(k)
                    links = 0
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] not in ("span", "font"):
                    break
            links = 0
        if name in IMPLIED:
            same, stop = IMPLIED[name]
            same = same.split()
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in same) else ():
                if stack[k][0] in stop:
                    break
                if stack[k][0] in same:
                    leave(k)
                    break
        if name in ("html", "body") and opened[name] > 0:
            continue
        node = page.add(stack[-1][1], name, attrs)
        if not attrs.endswith("/"):
            stack.append((name, node))
            opened[name] += 1
    return page


@lru_cache(maxsize=20_000)
def _marks(attrs: str) -> tuple[int, ...]:
    out = set()
    for name, value in ATTR.findall(attrs):
        if name.lower() == "hidden":
            out.add(AT["hidden"])
        for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            if w in GROUP:
                out.add(AT[f"word_{GROUP[w]}"])
    if re.search(r"display\s*:\s*none", attrs, re.I):
        out.add(AT["hidden"])
    return tuple(out)


def features(page: Page) -> np.ndarray:
    """One row of binary features per node."""
    n = len(page.parent)
    x = np.zeros((n, len(FEATURES)), np.float32)
    x[:, AT["bias"]] = 1
    text, linked = np.array(page.text, np.float64), np.array(page.linked, np.float64)
    total, total_l = text.copy(), linked.copy()
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
        total_l[page.parent[i]] += total_l[i]
    inside, body, other = [False] * n, [False] * n, [False] * n
    marks: list[tuple[int, ...]] = []
    for i in range(n):
        t = page.tag[i]
        x[i, AT.get(f"tag_{t}", AT["tag_other"])] = 1
        marks.append((_marks if len(page.attrs[i]) < 1000 else _marks.__wrapped__)(page.attrs[i]) if page.attrs[i] else ())
        for k in marks[i]:
            x[i, k] = 1
        p = page.parent[i]
        if p >= 0:
            inside[i] = inside[p] or page.tag[p] in ("article", "main")
            other[i] = other[p] or page.tag[p] in OTHER_TAGS or not OTHER_MARKS.isdisjoint(marks[p])
            body[i] = body[p] or AT["word_body"] in marks[p]
    ratio = total_l / np.maximum(total, 1)
    x[:, AT["no_text"]] = text == 0
    x[:, AT["short"]] = (text > 0) & (text < 40)
    x[:, AT["long"]] = text >= 120
    x[:, AT["links"]] = (total > 0) & (ratio > 0.6)
    x[:, AT["some_links"]] = (total > 0) & (ratio > 0.2)
    x[:, AT["in_article"]] = inside
    x[:, AT["in_body"]] = body
    x[:, AT["in_other"]] = other
    # sentences, and where the prose of the page lies: plain text outside anything marked as something else
    says = np.zeros(n, bool)
    for node, pieces in page.blocks:
        t = "".join(pieces).strip()
        says[node] |= " " in t and bool(STOP.search(t))
    parent = np.array(page.parent)
    kid = np.flatnonzero(parent >= 0)
    apart = np.array(other) | np.array([page.tag[i] in OTHER_TAGS or not OTHER_MARKS.isdisjoint(marks[i]) for i in range(n)], bool)
    plain = np.where(apart, 0, text - linked)
    prose = np.where(says, plain, 0)
    within = prose.copy()
    for i in range(n - 1, 0, -1):
        within[parent[i]] += within[i]
    whole = max(within[0], 1.0)
    beside, heads = np.zeros(n), np.zeros(n)
    np.add.at(beside, parent[kid], prose[kid])
    np.add.at(heads, parent[kid], [page.tag[k] in HEADINGS for k in kid])
    x[:, AT["sentence"]] = says & (ratio <= 0.6)
    x[:, AT["no_sentence"]] = (text > 0) & ~says
    x[:, AT["most_text"]] = within > 0.5 * whole
    x[kid, AT["in_prose"]] = within[parent[kid]] > 0.3 * whole
    x[kid, AT["prose_beside"]] = beside[parent[kid]] - prose[kid] > 0.15 * whole
    x[kid, AT["heading_beside"]] = heads[parent[kid]] > 0
    x[kid, AT["parent_links"]] = (ratio[parent[kid]] > 0.5) & (total[parent[kid]] > 0)
    x[:, AT["no_marks"]] = ~np.array([bool(m) for m in marks], bool)
    x[:, AT["own_marks"]] = apart & ~np.array(other)
    # before the first prose of the page, and behind the last
    first = np.flatnonzero((prose > 0.02 * whole) & says)
    if len(first):
        at = np.arange(n)
        x[:, AT["before_all"]] = at < first[0]
        x[:, AT["behind_all"]] = at > first[-1]
    return x


def marginals(parent: np.ndarray, depth: np.ndarray, unary: np.ndarray, pair: np.ndarray):
    """Sum-product on a forest: P(content) of each node, and the joint with its parent as n x 2 x 2.

    ``unary`` is n x 2 and ``pair`` is 2 x 2 (parent, child), all in logs.
    """
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
    inner = unary.copy()
    up = np.zeros((n, 2))  # message of a node to its parent
    for own in reversed(levels[1:]):
        up[own] = np.logaddexp(pair[:, 0] + inner[own, 0:1], pair[:, 1] + inner[own, 1:2])
        up[own] -= up[own].max(axis=1, keepdims=True)
        np.add.at(inner, parent[own], up[own])
    belief = inner.copy()
    for own in levels[1:]:
        rest = belief[parent[own]] - up[own]
        down = np.logaddexp(rest[:, 0:1] + pair[0], rest[:, 1:2] + pair[1])
        belief[own] = inner[own] + down - down.max(axis=1, keepdims=True)
    belief -= np.logaddexp(belief[:, 0], belief[:, 1])[:, None]
    kid = np.flatnonzero(parent >= 0)
    joint = np.zeros((n, 2, 2))
    joint[kid] = (belief[parent[kid]] - up[kid])[:, :, None] + pair[None] + inner[kid][:, None, :]
    top = joint[kid].max(axis=(1, 2), keepdims=True)
    joint[kid] = np.exp(joint[kid] - top)
    joint[kid] /= joint[kid].sum(axis=(1, 2), keepdims=True)
    return np.exp(belief[:, 1]), joint


def _forest(pages: list[Page]):
    sizes = [len(p.parent) for p in pages]
    base = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.where((q := np.array(p.parent)) >= 0, q + b, -1) for p, b in zip(pages, base)]) if pages else np.zeros(0, np.int64)
    depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
    x = np.concatenate([features(p) for p in pages]) if pages else np.zeros((0, len(FEATURES)), np.float32)
    return base, parent, depth, x


def labelled_pages(count: int = 320, seed: int = 11) -> list[tuple[str, list[str]]]:
    """The small table of labelled pages: (html, the text blocks that are content)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    pages = []
    for _ in range(count):
        good: list[str] = []
        bare = rng.random() < 0.45  # a page whose names say nothing
        name = lambda: rng.choice(["", f" class={word()}", f" id={word()}", f' class="{word()} c{rng.randint(1, 99)}"', " class=top", " class=txt", " class=col", " class=box", " style='margin:0'"]) if bare else ""  # noqa: E731,B023

        def keep(tag: str, a: int, b: int) -> str:
            t = say(a, b)
            good.append(t)
            link = f' <a href="/x">{word()}</a>' if rng.random() < 0.2 else ""
            if link:
                good[-1] = t + " " + re.sub("<[^>]*>", "", link).strip()
            return f"<{tag}>{t}{link}</{tag}>"

        menu = lambda c: f'<{c}><ul>{"".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randint(3, 9)))}</ul></{c.split()[0]}>'
        before = [menu(f"div{name()}" if bare else rng.choice(["nav", "div class=menu", 'div id="navbar"', "nav class=breadcrumb"]))]
        if bare and rng.random() < 0.5:
            before.append(f"<div{name()}>" + " | ".join(f"<a href=/{word()}>{word()}</a>" for _ in range(rng.randint(2, 7))) + "</div>")
        if bare and rng.random() < 0.3:
            before.append(f"<div{name()}>{word().capitalize()} {word()}</div>")
        if rng.random() < 0.5:
            before.append(f'<header class="site-header"><h2>{say(1, 3)}</h2><p>{say(3, 8)}</p></header>')
        if rng.random() < 0.6:
            before.append(f'<div class="{rng.choice(["ad", "advert", "ads top", "sponsored", "promo-box ad"])}">{say(4, 30)}</div>')
        if rng.random() < 0.4:
            before.append(f'<div class="{rng.choice(["cookie-notice", "notice", "consent banner", "alert"])}"><p>{say(5, 30)}</p></div>')
        if rng.random() < 0.3:
            before.append(f'<aside class="sidebar"><h3>{say(1, 3)}</h3><p>{say(5, 40)}</p></aside>')
        body = [keep("h1", 2, 10)]
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.65:
                body.append(keep("p", 1, 80))
            elif r < 0.72:
                body.append(keep("h2", 1, 6))
            elif r < 0.79:
                body.append("<ul>" + "".join(keep("li", 1, 15) for _ in range(rng.randint(2, 4))) + "</ul>")
            elif r < 0.83:
                body.append("<blockquote>" + keep("p", 4, 40) + "</blockquote>")
            elif r < 0.845:
                body.append(keep("div", 2, 60))
            elif r < 0.855:
                body.append("<div><div>" + keep("p", 2, 60) + keep("div", 2, 20) + "</div></div>")
            elif r < 0.87:
                body.append("<table>" + "".join("<tr>" + keep("td", 1, 5) + keep("td", 1, 5) + "</tr>" for _ in range(2)) + "</table>")
            elif r < 0.91:
                body.append(f'<div class="{rng.choice(["ad", "advert inline", "sponsored", "newsletter"])}"><p>{say(3, 40)}</p></div>')
            elif r < 0.94:
                body.append(f"<aside><p>{say(4, 40)}</p></aside>")
            elif r < 0.97:
                body.append(f"<section>{keep('h3', 1, 5)}{keep('p', 3, 50)}</section>")
            elif r < 0.98:
                body.append(f'<div class="{rng.choice(["related-content", "related-posts box", "share-links", "read-more related", "newsletter-signup content"])}"><h3>{say(1, 4)}</h3><p>{say(3, 30)}</p></div>')
            else:
                body.append(f"<form><p>{say(2, 12)}</p><label>{say(1, 3)}</label><input></form>")
        if rng.random() < 0.15:
            body.append("<dl>" + "".join(keep("dt", 1, 3) + keep("dd", 2, 20) for _ in range(2)) + "</dl>")
        if rng.random() < 0.15:
            body.append("<figure><img src=x>" + keep("figcaption", 2, 12) + "</figure>")
        if rng.random() < 0.1:
            body.append("<pre>" + (code := word() + " " + word()) + "</pre>")
            good.append(code)
        comments = ""
        if rng.random() < 0.5:
            c = rng.choice(['section class="comments"', 'div id="comments"', 'div class="reader-comments"', 'ol class="comment-list"', "div id=disqus_thread"])
            comments = f'<{c}><h3>{say(1, 3)}</h3>' + "".join(f'<div class="{rng.choice(["comment", "reply", "c"])}"><p>{say(3, 70)}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{c.split()[0]}>"
        wrap = rng.choice(["article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post entry"', "main><article"])
        if bare:
            wrap = rng.choice(["div", "div", "div><div", "section", "div><div><div", "center"])
            wrap = "><".join(w + name() for w in wrap.split("><"))
        inside = rng.random() < 0.4
        close = "".join(f"</{w.split()[0]}>" for w in reversed(wrap.split("><")))
        main = f"<{wrap}>" + "".join(body) + (comments if inside else "") + close
        after = [] if inside else [comments]
        if rng.random() < 0.4:
            after.append(f'<div class="{rng.choice(["sidebar", "related", "widget"])}"><h3>{say(1, 4)}</h3><ul>' + "".join(f"<li><a href=/>{say(2, 8)}</a></li>" for _ in range(4)) + f"</ul><p>{say(4, 40)}</p></div>")
        if rng.random() < 0.3:
            after.append(f'<form class="{rng.choice(["search", "signup", "login"])}"><p>{say(2, 20)}</p><input type=text></form>')
        if rng.random() < 0.85:
            after.append(rng.choice([f"<footer>{say(3, 15)}</footer>", f"<footer><p>{say(3, 20)}</p></footer>", f'<div class="footer">{say(2, 12)}</div>']))
        if bare and rng.random() < 0.6:
            after.append(f"<div{name()}>" + " ".join(f"<a href=/{word()}>{word()}</a>" for _ in range(rng.randint(2, 5))) + f" {word().capitalize()} 2{rng.randint(100, 999)}</div>")
        left, right = "".join(before), "".join(after)
        if bare and rng.random() < 0.3:  # laid out in a table
            rows = [f"<tr><td colspan=2>{before[0]}</td></tr>", f"<tr><td{name()}>{menu('div')}</td><td{name()}>{main if rng.random() < 0.5 else ''.join(body) + (comments if inside else '')}</td></tr>", f"<tr><td colspan=2>{right}</td></tr>"]
            left, main, right = "".join(before[1:]), f"<table{name()}>" + "".join(rows) + "</table>", ""
        if bare and rng.random() < 0.4:
            left, right = f"<div{name()}>{left}", f"{right}</div>"
        pages.append(("<html><head><title>x</title></head><body>" + left + main + right + "</body></html>", good))
    return pages


def _clean(pieces: list[str]) -> str:
    return " ".join(_html.unescape("".join(pieces)).split())


@lru_cache(maxsize=1)
def train(count: int = 320, seed: int = 11, steps: int = 250, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features,) and pair potentials (2, 2), by gradient ascent on the likelihood of the labelled pages."""
    pages, target = [], []
    for source, good in labelled_pages(count, seed):
        page, good = parse(source), set(good)
        y = np.full(len(page.parent), -1)
        for node, pieces in page.blocks:
            if t := _clean(pieces):
                y[node] = int(t in good)
        kids: dict[int, list[int]] = {}
        for i in range(len(y) - 1, -1, -1):  # an element without text of its own counts as content if it holds some
            if y[i] < 0:
                y[i] = int(any(y[k] for k in kids.get(i, [])))
            kids.setdefault(page.parent[i], []).append(i)
        pages.append(page)
        target.append(y)
    _, parent, depth, x = _forest(pages)
    y = np.concatenate(target)
    kid = np.flatnonzero(parent >= 0)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[kid]], y[kid]), 1)
    vw, vp = np.zeros_like(w), np.zeros_like(pair)
    for _ in range(steps):
        unary = np.stack([np.zeros(len(y)), x @ w], axis=1)
        p, joint = marginals(parent, depth, unary, pair)
        gw = x.T @ (y - p) / len(y) - ridge * w
        gp = (seen - joint.sum(axis=0)) / len(y) - ridge * pair
        vw, vp = 0.9 * vw + gw, 0.9 * vp + gp
        w, pair = w + 2.0 * vw, pair + 2.0 * vp
    return w, pair


def extract_texts(sources: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page, the blocks in page order joined by newlines."""
    w, pair = model
    pages = [parse(s or "") for s in sources]
    base, parent, depth, x = _forest(pages)
    if not pages:
        return []
    p, _ = marginals(parent, depth, np.stack([np.zeros(len(x)), x @ w], axis=1), pair)
    return ["\n".join(t for node, pieces in page.blocks if p[b + node] > 0.5 and (t := _clean(pieces))) for page, b in zip(pages, base)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null page is empty and has the empty text; pages without content too.
    Repeated rows keep their rows.  Extra columns are not read, and an empty table
    gives an empty one.
    """
    # a few kilobytes of weights, whatever the number of pages
    model = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                texts = extract_texts(part.column(2).to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
