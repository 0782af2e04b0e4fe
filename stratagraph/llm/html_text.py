"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks: stretches of text between block elements, with their
ancestors. Each block has features of its ancestors (tags, classes, ids, roles) and of its text;
a chain of labels (main text or not) with transition weights is trained by conditional likelihood on
labelled pages (``labelled_pages``, made here in many layouts) and decoded by Viterbi.

Character references are decoded, white space inside a block becomes one space, blocks
are joined in page order by two line feeds. Scripts, styles, templates, form controls, comments and
the head are never blocks. Nulls: a null or empty page, or one without main text, gives an empty text. Repeated rows are each
returned, an empty table gives no rows, clashing output names get underscores. Pages of any length and nesting are parsed in one pass, in time
proportional to their length; unclosed elements end with the page. Quotes in tags protect ">"; once a tag's
quotes don't end, they protect nothing in the rest of the page.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"""((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "template", "svg", "iframe", "select", "button")}
#: What may lack an end tag; then only the start tag goes. A button or select ends at the next one too.
_MAY_STAY_OPEN = frozenset(("template", "svg", "iframe", "select", "button"))
_NEXT = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in ("select", "button")}
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
# fixed values: HTML elements by role
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"body", "html", "head"}
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that leave a head open; any other ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
SCOPE = frozenset("ul ol dl table article section div nav aside main body".split())


class Element:
    """An open element that counts: its tag, the features of its tag and attributes, and its parent."""

    __slots__ = ("tag", "own", "parent", "seen")

    def __init__(self, tag: str, own: tuple[str, ...], parent: Element | None):
        self.tag, self.own, self.parent, self.seen = tag, own, parent, None

    def all(self, known: frozenset | None) -> frozenset:
        """The features of this element and its ancestors (of those known); elements that add nothing share their parent's."""
        way, e = [], self
        while e is not None and not (e.seen and e.seen[0] is known):
            way.append(e)
            e = e.parent
        got = e.seen[1] if e is not None else frozenset()
        for e in reversed(way):
            more = [f for f in e.own if f not in got and (known is None or f in known)]
            got = got.union(more) if more else got
            e.seen = known, got
        return got


class Block:
    """A leaf block: its text, the element that it is in (or nothing) and how much of it is links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: Element | None | tuple, linked: float):
        self.text, self.path, self.linked = text, path or None, linked


#: Words of names that are put together from an advertiser's word and another.
_AD_WORD = re.compile(r"(?:google|dfp|gpt|web)?ads?(?:by[a-z]+|box|slot|unit|space|sense|wrapper|container|block|banner|zone|label|holder|frame|content|area)?|advert(?:s|ise[a-z]*|ising|orial)?|sponsor(?:s|ed|ship)?[a-z]*")


def _words(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of one element: its tag, the words of its class, id, role and item property, and whether one is an advert's."""
    words = {tag}
    for _, a, b, c in _ATTR.findall(attrs):
        for x in _NAME.findall(_html.unescape(a or b or c).lower()):
            if not x.isdigit():
                words.add("." + x)
            if _AD_WORD.fullmatch(x):
                words.add(".advert-word")
    if _HIDDEN.search(attrs):
        words.add(".hidden")
    return tuple(sorted(words))


_short_words = lru_cache(50_000)(_words)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    stack: list[tuple[str, Element | None]] = []
    open_: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    links = in_link = 0
    at = scan = 0
    size, last = len(page), page.rfind(">")
    ends: dict[str, re.Match | None] = {}  # the next end tag of each raw element, as last found
    quoted = True

    def flush():
        nonlocal parts, links
        if parts:
            t = _SPACE.sub(" ", "".join(parts)).strip()
            if t and not any(tag == "head" for tag, _ in stack[:2]):
                out.append(Block(t, stack[-1][1] if stack else None, min(1.0, links / len(t))))
            parts, links = [], 0

    def pop(k: int):
        nonlocal in_link
        for t, _ in stack[k:]:
            open_[t] -= 1
            in_link -= t == "a"
        del stack[k:]

    def leave_head():
        for k in range(min(2, len(stack))):
            if stack[k][0] == "head":
                flush()
                pop(k)
                break

    def close(tags: tuple[str, ...]):
        """Ends the innermost open element of these that no sectioning element separates."""
        if any(open_.get(t) for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    pop(k)
                    break
                if stack[k][0] in SCOPE:
                    break

    def text(raw: str):
        nonlocal links
        if raw:
            t = _html.unescape(raw) if "&" in raw else raw
            if t.strip(" \t\n\f\r"):
                leave_head()
            parts.append(t)
            if in_link > 0:
                links += len(t.strip())

    while at < size:
        i = page.find("<", scan)
        if i < 0 or i > last:
            text(page[at:])
            break
        if page.startswith("<!--", i):
            text(page[at:i])
            end = page.find("-->", i + 4)
            at = scan = end + 3 if end >= 0 else size
            continue
        m = _TAG.match(page, i)
        if not m:
            if page[i + 1 : i + 2] not in ("!", "?", "/"):
                scan = i + 1  # a "<" of the text
                continue
            text(page[at:i])
            at = scan = page.index(">", i) + 1
            continue
        text(page[at:i])
        got = _ATTRS.match(page, m.end()) if quoted else None
        if got:
            attrs, at = got[1], got.end()
        else:
            quoted = False
            at = page.index(">", m.end()) + 1
            attrs = page[m.end() : at - 1]
        scan = at
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag in BLOCK_TAGS:
                            flush()
                        pop(k)
                        break
                    if stack[k][0] in SCOPE and tag not in BLOCK_TAGS:
                        break
            continue
        if tag not in IN_HEAD:
            leave_head()
        if tag in _RAW_END and not attrs.endswith("/"):
            end = ends.get(tag)
            if tag not in ends or (end and end.start() < at):
                end = ends[tag] = _RAW_END[tag].search(page, at)
            if end or tag not in _MAY_STAY_OPEN:
                if not (end and tag in _NEXT and _NEXT[tag].search(page, at, end.start())):
                    at = scan = end.end() if end else size
            if tag in ("textarea", "title", "select", "button"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P:
                close(("p",))
            if tag in SAME:
                close(SAME[tag])
        if tag not in VOID_TAGS and not attrs.endswith("/"):
            within = stack[-1][1] if stack else None
            if tag in BLOCK_TAGS or tag == "a":
                within = Element(tag, (_short_words if len(attrs) < 300 else _words)(tag, attrs), within)
            stack.append((tag, within))
            open_[tag] = open_.get(tag, 0) + 1
            in_link += tag == "a"
    flush()
    return out


_END = frozenset(".!?…。\"'”’")


def features(b: Block, known: frozenset | None = None) -> list[str]:
    """Ancestor (of those known) and text features of a block."""
    out = ["bias"]
    out += ["^" + t for t in (b.path.all(known) if b.path else ()) if t not in ("html", "body")]
    out.append("own:" + (b.path.tag if b.path else ""))
    words = b.text.count(" ") + 1
    out.append(f"words:{min(8, int(math.log2(words)))}")
    out.append(f"links:{int(b.linked * 4)}")
    out.append("stop" if b.text[-1] in _END else "no-stop")
    if words >= 8 and b.text[-1] in _END:
        out.append("sentence")
    if "©" in b.text or "(c)" in b.text:
        out.append("copyright")
    if sum(map(str.isdigit, b.text)) * 4 > len(b.text):
        out.append("digits")
    return out


class Chain:
    """A two-label linear chain: weights of features for label 1, and transitions [from][to]."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.move = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]
        self.known: frozenset | None = None

    def scores(self, page: list[Block]) -> list[float]:
        w = self.weight
        if self.known is None:
            self.known = frozenset(f[1:] for f in w if f[0] == "^")
        return [sum(w.get(f, 0.0) for f in features(b, self.known)) for b in page]

    def decode(self, s: list[float]) -> list[int]:
        """Viterbi: the likeliest labels."""
        if not s:
            return []
        m = self.move
        a0, a1 = self.start[0], self.start[1] + s[0]
        back = []
        for x in s[1:]:
            f0, f1 = a1 + m[1][0] > a0 + m[0][0], a1 + m[1][1] > a0 + m[0][1]
            back.append((f0, f1))
            a0, a1 = (a1 + m[1][0] if f0 else a0 + m[0][0]), (a1 + m[1][1] if f1 else a0 + m[0][1]) + x
        y = [int(a1 > a0)]
        for f in reversed(back):
            y.append(int(f[y[-1]]))
        return y[::-1]

    def marginals(self, s: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block and expected counts of the transitions (forward-backward)."""
        m = [[math.exp(x) for x in r] for r in self.move]
        e = [math.exp(max(-30.0, min(30.0, x))) for x in s]
        fwd, a, b = [], math.exp(self.start[0]), math.exp(self.start[1]) * e[0]
        for k in range(len(e)):
            if k:
                a, b = a * m[0][0] + b * m[1][0], (a * m[0][1] + b * m[1][1]) * e[k]
            z = a + b
            a, b = a / z, b / z
            fwd.append((a, b))
        p, count = [0.0] * len(e), [[0.0, 0.0], [0.0, 0.0]]
        u, v = 1.0, 1.0
        for k in range(len(e) - 1, -1, -1):
            a, b = fwd[k]
            z = a * u + b * v
            p[k] = b * v / z
            if k:
                c, d = fwd[k - 1]
                t = [[c * m[0][0] * u, c * m[0][1] * e[k] * v], [d * m[1][0] * u, d * m[1][1] * e[k] * v]]
                z = sum(map(sum, t))
                for i in (0, 1):
                    for j in (0, 1):
                        count[i][j] += t[i][j] / z
                u, v = m[0][0] * u + m[0][1] * e[k] * v, m[1][0] * u + m[1][1] * e[k] * v
                z = u + v
                u, v = u / z, v / z
        return p, count

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4) -> Chain:
        """Stochastic gradient on the conditional log-likelihood, with per-weight steps."""
        rng = random.Random(5)
        data = [([features(b) for b in p], y) for p, y in pages if p]
        seen: dict[str, float] = {}
        seen_move = [[1e-8, 1e-8], [1e-8, 1e-8]]
        for _ in range(epochs):
            rng.shuffle(data)
            for fs, y in data:
                p, count = self.marginals([sum(self.weight.get(f, 0.0) for f in x) for x in fs])
                g: dict[str, float] = {}
                for x, yk, pk in zip(fs, y, p, strict=True):
                    if abs(yk - pk) > 1e-4:
                        for f in x:
                            g[f] = g.get(f, 0.0) + yk - pk
                for f, d in g.items():
                    d -= l2 * self.weight.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-8) + d * d
                    self.weight[f] = self.weight.get(f, 0.0) + rate * d / math.sqrt(seen[f])
                for i, j in zip(y, y[1:]):
                    count[i][j] -= 1
                for i in (0, 1):
                    for j in (0, 1):
                        d = -count[i][j]
                        seen_move[i][j] += d * d
                        self.move[i][j] += rate * d / math.sqrt(seen_move[i][j])
        return self


# ---- labelled pages -------------------------------------------------------------------------

# fixed values: names that page authors give to containers
MAIN_NAMES = ["content", "main-content", "main", "post", "post-body", "entry-content", "article-body", "story", "article", "text", "page-content", "body-text", "maincontent", "entry", "blog-post", "prose", "markdown-body", "single-post", "news-item", "documentation", "articleBody", "mw-parser-output", "post-content", "story-body"]
SIDE_NAMES = ["sidebar", "side", "related", "widget", "recommended", "popular", "tags", "share", "social", "newsletter", "promo", "breadcrumb", "toc"]
AD_NAMES = ["ad", "ads", "advert", "banner", "sponsored", "ad-slot", "adbox", "adsbygoogle", "advertisement", "ad-container", "adsense", "sponsor"]
LINE_NAMES = ["siteSub", "contentSub", "jump-to-nav", "tagline"]
NOTICE_NAMES = ["cookie-notice", "notice", "cookie", "consent", "alert", "modal", "popup", "disclaimer"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "replies", "discussion", "respond"]
NAV_NAMES = ["nav", "menu", "navbar", "navigation", "main-menu"]
HEAD_NAMES = ["header", "site-header", "masthead", "top", "branding"]
FOOT_NAMES = ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"]


def labelled_pages(count: int = 600, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Pages in many layouts with the label of each leaf block (1: main text), known by construction."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbg"

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def sentence(a=4, b=22):
        w = [word() for _ in range(rng.randint(a, b))]
        if rng.random() < 0.1:
            w = [x + rng.choice(["###", "!!", "%%%", "&amp;&amp;"]) for x in w]
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(a=1, b=6):
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def page():
        out, y = [], []

        def add(markup, *labels):
            out.append(markup)
            y.extend(labels)

        def box(names, tag=None, attr="class"):
            if tag and rng.random() < 0.5:
                return f"<{tag}>", f"</{tag}>"
            t = rng.choice(["div", "section", tag or "div"])
            return f'<{t} {rng.choice([attr, "id"])}="{rng.choice(names)}">', f"</{t}>"

        def menu(n):
            a, b = box(NAV_NAMES, "nav")
            links = [f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)]
            add(a + "<ul>" + "".join(links) + "</ul>" + b, *[0] * n)

        def side():
            a, b = box(SIDE_NAMES, "aside")
            n = rng.randint(1, 5)
            if rng.random() < 0.5:
                add(f"{a}<h3>{sentence(1, 4)}</h3><ul>" + "".join(f'<li><a href="#">{sentence(2, 9)}</a></li>' for _ in range(n)) + f"</ul>{b}", *[0] * (n + 1))
            else:
                add(a + "".join(f"<p>{prose(1, 3)}</p>" for _ in range(n)) + b, *[0] * n)

        def widget():
            a, b = box(SIDE_NAMES, "aside")
            n = rng.randint(1, 3)
            add(a + "<table>" + "".join(f"<tr><td>{sentence(1, 3)}</td><td>{rng.randint(1, 999)}</td></tr>" for _ in range(n)) + "</table>" + b, *[0] * (2 * n))

        def ad():
            a, b = box(AD_NAMES)
            add(rng.choice([f"{a}{prose(1, 2)}{b}", f"{a}<p>{prose(1, 2)}</p>{b}"]), 0)

        def notice():
            a, b = box(NOTICE_NAMES)
            add(f"{a}<p>{prose(1, 2)}</p>{b}", 0)

        def form():
            add(f'<form action="/{word()}"><label>{sentence(1, 3)}</label><input name="q"><p>{sentence(2, 8)}</p><button>{word()}</button></form>', 0, 0)

        def head():
            a, b = box(HEAD_NAMES, "header")
            add(f"{a}<div>{sentence(1, 4)}</div><p>{sentence(2, 8)}</p>{b}", 0, 0)

        def foot():
            a, b = box(FOOT_NAMES, "footer")
            if rng.random() < 0.5:
                add(f"{a}&copy; {word()}.example.com &middot; {prose(1, 2)}{b}", 0)
            else:
                add(f"{a}<p>&copy; {rng.randint(1990, 2030)} {sentence(1, 4)}</p><p>{prose(1, 2)}</p>{b}", 0, 0)

        def comments():
            a, b = box(COMMENT_NAMES)
            n = rng.randint(1, 5)
            add(a + f"<h3>{sentence(1, 3)}</h3>" + "".join(f'<div class="comment"><b>{word()}</b><p>{prose(1, 3)}</p></div>' for _ in range(n)) + b, 0, *[0] * (2 * n))

        def main():
            kind = rng.random()
            a, b = ("<article>", "</article>") if kind < 0.38 else ("<main>", "</main>") if kind < 0.5 else ("<main><article>", "</article></main>") if kind < 0.58 else ("", "") if kind < 0.61 else (f'<div class="{word()}">', "</div>") if kind < 0.65 else ("<section>", "</section>") if kind < 0.7 else ('<div itemprop="articleBody">', "</div>") if kind < 0.74 else box(MAIN_NAMES)
            add(a)
            if rng.random() < 0.85:
                add(f"<h1>{sentence(1, 10)}</h1>", 1)
            if rng.random() < 0.15:
                add(f'<div {rng.choice(["class", "id"])}="{rng.choice(LINE_NAMES)}">{sentence(2, 6)}</div>', 0)
            brief = rng.random() < 0.25  # an article of short paragraphs
            para = rng.choice(["p", "p", "p", "p", "div"])
            inner = rng.random() < 0.15
            add("<div>" if inner else "")
            for _ in range(rng.randint(0, 9)):
                k = rng.random()
                if k < 0.5:
                    add(f"<{para}>{sentence(2, 9) if brief or rng.random() < 0.1 else prose()}</{para}>", 1)
                elif k < 0.53:
                    n = rng.randint(1, 4)
                    add("<table>" + "".join(f"<tr><th>{sentence(1, 3)}</th><td>{sentence(1, 8)}</td></tr>" for _ in range(n)) + "</table>", *[1] * (2 * n))
                elif k < 0.56:
                    add(f'<figure><img src="{word()}.png"><figcaption>{sentence(2, 12)}</figcaption></figure>', 1)
                elif k < 0.59:
                    n = rng.randint(1, 3)
                    add("<dl>" + "".join(f"<dt>{sentence(1, 3)}</dt><dd>{sentence(2, 12)}</dd>" for _ in range(n)) + "</dl>", *[1] * (2 * n))
                elif k < 0.62:
                    add(rng.choice([f"<p hidden>{prose(1, 2)}</p>", f'<div style="display:none"><p>{prose(1, 2)}</p></div>', f"<noscript>{prose(1, 1)}</noscript>"]), 0)
                elif k < 0.7:
                    add(f"<p><b>{prose()}<br>", 1) if para == "p" else add(f"<div><b>{prose()}</b><br></div>", 1)
                elif k < 0.72:
                    n = rng.randint(1, 3)
                    add(f"<section><h2>{sentence(1, 5)}</h2>" + "".join(f"<p>{sentence(2, 9) if brief else prose(1, 3)}</p>" for _ in range(n)) + "</section>", *[1] * (n + 1))
                elif k < 0.77:
                    h = rng.choice(["h2", "h2", "h3", "h3", "h4"])
                    add(f"<{h}>{sentence(1, 6)}</{h}>", 1)
                elif k < 0.82:
                    n = rng.randint(1, 4)
                    add("<ul>" + "".join(f"<li>{sentence(2, 10)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
                elif k < 0.86:
                    add(f"<blockquote><p>{prose(1, 2)}</p></blockquote>", 1)
                elif k < 0.9:
                    add(f"<p>{word()} <a href='#'>{word()}</a> {prose(1, 2)}</p>", 1)
                elif k < 0.93:
                    add(f"<pre>{word()} {word()}\n{word()}</pre>", 1)
                elif k < 0.95:
                    add(f"<p>{word()}.</p>", 1)
                elif k < 0.97:
                    ad()
                elif k < 0.985:
                    side()
                else:
                    form()
            add("</div>" if inner else "")
            if rng.random() < 0.08:
                comments()
            add(b)

        add(f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title><style>p{{}}</style></head><body>")
        for f, p in ((notice, 0.2), (head, 0.4), (lambda: menu(rng.randint(2, 8)), 0.8), (ad, 0.4), (side, 0.15), (form, 0.1)):
            if rng.random() < p:
                f()
        if rng.random() < 0.3:
            add("<!-- note --><script>var t='</p>';</script>")
        wrap = rng.random() < 0.3
        add('<div class="container"><div class="row">' if wrap else "")
        main()
        for f, p in ((side, 0.3), (widget, 0.1), (ad, 0.2), (comments, 0.3), (form, 0.15), (notice, 0.1)):
            if rng.random() < p:
                f()
        add("</div></div>" if wrap else "")
        if rng.random() < 0.8:
            foot()
        if rng.random() < 0.7:
            add("</body></html>")
        return "".join(out), y

    return [page() for _ in range(count)]


@lru_cache(1)
def trained() -> Chain:
    """The chain trained on the labelled pages; pages whose parse differs in blocks are left out."""
    data = []
    for page, y in labelled_pages():
        b = blocks(page)
        if len(b) == len(y):
            data.append((b, y))
    return Chain().fit(data)


def main_text(page: str, chain: Chain) -> str:
    b = blocks(page)
    return "\n\n".join(x.text for x, y in zip(b, chain.decode(chain.scores(b)), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, names: tuple[str, str] = ("text", "n_chars"), chain: Chain | None = None) -> DataFrame:
    """Adds the main text of each page and its length in code points."""
    sent = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def task():
        c = sent.value

        def f(raw, off, rows):
            data = raw.tobytes()
            texts = [main_text(data[a:b].decode("utf-8", "replace"), c) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return f

    return map_text(pages, html, task, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())], keep)
