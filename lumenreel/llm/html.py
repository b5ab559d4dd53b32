"""Main text of web pages: boosted trees over DOM nodes, then one consistent choice per tree.

A page becomes its elements in document order.  Boosted trees (:mod:`lumenreel.llm.boost`) give each element the log-odds that it
belongs to the article, from its tag, attribute words, depth, subtree text and link density, its siblings' statistics and
what its ancestors are.  Decoding picks the set of kept elements with the greatest total log-likelihood among those in which
everything below a dropped element is dropped too, bottom-up in one pass, so ancestors and descendants never contradict
each other.  Scripts, styles, the head, form controls and comments in the markup never count as text.

The model is trained on pages made by :func:`training_page` (seeded; no input is used), once per driver process.

Results for odd input
    null or empty html: empty text.  No markup: the whole text.  Unclosed or stray tags: elements end where their parent
    ends, or where the next of their kind begins (p, li, td and so on).  null page_id or url: passed through.  Repeated
    rows: one result each.  Very long pages, deep nesting, thousands of unclosed tags: work is linear but for a sort.  Empty table: no
    rows.  Other columns are not read.
"""

from __future__ import annotations

import functools
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.boost import BoostedTrees

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label|data-[a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Behind the last '>': an unclosed comment or declaration.
TAIL = re.compile(r"<[!?].*", re.S)
#: Rows of features that are held at once.
ROWS = 50_000
RAW = frozenset("script style textarea title noscript template iframe xmp svg math select".split())
HIDDEN = frozenset("head script style title noscript template textarea select option button input object iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of the key ends open elements of the values (up to the barrier).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
CLOSABLE = frozenset().union(*ENDS.values())
BARRIER = frozenset("ul ol dl table body html article section main div nav aside footer header form".split())
#: Elements, besides these, inside which a paragraph outside stays open.
KEEPS_PARAGRAPH = frozenset(("td", "th", "li", "button"))
RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}
#: Words of class, id and role, by what they point to.
CUES = (
    frozenset("article post entry story content main maincontent text articlebody postbody entrycontent prose body news blog".split()),
    frozenset("nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs submenu topnav".split()),
    frozenset("header masthead banner top topbar branding logo hero site".split()),
    frozenset("footer foot bottom copyright legal colophon".split()),
    frozenset("sidebar aside side rail widget secondary complementary".split()),
    frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion adsense adbox dfp".split()),
    frozenset("comment comments reply replies disqus discussion respond commentlist reader".split()),
    frozenset("cookie consent gdpr notice alert popup modal overlay message warning notification privacy".split()),
    frozenset("form search login signup subscribe newsletter register contact input".split()),
    frozenset("share social related recommended more trending popular tags meta byline author date teaser links also".split()),
)
TAGS = {t: k for k, names in enumerate((("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl"), ("a",), ("div", "center"), ("article",), ("main",), ("section",), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "legend"), ("table", "tbody", "tr", "thead"), ("td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html"), ("b", "i", "em", "strong", "span", "u", "small", "font", "code"))) for t in names}
KINDS = 20
#: Of ancestors: which tags and cues are passed down.
PASSED = (7, 8, 10, 11, 12, 13, 14)


class Pages:
    """Elements and text pieces of a batch of pages, as flat columns in document order."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.cues: list[int] = []
        self.hidden: list[bool] = []
        self.page: list[int] = []
        self.roots: list[int] = []
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.broken: list[bool] = []
        self.in_link: list[bool] = []
        self.memo: dict[str, int] = {}

    def _cues(self, attributes: str) -> int:
        found = self.memo.get(attributes)
        if found is None:
            words: set[str] = set()
            for value in ATTRIBUTE.findall(attributes):
                low = value.strip("\"'")
                low = re.sub(r"([a-z])([A-Z])", r"\1 \2", low).lower()
                words.update(re.findall(r"[a-z]+", low))
                words.add(re.sub(r"[^a-z]", "", low))
            found = sum(1 << k for k, cue in enumerate(CUES) if not words.isdisjoint(cue))
            if len(self.memo) < 50_000:
                self.memo[attributes] = found
        return found

    def add(self, source: str) -> None:
        root = len(self.kind)
        page = len(self.roots)
        self.roots.append(root)
        names = ["#root"]
        stack = [root]
        kind, parent, depth, end, cues, hidden, pages = self.kind, self.parent, self.depth, self.end, self.cues, self.hidden, self.page
        # so that no tag looks through the open elements: where each name is open, where blocks are, per open element the
        # paragraph that a block ends there, and per barrier where the names that ENDS closes are open since
        open_at: dict[str, list[int]] = {}
        blocks: list[int] = []
        paragraph = [0]
        scopes: list[dict[str, list[int]]] = [{}]

        def push(name: str, attributes: str) -> int:
            at = len(kind)
            kind.append(TAGS.get(name, KINDS - 1 + 1))
            parent.append(stack[-1] if at > root else -1)
            depth.append(len(stack) if at > root else 0)
            end.append(-1)
            cues.append(self._cues(attributes) if attributes and not attributes.isspace() else 0)
            hidden.append(name in HIDDEN or (at > root and hidden[stack[-1]]))
            pages.append(page)
            return at

        push("#root", "")
        broken, links, at = True, 0, 0

        def text(lo: int, hi: int) -> None:
            nonlocal broken
            if hi > lo and not hidden[stack[-1]]:
                piece = source[lo:hi]
                if "&" in piece:
                    piece = _html.unescape(piece)
                self.texts.append(piece)
                self.owner.append(stack[-1])
                self.broken.append(broken)
                self.in_link.append(links > 0)
                broken = False

        def close(to: int) -> None:
            nonlocal links
            while len(stack) > to:
                k = stack.pop()
                end[k] = len(kind)
                name = names.pop()
                if not names:
                    break
                paragraph.pop()
                open_at[name].pop()
                if name in BARRIER:
                    scopes.pop()
                elif name in CLOSABLE:
                    scopes[-1][name].pop()
                if name not in INLINE:
                    blocks.pop()
                if name == "a":
                    links -= 1

        last = source.rfind(">") + 1  # behind it only comments and declarations can begin
        while True:
            m = TAG.search(source, at, last) if at < last else TAIL.search(source, at)
            if not m:
                if at >= last:
                    break
                tail = TAIL.search(source, last)
                if tail:
                    text(at, tail.start())
                    at = len(source)
                break
            text(at, m.start())
            at = m.end()
            name = m[2] or m[5] if m.re is TAG else None
            if not name:
                if at >= last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                continue
            name = name.lower()
            inline = name in INLINE
            if m[1] or m[4]:
                if not inline:
                    broken = True
                k = open_at[name][-1] if open_at.get(name) else 0
                # an inline end tag doesn't close blocks that began inside it
                if k and not (inline and blocks and blocks[-1] > k):
                    close(k)
                continue
            if not inline:
                broken = True
                ends = ENDS.get(name)
                if ends:
                    first = min((scopes[-1][x][0] for x in ends if scopes[-1].get(x)), default=0)
                    if first:
                        close(first)
                elif paragraph[-1] and name not in VOID:
                    close(paragraph[-1])
                if name == "body" and open_at.get("head"):
                    close(open_at["head"][0])
            k = push(name, m[3] or m[6] or "")
            if name in VOID or (m[3] or "").endswith("/") and name not in TAGS:
                end[k] = k + 1
                continue
            if name in RAW:
                stop = RAW_END[name].search(source, at)
                at = stop.start() if stop else len(source)
                end[k] = k + 1
                if stop:
                    after = source.find(">", at)
                    at = len(source) if after < 0 else after + 1
                continue
            place = len(stack)
            stack.append(k)
            names.append(name)
            open_at.setdefault(name, []).append(place)
            paragraph.append(place if name == "p" else 0 if name in BARRIER or name in KEEPS_PARAGRAPH else paragraph[-1])
            if name in BARRIER:
                scopes.append({})
            elif name in CLOSABLE:
                scopes[-1].setdefault(name, []).append(place)
            if not inline:
                blocks.append(place)
            if name == "a":
                links += 1
        text(at, len(source))
        close(0)

    def arrays(self) -> dict[str, np.ndarray]:
        return {
            "kind": np.array(self.kind, np.int64),
            "parent": np.array(self.parent, np.int64),
            "depth": np.array(self.depth, np.int64),
            "end": np.array(self.end, np.int64),
            "cues": np.array(self.cues, np.int64),
            "hidden": np.array(self.hidden, bool),
            "page": np.array(self.page, np.int64),
            "owner": np.array(self.owner, np.int64),
            "in_link": np.array(self.in_link, bool),
        }


def features(pages: Pages, a: dict[str, np.ndarray]) -> Features:
    """A row for each element."""
    n = len(a["kind"])
    length = np.array([len(t) - t.count(" ") for t in pages.texts] or [0], float)[: len(pages.texts)]
    marks = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in pages.texts] or [0], float)[: len(pages.texts)]
    own = np.bincount(a["owner"], length, n)
    link = np.bincount(a["owner"], length * a["in_link"], n)
    mark = np.bincount(a["owner"], marks, n)
    roots = np.array(pages.roots)
    page = a["page"]

    def below(v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(v)])
        return total[a["end"]] - total[:-1]

    text, linked, marked, count = below(own), below(link), below(mark), below(np.ones(n))
    paragraphs, anchors = below((a["kind"] == 0).astype(float)), below((a["kind"] == 5).astype(float))
    before = np.concatenate([[0.0], np.cumsum(own)])[:-1]
    before -= before[roots][page]
    whole = np.maximum(1.0, text[roots][page])
    up = np.maximum(a["parent"], 0)
    inner = a["parent"] >= 0
    siblings = np.bincount(up[inner], minlength=n)[up] * inner
    sibling_text = np.bincount(up[inner], text[inner], n)[up] * inner / np.maximum(1, siblings)
    order = np.lexsort((np.arange(n), a["parent"]))
    same = np.concatenate([[False], (a["parent"][order][1:] == a["parent"][order][:-1])])
    earlier, later = np.zeros(n), np.zeros(n)
    earlier[order[same]] = text[order[np.flatnonzero(same) - 1]]
    later[order[np.flatnonzero(same) - 1]] = text[order[same]]
    alike = np.zeros(n)
    pair = up * 64 + a["kind"]
    _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
    alike = counts[inverse] / np.maximum(1, siblings)
    passed = a["cues"] | sum((a["kind"] == k).astype(np.int64) << (len(CUES) + n_) for n_, k in enumerate(PASSED))
    from_above, inside = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for bit in range(len(CUES) + len(PASSED)):
        has = (passed >> bit & 1).astype(np.int32)
        from_above |= (_open(has, a["end"]) > 0).astype(np.int64) << bit
        total = np.concatenate([[0], np.cumsum(has)])
        inside |= (total[a["end"]] - total[1:] > 0).astype(np.int64) << bit  # what is below says of an element
    columns = [
        np.log1p(own), np.log1p(text), linked / np.maximum(1, text), marked / np.maximum(1, text), text / count, np.log1p(count),
        a["depth"].astype(float), before / whole, text / whole, np.log1p(siblings), np.log1p(sibling_text), np.log1p(earlier), np.log1p(later),
        alike, paragraphs, anchors, np.log1p(text / np.maximum(1, paragraphs)), text[up] / whole, linked[up] / np.maximum(1, text[up]),
    ]
    return Features(columns, a["cues"], a["kind"], from_above, inside)


class Features:
    """Features of all elements; rows of them are made a block at a time, so that memory is a few numbers an element."""

    def __init__(self, columns: list[np.ndarray], cues: np.ndarray, kind: np.ndarray, from_above: np.ndarray, inside: np.ndarray) -> None:
        self.columns, self.cues, self.kind, self.from_above, self.inside = columns, cues, kind, from_above, inside

    def __len__(self) -> int:
        return len(self.kind)

    def rows(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        s = slice(lo, len(self) if hi is None else hi)
        flags = np.arange(len(CUES) + len(PASSED))
        parts = [np.stack([c[s] for c in self.columns], 1)]
        parts += [(self.cues[s, None] >> np.arange(len(CUES)) & 1), self.kind[s, None] == np.arange(KINDS)]
        parts += [self.from_above[s, None] >> flags & 1, self.inside[s, None] >> flags & 1]
        return np.concatenate([x.astype(float) for x in parts], 1)


def _open(has: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each element: how many of its ancestors have a mark."""
    marked = np.flatnonzero(has)
    steps = np.bincount(marked + 1, minlength=len(has) + 1) - np.bincount(end[marked], minlength=len(has) + 1)
    return np.cumsum(steps)[: len(has)]


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)))


def decode(logit: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    """Which elements are kept: the likeliest choice in which what lies below a dropped element is dropped."""
    keep, drop = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    keep = np.where(a["hidden"], -1e9, keep)
    keep[a["parent"] < 0] = 0.0
    drop[a["parent"] < 0] = -1e9
    all_drop, best, parent = drop.copy(), keep.copy(), a["parent"]
    if a["depth"].max(initial=0) * 16 > len(parent):  # deep and thin: one element at a time is cheaper than one level
        up, held, low = parent.tolist(), best.tolist(), all_drop.tolist()
        for k in range(len(up) - 1, -1, -1):  # children stand behind their parents
            if up[k] >= 0:
                held[up[k]] += max(held[k], low[k])
                low[up[k]] += low[k]
        best, all_drop = np.array(held), np.array(low)
    else:
        for level in _levels(a["depth"])[:0:-1]:
            p = parent[level]
            np.add.at(best, p, np.maximum(best[level], all_drop[level]))
            np.add.at(all_drop, p, all_drop[level])
    out = best >= all_drop
    return out & (_open(~out, a["end"]) == 0)


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    if not sources:
        return []
    pages = Pages()
    for s in sources:
        pages.add(s)
    a = pages.arrays()
    found = features(pages, a)
    logit = [model.logit(found.rows(lo, min(len(found), lo + ROWS))) for lo in range(0, len(found), ROWS)]
    kept = decode(np.concatenate(logit), a)
    parts: list[list[str]] = [[] for _ in sources]
    page_of, gap = a["page"].tolist(), True
    last = -1
    for text, owner, broken in zip(pages.texts, pages.owner, pages.broken, strict=True):
        page = page_of[owner]
        if page != last:
            last, gap = page, True
        if not kept[owner]:
            gap = True
            continue
        parts[page].append(f" {text}" if broken or gap else text)
        gap = False
    return [" ".join("".join(p).split()) for p in parts]


# ---------------------------------------------------------------------------------------------------- training pages


def training_page(rng: np.random.Generator) -> str:
    """A made-up page; text of the article carries the mark U+E000 (removed before features are taken)."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    yes = lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick("th", "er", "on", "an", "re", "ti", "es", "st", "en", "la", "de", "ment", "ä", "ch", "é", "ción", "os") for _ in range(int(rng.integers(1, 4))))

    def words(lo: int, hi: int) -> str:
        out = [word() for _ in range(int(rng.integers(lo, hi)))]
        if yes(0.06):
            out = [w + pick("%%%", "***", "!!", "&amp;&amp;") for w in out]
        if yes(0.05):
            out = [w.upper() for w in out]
        return " ".join(out).capitalize()

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(1, 18) + pick(".", ".", ".", "!", "?") for _ in range(int(rng.integers(lo, hi))))

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def links(lo: int, hi: int) -> str:
        items = [link(words(1, 4)) for _ in range(int(rng.integers(lo, hi)))]
        kind = pick("ul", "ul", "span", "bar", "p")
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{x}" + pick("</li>", "</li>", "") for x in items) + "</ul>"
        return {"span": "".join(f"<span>{x}</span> " for x in items), "bar": " | ".join(items), "p": f"<p>{' '.join(items)}</p>"}[kind]

    def box(names: tuple[str, ...], tag: str, body: str, bare: float = 0.25) -> str:
        if yes(0.45):
            return f"<{tag}>{body}</{tag}>"
        name = pick(*names) + pick("", "", "-wrap", "-box", "_1", " col", "-inner")
        how = "" if yes(bare) else f' {pick("class", "id")}="{name}"'
        t = pick("div", "div", "section", tag)
        return f"<{t}{how}>{body}</{t}>"

    m = ""

    def prose(text: str) -> str:
        text = m + text
        if yes(0.3):
            ws = text.split(" ")
            k = int(rng.integers(len(ws)))
            ws[k] = pick("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<i>{}", "<strong>{}</strong>", "{}<br>").format(m + ws[k].replace(m, "")) + m
            text = " ".join(ws)
        return text

    def article() -> str:
        out = []
        if yes(0.8):
            head = f"<h1>{m}{words(2, 12)}</h1>"
            if yes(0.25):
                head = f"<header>{head}" + (f'<p class="{pick("byline", "meta", "date")}">{words(2, 6)}</p>' if yes(0.6) else "") + "</header>"
            out.append(head)
        if yes(0.12):
            out.append(f'<div class="{pick("meta", "share", "social", "byline")}">{links(2, 5)}</div>')
        for _ in range(int(rng.integers(1, 14)) if yes(0.85) else 1):
            r = rng.random()
            if yes(0.03):  # one block as long as a whole article
                out.append(f"<p>{prose(' '.join([sentences(3, 9)] * int(rng.integers(4, 60))))}" + pick("</p>", "<br>"))
            elif r < 0.62:
                body = prose(sentences(1, 8))
                out.append(pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{m}{words(2, 8)}.<br>", f"<div>{body}</div>"))
            elif r < 0.72:
                out.append(f"<p>{m}{words(1, 4)}.</p>")
            elif r < 0.8:
                out.append(f"<{(t := pick('h2', 'h3'))}>{m}{words(1, 8)}</{t}>")
            elif r < 0.87:
                out.append("<ul>" + "".join(f"<li>{prose(words(2, 14))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote>{pick('<p>{}</p>', '{}').format(m + sentences(1, 4))}</blockquote>")
            elif r < 0.94:
                rows = "".join("<tr>" + "".join(f"<td>{m}{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(2, 5))))
                out.append(f"<table>{rows}</table>")
            elif r < 0.96:
                out.append(f"<pre>{m}{words(4, 20)}</pre>")
            else:
                out.append(advert())
        return "\n".join(out) if yes(0.4) else "".join(out)

    def advert() -> str:
        return box(("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "adbox"), pick("div", "aside", "section"), pick(sentences(1, 3), link(words(2, 8)), f"<p>{sentences(1, 3)}</p>"), 0.0) if yes(0.8) else f'<div class="ad">{sentences(1, 3)}</div>'

    def comments() -> str:
        one = lambda: pick("<li>{}</li>", '<div class="comment"><b>{}</b><p>{}</p></div>', "<p>{}</p>", "<div>{}</div>").format(words(1, 3), sentences(1, 4))
        body = pick("<h2>{}</h2>", "<h3>{}</h3>", "").format(words(1, 3)) + "".join(one() for _ in range(int(rng.integers(1, 6)))) + (form() if yes(0.3) else "")
        t = pick("section", "div", "div", "ol")
        return f'<{t} {pick("class", "id")}="{pick("comments", "comment-list", "reader-comments", "disqus_thread", "replies", "discussion", "comments-area")}">{body}</{t}>'

    def form() -> str:
        body = f"<label>{words(1, 3)}</label><input type=text name=q>" + pick("", f"<p>{sentences(1, 2)}</p>", f"<h3>{words(1, 4)}</h3>") + f"<button>{words(1, 2)}</button>"
        return f'<form action="/{word()}">{body}</form>' if yes(0.8) else f'<div class="{pick("newsletter", "signup", "search-box", "login")}">{body}</div>'

    def notice() -> str:
        return box(("cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "privacy-notice"), "div", pick(sentences(1, 3), f"<p>{sentences(1, 3)}</p><button>{word()}</button>"), 0.0) if yes(0.9) else f'<div class="notice">{sentences(1, 3)}</div>'

    def sidebar() -> str:
        body = "".join(pick(f"<h3>{words(1, 4)}</h3>{links(2, 8)}", f"<p>{sentences(1, 3)}</p>", advert(), f"<h4>{words(1, 3)}</h4><p>{sentences(1, 2)}</p>") for _ in range(int(rng.integers(1, 4))))
        return pick(f"<aside>{body}</aside>", f'<div class="{pick("sidebar", "widget", "right-rail", "aside", "side-bar")}">{body}</div>', f'<aside class="{pick("sidebar", "related", "widget")}">{body}</aside>')

    def header() -> str:
        body = pick(f"<h1>{words(1, 4)}</h1>", f'<div class="logo">{link(words(1, 3))}</div>', f"<p>{words(2, 7)}</p>", link(words(1, 3)), words(1, 5)) + (links(2, 7) if yes(0.4) else "")
        return pick(f"<header>{body}</header>", f'<div class="{pick("header", "masthead", "site-header", "top-bar", "banner")}">{body}</div>', f'<header class="site-header">{body}</header>')

    def nav() -> str:
        body = links(3, 10)
        return pick(f"<nav>{body}</nav>", f"<nav>{body}</nav>", f'<div class="{pick("nav", "menu", "navbar", "breadcrumbs", "main-menu")}">{body}</div>', f'<ul class="{pick("menu", "nav")}">' + "".join(f"<li>{link(words(1, 2))}</li>" for _ in range(5)) + "</ul>")

    def footer() -> str:
        body = pick(f"&copy; {word()}.example &middot; {sentences(1, 2)}", f"<p>&copy; {words(2, 6)}</p>{links(1, 6)}", f"{links(2, 8)}<p>{sentences(1, 3)}</p>", sentences(1, 3))
        return pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f'<div class="{pick("footer", "site-footer", "copyright", "bottom")}">{body}</div>')

    body = article()
    tail = comments() if yes(0.25) else ""
    core = pick(
        f"<article>{body}</article>", f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>",
        f'<div class="{pick("content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "text")}">{body}</div>',
        f'<div id="{pick("content", "main", "article", "page")}">{body}</div>', f"<div>{body}</div>", f'<section class="article">{body}</section>',
    )
    if tail and yes(0.4) and core.endswith(("</article>", "</main>")):
        cut = core.rindex("</")
        core = core[:cut] + tail + core[cut:]
    else:
        core += tail
    if yes(0.3):
        core += box(("related", "recommended", "more-stories", "you-may-also-like"), "aside", f"<h3>{words(1, 4)}</h3>" + pick(links(2, 6), "".join(f"<p>{link(words(3, 9))} {words(3, 12)}</p>" for _ in range(3))), 0.0)
    if yes(0.35):
        core = pick(core + sidebar(), sidebar() + core)
    if yes(0.2):
        core = f'<div class="{pick("container", "wrapper", "row", "page")}">{core}</div>'
    top = "".join(x() for x in (header, nav, notice, advert) if yes(0.55))
    end = "".join(x() for x in (advert, form, notice, footer) if yes(0.45))
    head = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
    return (head if yes(0.9) else "") + top + core + end + ("</body></html>" if yes(0.85) else "")


@functools.lru_cache(maxsize=2)
def trained(pages: int = 1100, seed: int = 5) -> BoostedTrees:
    """The model, from ``pages`` made-up pages; an element's label is whether article text lies in it."""
    rng = np.random.default_rng(seed)
    found = Pages()
    for _ in range(pages):
        found.add(training_page(rng))
    article = np.array(["" in t for t in found.texts])
    found.texts = [t.replace("", "") for t in found.texts]
    a = found.arrays()
    n = len(a["kind"])
    total = np.concatenate([[0], np.cumsum(np.bincount(a["owner"], article, n))])
    label = (total[a["end"]] - total[:-1] > 0).astype(float)
    size = np.concatenate([[0.0], np.cumsum(np.bincount(a["owner"], [len(t.strip()) for t in found.texts], n))])
    use = ~a["hidden"] & (a["parent"] >= 0) & (size[a["end"]] - size[:-1] > 0)
    nodes = np.bincount(a["page"][use], minlength=pages)
    return BoostedTrees().fit(features(found, a).rows()[use], label[use], np.minimum(4.0, 40.0 / nodes[a["page"][use]]))  # short pages count too


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(vars(trained()))  # some thousand numbers

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BoostedTrees()
        vars(model).update(shared.value)
        for batch in it:
            at, sources = 0, None
            while at < batch.num_rows:
                held, end, sources = 0, at, []
                while end < batch.num_rows and (end == at or held < 2_000_000):
                    sources.append(batch.column(2)[end].as_py() or "")
                    held += len(sources[-1])
                    end += 1
                texts = main_texts(sources, model)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = end

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(batches, "page_id long, url string, text string, n_chars long")
