"""Main-text extraction with a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is main text or not.
A node's potential given its parent depends on its tag; its class words, text
length and link share are emissions; of an explicit article or main element they aren't
asked, and within one they count for little, as articles have short and linked
paragraphs too. Sum-product messages go once up and once
down the tree and give every node's exact marginal; the text of nodes with a
marginal above one half is the result, block by block in page order.

The tables are counted on labelled pages: a bounded sample of the given pages
that mark their article (``MAX_TRAIN_PAGES``, chosen by hash of the page id) and a
few labelled seed pages for layouts without such marks. Prediction reads every
page whole and shuffles nothing.

Defined results: null or empty html gives empty text; pages without any block
give their loose text the root's verdict, beside blocks it is a node of its own at the
root; svg, math and option have no text and end with their parent; broken markup is read as browsers do
(open paragraphs end at the next block, cut tags and comments at the end are
dropped).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, plus, prepare, text_slices

MAX_TRAIN_PAGES = 2000
SEED_WEIGHT = 25
SMOOTHING = 0.5
BACKOFF = 2.0                 # weight of the hint's own odds where a potential has few counts
SIZE_WEIGHT, LINK_WEIGHT = 0.25, 0.5   # these emissions repeat much of what the tag says
INSIDE_WEIGHT = 0.05          # within an explicit article

# HTML's element kinds.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CATEGORY = ({t: "heading" for t in HEADINGS} | {t: "item" for t in ("li", "dt", "dd")}
            | {t: "list" for t in ("ul", "ol", "dl", "menu", "dir")}
            | {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")}
            | {t: "quote" for t in ("blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "hgroup", "center")}
            | {t: t for t in ("p", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form")}
            | {t: "form" for t in ("fieldset", "dialog")} | {"body": "body"})
DROPPED = ("script", "style", "noscript", "template", "iframe", "select", "textarea", "title", "button", "object", "canvas")
SILENT = frozenset(("svg", "math", "option"))      # elements without text of the page: they end with their tag or their parent
BOILER_WORDS = frozenset("""nav navbar navigation menu sidebar side footer foot header masthead banner ad ads adv advert adverts
advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay
newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments
reply replies respond disqus widget widgets breadcrumb breadcrumbs pagination pager toolbar copyright legal disclaimer alert
complementary contentinfo hidden""".split())
CONTENT_WORDS = frozenset("article content post entry story main body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(DROPPED) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.I | re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|data-y)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("parent", "cat", "tag", "hint", "size", "links", "kids", "label")

    def __init__(self, parent: int, tag: str, hint: int, label: int | None):
        self.parent, self.tag, self.cat, self.hint, self.label = parent, tag, CATEGORY[tag], hint, label
        self.size = self.links = self.kids = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, parents before children; blocks (node or -1, raw text) in page order)."""
    nodes: list[Node] = []
    blocks: list[tuple[int, str]] = []
    stack: list[int] = []
    piece: list[str] = []
    in_link = False
    silent: list[str] = []                      # an open element without text of the page, and the inline ones open in it
    body = Node(-1, "body", 2, None)            # holds the text in no block; its hint: whether the page marks its article
    nodes.append(body)

    def flush() -> None:
        if piece:
            text = " ".join(html_lib.unescape("".join(piece)).split())
            piece.clear()
            if text:
                blocks.append((stack[-1] if stack else 0, text))
                nodes[blocks[-1][0]].size += len(text)

    def close(stop: set[str], within: tuple[str, ...]) -> None:
        """End the innermost open element of ``stop`` unless one of ``within`` is nearer."""
        for k in range(len(stack) - 1, -1, -1):
            tag = nodes[stack[k]].tag
            if tag in stop:
                del stack[k:]
                return
            if tag in within:
                return

    for m in _TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            if not silent:
                piece.append(text)
                if in_link:
                    nodes[stack[-1] if stack else 0].links += len(text.strip())
            continue
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if tag in CATEGORY or tag == "html":
            silent.clear()                      # a block begins or ends
        elif silent and not m.group("end"):
            silent.append(tag)
            continue
        elif silent and tag in silent:
            del silent[len(silent) - 1 - silent[::-1].index(tag):]
            continue
        elif tag in SILENT:
            if not m.group("end") and not (m.group("attrs").endswith("/") and tag != "option"):
                silent.append(tag)
            continue
        silent.clear()                          # here it is its parent's end
        if tag not in CATEGORY or tag == "body":
            if tag == "a":
                in_link = not m.group("end")
            elif tag in ("br", "hr", "img", "wbr"):
                piece.append(" ")
            elif tag in ("html", "body", "head"):
                flush()
                if tag == "body" and m.group("attrs"):
                    body.label = _attributes(m.group("attrs"))[1]
            continue
        flush()
        if m.group("end"):
            in_link = False
            close({tag}, () if tag != "p" else ("td", "th", "article", "section", "div", "main", "li"))
            continue
        close({"p"}, ("td", "th", "li", "div", "section", "article", "main", "blockquote"))
        if tag == "li":
            close({"li"}, ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            close({"dt", "dd"}, ("dl",))
        elif tag in ("tr", "td", "th"):
            close({"td", "th"} | ({"tr"} if tag == "tr" else set()), ("table",))
        elif tag in HEADINGS:
            close(HEADINGS, ("div", "section", "article", "td", "li"))
        hint, label = _attributes(m.group("attrs") or "")
        parent = stack[-1] if stack else 0
        if parent:
            nodes[parent].kids += 1
        if tag in ("article", "main"):
            body.hint = 1
        stack.append(len(nodes))
        nodes.append(Node(parent, tag, hint, label))
    flush()
    if body.size == 0 or len(nodes) == 1:       # no loose text beside blocks: no body node
        for n in nodes:
            n.parent -= 1
        return nodes[1:], [(k - 1, text) for k, text in blocks]
    return nodes, blocks


def _attributes(attrs: str) -> tuple[int, int | None]:
    """(class-word hint: 0 none, 1 boilerplate, 2 content; seed label)."""
    hint, label = 0, None
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "data-y":
            label = int(value) if value in ("0", "1") else label
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hint = 1
        elif name == "style":
            hint = 1 if "display:none" in value.replace(" ", "") else hint
        else:
            words = set(_NAME.findall(value))
            if words & BOILER_WORDS:
                hint = 1
            elif words & CONTENT_WORDS and hint == 0:
                hint = 2
    return hint, label


def _emissions(nodes: list[Node]) -> list[tuple[int, int, int, int]]:
    """Per node (hint, kind, text size class, link share class), sizes of the subtree. Kinds: 0
    leaf, 1 inner, 2 body, 3 an explicit article, 5 and 6 leaf and inner within one."""
    size = [n.size for n in nodes]
    links = [n.links for n in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        if (p := nodes[k].parent) >= 0 and nodes[p].tag != "body":     # the body's are those of its loose text
            size[p] += size[k]
            links[p] += links[k]
    place: list[int] = []                       # 0: not in an article, 1: an article itself, 2: in one, in no part that marks itself as other
    for n in nodes:
        above = place[n.parent] if n.parent >= 0 else 0
        other = n.hint == 1 or n.tag in _OUT_TAGS or (n.tag == "header" and not above)
        place.append(0 if other else 1 if n.tag in ("article", "main") else 2 if above else 0)
    return [(n.hint, 2 if n.tag == "body" else (0, 3, 5)[at] + (int(n.kids > 0) if at != 1 else 0), min(6, s.bit_length() // 2),
             0 if not x else 1 + min(2, int(3 * x / max(s, 1))))
            for n, s, x, at in zip(nodes, size, links, place, strict=True)]


# Seed pages: layouts whose article isn't marked by a semantic element, as data-y.
_BODY = "Sentences of a running text that tells the reader something at some length, with commas and stops. " * 3
SEEDS = [
    f"""<div class="header" data-y=0><h1 data-y=0>Site</h1><p data-y=0>Our motto</p></div><div class="menu" data-y=0><ul data-y=0><li data-y=0>
    <a>Home</a></li><li data-y=0><a>News</a></li></ul></div><div class="content" data-y=1><h1 data-y=1>A title</h1><p data-y=1>{_BODY}</p>
    <h2 data-y=1>Part</h2><p data-y=1>{_BODY}</p><ul data-y=1><li data-y=1>First point of the text.</li><li data-y=1>Second point.</li></ul>
    <div class="related" data-y=0><h3 data-y=0>Related</h3><ul data-y=0><li data-y=0><a>Other story</a></li></ul></div></div>
    <div class="footer" data-y=0><p data-y=0>Copyright</p></div>""",
    f"""<header data-y=0><h1 data-y=0>Name</h1><form data-y=0><p data-y=0>Search</p></form></header><main data-y=1><h1 data-y=1>Title</h1>
    <div data-y=1><p data-y=1>{_BODY}</p><blockquote data-y=1><p data-y=1>{_BODY}</p></blockquote><table data-y=1><tr data-y=1><td data-y=1>cell
    </td><td data-y=1>12</td></tr></table></div><aside data-y=0><h3 data-y=0>More</h3><p data-y=0>{_BODY}</p></aside>
    <section class="comments" data-y=0><h3 data-y=0>Comments</h3><div class="comment" data-y=0><p data-y=0>{_BODY}</p></div></section></main>
    <footer data-y=0><div data-y=0><p data-y=0>Imprint</p></div></footer>""",
    f"""<div class="notice" data-y=0><p data-y=0>{_BODY}</p></div><article data-y=1><header data-y=1><h1 data-y=1>Title</h1></header>
    <section data-y=1><h2 data-y=1>Part</h2><p data-y=1>{_BODY}</p><pre data-y=1>x = 1</pre><figure data-y=1><figcaption data-y=1>A picture</figcaption>
    </figure></section><div data-y=1><p data-y=1>Short.</p></div><div class="ad" data-y=0><p data-y=0>Buy now, it is cheap.</p></div>
    <div class="share" data-y=0><ul data-y=0><li data-y=0><a>Mail</a></li></ul></div><aside data-y=0><p data-y=0>{_BODY}</p></aside>
    <form data-y=0><div data-y=0><p data-y=0>Your address</p></div></form><footer data-y=0><p data-y=0>Posted in news</p></footer>
    <nav data-y=0><p data-y=0>Next page</p></nav><section id="comments" data-y=0><ol data-y=0><li data-y=0><p data-y=0>{_BODY}</p></li></ol>
    </section></article><div class="sidebar" data-y=0><div data-y=0><h3 data-y=0>Popular</h3><p data-y=0>{_BODY}</p></div></div>""",
    f"""<div data-y=1><h1 data-y=1>Title</h1><p data-y=1>{_BODY}</p><p data-y=1>{_BODY}</p></div>
    <div id="comments" data-y=0><div data-y=0><p data-y=0>{_BODY}</p></div></div><div data-y=0><a>One</a> <a>Two</a></div>""",
    f"""<h1 data-y=1>Title</h1><p data-y=1>{_BODY}</p><p data-y=1>{_BODY}</p><h2 data-y=1>Part</h2><p data-y=1>{_BODY}</p>
    <ul data-y=1><li data-y=1>One point of it.</li></ul><blockquote data-y=1>{_BODY}</blockquote><ul data-y=0><li data-y=0><a>Home</a></li></ul>
    <form data-y=0><p data-y=0>Mail</p></form><aside data-y=0>{_BODY}</aside><p class="copyright" data-y=0>All rights</p>""",
    f"""<section data-y=1><h1 data-y=1>Title</h1><div class="text" data-y=1><p data-y=1>{_BODY}</p><p class="notice" data-y=0>{_BODY}</p>
    <ul class="menu" data-y=0><li data-y=0><a>Go</a></li></ul></div></section><section class="newsletter" data-y=0><p data-y=0>{_BODY}</p></section>
    <div class="cookie-banner" data-y=0><p data-y=0>{_BODY}</p></div>""",
    f"""<body data-y=1><div class="menu" data-y=0><a>Home</a></div><h1 data-y=1>Title</h1>{_BODY}<br>{_BODY}<h2 data-y=1>Part</h2>{_BODY}
    <div class="footer" data-y=0>Imprint</div></body>""",
    f"""<body data-y=1>{_BODY}<p data-y=1>{_BODY}<ul data-y=1><li data-y=1>One point of it.</li></ul></body>""",
    f"""<body data-y=0><div class="menu" data-y=0><a>Home</a></div> | <div data-y=1><h1 data-y=1>Title</h1><p data-y=1>{_BODY}</p></div>Imprint</body>""",
    *(f"<body data-y=1><h1 data-y=1>Title</h1>{text}<br>{text}</body>" for text in (_BODY[:90], _BODY[:220], _BODY * 2, _BODY * 8)),
    *(f'<body data-y=0>{text}<div class="content" data-y=1><h1 data-y=1>Title</h1><p data-y=1>{_BODY}</p></div></body>' for text in (
        "Home", "Imprint and contact", "Our motto, and contact of this site", "<a>Home</a> <a>News</a>", "<a>Some link</a> " * 40)),
]
_OUT_TAGS = {"nav", "aside", "footer", "form"}


def _labels(nodes: list[Node]) -> list[int]:
    """Seed labels, else: inside an article or main element and in no part that marks itself as other."""
    out: list[int] = []
    for n in nodes:
        if n.label is not None:
            out.append(n.label)
            continue
        above = out[n.parent] if n.parent >= 0 else 0
        inside = above or n.tag in ("article", "main")
        out.append(int(bool(inside) and n.tag not in _OUT_TAGS and n.hint != 1 and not (n.tag == "header" and not above)))
    return out


def _above(nodes: list[Node], parent: int, y: int) -> int:
    """The parent's state as the potentials know it: 3 and 4 are the body's."""
    return y + 3 if nodes[parent].tag == "body" else y


def count_page(page: str, into: Counter, weight: int = 1) -> None:
    nodes, _ = parse(page)
    labels, emitted = _labels(nodes), _emissions(nodes)
    for n, y, (hint, inner, size, link) in zip(nodes, labels, emitted, strict=True):
        above = _above(nodes, n.parent, labels[n.parent]) if n.parent >= 0 else 2
        into["tree", above * 3 + hint, n.cat, y] += weight
        into["hint", hint, "", y] += weight
        if inner == 3:                          # its tag says what it is, whatever its text is like
            continue
        inner -= 5 * (inner > 4)
        into["body" if inner == 2 else "size", inner * 8 + size, "", y] += weight
        into["body" if inner == 2 else "link", inner * 8 + (8 if inner == 2 else 0) + link, "", y] += weight


class PageModel:
    """Potentials from counts {(kind, a, b, y): n}."""

    def __init__(self, counts: dict[tuple[str, int, str, int], int]):
        s = SMOOTHING
        cats = sorted(set(CATEGORY.values()))
        by_hint = {}
        for hint in range(3):
            n0, n1 = (counts.get(("hint", hint, "", y), 0) + s for y in (0, 1))
            by_hint[hint] = n1 / (n0 + n1)
        self.tree = {}                              # (parent's state, hint, tag kind) -> P(state)
        for above in (0, 1, 2, 3, 4):               # 2: no parent; 3, 4: a body with loose text that isn't main text, or is
            for hint in range(3):
                for c in cats:
                    n0, n1 = (counts.get(("tree", above * 3 + hint, c, y), 0) for y in (0, 1))
                    if above > 2:                   # as without a parent, or within main text, unless counted otherwise
                        prior = self.tree[2 if above == 3 else 1, hint, c][1]
                    elif c == "body":
                        prior = 0.1 if hint == 1 else 0.5
                    else:
                        prior = by_hint[hint] if above == 2 or hint == 1 else 0.1 + 0.8 * above
                    p = (n1 + BACKOFF * prior) / (n0 + n1 + BACKOFF)
                    self.tree[above, hint, c] = (1 - p, p)
        self.ratio = {}
        for kind, values in (("size", range(16)), ("link", range(16)), ("body", range(16, 24)), ("body", range(24, 28))):
            totals = [sum(counts.get((kind, v, "", y), 0) + s for v in values) for y in (0, 1)]
            for v in values:
                p0, p1 = ((counts.get((kind, v, "", y), 0) + s) / totals[y] for y in (0, 1))
                self.ratio[kind, v] = math.log(p1 / p0)

    def unary(self, inner: int, size: int, link: int) -> tuple[float, float]:
        if inner == 3:
            return 0.5, 0.5
        if inner > 4:                           # short and linked paragraphs belong to an article like others
            r = INSIDE_WEIGHT * (self.ratio["size", (inner - 5) * 8 + size] + self.ratio["link", (inner - 5) * 8 + link])
        elif inner == 2:                          # nothing else says what a body's loose text is
            r = self.ratio["body", 16 + size] + self.ratio["body", 24 + link]
        else:
            r = SIZE_WEIGHT * self.ratio["size", inner * 8 + size] + LINK_WEIGHT * self.ratio["link", inner * 8 + link]
        r = max(-30.0, min(30.0, r))
        return 1 / (1 + math.exp(r)), 1 / (1 + math.exp(-r))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(main text) of every node by sum-product, up and down the tree."""
        n = len(nodes)
        phi = [list(self.unary(*e[1:])) for e in _emissions(nodes)]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, -1, -1):
            p = nodes[k].parent
            if p >= 0:
                a, b = phi[k]
                h, c = nodes[k].hint, nodes[k].cat
                t0, t1 = self.tree[_above(nodes, p, 0), h, c], self.tree[_above(nodes, p, 1), h, c]
                m0, m1 = t0[0] * a + t0[1] * b, t1[0] * a + t1[1] * b
                z = m0 + m1
                up[k] = m0, m1 = m0 / z, m1 / z
                f = phi[p]
                f[0], f[1] = f[0] * m0, f[1] * m1
                z = f[0] + f[1]
                f[0], f[1] = f[0] / z, f[1] / z
        out = [0.0] * n
        for k in range(n):
            p, cat, h = nodes[k].parent, nodes[k].cat, nodes[k].hint
            if p < 0:
                d0, d1 = self.tree[2, h, cat]
            else:
                q1 = out[p] / max(up[k][1], 1e-300)        # the parent's belief without this child
                q0 = (1 - out[p]) / max(up[k][0], 1e-300)
                t0, t1 = self.tree[_above(nodes, p, 0), h, cat], self.tree[_above(nodes, p, 1), h, cat]
                d0, d1 = q0 * t0[0] + q1 * t1[0], q0 * t0[1] + q1 * t1[1]
            b0, b1 = d0 * phi[k][0], d1 * phi[k][1]
            out[k] = b1 / (b0 + b1)
        return out

    def extract(self, page: str) -> str:
        nodes, blocks = parse(page)
        p = self.marginals(nodes)
        loose = self.tree[2, 0, "p"][1]
        return "\n".join(text for k, text in blocks if (p[k] if k >= 0 else loose) > 0.5)


def train(pages: DataFrame, max_pages: int = MAX_TRAIN_PAGES) -> PageModel:
    """Count the tables on at most ``max_pages`` pages that mark their article, and the seeds."""
    prepare(pages)
    marked = pages.filter(F.lower("html").rlike("<(article|main)[ >]"))
    ids = marked.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    chosen = marked.join(F.broadcast(ids), "page_id", "left_semi").select(as_bytes("html"))   # at most max_pages ids

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_page(page.decode("utf-8", "replace"), seen)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int32()),
                                          pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "a", "b", "y", "n"])

    rows = (chosen.mapInArrow(emit, "kind string, a int, b string, y int, n long")
            .groupBy("kind", "a", "b", "y").agg(F.sum("n").alias("n")).collect())   # bounded: the model's cells
    counts: Counter = Counter({(r["kind"], r["a"], r["b"], r["y"]): r["n"] for r in rows})
    for page in SEEDS:
        count_page(page, counts, SEED_WEIGHT)
    return PageModel(dict(counts))


def extract(pages: DataFrame, model: PageModel) -> DataFrame:
    """``pages`` without html, plus text and n_chars."""
    spark = prepare(pages)
    sent = spark.sparkContext.broadcast((model.tree, model.ratio))
    base = [f.name for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    df = pages.select(*base, as_bytes("html").alias("_h_html"))
    schema = plus(pages.select(*base).schema, text="string", n_chars="long")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PageModel({})
        m.tree, m.ratio = sent.value
        for batch in batches:
            for part, texts in text_slices(batch, "_h_html"):
                out = [m.extract(t.decode("utf-8", "replace")) if t else "" for t in texts]
                cols = [part.column(k) for k in range(len(base))]
                cols += [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*base, "text", "n_chars"])

    return df.mapInArrow(emit, schema)
