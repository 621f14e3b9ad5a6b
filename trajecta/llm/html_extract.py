"""HTML extraction: a tree-structured graphical model over the DOM.

Block elements and the runs of text in them are the variables: part of the main text or not. A node's own look (tag,
class words, length, links, punctuation) gives its potential, and each parent-child pair has a potential by the kind of
the child; both are counted from labelled pages. Sum-product messages, first from the leaves up, then from the root
down, give every node's exact marginal; a run of text whose marginal is above one half belongs to the main text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajecta.llm.common import map_batches, table, with_outputs

BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol option p pre search section select summary svg table tbody td template tfoot th thead tr ul video".split()
)
#: What these hold is no text; an end tag that is missing is only looked for where the content is code.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title")}
CODE = ("script", "style")
ALIKE, ANY = 0.6, "*"
CONTAINERS = frozenset("div section article main aside header footer nav form".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: An open element of the set is closed by a start tag of the key, up to the barrier.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+(?=>)""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|data-main)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[a-z]{2,}")
MOST_WORDS = 12  # of an attribute that tell about an element


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of tags, comments and declarations (without name), in one pass.

    A > within quotes does not end a tag. After a quote that is never closed, quotes mean nothing; a tag without > is text.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        name = NAME.match(page, start)
        if not name and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1
            continue
        begin = name.end() if name else start
        inner = ATTRIBUTES.match(page, begin) if quotes and name else None
        if inner:
            end = inner.end()
        else:
            quotes = quotes and not name
            end = page.find(">", begin)
            if end < 0:
                return
        at = end + 1
        yield start, at, name[1] if name else "", name[2] if name else "", page[begin:end]


class Node:
    __slots__ = ("tag", "sign", "parent", "text", "links", "label")

    def __init__(self, tag: str, sign: tuple, parent: int, label: bool | None = None) -> None:
        self.tag, self.sign, self.parent, self.label = tag, sign, parent, label
        self.text: list[str] | None = None
        self.links = 0


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[tuple, bool | None]:
    """The signature of an element (its tag and the words of its class, id and role), and its label if it carries one."""
    words, label, hidden = set(), None, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words |= set(WORDS.findall(value)[:MOST_WORDS])
        elif name == "data-main":
            label = value == "1"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        else:
            hidden |= value != "false"
    return ("e", tag, *sorted(words), *["(hidden)"] * hidden), label


def parse(page: str) -> list[Node]:
    """Block elements and runs of text, parents before children, in page order."""
    nodes = [Node("html", ("e", "html"), -1)]
    stack, run, links, at, missing = [0], [], 0, 0, set()  # links: open <a> elements

    def add_text(piece: str) -> None:
        nonlocal run
        if not run:
            run = nodes_run = [len(nodes)]
            nodes.append(Node("#text", (), stack[-1]))
            nodes[nodes_run[0]].text = []
        node = nodes[run[0]]
        node.text.append(piece)
        if links:
            node.links += len(piece)

    for start, stop, close, tag, attributes in tags(page):
        if start < at:
            continue  # within a skipped element
        if start > at:
            piece = page[at:start]
            if run or not piece.isspace():
                add_text(entities.unescape(piece) if "&" in piece else piece)
        at = stop
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                run = []
                same = HEADINGS if tag in HEADINGS else (tag,)
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in same:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            if not attributes.endswith("/") and tag not in missing:
                end = RAW[tag].search(page, at)
                if not end:
                    missing.add(tag)  # and none behind it
                at = end.end() if end else len(page) if tag in CODE else at
            continue
        if tag == "br":
            if run:
                add_text(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            run = []
            if tag == "html":
                continue
            if tag == "hr":
                continue
            links = 0
            if nodes[stack[-1]].tag == "svg":  # a block within a drawing ends it
                stack.pop()
            if nodes[stack[-1]].tag == "p" or tag in CLOSES:
                shut, barrier = CLOSES.get(tag, (set(), set()))
                if nodes[stack[-1]].tag == "p":
                    stack.pop()
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in barrier:
                        break
                    if nodes[stack[k]].tag in shut:
                        del stack[k:]
                        break
            sign, label = _element(tag, attributes)
            nodes.append(Node(tag, sign, stack[-1], label))
            stack.append(len(nodes) - 1)
    if at < len(page) and not page[at:].isspace():
        add_text(entities.unescape(page[at:]))
    if not any(n.tag == "body" for n in nodes):
        nodes[0].tag = "body"  # it may be left out
    return nodes


def _text_sign(node: Node, text: str) -> tuple:
    """What a run of text looks like: number of words, share of link text, sentence ends, and marks of rights."""
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 6 else 2 if words < 12 else 3 if words < 30 else 4
    linked = min(3, 4 * node.links // max(1, len(text)))
    return ("t", "#text", f"words-{size}", f"links-{linked}", f"stop-{text[-1:] in '.!?…。' and words > 2}", *["rights"] * ("©" in text))


def _kind(sign: tuple) -> str:
    return "text" if sign[0] == "t" else "block"


class TreeModel:
    """Potentials counted from labelled nodes, with add-one smoothing."""

    def __init__(self, pages: list[str]) -> None:
        """pages: HTML whose elements carry data-main="1" (main text from here on down) or "0" (not)."""
        seen: list[Counter] = [Counter(), Counter()]
        step = Counter()
        total = [0, 0]
        for page in pages:
            nodes, labels = parse(page), []
            for n in nodes:
                above = labels[n.parent] if n.parent >= 0 else 0
                y = above if n.label is None else int(n.label)
                labels.append(y)
                if n.text is not None:
                    text = " ".join("".join(n.text).split())
                    if not text:
                        continue
                    n.sign = _text_sign(n, text)
                if n.parent >= 0:
                    seen[y].update(((nodes[n.parent].tag, n.tag), (nodes[n.parent].tag, None), (ANY, n.tag), (ANY, None)))
                group = self._group(n.sign, nodes[n.parent].tag)
                seen[y].update({(group, f) for f in n.sign[2:]})
                seen[y].update(((group, None), (group, n.sign[2:])))
                step[_kind(n.sign), above, y] += 1
                total[y] += 1
        self.seen = seen
        self.step = {k: tuple(tuple((step[k, a, y] + 1) / (step[k, a, 0] + step[k, a, 1] + 2) for y in (0, 1)) for a in (0, 1)) for k in ("text", "block")}
        self.known: dict[tuple, float] = {}

    @staticmethod
    def _group(sign: tuple, under: str) -> str:
        """Elements are compared with those of their kind, runs of text with those in elements of the same kind."""
        if sign[0] == "e":
            return "container" if sign[1] in CONTAINERS else "block"
        return f"text in {under if under in ('p', 'li', 'div', 'td') else 'heading' if under in HEADINGS else 'other'}"

    def odds(self, sign: tuple, under: str) -> float:
        """The potential of a node's look for main text, relative to not: its tag below its parent's, and its other features."""
        got = self.known.get((sign, under))
        if got is None:
            got, group = 1.0, self._group(sign, under)
            own = list(sign[2:])
            if sign[0] == "e" and self.seen[0][group, sign[2:]] + self.seen[1][group, sign[2:]] >= 5:
                own = [sign[2:]]  # words that are often seen together, or none, count as one
            known = lambda x: self.seen[0][x] or self.seen[1][x]
            below = (under, sign[1]) if known((under, sign[1])) else (ANY, sign[1])
            for where, f in [x for x in (below, *[(group, f) for f in own]) if known(x)]:  # what was not seen says nothing
                a, b = ((self.seen[y][where, f] + 0.5) / (self.seen[y][where, None] + 1) for y in (1, 0))
                got *= a / b
            if len(self.known) < 100_000:
                self.known[sign, under] = got
        return got

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of main text for each node, by sum-product up and down the tree. The root is none.

        Siblings of one tag resemble each other, so that the looks of n of them (and of the text in them) count as n ** (1 - ALIKE).
        """
        n = len(nodes)
        alike = Counter((x.parent, x.tag) for x in nodes)
        weight = [alike[x.parent, x.tag] ** -ALIKE for x in nodes]
        for i in range(1, n):
            if nodes[i].text is not None:
                weight[i] *= weight[nodes[i].parent]
        up0, up1 = [1.0] * n, [self.odds(x.sign, nodes[x.parent].tag) ** w if x.sign else 1.0 for x, w in zip(nodes, weight, strict=True)]
        sent = [(1.0, 1.0)] * n
        up1[0] = 0.0
        for i in range(n - 1, 0, -1):
            a, b = up0[i], up1[i]
            t = self.step["text" if nodes[i].text is not None else "block"]
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = m0 + m1
            sent[i] = m = (m0 / s, m1 / s)
            p = nodes[i].parent
            c, d = up0[p] * m[0], up1[p] * m[1]
            s = c + d
            up0[p], up1[p] = c / s, d / s
        out0, out1 = [1.0] * n, [0.0] * n
        for i in range(1, n):
            p, m = nodes[i].parent, sent[i]
            c, d = out0[p] / m[0], out1[p] / m[1]  # the parent without what this child said
            t = self.step["text" if nodes[i].text is not None else "block"]
            a, b = up0[i] * (c * t[0][0] + d * t[1][0]), up1[i] * (c * t[0][1] + d * t[1][1])
            s = a + b
            out0[i], out1[i] = a / s, b / s
        return out1

    def extract(self, page: str) -> str:
        nodes = parse(page)
        texts = {}
        for i, n in enumerate(nodes):
            if n.text is not None:
                text = " ".join("".join(n.text).split())
                if text:
                    n.sign = _text_sign(n, text)
                    texts[i] = text
        p = self.marginals(nodes)
        return " ".join([t for i, t in texts.items() if p[i] > 0.5])


#: Class names that pages use, by what the element holds; they label training pages and are no features by themselves.
CLASS_NAMES = {
    "content": "content post-content article-body entry entry-content story-text post story main body-text prose article text blog-post news-item reading",
    "menu": "menu navbar main-menu navigation nav breadcrumb breadcrumbs pagination pager tabs toolbar toc skip-links crumbs",
    "header": "header site-header masthead topbar banner branding logo top-bar hero",
    "footer": "footer site-footer copyright page-footer legal colophon bottom credits foot",
    "side": "sidebar widget related recommended side-rail rail widgets complementary right-column trending popular teaser more-links tags aside",
    "advert": "ad ads advert sponsored advertisement promo ad-banner sponsor dfp promotion advertising promoted-links",
    "notice": "cookie-notice notice consent alert popup gdpr-banner modal overlay message-bar toast privacy-warning cookies paywall disclaimer",
    "form": "search newsletter login subscribe signup register contact-form subscription poll survey search-box",
    "comments": "comments comment-list discussion replies respond thread reviews commentlist feedback disqus",
    "comment": "comment reply comment-body review-item post-comment",
    "social": "share social sharing follow like-buttons share-bar",
}


def labelled_pages(n: int = 1500, seed: int = 5) -> list[str]:
    """Labelled pages of many layouts: articles in <article>, <main>, or classed <div>; headings, lists, quotes, tables and
    figures in them; menus, headers, footers, sidebars, adverts, notices, forms and comments around and inside."""
    r = random.Random(seed)
    syllables = "ta re mi on sel ver an ko li dor es pa ni tur am be que sto la gen ik ou wal tri".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(3, 18).capitalize() + r.choice(".....!?") for _ in range(r.randint(lo, hi)))

    names = {k: v.split() for k, v in CLASS_NAMES.items()}

    def cls(kind: str) -> str:
        both = f"{r.choice(names[kind])} {r.choice(names[kind])}" if r.random() < 0.15 else r.choice(names[kind])
        return f' {r.choice(("class", "class", "id"))}="{both}"' if r.random() < 0.85 else ""

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(lo, hi)))

    def off(tag: str, inner: str, kind: str | None = None) -> str:
        return f'<{tag} data-main="0"{cls(kind) if kind else ""}>{inner}</{tag}>'

    def menu() -> str:
        return r.choice([lambda: off("nav", f"<ul>{links(2, 9)}</ul>"), lambda: off("nav", f"<ul>{links(2, 9)}</ul>", "menu"), lambda: off("div", f"<ul>{links(3, 9)}</ul>", "menu"), lambda: off("ul", links(2, 7), "menu")])()

    def advert() -> str:
        return r.choice([lambda: off("div", sentences(1, 2), "advert"), lambda: off("div", f"<p>{sentences(1, 3)}</p><a href=/b>{words(1, 4)}</a>", "advert"), lambda: off("aside", sentences(1, 2), "advert")])()

    def notice() -> str:
        return off(r.choice(("div", "section", "dialog")), f"<p>{sentences(1, 3)}</p><button>{words(1, 2)}</button>" if r.random() < 0.6 else sentences(1, 2), "notice")

    def form() -> str:
        return r.choice([lambda: f'<form data-main="0" action="/s"{cls("form")}><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>', lambda: off("div", f"<p>{sentences(1, 1)}</p><form><input><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 1)}</button></form>", "form")])()

    def social() -> str:
        return off(r.choice(("div", "ul")), f"<li><a href=/f>{words(1, 1)}</a></li><li><a href=/t>{words(1, 2)}</a></li>", "social")

    def comments() -> str:
        tag, item = r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("div", "p"), ("div", "article")))
        inner = "".join(f'<{item}{cls("comment")}>' + (f"<p>{sentences(1, 4)}</p>" if item != "p" else sentences(1, 3)) + f"</{item}>" for _ in range(r.randint(1, 6)))
        return f'<{tag} data-main="0" {r.choice(("class", "id"))}="{r.choice(names["comments"])}"><h{r.randint(2, 4)}>{words(1, 3)}</h3>{inner}</{tag}>'

    def header() -> str:
        return off("header", r.choice((f"<h1>{words(1, 4)}</h1>", f"<div class=logo>{words(1, 3)}</div>", f"<p>{words(2, 7)}</p>")) + (menu() if r.random() < 0.4 else "")) if r.random() < 0.6 else off("div", f"<h2>{words(1, 4)}</h2><p>{words(2, 8)}</p>", "header")

    def footer() -> str:
        inner = r.choice((f"&copy; {words(1, 4)} &middot; {sentences(1, 2)}", f"<p>&copy; {words(1, 5)}</p><ul>{links(1, 5)}</ul>", f"<p>{sentences(1, 2)}</p>", f"{words(3, 9)}"))
        return off("footer", inner) if r.random() < 0.7 else off("div", inner, "footer")

    def side() -> str:
        inner = r.choice((f"<h3>{words(1, 3)}</h3><ul>{links(2, 8)}</ul>", f"<h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p>", f"<p>{sentences(1, 2)}</p>"))
        return off("aside", inner) if r.random() < 0.5 else off("div", inner, "side")

    def junk(p: float) -> str:
        return "".join(f() for f in r.sample((advert, notice, form, side, social), 2) if r.random() < p)

    def body() -> str:
        style = r.random()  # some pages write without sentences
        out = [f"<h1>{words(2, 9)}</h1>" if r.random() < 0.8 else ""]
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            x = r.random()
            if x < 0.62:
                inner = r.choice((sentences(1, 8), sentences(1, 1), f"{sentences(1, 2)} <a href=/y>{words(1, 3)}</a> {sentences(1, 2)}", f"<b>{sentences(1, 2)}<br>", words(1, 4) + ".", f"<em>{sentences(1, 2)}</em>", words(2, 20)) if style < 0.75 else (words(30, 90), words(8, 40), words(1, 4), " ".join([words(1, 1)] * r.randint(5, 60)), re.sub(r"(\s)", r"***\1", sentences(1, 4)) + "###", sentences(1, 2)))
                out.append(f"<p>{inner}" + ("</p>" if r.random() < 0.8 else ""))
            elif x < 0.7:
                out.append(f"<h{r.randint(2, 4)}>{words(1, 7)}</h2>".replace("</h2>", ""))
                out[-1] = re.sub(r"^<(h\d)>(.*)$", r"<\1>\2</\1>", out[-1])
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{sentences(1, 1) if r.random() < 0.7 else words(1, 6)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.8:
                out.append(f"<blockquote>{'<p>' if r.random() < 0.5 else ''}{sentences(1, 3)}</blockquote>")
            elif x < 0.83:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.86:
                out.append(f"<figure><img src=a.png><figcaption>{sentences(1, 1)}</figcaption></figure>")
            elif x < 0.9:
                out.append(f"<div>{sentences(1, 4)}</div>")
            elif x < 0.92:
                out.append(f"<pre>{words(2, 12)}\n{words(2, 12)}</pre>")
            elif x < 0.95:
                out.append(junk(0.7))
            elif x < 0.965:
                out.append(r.choice((f"<noscript>{sentences(1, 2)}</noscript>", f"<p>{sentences(1, 1)}<svg><text>{words(1, 3)}</text></svg>{sentences(1, 1)}</p>", f"<p>{words(2, 5)} <math><mi>{words(1, 1)}</mi></math> {sentences(1, 1)}</p>", f"<object><p>{sentences(1, 1)}</p></object>")))
            else:
                out.append(sentences(1, 3))
        if r.random() < 0.2:
            out.append(comments())
        return "".join(out)

    pages = []
    for _ in range(n):
        open_, close = r.choice((("<article data-main=1>", "</article>"), ("<article data-main=1>", "</article>"), (f'<article data-main=1 {cls("content")}>', "</article>"), ("<main><article data-main=1>", "</article></main>"), ("<main data-main=1>", "</main>"), (f'<div data-main=1 class="{r.choice(names["content"])}">', "</div>"), (f'<section data-main=1 id="{r.choice(names["content"])}">', "</section>"), ("<div><div data-main=1>", "</div></div>")))
        top = "".join(f() for f in (header, menu, notice, advert, form) if r.random() < 0.5)
        end = "".join(f() for f in (comments, side, form, advert, notice) if r.random() < 0.4) + (footer() if r.random() < 0.85 else "")
        wrap = r.random() < 0.3
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{'<div id=page>' * wrap}{top}{open_}{body()}{close}{end}{'</div>' * wrap}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    """The model of the built-in labelled pages (a bounded set that is made anew from its seed in a second or two)."""
    return TreeModel(labelled_pages())


def extract_pages(df: DataFrame, model: TreeModel, html: str = "html") -> DataFrame:
    """df without its html, with text and n_chars (code points).

    Null or empty html gives an empty text, as does a page without main text. Whole pages are read, however long or
    deep. Repeated rows get the same result; input columns named text or n_chars are replaced.
    """
    df = with_outputs(df, ["text", "n_chars"])
    fields = [f for f in df.schema.fields if f.name != html]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [model.extract(x) if x else "" for x in b.column(b.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in fields] + ["text", "n_chars"])

    return map_batches(df.select(*[f"`{f.name}`" for f in fields], f"`{html}`"), run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars long"]))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), default_model())
