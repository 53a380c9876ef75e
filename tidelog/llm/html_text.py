"""Main text of web pages: boosted trees over DOM-node features, decoded hierarchically.

Every block element gets features of its subtree (text, density of tags, links and punctuation), its attribute tokens and those
of its ancestors, its depth and place, and its siblings. Boosted trees give each element's log-odds of holding main text. Decoding
finds, in one pass over the tree, the likeliest choice in which nothing below a dropped element is kept.

The trees are trained here, on pages with known parts: ``sample_page`` makes menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside articles of many shapes, by telling names; ``plain_page`` makes pages whose names tell nothing, down
to bare bodies, tables and nested boxes, so that structure alone must do. Training is deterministic and needs no corpus, so results do
not depend on the table's size.

Defined cases: null or empty HTML gives an empty text; a page without main text too; broken markup is read as far as it goes;
repeated rows are extracted each; columns other than id, URL and HTML are ignored.
"""

from __future__ import annotations

import functools
import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .gbt import Boosted
from .html_dom import Page

#: Tokens of class, id and role that tell what a part is for; and the elements' own kinds.
TOKENS = {
    "main": "article articlebody main content story post entry text body copy prose read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager",
    "head": "header masthead head banner hero logo branding",
    "foot": "footer foot bottom copyright colophon legal",
    "side": "sidebar aside side rail widget widgets complementary secondary",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay banner subscribe newsletter paywall",
    "talk": "comment comments reply replies discussion disqus respond reader",
    "form": "form search login signup signin contact subscribe register",
    "more": "related share sharing social recommended more tags tagged links popular trending follow",
}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "body", "html", "dl", "dd", "address", "fieldset")
_WHAT = {w: [k for k, words in enumerate(TOKENS.values()) if w in words.split()] for v in TOKENS.values() for w in v.split()}
_TAG = {t: k for k, t in enumerate(TAGS)}
_K = len(TOKENS)


def features(pages: list[Page]) -> np.ndarray:
    """A row for each block element of all pages, one page after the other."""
    count = [len(p.tag) for p in pages]
    n = sum(count)
    own, link, marks, pieces = (np.zeros(n) for _ in range(4))
    kinds, tags = np.zeros((n, _K)), np.full(n, len(TAGS))
    parent, depth, page = np.zeros(n, np.int64), np.zeros(n), np.repeat(np.arange(len(pages)), count)
    before = np.zeros(n)
    base = 0
    for p in pages:
        seen = 0
        o, lk, mk, pc = [0] * len(p.tag), [0] * len(p.tag), [0] * len(p.tag), [0] * len(p.tag)
        first = [-1] * len(p.tag)
        for node, text, linked in p.pieces:
            if text is None:
                if first[node] < 0:
                    first[node] = seen
                continue
            size = len(text)
            o[node] += size
            seen += size
            pc[node] += 1
            if linked:
                lk[node] += size
            mk[node] += text.count(".") + text.count(",")
        s = slice(base, base + len(p.tag))
        own[s], link[s], marks[s], pieces[s], before[s] = o, lk, mk, pc, first
        parent[s] = np.array(p.parent) + base
        depth[s] = p.depth
        tags[s] = [_TAG.get(t, len(TAGS)) for t in p.tag]
        for k, names in enumerate(p.names):
            for w in names:
                for c in _WHAT.get(w, ()):
                    kinds[base + k, c] = 1
        base += len(p.tag)
    root = np.cumsum([0, *count[:-1]]).astype(np.int64) if count else np.zeros(0, np.int64)
    parent[root] = root
    chars, links, signs, parts, nodes = own.copy(), link.copy(), marks.copy(), pieces.copy(), np.ones(n)
    above = kinds.copy()
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2 if n else 1))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for level in reversed(levels):
        up = parent[level]
        for x in (chars, links, signs, parts, nodes):
            np.add.at(x, up, x[level])
    tag_above = np.zeros((n, 6))
    group = np.zeros(len(TAGS) + 1, np.int64)
    for k, names in enumerate((("article", "main"), ("nav",), ("footer",), ("aside",), ("form", "fieldset"), ("header",))):
        group[[_TAG[t] for t in names]] = k + 1
    mine = group[tags]
    tag_above[np.arange(n)[mine > 0], mine[mine > 0] - 1] = 1
    for level in levels:
        above[level] = np.maximum(above[level], above[parent[level]])
        tag_above[level] = np.maximum(tag_above[level], tag_above[parent[level]])
    kids, kid_chars, kid_links, kid_max, place = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    inner = np.flatnonzero(parent != np.arange(n))
    np.add.at(kids, parent[inner], 1)
    np.add.at(kid_chars, parent[inner], chars[inner])
    np.add.at(kid_links, parent[inner], links[inner])
    np.maximum.at(kid_max, parent[inner], chars[inner])
    by = np.lexsort((np.arange(len(inner)), parent[inner]))
    ordered = parent[inner][by]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, int)
    place[inner[by]] = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))
    total = chars[root][page] if n else chars
    safe = lambda a, b: a / np.maximum(b, 1)
    paragraphs = np.zeros(n)
    is_p = np.flatnonzero(tags == _TAG["p"])
    np.add.at(paragraphs, parent[is_p], 1)
    columns = [
        np.log1p(own), np.log1p(chars), safe(links, chars), safe(signs, chars) * 100, safe(nodes, chars) * 100, safe(chars, parts), safe(chars, total),
        depth, kids, paragraphs, place, safe(place, kids[parent] - 1), kids[parent], safe(kid_links[parent] - links, kid_chars[parent] - chars),
        safe(kid_max[parent], np.maximum(chars, 1)), safe(np.maximum(before, 0), total), safe(link, own), np.log1p(nodes),
    ]
    one = np.zeros((n, len(TAGS) + 1))
    one[np.arange(n), tags] = 1
    up = np.zeros((n, len(TAGS) + 1))
    up[np.arange(n), tags[parent]] = 1
    return np.concatenate([np.stack(columns, 1) if n else np.zeros((0, 18)), one, up[:, [_TAG[t] for t in ("article", "main", "nav", "footer", "aside", "form", "header", "ul", "li", "body")]], kinds, above, tag_above], 1).astype(np.float32)


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The likeliest choice without a kept element below a dropped one. ``parent`` comes before child; the root is kept."""
    n = len(parent)
    yes = -np.logaddexp(0, -odds)
    no = (-np.logaddexp(0, odds)).tolist()
    keep, drop = yes.tolist(), no[:]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        keep[p] += keep[i] if keep[i] > drop[i] else drop[i]
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


# --- training pages -------------------------------------------------------------------------------------------------------


def invented(r: random.Random, n: int, main: bool) -> str:
    """Words; those of main text begin with ``Q``, others not."""
    out = []
    for _ in range(n):
        w = "".join(r.choice("aeiourstnlmdchbgp") for _ in range(r.randint(1, 9)))
        out.append(("Q" if main else "z") + w + r.choice(["", "", "", "", ",", ".", "***", " &amp;"]))
    return " ".join(out)


def sample_page(r: random.Random) -> str:
    """HTML of an invented page with names that tell what its parts are for."""

    def words(n: int, main: bool) -> str:
        return invented(r, n, main)

    def count() -> int:
        return max(1, int(math.exp(r.uniform(0, 5.3))))

    def cls(*names: str) -> str:
        kind = r.random()
        name = r.choice(names)
        return "" if kind < 0.1 else f' class="{name}"' if kind < 0.7 else f" id='{name}'" if kind < 0.85 else f' class="{r.choice(["box", "c1", "row"])} {name}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(r.randint(1, 3), False)}</a></li>' for k in range(n))

    def menu() -> str:
        tag = r.choice(["nav", "nav", "div", "header"])
        c = cls("nav", "menu", "navbar", "breadcrumb") if tag != "nav" or r.random() < 0.3 else ""
        if tag == "div" and not c:
            c = ' class="menu"'
        return f"<{tag}{c}><ul>{links(r.randint(2, 9))}</ul></{tag}>"

    def ad(where: str = "div") -> str:
        return f'<{where} class="{r.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-box"])}">{words(r.randint(1, 40), False)}</{where}>'

    def notice() -> str:
        return f'<div class="{r.choice(["cookie-notice", "notice", "consent", "newsletter", "alert", "paywall popup"])}"><p>{words(r.randint(3, 40), False)}</p></div>'

    def sidebar() -> str:
        tag = r.choice(["aside", "div"])
        c = cls("sidebar", "widget", "rail") if tag == "aside" else ' class="sidebar"'
        body = r.choice([lambda: f"<h3>{words(2, False)}</h3><ul>{links(4)}</ul>", lambda: f"<p>{words(r.randint(3, 60), False)}</p>", lambda: words(r.randint(3, 40), False)])()
        return f"<{tag}{c}>{body}</{tag}>"

    def form() -> str:
        return f'<form{cls("search", "login", "contact")}><label>{words(2, False)}</label><input name="q"><p>{words(r.randint(1, 12), False)}</p><button>{words(1, False)}</button></form>'

    def talk() -> str:
        tag = r.choice(["section", "div", "ul"])
        item = "li" if tag == "ul" else "div"
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "discussion", "replies"])}"><{item} class="{r.choice(["comment", "reply", ""])}"><p>{words(count() // 2 + 1, False)}</p></{item}>' + f'<{item}><p>{words(count() // 2 + 1, False)}</p></{item}>' * r.randint(0, 3) + f"</{tag}>"

    def share() -> str:
        return f'<div class="{r.choice(["share", "social", "related", "tags"])}"><ul>{links(r.randint(1, 5))}</ul></div>'

    def footer() -> str:
        tag, c = r.choice([("footer", ""), ("footer", ""), ("footer", cls("footer")), ("div", ' class="footer"')])
        inner = r.choice([lambda: f"&copy; {words(2, False)} &middot; {words(r.randint(1, 40), False)}", lambda: f"<p>{words(r.randint(2, 30), False)}</p><ul>{links(3)}</ul>"])()
        return f"<{tag}{c}>{inner}</{tag}>"

    def block() -> str:
        k = r.random()
        if k < 0.7:
            n = count()
            body = words(n, True)
            if r.random() < 0.12:
                body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{body}</b>"
            if r.random() < 0.15:
                body += f' <a href="/x">{words(r.randint(1, 3), True)}</a> {words(r.randint(1, 9), True)}'
            return f"<p>{body}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.78:
            return f"<h2>{words(r.randint(1, 6), True)}</h2>"
        if k < 0.84:
            return "<ul>" + "".join(f"<li>{words(r.randint(1, 15), True)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if k < 0.88:
            return f"<blockquote><p>{words(r.randint(2, 40), True)}</p></blockquote>"
        if k < 0.92:
            return "<table>" + "".join(f"<tr><td>{words(r.randint(1, 4), True)}</td><td>{words(r.randint(1, 4), True)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if k < 0.95:
            return f"<figure><figcaption>{words(r.randint(2, 12), True)}</figcaption></figure>"
        return f"<div>{words(r.randint(2, 60), True)}</div>"

    shape = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    c = cls("post", "article-body", "content", "entry-content", "story") if shape in ("article", "main") else f' class="{r.choice(["content", "article", "post-body", "entry-content", "story", "main-text"])}"'
    if shape == "article" and r.random() < 0.6:
        c = ""
    title = f"<h1>{words(r.randint(1, 9), True)}</h1>"
    if r.random() < 0.15:
        title = f"<header>{title}</header>"
    inner = [block() for _ in range(max(1, int(math.exp(r.uniform(0, 3.2)))))]
    for extra, chance in ((ad, 0.15), (share, 0.15), (talk, 0.08), (form, 0.06), (notice, 0.06), (sidebar, 0.06)):
        if r.random() < chance:
            inner.insert(r.randint(0, len(inner)), extra())
    article = f"<{shape}{c}>{title}{''.join(inner)}</{shape}>"
    head = [f() for f, chance in ((menu, 0.85), (ad, 0.5), (notice, 0.2), (form, 0.15), (sidebar, 0.15)) if r.random() < chance]
    tail = [f() for f, chance in ((talk, 0.25), (share, 0.2), (sidebar, 0.2), (ad, 0.2), (form, 0.1), (footer, 0.85)) if r.random() < chance]
    if r.random() < 0.15:
        head.insert(0, f"<header><h2>{words(2, False)}</h2><p>{words(r.randint(1, 8), False)}</p></header>")
    middle = article
    if r.random() < 0.3:
        middle = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{article}{"".join(tail[:-1])}</div>'
        tail = tail[-1:]
    return f"<!DOCTYPE html><html><head><title>{words(3, False)}</title><style>p{{}}</style></head><body>{''.join(head)}{middle}{''.join(tail)}</body></html>"


def plain_page(r: random.Random) -> str:
    """HTML of an invented page whose names tell nothing: what is no main text is a menu of links, a short footer, a form, or has its own tag."""
    words = functools.partial(invented, r)

    def cls() -> str:
        name = "".join(r.choice("bdfgkqvxyz0123456789") for _ in range(r.randint(1, 5)))
        return r.choice(["", "", f' class="{name}"', f' id="{name}"', f' class="{name} c{r.randint(1, 30)}"'])

    def links(n: int) -> str:
        items = [f'<a href="/{k}">{words(r.randint(1, 3), False)}</a>' for k in range(n)]
        how = r.randrange(5)
        if how == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if how == 1:
            return "".join(f"<{t}>{x}</{t}>" for t in [r.choice(["div", "p"])] for x in items)
        return r.choice([" ", " | ", "<br>", " &middot; "]).join(items)

    def menu() -> str:
        tag = r.choice(["div", "div", "div", "nav", "ul", "p", "header"])
        if tag == "ul":
            return f"<ul{cls()}>" + "".join(f'<li><a href="#">{words(r.randint(1, 3), False)}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"
        return f"<{tag}{cls()}>{links(r.randint(2, 10))}</{tag}>"

    def footer() -> str:
        tag = r.choice(["div", "div", "p", "footer", "footer"])
        note = f"{r.choice(['&copy; ', '&#169; ', '© ', '(c) 2021 '])}{words(r.randint(1, 6), False)}"
        return f"<{tag}{cls()}>" + r.choice([note, f"{note} {links(r.randint(1, 4))}", links(r.randint(2, 6))]) + f"</{tag}>"

    def form() -> str:
        return f'<form{cls()}><input name="q"><label>{words(r.randint(1, 4), False)}</label><button>{words(1, False)}</button></form>'

    def aside() -> str:
        return f"<aside{cls()}><p>{words(r.randint(2, 50), False)}</p></aside>"

    def sentence_block() -> str:
        n = max(4, int(math.exp(r.uniform(1.5, 5.3))))
        body = words(n, True)
        if r.random() < 0.12:
            body += f' <a href="/x">{words(r.randint(1, 3), True)}</a> {words(r.randint(1, 9), True)}'
        tag = r.choice(["p", "p", "p", "p", "div", "blockquote", "pre", "li"])
        one = f"<{tag}{cls() if r.random() < 0.3 else ''}>{body}</{tag}>" if tag != "li" else "<ul>" + "".join(f"<li>{words(r.randint(2, 20), True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        return one * (2 if r.random() < 0.1 else 1)

    parts = [sentence_block() for _ in range(max(1, int(math.exp(r.uniform(0, 2.8)))))]
    for k in range(len(parts)):
        if r.random() < 0.12:
            parts[k] = f"<h{r.randint(2, 4)}>{words(r.randint(1, 7), True)}</h{r.randint(2, 4)}>" + parts[k]
    if r.random() < 0.1:
        parts.insert(r.randint(0, len(parts)), "<table>" + "".join(f"<tr><td>{words(r.randint(1, 6), True)}</td><td>{words(r.randint(1, 6), True)}</td></tr>" for _ in range(r.randint(2, 6))) + "</table>")
    title = f"<h1>{words(r.randint(1, 9), True)}</h1>" if r.random() < 0.6 else ""
    if r.random() < 0.12:  # running text without any block of its own
        parts = ["<br><br>".join(words(r.randint(15, 80), True) for _ in range(r.randint(1, 5)))]
    article = title + "".join(parts)
    for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
        tag = r.choice(["div", "div", "div", "section", "main", "article", "center"])
        article = f"<{tag}{cls()}>{article}</{tag}>"
    head = [f() for f, chance in ((menu, 0.6), (form, 0.1)) if r.random() < chance]
    tail = [f() for f, chance in ((aside, 0.1), (menu, 0.1), (footer, 0.6)) if r.random() < chance]
    if r.random() < 0.2:
        cells = "".join(f"<td>{x}</td>" for x in [*([menu()] if r.random() < 0.7 else []), article])
        article = f"<table{cls()}><tr>{cells}</tr></table>"
    body = "".join([*head, article, *tail])
    for _ in range(r.choice([0, 0, 1, 2])):
        body = f"<div{cls()}>{body}</div>"
    return r.choice([f"<html><head><title>{words(3, False)}</title></head><body>{body}</body></html>", f"<body>{body}</body>", body])


#: Of ``sample_page`` and of ``plain_page``.
TRAINING_PAGES = (700, 700)


@functools.lru_cache(maxsize=2)
def model(seed: int = 7, pages: tuple[int, int] = TRAINING_PAGES) -> Boosted:
    """An element is to be kept if main text is at or below it."""
    r = random.Random(seed)
    parsed = [Page(make(r)) for make, n in zip((sample_page, plain_page), pages, strict=True) for _ in range(n)]
    y: list[float] = []
    w: list[float] = []
    for p in parsed:
        good, text = [False] * len(p.tag), [False] * len(p.tag)
        for node, piece, _ in p.pieces:
            if piece and piece.strip():
                text[node] = True
                good[node] |= "Q" in piece
        for i in range(len(p.tag) - 1, 0, -1):
            good[p.parent[i]] |= good[i]
            text[p.parent[i]] |= text[i]
        y += good
        w += [1.0 if t else 0.1 for t in text]
    return Boosted().fit(features(parsed), np.array(y, float), np.array(w))


def main_texts(sources: list[str | None], trees: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    odds = trees.score(features(pages))
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        out.append(p.text(decode(p.parent, odds[at : at + n])))
        at += n
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points)."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    trees = model()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                b = batch.slice(i, 200)
                texts = main_texts(b.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
