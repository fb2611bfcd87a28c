"""HTML extraction: flat text blocks, classified by a decision tree.

A page is read once into flat blocks: runs of text between block-level tags.
Each block has its words and link density, those of the blocks before and
after it, and what its open elements say: tags of menus, footers or forms,
words in their class, id or role, whether an article is open, and what share of
the page's unlinked words the marked element holds.  A decision tree decides
which blocks are article; it is grown (Gini, exact splits) from the small
labelled table that ``labelled_blocks`` makes from generated pages, on
the driver, and sent along as a nested tuple.

Inline elements end no block.  One that is hidden, or whose name or role says
that it is no article (adverts, share links, comments), leaves its own text out
of the block around it; blocks inside it inherit its signs.

Character references are decoded, white space inside a block becomes one space,
and the chosen blocks are joined in page order by two newlines.

Nothing is shuffled; each page is one row of work and a page costs its length.

Edge cases: null, empty or text-free html gives an empty text; open or crossed
tags close with what encloses them; a ``<`` that starts no tag is text;
repeated rows give equal rows; an empty table an empty result; columns other
than page_id, url and html pass by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea iframe noscript template svg math object canvas noembed noframes xmp".split())
CHARACTER_TAGS = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
#: Tags that close an open one of their kind.
ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table article section div nav aside main body html form select".split())
CLOSES_P = BLOCK_TAGS - {"button", "label", "option", "optgroup", "html", "body", "head", "title"}
BOILER_TAGS = frozenset("nav footer aside form menu select option optgroup button label legend fieldset dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
BOILER_WORDS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense adslot adunit sponsor sponsored sponsors promo promos promoted promotion menu nav navi navbar navigation breadcrumb breadcrumbs crumbs sidebar sidebars rail widget widgets footer foot bottombar masthead topbar toolbar banner cookie cookies consent gdpr privacy notice notices notification notifications alert alerts announcement popup modal overlay lightbox paywall newsletter subscribe subscription signup signin login register search share shares sharing social follow related recommended recommendations recommend recirculation outbrain taboola trending popular mostread pagination pager paginator skip tags taglist tagcloud copyright legal disclaimer aside hidden print toc rating ratings poll survey donate cta".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion guestbook".split())
CONTENT_WORDS = frozenset("article content post entry story main body text page prose copy".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler_tag", "boiler_name", "name_share", "comment", "in_article", "page_has_article", "content_name", "header", "heading", "item", "sign")


class Block:
    __slots__ = ("text", "words", "linked", "tag", "boiler_tag", "name_at", "comment", "in_article", "content", "header", "label", "form_at")


class _Open:
    __slots__ = ("tag", "boiler_tag", "name_at", "comment", "in_article", "content", "header", "label", "form_at")


def _opened(tag: str, raw: str, outer: _Open | None, at: int) -> _Open:
    o = _Open()
    o.tag = tag
    for name, default in (("boiler_tag", False), ("name_at", -1), ("comment", False), ("in_article", False), ("content", False), ("header", False), ("label", None), ("form_at", -1)):
        setattr(o, name, getattr(outer, name) if outer is not None else default)
    attributes = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
    role = attributes.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if tag not in ("html", "body") else []
    words = {w.lower() for n in names if not re.match("(?i)(has|with|no|is)[-_]", n) for w in _NAME_WORD.findall(n)}
    if words & COMMENT_WORDS:
        o.comment = True
    if main:
        o.in_article = True
        o.form_at = -1
    elif words & BOILER_WORDS and o.name_at < 0:
        o.name_at = at
    if tag == "form" and not o.in_article:
        o.form_at = at if o.form_at < 0 else o.form_at
    elif tag in BOILER_TAGS or role in BOILER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        o.boiler_tag = True
    if tag == "header" or "header" in words:
        o.header = True
    if words & CONTENT_WORDS and not words & BOILER_WORDS:
        o.content = True
    o.label = attributes.get("data-y", o.label)
    return o


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where an element ends whose content is no text; elements of the same tag inside count, but for those that hold characters only."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?![\w:-])[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag not in CHARACTER_TAGS and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """The flat blocks of a page, and the unlinked words of each marked element by its number."""
    found: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    link, number, at, n = False, 0, 0, len(page)
    body = _opened("body", "", None, 0)

    def block_of() -> _Open:
        """The innermost open block-level element."""
        for o in reversed(stack):
            if o.tag in BLOCK_TAGS:
                return o
        return body

    def add(text: str) -> None:
        """Take text into the block, unless an inline element keeps it out of the article that the block itself does not."""
        if stack and stack[-1].tag not in BLOCK_TAGS:
            top, base = stack[-1], block_of()
            if (top.boiler_tag, top.comment, top.name_at >= 0) != (base.boiler_tag, base.comment, base.name_at >= 0):
                text = " "
        parts.append((text, link))

    def end_block() -> None:
        nonlocal parts
        if not parts:
            return
        b = Block()
        b.text = " ".join(unescape("".join(p for p, _ in parts)).split())
        b.linked = len(unescape(" ".join(p for p, linked in parts if linked)).split())
        parts = []
        if not b.text:
            return
        b.words = b.text.count(" ") + 1
        top = block_of()
        b.tag = top.tag
        for name in ("boiler_tag", "name_at", "comment", "in_article", "content", "header", "label", "form_at"):
            setattr(b, name, getattr(top, name))
        found.append(b)

    def close(tag: str) -> None:
        nonlocal link
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                link = False
                return

    def close_inline(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if stack[i].tag in BLOCK_TAGS:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK_TAGS:
                end_block()
                close(tag)
            else:
                link = link and tag != "a"
                close_inline(tag)
            continue
        raw = m[3] if m[2] else m[6]
        if tag == "br":
            parts.append((" ", link))
        elif tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                end_block()
            if not raw.rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
        elif tag in BLOCK_TAGS:
            end_block()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        link = False
                        break
                    if stack[i].tag in FENCES:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ALONE.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in FENCES:
                    break
            if tag not in VOID_TAGS:
                number += 1
                stack.append(_opened(tag, raw, stack[-1] if stack else None, number))
        elif tag not in VOID_TAGS and (tag == "a" or not _CLOSED.search(raw)):
            if tag == "a":
                link = True
                close_inline(tag)
            number += 1
            stack.append(_opened(tag, raw, stack[-1] if stack else None, number))
    end_block()
    shares: dict[int, int] = {}
    for b in found:
        for k in {b.name_at, b.form_at} - {-1}:
            shares[k] = shares.get(k, 0) + b.words - b.linked
    # some sites wrap the whole page in a form; only a form that holds less than half of its words is one
    total = sum(b.words - b.linked for b in found)
    for b in found:
        if b.form_at >= 0 and 2 * shares[b.form_at] < total:
            b.boiler_tag = True
    return found, shares


def features(found: list[Block], shares: dict[int, int]) -> list[tuple[float, ...]]:
    total = sum(b.words - b.linked for b in found) or 1
    has_article = any(b.in_article for b in found)
    size = [(float(b.words), b.linked / b.words) for b in found]
    rows = []
    for i, b in enumerate(found):
        before, after = size[i - 1] if i else (0.0, 0.0), size[i + 1] if i + 1 < len(found) else (0.0, 0.0)
        sign = not b.in_article and (b.text[:1] in "©Ⓒ" or bool(re.match(r"(?i)\(c\)|copyright\b|all rights reserved", b.text)))
        rows.append(
            (*size[i], *before, *after, float(b.boiler_tag), float(b.name_at >= 0), shares.get(b.name_at, 0) / total, float(b.comment), float(b.in_article), float(has_article), float(b.content), float(b.header), float(len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()), float(b.tag in ("li", "dt", "dd", "td", "th")), float(sign))
        )
    return rows


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 10) -> tuple:
    """A leaf (label,) or (feature, limit, at most, above)."""
    ones = sum(labels)
    if not depth or ones in (0, len(labels)):
        return (int(2 * ones >= len(labels)),)
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda i: rows[i][f])
        left = 0
        for k, i in enumerate(order[:-1], 1):
            left += labels[i]
            low, high = rows[i][f], rows[order[k]][f]
            if low == high:
                continue
            right, m = ones - left, len(rows) - k
            impurity = left * (k - left) / k + right * (m - right) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (low + high) / 2)
    if best is None:
        return (int(2 * ones >= len(labels)),)
    _, f, limit = best
    sides = [[i for i in range(len(rows)) if (rows[i][f] <= limit) == low] for low in (True, False)]
    return (f, limit, *(grow([rows[i] for i in side], [labels[i] for i in side], depth - 1) for side in sides))


def judge(tree: tuple, row: tuple[float, ...]) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def _words(n: int) -> str:
    return " ".join(("field", "river", "stone", "over", "light", "the", "and")[i * i % 7] for i in range(n))


def _pages(n: int = 260, seed: int = 11) -> list[str]:
    """Small labelled pages in the shapes that sites have; data-y says what an element's text is."""
    rnd = Random(seed)
    some = lambda p: rnd.random() < p
    size = lambda: rnd.choice((1, 2, 4, 8, 15, 30, 60, 120))
    link = lambda k: f"<a href=/>{_words(k)}</a>"
    para = lambda: f"<p>{_words(size())}{link(2) if some(0.2) else ''}</p>"
    junk = lambda: "".join(rnd.choice((para, para, lambda: f"<h3>{_words(2)}</h3>", lambda: f"<div>{link(rnd.randrange(1, 4))}</div>"))() for _ in range(rnd.randrange(1, 4)))
    menu = lambda tag: f"<{tag} data-y=0><ul>{''.join(f'<li>{link(rnd.randrange(1, 4))}</li>' for _ in range(rnd.randrange(2, 6)))}</ul></{tag}>"
    named = ("ad", "advert", "sidebar", "cookie-notice", "share-buttons", "related", "newsletter", "widget", "site-footer", "top-nav", "promo", "breadcrumbs", "popup", "tags")

    def boiler(tags: tuple[str, ...]) -> str:
        kind = rnd.choice(("tag", "name", "comment"))
        if kind == "tag":
            tag = rnd.choice(tags)
            return f"<{tag} data-y=0>{junk()}</{tag}>"
        name = rnd.choice(named) if kind == "name" else rnd.choice(("comments", "comment-list"))
        return f"<div {rnd.choice(('class', 'id'))}='{name}' data-y=0>{junk() * (1 if kind == 'name' else rnd.randrange(1, 6))}</div>"

    out = []
    for _ in range(n):
        kind = rnd.choice(("article", "main", "div class=post-content", "div id=content", "div", "div"))
        sure = kind in ("article", "main")
        body = [f"<h1>{_words(rnd.randrange(1, 9))}</h1>"] if some(0.6) else []
        if some(0.15) and sure:
            body = [f"<header>{body[0] if body else ''}</header>"]
        for _ in range(rnd.randrange(1, 8)):
            body.append(para())
            if sure and some(0.1):
                body.append(f"<p>{link(size())}</p>")
            if some(0.15):
                body.append(f"<ul><li>{_words(size())}</li><li>{_words(2)}</li></ul>")
            if some(0.15):
                body.append(boiler(("form", "aside", "footer", "nav")))
        if not sure:
            body.append(f"<p>{_words(150)}</p>")
        page = f"<{kind} data-y=1>{''.join(body)}</{kind.split()[0]}>"
        before = [menu("nav")] * some(0.5) + [menu("div")] * some(0.3) + [f"<header data-y=0>{junk()}</header>"] * some(0.5) + [boiler(("form", "aside", "nav")) for _ in range(rnd.randrange(3))]
        after = [boiler(("form", "aside", "nav", "footer")) for _ in range(rnd.randrange(3))] + [f"<footer data-y=0>&copy; {_words(9)}</footer>"] * some(0.5) + [f"<div data-y=0>&copy; {_words(12)}</div>"] * some(0.3)
        if sure and some(0.5):
            after.append(f"<div data-y=0>{junk()}</div>")
        out.append("".join(before) + page + "".join(after))
    # bare text, and names that mark the whole page
    out += [f"<p data-y=1>{_words(k)}</p>" for k in (1, 3, 9, 40)] + [f"<div data-y=1>{_words(k)}</div>" for k in (2, 12)]
    out.append(f'<div class="print" data-y=1><h1>{_words(4)}</h1><p>{_words(150)}</p><p>{_words(3)}</p></div>{menu("nav")}')
    return out


def labelled_blocks() -> tuple[list[tuple[float, ...]], list[int]]:
    rows: list[tuple[float, ...]] = []
    labels: list[int] = []
    for page in _pages():
        found, shares = blocks(page)
        rows += features(found, shares)
        labels += [int(b.label or 0) for b in found]
    return rows, labels


def main_text(page: str | None, tree: tuple) -> str:
    if not page:
        return ""
    found, shares = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found, shares), strict=True) if judge(tree, row))


def _extract(tree: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html)."""
    tree = grow(*labelled_blocks())
    return pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").mapInArrow(_extract(tree), "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
