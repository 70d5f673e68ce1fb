r"""Main text of web pages by a conditional random field over the leaf blocks of the DOM.

A page becomes its leaf blocks in order. A block's features are its open elements, the words
of their classes, ids and roles, and plain facts of its text (length, links, punctuation,
place, share of the text its parent
element holds, telling words). A linear-chain CRF labels the blocks as main text or not, decoded by
Viterbi; consecutive blocks of one parent element have transition weights of their own.

It is trained on labelled pages: about ``PAGES`` pages of the corpus (twice as many at most) that hold one
``<article>``, whose blocks it labels, and ``COMPOSED`` pages composed from the texts of those
in layouts of many kinds (other containers, menus, sidebars, notices, adverts, forms, reader
comments), some of them with text in every part. So tags help where they are and text and
class words decide where they are not. Pages of the sample have under ``LONGEST_PAGE`` characters,
and the chain learns from the first ``LONGEST`` blocks of each, with the features they have in
the whole page; extraction has no such bounds, neither of blocks nor of depth or class words.

Defined cases: a null or empty page has no text; a page without blocks of main text gives an
empty string; unclosed tags, comments, scripts and quotes end with the page and cost linear
time; character references are decoded; repeated rows are done each; an empty table gives no
rows (the model then knows composed pages with invented words only); columns named like the
result are replaced, all others stay.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm import crf, dom
from tramline.llm.common import drawn, table

PAGES, COMPOSED, SEED = 150, 450, 3
LONGEST, LONGEST_PAGE = 80, 200_000   # blocks of a page to learn from, and characters of such a page
SIZE = 1 << 12          # places for hashed features
KINDS = 2               # steps within one parent, and to another

# Fixed words that mark text around an article.
TELLING = {
    "rights": ("©", "copyright", "all rights", "privacy", "terms of", "imprint", "impressum"),
    "cookie": ("cookie", "consent", "accept all", "gdpr"),
    "reader": ("reply", "comment", "says:", "wrote:", "posted by", "upvote", "report abuse"),
    "ask": ("subscribe", "sign up", "newsletter", "log in", "login", "register", "your email", "search", "submit"),
    "more": ("read more", "related", "share this", "follow us", "advertisement", "sponsored", "recommended", "most read", "tags:"),
}
INSIDE = ("p", "li", "td", "h1", "h2", "h3", "h4", "blockquote", "pre")


def bucket(n: float, limits: tuple) -> int:
    return sum(n > x for x in limits)


@functools.lru_cache(maxsize=1 << 16)
def place(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


def features(found: list[dom.Block]) -> tuple[list[list[int]], list[int]]:
    rows, kinds, before = [], [], None
    mass: dict[int, int] = {}
    for b in found:
        mass[b.parent] = mass.get(b.parent, 0) + len(b.text) - b.linked
    whole, most = max(1, sum(mass.values())), max(mass.values(), default=0)
    for i, b in enumerate(found):
        words, low = b.text.split(" "), b.text.lower()
        share = b.linked / len(b.text)
        names = {f"in:{t}" for t in b.tags} | {f"word:{t}" for t in b.tokens}
        names |= {
            "any", f"leaf:{b.leaf}", f"words:{bucket(len(words), (1, 2, 4, 8, 16, 32, 64))}",
            f"links:{bucket(share, (0, 0.3, 0.8))}", f"stops:{bucket(len(re.findall('[.!?,;]', b.text)), (0, 1, 3))}",
            f"ends:{b.text[-1] in '.!?:;…”\"'}", f"first:{bucket(i, (0, 2, 5))}", f"last:{bucket(len(found) - 1 - i, (0, 1, 3))}",
            f"near:{bucket(len(b.text), (40, 150))}:{b.leaf if b.leaf in INSIDE else ''}",
        }
        names |= {f"mass:{bucket(mass[b.parent] / whole, (0.1, 0.3, 0.5, 0.8))}", f"most:{mass[b.parent] == most}"}
        if len(words) < 40:
            names |= {f"told:{k}" for k, told in TELLING.items() if any(w in low for w in told)}
        for tag in ("nav", "footer", "aside", "form", "header", "article", "main", "section"):
            if tag in b.tags:
                names.add(f"{tag}+{bucket(len(words), (4, 20))}")
        rows.append([place(n) for n in sorted(names)])
        kinds.append(int(b.parent == before))
        before = b.parent
    return rows, kinds


# --- labelled pages -------------------------------------------------------------------


def invented(rng: random.Random, n: int) -> str:
    parts = ["ta", "re", "mi", "lo", "sen", "dor", "ka", "pel", "un", "is", "ver", "ton"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def composed(rng: random.Random, texts: list[str], links: list[str]) -> str:
    """A page in a random layout; elements carry the label of what is in them."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    some = lambda lo, hi: esc(rng.choice(texts) if rng.random() < 0.85 else invented(rng, rng.randint(lo, hi)))
    short = lambda: " ".join(some(3, 9).split(" ")[:rng.randint(1, 9)])
    link = lambda: f'<a href="/x">{esc(rng.choice(links))}</a>'
    pick = rng.choice

    def named(tags: list[str], words: list[str], inner: str, label: int, bare: float = 0.2) -> str:
        tag = pick(tags)
        naming = "" if rng.random() < bare else f' {pick(["class", "class", "id"])}="{pick(words)}"'
        return f'<{tag}{naming} data-label="{label}">{inner}</{tag}>'

    def menu() -> str:
        items = [link() for _ in range(rng.randint(2, 9))]
        body = pick([f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items)])
        return named(["nav", "div", "ul", "nav"], ["menu", "nav", "navbar", "main-menu", "site-nav", "breadcrumb", "breadcrumbs", "navigation", "topnav"], body, 0)

    def header() -> str:
        return named(["header", "div"], ["header", "masthead", "site-header", "banner", "top-bar"], f"{pick(['<h1>', '<p>', '<div>'])}{short()}" + pick(["", menu()]), 0)

    def footer() -> str:
        body = pick([f"&copy; {short()} &middot; {some(5, 14)}", f"<p>Copyright 2024 {short()}</p>", f"<p>{some(8, 30)}</p>{link()}", f"{link()} {link()} All rights reserved."])
        return named(["footer", "div", "footer"], ["footer", "site-footer", "colophon", "bottom", "legal", "copyright"], body, 0, 0.15)

    def aside() -> str:
        body = pick([f"<h3>{short()}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<p>{some(10, 40)}</p>", f"<h4>About</h4><p>{some(15, 50)}</p>"])
        return named(["aside", "div", "section", "aside"], ["sidebar", "side", "widget", "related", "related-posts", "recommended", "author-box", "rail", "trending", "share", "social"], body, 0, 0.1)

    def notice() -> str:
        body = pick([f"<p>We use cookies. {some(8, 24)}</p><button>Accept all</button>", f"{some(6, 20)} {link()}", f"<p>{some(6, 20)}</p>"])
        return named(["div", "section", "div"], ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "modal", "newsletter", "paywall", "promo"], body, 0, 0.0)

    def advert() -> str:
        return named(["div", "aside", "section", "div"], ["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "banner-ad", "promoted", "adsbygoogle"], pick([some(4, 25), f"<p>{some(5, 30)}</p>", f"<p>Advertisement</p>{link()}"]), 0, 0.0)

    def form() -> str:
        return f'<form data-label="0" {pick(["", "class=newsletter", "id=search", "class=login"])}><label>{short()}</label><input name="q">{pick(["", f"<p>{some(5, 18)}</p>"])}<button>{short()}</button></form>'

    def comments() -> str:
        one = lambda: pick([f"<div class=\"comment\"><b>{short()}</b> says:<p>{some(10, 60)}</p></div>", f"<li><p>{some(5, 60)}</p><a href='#'>Reply</a></li>", f"<p>{some(10, 70)}</p>"])
        return named(["section", "div", "ol", "div"], ["comments", "comment-list", "responses", "discussion", "reader-comments", "disqus", "replies", "commentlist"], pick([f"<h2>{rng.randint(1, 40)} comments</h2>", "<h3>Comments</h3>", ""]) + "".join(one() for _ in range(rng.randint(1, 7))), 0, 0.0)

    def paragraph() -> str:
        text = some(15, 90)
        if rng.random() < 0.2:
            words = text.split(" ")
            k = rng.randrange(len(words))
            words[k] = pick([f"<b>{words[k]}</b>", f'<a href="/y">{words[k]}</a>', f"<em>{words[k]}", f"{words[k]}<br>"])
            text = " ".join(words)
        return pick([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<blockquote>{text}</blockquote>", f"<ul><li>{text}</li><li>{short()}</li></ul>", f"<h2>{short()}</h2><p>{text}</p>", f"<p>{short()}</p>", f"<div>{text}</div>"])

    body = [f"<h1>{short()}</h1>"] if rng.random() < 0.8 else []
    body += [paragraph() for _ in range(rng.randint(1, 12))]
    extras = [advert, notice, aside, form, comments]
    for _ in range(rng.randint(0, 2)):
        body.insert(rng.randint(1, len(body)), pick(extras)())
    inside = "".join(body)
    if rng.random() < 0.3:
        inside += comments()
    main = named(["article", "article", "main", "div", "section", "div"], ["content", "post", "entry-content", "article-body", "post-content", "story", "main", "text", "article"], inside, 1, 0.35)
    if rng.random() < 0.3:
        main = f'<{pick(["main", "div", "section"])} {pick(["", "class=container", "id=page", "class=wrapper"])}>{main}{pick(["", aside(), comments()])}</{pick(["main", "div"])}>'
    start = [f() for f in (header, menu, notice, advert, form, aside) if rng.random() < 0.4]
    end = [f() for f in (aside, comments, form, advert, menu, footer, notice) if rng.random() < 0.4] + ([footer()] if rng.random() < 0.5 else [])
    rng.shuffle(start)
    return f"<html><head><title>{short()}</title></head><body>{''.join(start)}{main}{''.join(end)}</body></html>"


def labelled(pages: list[str]) -> list[tuple[list[dom.Block], list[int]]]:
    """Blocks and labels of pages with one article, and of composed ones."""
    out, texts, links = [], [], []
    for page in pages:
        found = dom.blocks(page)
        if len(re.findall("<article", page, re.I)) == 1 and found:
            marks = [int("article" in b.tags) for b in found]
            out.append((found, marks))
            texts += [b.text for b, m in zip(found, marks) if m]
            links += [b.text for b, m in zip(found, marks) if not m and b.linked]
    rng = random.Random(SEED)
    texts = sorted(set(texts)) or [invented(rng, 20) for _ in range(50)]
    links = sorted(set(links)) or [invented(rng, 2) for _ in range(20)]
    for _ in range(COMPOSED):
        found = dom.blocks(composed(rng, texts, links))
        out.append((found, [b.label or 0 for b in found]))
    return out


def trained(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = PAGES) -> crf.Chain:
    fit_for_it = pages.filter(F.col(html).isNotNull() & (F.char_length(html) < LONGEST_PAGE))
    some = drawn(fit_for_it, key, SEED, most).select(F.col(html).alias("html")).collect()
    rows = labelled(sorted(r["html"] for r in some))
    some = [(*features(found), marks) for found, marks in rows]     # of whole pages, then cut
    return crf.fit([tuple(x[:LONGEST] for x in row) for row in some], SIZE, KINDS)


def main_text(page: str | None, chain: crf.Chain) -> tuple[str, int, int]:
    """Text, number of blocks, and number of blocks taken."""
    found = dom.blocks(page)
    labels = chain.best(*features(found))
    taken = [b.text for b, y in zip(found, labels) if y]
    return "\n\n".join(taken), len(found), len(taken)


def extract(pages: DataFrame, chain: crf.Chain, html: str = "html") -> DataFrame:
    """All rows and columns, with ``text``, ``n_chars``, ``n_blocks`` and ``n_taken``."""
    added = [("text", T.StringType()), ("n_chars", T.LongType()), ("n_blocks", T.LongType()), ("n_taken", T.LongType())]
    pages = pages.drop(*[n for n, _ in added if n != html])
    place = pages.columns.index(html)
    schema = T.StructType([*pages.schema.fields, *[T.StructField(n, t) for n, t in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, took = [], [], []
            for page in batch.column(place).to_pylist():
                text, blocks, taken = main_text(page, chain)
                texts.append(text)
                n.append(blocks)
                took.append(taken)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array(took, pa.int64())],
                names=[*batch.schema.names, *[n for n, _ in added]])

    return pages.mapInArrow(run, schema)


def op3_html_extraction(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract(pages, trained(pages)).select("page_id", "url", "text", "n_chars", "n_blocks", "n_taken")
