"""Leaf blocks of a web page: runs of text that no block-level tag divides."""

from __future__ import annotations

import dataclasses
import html
import re

# Fixed names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var".split())
SPACING = frozenset("br wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript object svg math select".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())
PIECES = INLINE | frozenset("p li td th tr tbody ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("datalist",)}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TOKENS = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
LABEL = re.compile(r'data-label="([01])"')
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclasses.dataclass
class Block:
    text: str
    leaf: str                      # the innermost open element
    tags: frozenset[str]           # all open elements
    tokens: frozenset[str]         # words of their classes, ids and roles
    linked: int                    # characters inside links
    parent: int = 0                # number of the element that holds it, paragraphs and the like aside
    label: int | None = None       # of the nearest element that carries one, in training pages


@dataclasses.dataclass(frozen=True)
class Element:
    """An open element, with what holds for all that is inside it, so no block looks up its ancestors."""

    name: str
    tags: frozenset[str] = frozenset()
    tokens: frozenset[str] = frozenset()
    links: int = 0                 # open links
    parent: int = 0                # number of the nearest element that is no piece of one
    label: int | None = None


OUTSIDE = Element("")


class Scanner:
    def __init__(self, page: str):
        self.page = page
        self.stack: list[Element] = []
        self.open_names: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []
        self.opened = 0
        self.missing: dict[str, int] = {}    # strings not found from some place on

    def find(self, what: str, at: int) -> int:
        """``str.find`` that never searches the same rest twice in vain."""
        if self.missing.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    @property
    def inside(self) -> Element:
        return self.stack[-1] if self.stack else OUTSIDE

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            of = self.inside
            self.blocks.append(Block(text, of.name, of.tags, of.tokens, self.linked, of.parent, of.label))
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text:
            plain = html.unescape(text) if "&" in text else text
            self.parts.append(plain)
            if self.inside.links:
                self.linked += len(plain.strip())

    def pop_to(self, name: str, walls: tuple[str, ...] | frozenset = ()) -> None:
        if not self.open_names.get(name):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                for element in self.stack[i:]:
                    self.open_names[element.name] -= 1
                del self.stack[i:]
                return
            if self.stack[i].name in walls:
                return

    def tag_end(self, at: int) -> int:
        """Place after the ``>`` that ends the tag, outside quotes; -1 if there is none."""
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            quote = min((q for q in (self.page.find('"', at, end), self.page.find("'", at, end)) if q >= 0), default=-1)
            if quote < 0 or self.page[at:quote].rstrip()[-1:] != "=":
                return end + 1
            closing = self.find(self.page[quote], quote + 1)
            if closing < 0:
                return end + 1
            at = closing + 1

    def open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self.pop_to("p", CLOSES_P - {"p"})
        if name in SIBLINGS:
            for sibling in ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,):
                self.pop_to(sibling, SIBLINGS[name])
        words = frozenset(w.lower() for m in TOKENS.finditer(attributes) for w in WORDS.findall(m[1] or m[2] or m[3] or ""))
        label, of = LABEL.search(attributes), self.inside
        self.opened += 1
        self.open_names[name] = self.open_names.get(name, 0) + 1
        self.stack.append(Element(
            name, of.tags if name in of.tags else of.tags | {name}, of.tokens if words <= of.tokens else of.tokens | words,
            of.links + (name == "a"), of.parent if name in PIECES else self.opened, int(label[1]) if label else of.label))

    def run(self) -> list[Block]:
        page, at = self.page, 0
        while at < len(page):
            mark = page.find("<", at)
            if mark < 0:
                self.say(page[at:])
                break
            self.say(page[at:mark])
            after = page[mark + 1:mark + 2]
            if page.startswith("<!--", mark):
                end = self.find("-->", mark + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            if after in ("!", "?"):
                end = self.find(">", mark)
                at = end + 1 if end >= 0 else len(page)
                continue
            closing = after == "/"
            name_match = NAME.match(page, mark + 1 + closing)
            end = self.tag_end(name_match.end()) if name_match else -1
            if end < 0:
                self.parts.append("<")
                at = mark + 1
                continue
            name, at = name_match[0].lower(), end
            if name in SPACING:
                self.parts.append(" ")
            elif name not in INLINE:
                self.flush()
            if closing:
                self.pop_to(name)
            elif name in RAW and not page.endswith("/>", mark, end):
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, end) if self.missing.get("/" + name) is None else None
                if close is None:
                    self.missing["/" + name] = end
                    at = len(page) if name in ("script", "style") else end
                else:
                    stop = page.find(">", close.start())
                    at = stop + 1 if stop >= 0 else len(page)
            elif name not in VOID:
                self.open(name, page[name_match.end():end - 1])
        self.flush()
        return self.blocks


def blocks(page: str | None) -> list[Block]:
    return Scanner(page).run() if page else []
