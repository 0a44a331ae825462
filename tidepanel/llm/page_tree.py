"""What a web page holds, for wrapper induction: its blocks of text, and its tree with like siblings as one."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Quoted values do not reach over a "<", so that a lost quote costs no more than the way to the next tag.
_TAG = re.compile(
    r"""<(?:!--|(?P<close>/)?(?P<name>[A-Za-z][^\s/><]*)(?P<rest>(?:[^><"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|[!?][^>]*+>)"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_WORDS = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[-_]+")

#: Elements without content, elements whose content is no markup, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Which open elements a new one closes, and where the search for them ends.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = frozenset("ul ol dl table select html body".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
#: Elements whose text is not shown as text of the page.
UNSEEN = frozenset(
    "head button select datalist script style textarea title noscript iframe template svg canvas object audio video math "
    "xmp noembed noframes".split()
)
#: Elements that never hold the article.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
#: Words that say the same in class, id or role. A name counts as a whole: each of its parts is one of them, one of
#: PLACES or a number, so "comment-list" and "site-footer" count, "no-sidebar" and "share-price" do not.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu sidebar "
    "footer contentinfo complementary breadcrumb breadcrumbs pagination cookie cookies consent gdpr notice popup modal "
    "newsletter subscribe signup social share sharing comment comments disqus related recommended widget toolbar search "
    "skip masthead".split()
)
PLACES = frozenset(
    "list box container wrapper wrap area section block slot bar links link item items form button buttons icons inner "
    "outer left right top bottom main site page global primary secondary post posts article entry".split()
)
MAIN = frozenset(("article", "main"))
MAIN_PLACES = frozenset("main content container wrapper area column body section".split())
#: Elements that hold the whole page or the article, whatever they are called.
WHOLE = frozenset(("html", "body", *MAIN))
#: How a block stands by the names around it: free, inside a name or form of the kinds above, inside such an element.
FREE, NAMED, OUT, HIDDEN = range(4)
#: Text of articles (or main parts) is believed to be the page's own when it is this share of the free text.
MAIN_SHARE = 0.25
DEPTH = 48


@dataclass(frozen=True)
class Page:
    """``nodes``: (parent, label) of each kind of element, like siblings as one; ``texts``: (node, text, grade,
    level) of every block that is shown, ``grade`` one of FREE, NAMED and OUT, ``level`` 2 in an article, 1 in a main part."""

    nodes: tuple[tuple[int, str], ...]
    texts: list[tuple[int, str, int, int]]

    @property
    def blocks(self) -> list[tuple[int, str]]:
        """(node, text) of the blocks that names alone would choose."""
        return [self.texts[i][:2] for i in by_names(self.texts, range(len(self.texts)))]

    @property
    def content(self) -> list[str]:
        """What tells copies of a page: its own text where names can tell it, else all but menus and the like."""
        own = by_names(self.texts, range(len(self.texts)))
        near = [i for i, t in enumerate(self.texts) if t[2] < OUT]
        sure = own and (self.texts[own[0]][3] > 0 or 2 * _length(self.texts, own) > _length(self.texts, near))
        return [self.texts[i][1] for i in (own if sure else near)]


def _length(texts, places) -> int:
    return sum(len(texts[i][1]) for i in places)


def by_names(texts, places, grade: int = FREE) -> list[int]:
    """Those of ``places`` with that grade: in articles, or in main parts, or all, by MAIN_SHARE."""
    found = [i for i in places if texts[i][2] == grade]
    for level in (2, 1):
        inside = [i for i in found if texts[i][3] >= level]
        if inside and _length(texts, inside) >= MAIN_SHARE * _length(texts, found):
            return inside
    return found


def choose(texts, template: frozenset[int] | set[int], few: bool = False) -> list[int]:
    """The numbers of the blocks that are the page's main text, given those that are template of its host.

    What varies is chosen among by names; where names leave nothing of it, NAMED blocks that vary are the text.
    A page without either keeps its template text. On a host of ``few`` pages template that is most of what
    names would choose shows pages to be copies of each other, and is kept.
    """
    every = range(len(texts))
    if few and template:
        own = by_names(texts, every) or by_names(texts, every, NAMED)
        if 2 * _length(texts, [i for i in own if i in template]) > _length(texts, own):
            template = frozenset()
    varying = [i for i in every if i not in template]
    for places in (varying, every):
        for grade in (FREE, NAMED):
            found = by_names(texts, places, grade)
            if found:
                return found
    return []


def parse(html: str) -> Page:
    """The page's tree and all its text blocks, with how each stands by names."""
    return _Parser(html).page()


class _Parser:
    def __init__(self, html: str):
        self.html = html
        self.nodes: list[tuple[int, str]] = [(-1, "")]
        self.children: dict[tuple[int, str], int] = {}
        # Of each open element: name, node, grade, how far in a main part.
        self.stack: list[tuple[str, int, int, int]] = [("", 0, FREE, 0)]
        self.blocks: list[tuple[int, str, int, int]] = []
        self.parts: list[tuple[int, str]] = []
        self.has_main = False

    def page(self) -> Page:
        html, at = self.html, 0
        while True:
            m = _TAG.search(html, at)
            if not m:
                break
            self.text(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m[0] == "<!--":
                    end = html.find("-->", at - 2)
                    at = len(html) if end < 0 else end + 3
                continue
            name = name.lower()
            if m["close"]:
                self.end(name)
                continue
            self.start(name, m["rest"])
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                at = end.start() if end else len(html)
        self.text(html[at:])
        self.flush()
        if self.has_main and not any(level for _, _, _, level in self.blocks):
            # An empty article: what names leave out does not stand in for it.
            self.blocks = [(node, t, OUT if grade == NAMED else grade, level) for node, t, grade, level in self.blocks]
        return Page(tuple(self.nodes), self.blocks)

    def text(self, piece: str) -> None:
        grade = self.stack[-1][2]
        if piece and grade < HIDDEN:
            self.parts.append((grade, unescape(piece) if "&" in piece else piece))

    def flush(self) -> None:
        """End the block at hand."""
        if self.parts:
            _, node, _, level = self.stack[-1]
            for grade in sorted({g for g, _ in self.parts if g >= 0}):
                text = _SPACES.sub(" ", "".join(t for g, t in self.parts if g in (grade, -1))).strip(" ")
                if text:
                    self.blocks.append((node, text, grade, level))
            self.parts = []

    def start(self, name: str, rest: str) -> None:
        if name not in INLINE:
            self.flush() if name != "br" else self.parts.append((-1, " "))
        if name in VOID:
            return
        if name in CLOSES_P:
            self.pop_to(("p",))
        if name in CLOSES:
            for other in CLOSES[name]:
                self.pop_to((other,))
        words, names, hidden = (), (), False
        if rest:
            words, names, hidden = _marks(rest)
        _, node, grade, level = self.stack[-1]
        if hidden or name in UNSEEN:
            grade = HIDDEN
        elif name in OUTSIDE or (name in ("header", "hgroup") and level == 0):
            grade = max(grade, OUT)
        elif name == "form" or (name not in WHOLE and any(map(_outside, names))):
            grade = max(grade, NAMED)
        if name == "article":
            level = 2
        elif level == 0 and (name == "main" or any(map(_main, names))):
            level = 1
        self.has_main |= name in MAIN
        label = name if not words else f"{name}.{' '.join(words[:3])}"
        self.stack.append((name, self.child(node, label), grade, level))

    def child(self, node: int, label: str) -> int:
        if len(self.stack) > DEPTH:
            return node
        key = (node, label)
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = len(self.nodes)
            self.nodes.append(key)
        return found

    def end(self, name: str) -> None:
        if name in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if name not in INLINE or any(s[0] not in INLINE for s in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                return
            if name in INLINE and self.stack[i][0] not in INLINE:
                return  # an inline element ends with the block that it was opened in

    def pop_to(self, names: tuple[str, ...]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                self.flush()
                del self.stack[i:]
                return
            if self.stack[i][0] in SCOPE or self.stack[i][0] in ("article", "main", "section", "div"):
                return


def _marks(rest: str) -> tuple[tuple[str, ...], tuple[str, ...], bool]:
    """The words of class, id and role, the whole names there, and whether the element is hidden."""
    words, names, hidden = [], [], False
    for name, a, b, c, bare in _ATTRIBUTE.findall(rest):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id", "role"):
            words += _WORDS.findall(value.lower())
            names += value.lower().split()
        elif bare or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return tuple(words), tuple(names), hidden


def _outside(name: str) -> bool:
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    return not OUTSIDE_WORDS.isdisjoint(parts) and all(p in OUTSIDE_WORDS or p in PLACES for p in parts)


def _main(name: str) -> bool:
    parts = _PARTS.split(name)
    return "main" in parts and MAIN_PLACES.issuperset(parts)


def match(a: tuple[tuple[int, str], ...], b: tuple[tuple[int, str], ...]) -> list[int]:
    """Simple tree matching: for each node of ``a`` the node of ``b`` that it is aligned with, or -1.

    Aligned nodes have the same label and aligned parents, their order is kept, and as many as possible are
    aligned. Depth is bounded by DEPTH, children by the different labels below a node.
    """
    kids_a, kids_b = _kids(a), _kids(b)
    scores: dict[tuple[int, int], int] = {}

    def table(x: int, y: int) -> list[list[int]]:
        rows = [[0] * (len(kids_b[y]) + 1)]
        for i in kids_a[x]:
            row, above = [0], rows[-1]
            for k, j in enumerate(kids_b[y]):
                both = above[k] + (size(i, j) if a[i][1] == b[j][1] else 0)
                row.append(max(row[-1], above[k + 1], both))
            rows.append(row)
        return rows

    def size(x: int, y: int) -> int:
        known = scores.get((x, y))
        if known is None:
            known = scores[x, y] = 1 + table(x, y)[-1][-1]
        return known

    out = [-1] * len(a)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        rows = table(x, y)
        i, j = len(kids_a[x]), len(kids_b[y])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((kids_a[x][i], kids_b[y][j]))
    return out


def _kids(nodes) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, (parent, _) in enumerate(nodes):
        if parent >= 0:
            out[parent].append(i)
    return out


def spell(nodes: tuple[tuple[int, str], ...]) -> str:
    return "\n".join(f"{p} {label}" for p, label in nodes)


def unspell(text: str) -> tuple[tuple[int, str], ...]:
    return tuple((int(p), label) for p, label in (line.split(" ", 1) for line in text.split("\n")))
