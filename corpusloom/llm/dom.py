"""Pages as small trees: block elements and runs of text, what their markup says of them, and simple tree matching."""

from __future__ import annotations

import functools
import html
import re
import struct
import zlib

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter output picture q rb rp rt ruby "
    "s samp slot small source span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never an article's.
NEVER = frozenset(
    "audio button canvas datalist embed head iframe input noembed noframes noscript object optgroup option progress script select style svg "
    "template textarea title video".split()
)
PAGE_PARTS = frozenset("aside dialog footer form header menu nav search".split())
PAGE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words of a class or id that mark what isn't the article.
COMMENT_WORDS = frozenset("comment comments commentlist commentlists disqus reply replies respond".split())
OTHER_WORDS = frozenset(
    "ad adbox ads adsense adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs consent cookie cookies footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion "
    "recommendations recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser toast toolbar widget widgets".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre search section summary table ul".split()
)
#: What an opening tag closes: the elements, and those beyond which none is closed.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = frozenset("html table td th caption object template".split())
TABLE_PARTS = frozenset("table tr tbody thead tfoot caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section main article aside nav header footer form ul ol dl table blockquote figure details fieldset center".split())
#: Elements nested deeper are laid beside each other at this depth; their text stays.
DEEPEST = 60
#: Nodes, and children of a node, that take part in matching; the rest has the place that its parent and label give.
MOST_NODES, MOST_CHILDREN = 4096, 256

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Tree:
    """Preorder arrays. Text runs are nodes with label 0; ``dropped`` marks nodes that aren't the article's by their markup."""

    __slots__ = ("parent", "kids", "tag", "label", "marks", "text", "linked", "dropped", "depth")

    def __init__(self) -> None:
        self.parent, self.kids, self.tag, self.label, self.marks, self.text, self.linked, self.depth = [], [], [], [], [], [], [], []
        self.dropped: list[bool] = []

    def add(self, parent: int, tag: str, label: int, marks: frozenset, text: str = "", linked: int = 0) -> int:
        at = len(self.tag)
        self.parent.append(parent)
        self.kids.append([])
        self.tag.append(tag)
        self.label.append(label)
        self.marks.append(marks)
        self.text.append(text)
        self.linked.append(linked)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        if parent >= 0:
            self.kids[parent].append(at)
        return at


#: A tag, with quoted values as a whole; possessive, so no input makes it go back.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>|[!?/])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_TELLS = re.compile("class|id|role|itemprop", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}


@functools.lru_cache(maxsize=4096)
def _meaning(tag: str, attributes: str) -> tuple[int, frozenset, bool]:
    """An element's label, the marks that its attributes give, and whether these end an inline element's text."""
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    label = zlib.crc32(" ".join([tag, *sorted(re.sub(r"\d+", "", named.get("class", "")).split())]).encode("utf-8", "replace")) | 2
    marks = {w.lower() for w in _WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}")} & (OTHER_WORDS | COMMENT_WORDS)
    role = named.get("role", "").strip().lower()
    unwanted = bool(marks - {"header"}) or role in PAGE_ROLES
    if role in PAGE_ROLES:
        marks.add("role")
    if role == "main":
        marks.add("is main")
    if named.get("itemprop") == "articleBody" or role == "article":
        marks.add("is article")
    return label, frozenset(marks), unwanted


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.open: list[tuple[str, int, bool]] = [("", self.tree.add(-1, "", 1, frozenset()), False)]  # tag, block node, unwanted
        self.run: list[str] = []
        self.in_link = 0
        self.link_chars = 0
        self.count: dict[str, int] = {"": 1}

    def feed(self, page: str) -> None:
        at, end, last = 0, len(page), page.rfind(">")
        while at < end:
            m = _TAG.search(page, at) if at <= last else None
            if m is None:
                # beyond the last tag; a tag that is never closed isn't text
                rest = page[at:]
                broken = re.search(r"<(?:[a-zA-Z/]|!--|[!?])", rest)
                self.data(rest[: broken.start()] if broken else rest)
                return
            if m.start() > at:
                self.data(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                at = self.declaration(page, m.start())
                continue
            tag = m[2].lower()
            if m[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, m[3])
            if tag in _RAW:
                close = _RAW[tag].search(page, at)
                at = close.start() if close else end

    @staticmethod
    def declaration(page: str, at: int) -> int:
        """Where a comment, or what counts as one, ends."""
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                return page.index(">", at + 4) + 1
            close = page.find("-->", at + 4)
            return close + 3 if close >= 0 else len(page)
        close = page.find(">", at)
        return close + 1 if close >= 0 else len(page)

    # -- text

    def data(self, data: str) -> None:
        if self.open[-1][2]:
            return
        if "&" in data:
            data = html.unescape(data)
        self.run.append(data)
        if self.in_link:
            self.link_chars += len(data)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.tree.add(self.open[-1][1], "", 0, frozenset(), text, self.link_chars)
            self.run, self.link_chars = [], 0

    # -- elements

    def push(self, tag: str, block: int, unwanted: bool) -> None:
        self.open.append((tag, block, unwanted))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.in_link += tag == "a"

    def pop(self) -> None:
        tag, block, _ = self.open[-1]
        if self.run and block != self.open[-2][1]:
            self.flush()
        self.open.pop()
        self.count[tag] -= 1
        self.in_link -= tag == "a"

    def close_through(self, tags, beyond) -> bool:
        """Close elements up to the innermost of ``tags``, if it is open inside the innermost of ``beyond``."""
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in tags:
                while len(self.open) > at:
                    self.pop()
                return True
            if tag in beyond:
                return False
        return False

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P and self.count.get("p"):
            self.close_through({"p"}, SCOPE | {"button"})
        if tag in SIBLINGS:
            tags, beyond = SIBLINGS[tag]
            while any(self.count.get(t) for t in tags) and self.close_through(tags, beyond):
                pass
        if tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self.pop()
        _, block, unwanted = self.open[-1]
        if tag in VOID:
            if tag in ("br", "hr"):
                self.run.append(" ")
                if tag == "hr":
                    self.flush()
            return
        label, marks, ends = _meaning(tag, attributes if _TELLS.search(attributes) else "")
        if tag in INLINE:
            self.push(tag, block, unwanted or ends)
            return
        if self.run:
            self.flush()
        if self.tree.depth[block] >= DEEPEST:
            block = self.tree.parent[block]
        never = tag in NEVER or unwanted
        self.push(tag, self.tree.add(block, tag, label, frozenset() if never else marks), never)

    def end_tag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.run.append(" ")
        elif self.count.get(tag):
            inline = tag in INLINE
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at][0]
                if name == tag:
                    while len(self.open) > at:
                        self.pop()
                    return
                if inline and name not in INLINE or name in SCOPE and tag not in TABLE_PARTS:
                    return


def parse(page: str) -> Tree:
    builder = _Builder()
    builder.feed(page)
    while len(builder.open) > 1:
        builder.pop()
    builder.flush()
    judge(builder.tree)
    return builder.tree


def judge(t: Tree) -> None:
    """Mark what isn't the article's by markup. An element around the article is never marked, whatever it is called."""
    n = len(t.tag)
    size, holds = [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        own = (t.tag[i] in ("article", "main") or "is main" in t.marks[i] or "is article" in t.marks[i]) and not t.marks[i] & (COMMENT_WORDS | {"teaser", "related", "promo", "ad", "sponsored"})
        size[i] += len(t.text[i])
        holds[i] = holds[i] or own
        if t.parent[i] >= 0:
            size[t.parent[i]] += size[i]
            holds[t.parent[i]] = holds[t.parent[i]] or holds[i]
    inside = [False] * n
    t.dropped = [False] * n
    for i in range(n):
        p = t.parent[i]
        if p >= 0:
            t.dropped[i], inside[i] = t.dropped[p], inside[p]
        tag, marks = t.tag[i], t.marks[i]
        if t.dropped[i] or not tag:
            continue
        if holds[i] and not (tag == "article" and marks & COMMENT_WORDS):
            inside[i] = inside[i] or tag in ("article", "main") or "is main" in marks or "is article" in marks
            continue
        if tag == "header" or marks & {"header", "banner", "masthead"} and not marks - {"header", "banner", "masthead", "role"}:
            # the header of the article itself holds its headline
            t.dropped[i] = not inside[i] and tag not in HEADINGS
        elif tag in PAGE_PARTS or marks & COMMENT_WORDS or "role" in marks:
            t.dropped[i] = True
        elif marks & OTHER_WORDS and tag not in HEADINGS:
            t.dropped[i] = 2 * size[i] <= size[0] or inside[i]


def blob(t: Tree) -> bytes:
    """The tree's shape for matching: label, depth and a hash of the text of its first nodes. What markup drops has no children."""
    out = []
    for i in range(len(t.tag)):
        if not (t.dropped[i] and t.dropped[t.parent[i]]):
            out.append(struct.pack("<IHI", t.label[i], t.depth[i], zlib.crc32(t.text[i].encode()) if t.text[i] else 0))
            if len(out) == MOST_NODES:
                break
    return b"".join(out)


class Shape:
    __slots__ = ("label", "kids", "text")

    def __init__(self, data: bytes) -> None:
        self.label, self.kids, self.text = [], [], []
        path: list[int] = []
        for label, depth, text in struct.iter_unpack("<IHI", data):
            at = len(self.label)
            self.label.append(label)
            self.kids.append([])
            self.text.append(text)
            del path[depth:]
            if path:
                self.kids[path[-1]].append(at)
            path.append(at)


def _ends(kids: list[int]) -> list[int]:
    return kids if len(kids) <= MOST_CHILDREN else kids[: MOST_CHILDREN // 2] + kids[-MOST_CHILDREN // 2 :]


def match(a: Shape, b: Shape) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving matching of equal labels, level by level; equal texts count twice.
    Returns the nodes of ``b`` that nodes of ``a`` are matched with."""
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def score(i: int, j: int) -> int:
        if a.label[i] != b.label[j]:
            return 0
        if not a.kids[i] or not b.kids[j]:
            return 1 + (a.text[i] == b.text[j] != 0)
        if (i, j) not in known:
            known[i, j] = children(_ends(a.kids[i]), _ends(b.kids[j]))
        return 1 + known[i, j][0]

    def children(left: list[int], right: list[int]):
        width = len(right)
        table = [[0] * (width + 1)]
        for i in left:
            above, row = table[-1], [0]
            for k in range(width):
                best = above[k + 1] if above[k + 1] > row[k] else row[k]
                s = score(i, right[k])
                if s and above[k] + s > best:
                    best = above[k] + s
                row.append(best)
            table.append(row)
        pairs, r, c = [], len(left), width
        while r and c:
            if table[r][c] == table[r - 1][c]:
                r -= 1
            elif table[r][c] == table[r][c - 1]:
                c -= 1
            else:
                r, c = r - 1, c - 1
                pairs.append((left[r], right[c]))
        return table[-1][-1], pairs

    out, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        if score(i, j):
            out[i] = j
            if (i, j) in known:
                todo.extend(known[i, j][1])
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def text_hash(text: str, seed: int = 0) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (1 << 64) - 1))


def places(t: Tree, reference: Shape) -> list[int]:
    """The place of each node: that of the reference's node, or one that the parent's place and the label give."""
    own = [i for i in range(len(t.tag)) if not (t.dropped[i] and t.dropped[t.parent[i]])][:MOST_NODES]
    met = {own[i]: j for i, j in match(Shape(blob(t)), reference).items()}
    out: list[int] = []
    for i, label in enumerate(t.label):
        j = met.get(i)
        out.append(j if j is not None else (out[t.parent[i]] * 0x9E3779B97F4A7C15 + label + (1 << 32) & (1 << 64) - 1) if label else 0)
    return out


def runs(t: Tree, reference: Shape) -> list[tuple]:
    """For every run of text that markup doesn't drop: its container's place, a key of container, labels and text, its outermost
    article and main element (-1: none), whether it is in a headline, whether in a menu, and the text."""
    at, out, known = places(t, reference), [], {}
    for i, text in enumerate(t.text):
        if text and not t.dropped[i]:
            if t.parent[i] not in known:
                known[t.parent[i]] = _surroundings(t, t.parent[i], at)
            place, seed, *around = known[t.parent[i]]
            out.append((_signed(place), text_hash(text, seed), *around, text))
    return out


def _surroundings(t: Tree, node: int, at: list[int]):
    path, labels, article, main = [], 0, -1, -1
    container = None
    while node >= 0:
        path.append(node)
        tag, marks = t.tag[node], t.marks[node]
        if container is None:
            if tag in CONTAINERS or t.parent[node] < 0:
                container = node
            else:
                labels = labels * 31 + t.label[node]
        if tag == "article" or "is article" in marks:
            article = node
        if tag == "main" or "is main" in marks:
            main = node
        node = t.parent[node]
    return at[container], at[container] * 131 + labels, article, main, any(t.tag[p] == "h1" for p in path), _menu(t, path)


def article(found: list[tuple], constant=frozenset()) -> str:
    """The text of the runs that aren't ``constant``, within the page's article where its markup names one."""
    left = [(a, m, title, menu, text) for _, key, a, m, title, menu, text in found if key not in constant]
    articles: dict[int, int] = {}
    mains: dict[int, int] = {}
    titled = set()
    for a, m, title, _, text in left:
        articles[a] = articles.get(a, 0) + len(text)
        mains[m] = mains.get(m, 0) + len(text)
        if title:
            titled.add(a)
    total = sum(articles.values())
    articles.pop(-1, None)
    mains.pop(-1, None)
    pick = None
    if articles:
        own = [a for a in articles if a in titled]
        pick = own[0] if len(own) == 1 else max(articles, key=lambda a: (articles[a], -a))
        if 4 * articles[pick] < max(mains.values(), default=total):
            pick = None
    if pick is not None:
        if pick in titled:
            return " ".join(text for a, _, _, _, text in left if a == pick)
        # a headline before the article, in the same main part, belongs to it
        part = next(m for a, m, _, _, _ in left if a == pick)
        first = next(i for i, r in enumerate(left) if r[0] == pick)
        return " ".join(text for i, (a, m, title, _, text) in enumerate(left) if a == pick or title and i < first and m == part)
    if mains:
        main = max(mains, key=lambda m: (mains[m], -m))
        return " ".join(text for _, m, _, _, text in left if m == main)
    return " ".join(text for _, _, _, menu, text in left if not menu)


def _menu(t: Tree, path: list[int]) -> bool:
    """A list of three entries or more that are links: a menu, where no markup names an article."""
    for p in path:
        if t.tag[p] in ("ul", "ol", "div", "p", "table", "dl"):
            texts = [k for c in t.kids[p] for k in (t.kids[c] if t.tag[c] else [c]) if t.text[k]]
            if len(texts) >= 3 and all(5 * t.linked[k] >= 4 * len(t.text[k]) for k in texts):
                return True
    return False
