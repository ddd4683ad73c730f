"""HTML extraction by tag-path ratios.

A page is parsed to text pieces, each with its root-to-leaf tag path. For each path of the page the characters outside
links and the punctuation marks of its pieces are summed; unlinked text per node and punctuation per node are two ratios
of a path. The sequence of ratios over the page's blocks is smoothed with a Gaussian kernel, and the smoothed ratios are
fused into one score, together with the path's own ratio, so that a short line beside long text stays below it. The score
is 0 for blocks whose tag, role or class words say that they are never article text (script, style, nav, footer, form,
aside, adverts, notices, comments and the like); words that have other meanings (rail, legal, search) only lower the
ratio of a block inside an article, and nothing beside a word of no layout (rail-transport). Blocks in an article keep together: a block inside a container that holds the text of
high score has the score of its container, so that short ones (a heading, a one-word paragraph) stay; article and main
elements that hold most of that text leave no score to what is outside them. Blocks from a share of the spread of the
page's scores on are the text; without that threshold every block would be.

A page is read in one pass: the time grows with its length, also where tags, quotes, comments or elements don't end and
however deep they stand. A tag without an end is text; a quote that would run to the page's end is an ordinary character.

White space inside a block is one space; blocks are joined by one line end, in page order. Character references are
decoded. Nothing else is dropped or capped.

Defined results: a null or empty page, or one without text, gives an empty text; very long pages are read whole;
repeated rows each get a row; of containers with equal text the deeper one counts; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_batches

#: Elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noframes noembed xmp title svg canvas object select option button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer form aside menu dialog head script style noscript template iframe button select option textarea title svg".split())
#: Words in class, id or role that mark what is no article.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead sidebar side rail related recommended share sharing social comment comments "
    "disqus reply replies respond notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "search widget toolbar pagination pager copyright legal alert complementary contentinfo form".split()
)
GOOD_WORDS = frozenset("article content main post entry story body text".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words that mark what is no article even where an article element is inside; the others also name layouts around one.
STICKY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended comment comments disqus "
    "reply replies respond cookie cookies consent gdpr popup modal newsletter subscribe signup login".split()
)
#: Words that also name subjects of articles.
AMBIGUOUS = frozenset("rail side form search legal alert notice notices copyright social share sharing banner promotion overlay complementary".split())
#: Words of layout that say nothing about a subject: with any other word beside it, an ambiguous word names a subject.
LAYOUT = frozenset("left right top bottom box list item block container wrap wrapper inner outer bar area panel section site page link links col column".split())
#: Elements skipped with their content only up to an end tag that is there; those that may be closed by "/>".
_NEED_END = frozenset("noscript template svg canvas object select option button iframe".split())
_MAY_CLOSE = frozenset("svg iframe".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: A tag from its name on; a quote only holds a value after an equals sign.
_TAG = re.compile(r"""</?[A-Za-z](?:[^>=]++|=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
#: An option ends before the next one and where its list ends.
_OPTION_END = re.compile(r"</?(?:option|optgroup|select|datalist)\b", re.I)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
_PUNCT = re.compile(r"[.,;:!?¿¡…、。，]")
#: Share of the smoothed scores' spread below which a block goes; width of the kernel, in blocks.
ALPHA, SIGMA = 0.5, 1.0
#: What an ambiguous word leaves of a ratio inside an article.
LOWERED = 0.25
#: Share of a block's characters in links from which it is a list of links.
LINKED = 0.8
#: Opening one of these closes an open p.
_CLOSES_P = BLOCK - {"html", "body"}
_CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div aside nav main form footer header body html blockquote".split())
_LIST = frozenset("ul ol dl table select".split())


class Node:
    __slots__ = ("name", "bad", "hard", "soft", "good", "link", "up", "i", "depth", "block", "scope", "list", "within", "path")

    def __init__(self, name: str, attrs: str, up: Node | None, i: int, path: int):
        self.name, self.up, self.i, self.path = name, up, i, path
        self.depth = up.depth + 1 if up else 0
        # Nearest block, and depth of the nearest border for end tags and for items, each from the node itself upwards.
        self.block: Node = self if up is None or name in BLOCK else up.block
        self.scope: int = self.depth if up is None or name in _SCOPE else up.scope
        self.list: int = self.depth if name in _LIST else up.list if up else -1
        inside = bool(up and up.within)
        self.within = inside or name in ("article", "main")
        self.link = name == "a" or bool(up and up.link)
        hard, marks = name in NEVER, set()
        good = name in ("article", "main")
        if attrs:
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), (m[2] or "").strip("\"'")
                if key == "style":
                    hard |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key in ("hidden", "aria-hidden"):
                    hard |= value.lower() != "false" and (key == "hidden" or value.lower() == "true")
                elif key in ("class", "id", "role"):
                    for token in value.split():
                        words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                        good |= bool(words & GOOD_WORDS)
                        if name not in ("html", "body", "article", "main"):
                            subject = inside and words - BAD_WORDS - LAYOUT
                            marks |= words & BAD_WORDS - (AMBIGUOUS if subject else frozenset())
        # A header outside an article is the page's, unless its words say that it is the article's.
        hard |= name == "header" and not good and not inside
        if name == "header" and good and not marks & STICKY:
            marks = set()
        # Inside an article, words with other meanings lower the ratio and decide nothing.
        self.soft = bool(up and up.soft) or inside and bool(marks & AMBIGUOUS)
        if inside:
            marks -= AMBIGUOUS
        # hard: by tag, style or sticky word; an article or main recovers from layout words around it.
        self.hard = hard or bool(marks & STICKY) or bool(up and up.hard)
        self.bad = self.hard or bool(marks) or bool(up and up.bad and name not in ("article", "main"))
        self.good = good and not self.bad and not self.soft


class Tags:
    """The markup of a page in order: (start, end) of each comment, declaration and tag."""

    def __init__(self, page: str):
        self.page, self.last, self.plain = page, page.rfind(">"), False

    def next(self, at: int) -> tuple[int, int] | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                return start, self._through("-->", start + 4)
            if page.startswith("<![CDATA[", start):
                return start, self._through("]]>", start + 9)
            if page.startswith(("<!", "<?"), start):
                return start, self._through(">", start)
            if start > self.last:
                return None
            head = page[start + 1 : start + 3].removeprefix("/")[:1]
            if head.isascii() and head.isalpha():
                m = None if self.plain else _TAG.match(page, start)
                # A match that fails has read to the page's end; from then on tags end at the first bracket.
                self.plain |= m is None
                return start, m.end() if m else page.index(">", start) + 1
            at = start + 1
        return None

    def _through(self, mark: str, at: int) -> int:
        end = self.page.find(mark, at)
        return end + len(mark) if end >= 0 else len(self.page)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All nodes, parents first, and (nearest block element, text, characters of it in links) of each run of text between
    block borders, in page order."""
    at, root, tags = 0, Node("html", "", None, 0, 0), Tags(page)
    nodes, stack, now = [root], [root], root
    places: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of a name
    paths: dict[tuple[int, str], int] = {}
    endless: set[str] = set()  # raw elements of which no end follows
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            if joined := _SPACE.sub(" ", html.unescape("".join(text))).strip(" "):
                out.append((now, joined, min(linked, len(joined))))
            text, linked = [], 0

    def innermost(names: frozenset[str] | set[str], above: int) -> int:
        """Depth of the innermost open element of the names that stands deeper than `above`; 0 if there is none."""
        depth = max((places[n][-1] for n in names if places[n]), default=0)
        return depth if depth > above else 0

    def close(depth: int) -> None:
        while len(stack) > depth > 0:
            places[stack.pop().name].pop()

    def raw_end(name: str, pattern: re.Pattern) -> re.Match | None:
        end = None if name in endless else pattern.search(page, at)
        if not end:
            endless.add(name)
        return end

    while at < len(page):
        tag_at = tags.next(at)
        chunk = page[at : tag_at[0] if tag_at else len(page)]
        if chunk:
            if (own := stack[-1].block) is not now:
                flush()
                now = own
            text.append(chunk)
            linked += len(chunk) if stack[-1].link else 0
        if not tag_at:
            break
        at, tag = tag_at[1], page[slice(*tag_at)]
        named = _NAME.match(tag)
        if not named:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            if depth := innermost({name}, 0 if name in _SCOPE else stack[-1].scope):
                if name in BLOCK:
                    flush()
                close(depth)
            elif name == "p":
                flush()
            continue
        if name == "html":
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:
            if name in _MAY_CLOSE and tag.endswith("/>"):
                continue
            if name == "option":
                end = raw_end(name, _OPTION_END)
                at = end.start() if end else at
                continue
            end = raw_end(name, re.compile(rf"</{re.escape(name)}\s*+>", re.I))
            at = end.end() if end else at if name in _NEED_END else len(page)
            continue
        if name in BLOCK:
            flush()
        if name in _CLOSES_P:
            close(innermost({"p"}, stack[-1].scope))
        if name in _CLOSES_SELF:
            close(innermost(_CLOSES_SELF[name], stack[-1].list))
        if name in VOID or tag.endswith("/>") and name not in BLOCK:
            continue
        up = stack[-1]
        node = Node(name, tag[named.end() : -1], up, len(nodes), paths.setdefault((up.path, name), len(paths) + 1))
        nodes.append(node)
        stack.append(node)
        places[name].append(node.depth)
    flush()
    return nodes, out


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing with the border values held."""
    r = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, r, mode="edge"), k / k.sum(), mode="valid")


def path_scores(found: list[tuple[Node, str, int]], able: list[bool]) -> np.ndarray:
    """The fused score of each block: the smoothed ratios of its path and the path's own ratio; 0 for what is not able."""
    nodes: dict[int, set[int]] = defaultdict(set)
    chars: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    lists = [linked >= LINKED * len(t) for _, t, linked in found]
    for (n, t, linked), ok, links in zip(found, able, lists, strict=True):
        if ok:
            share = LOWERED if n.soft else 1.0
            nodes[n.path].add(n.i)
            chars[n.path] += share * (len(t) - linked)
            marks[n.path] += 0 if links else share * len(_PUNCT.findall(t))
    ratio = lambda of: np.array([of[n.path] / len(nodes[n.path]) if ok else 0.0 for (n, _, _), ok in zip(found, able, strict=True)])
    own, marked = ratio(chars), ratio(marks)
    # Smoothing gives no score to what is never article text, nor to lists of links.
    return np.where(np.array(able) & ~np.array(lists), np.sqrt(own * smooth(own)) * (1.0 + np.sqrt(marked * smooth(marked))), 0.0)


def extract(page: str | None) -> str:
    nodes, found = parse(page or "")
    able = [not n.bad for n, _, _ in found]
    # Layout words around most of the text say nothing.
    if sum(len(t) for n, t, _ in found if n.bad and not n.hard) > sum(len(t) for n, t, _ in found if not n.bad):
        able = [not n.hard for n, _, _ in found]
    if not any(able):
        return ""
    if all(linked >= LINKED * len(t) for (_, t, linked), ok in zip(found, able, strict=True) if ok):
        found = [(n, t, 0) for n, t, _ in found]  # an article of links only
    score = path_scores(found, able)
    limit = min(ALPHA * score.std(), score.max()) if score.max() > 0 else ALPHA
    keep = [bool(s >= limit) for s in score]
    # Kept text below each node: children come after their parents.
    weight = [0] * len(nodes)
    for (n, t, _), k in zip(found, keep, strict=True):
        weight[n.i] += len(t) if k else 0
    for n in reversed(nodes[1:]):
        weight[n.up.i] += weight[n.i]
    total = weight[0]
    # The container of the article: the marked one with most scored text, else the deepest node with over half of it.
    known = [n for n in nodes if weight[n.i]]
    marked = [n for n in known if n.good and n.name in ("article", "main")]
    good = marked or [n for n in known if n.good]
    home = None
    if good and max(weight[n.i] for n in good) >= 0.25 * total:
        home = max(good, key=lambda n: (weight[n.i], n.depth))
    else:
        home = max((n for n in known if weight[n.i] > 0.5 * total and n.name not in ("p", "li", "td", "h1")), key=lambda n: n.depth, default=None)

    # Containers add blocks to those kept: further marked ones, else the common ancestor of all kept blocks.
    homes = {home.i} if home else set()
    over, up = set(), home.up if home else None
    while up:
        over.add(up.i)
        up = up.up
    if good:
        homes |= {n.i for n in good} - over
    elif sum(keep) > 1:
        homes.add(max((n for n in known if weight[n.i] == total), key=lambda n: n.depth).i)
    # A header that its words mark as the article's, beside the container.
    homes |= {n.i for n in nodes if home and n.name == "header" and n.good and n.up is home.up}

    # Whether a container holds a node; a block of links only needs a marked one.
    held, held_links, outer = ([False] * len(nodes) for _ in range(3))
    for n in nodes:
        u = n.up.i if n.up else n.i
        held[n.i] = held[u] or n.i in homes
        held_links[n.i] = held_links[u] or n.i in homes and n.good
        outer[n.i] = outer[u] or n.i in homes and n.name in ("article", "main")
    # Blocks of a container have its score; where article elements hold most of the text, others have none.
    inside = [held_links[n.i] if linked >= LINKED * len(t) else held[n.i] for n, t, linked in found]
    most = sum(len(t) for (n, t, _), k in zip(found, keep, strict=True) if k and outer[n.i]) > 0.5 * total
    whole = max(float(score.max()), limit)
    lifted = [
        max(s, whole) if ok and h and not n.soft else 0.0 if most and not held[n.i] else s
        for (n, _, _), s, ok, h in zip(found, score, able, inside, strict=True)
    ]
    return "\n".join(t for (_, t, _), s in zip(found, lifted, strict=True) if s >= limit)


SCHEMA = "page_id long, url string, text string, n_chars long"


def _rows(cols: dict[str, list]) -> dict[str, list]:
    text = [extract(h) for h in cols["html"]]
    return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages with its main text. No shuffle."""
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return map_batches(own, _rows, SCHEMA, "html")
