"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, less the further up; a container's points are discounted
by the share of its text that is links. The best container and those of its siblings that read like it are kept.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import longs, per_batch, plain_text, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre section summary table tbody tfoot thead tr ul".split()
)
# Elements that end an open element of the second set when they begin.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table article section div body html td th main aside nav form".split())

# What is never main text: by element, by role, and by words of class and id.
UNWANTED_TAGS = frozenset("nav footer aside button select input head script style noscript template iframe svg canvas object textarea title menu dialog".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
UNWANTED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "pagination pager popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words that tell the kind of a block wherever they stand in a name; of the others the last one does.
TELLING_WORDS = frozenset("ad ads advert adverts advertisement comment comments consent cookie cookies disqus gdpr promo promoted sponsor sponsored".split())
# Words that say where or in what a block is; they are passed over at a name's end. Names that begin with the second set describe the page.
PLACE_WORDS = frozenset(
    "area bar block bottom box buttons container group holder inner item items left link links list outer panel posts right section slot stories top unit wrap wrapper".split()
)
STATE_WORDS = frozenset("has hide is no not with without".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LISTINGS = frozenset("ul ol dl table pre blockquote figure".split())
LEAST_CHARS = 25  # of a text that counts as a sentence
BONUS = {"div": 5, "article": 10, "main": 10, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "th": -5}

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z0-9]+")
INNER_UPPER = re.compile(r"(?<=[a-z])(?=[A-Z])")

NO, MAYBE, YES = range(3)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "chars", "linked")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.points = 0.0
        self.chars = self.linked = 0


def parse(html: str) -> Node:
    """A tree of elements and strings. Open elements end where HTML lets them; what is never closed ends with the page."""
    root = here = Node("#root", "", None)
    at, n = 0, len(html)
    lower = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            here.children.append(html[at:])
            break
        if lt > at:
            here.children.append(html[at:lt])
        m = NAME.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                here.children.append("<")
                at = lt + 1
            continue
        tag = m[1].lower()
        gt = html.find(">", m.end())
        if gt < 0:
            break
        attrs = html[m.end() : gt]
        if (attrs.count('"') | attrs.count("'")) & 1 and (whole := REST.match(html, m.end())):
            gt = whole.end() - 1
            attrs = html[m.end() : gt]
        at = gt + 1
        if html[lt + 1] == "/":
            up = here
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                here = up.parent
            continue
        if tag in BLOCKS:  # begins outside of an open paragraph
            up = here
            while up.tag != "p" and up.tag not in SCOPES and up.parent is not None:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if (ends := ENDS.get(tag)) is not None:
            up = here
            while up.tag not in ends and up.tag not in SCOPES and up.parent is not None:
                up = up.parent
            if up.tag in ends:
                here = up.parent
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in RAW:
            lower = lower or html.lower()
            if len(lower) != n:  # lower-casing changed the length of other letters
                lower = html
            end = lower.find("</" + tag, at)
            at = n if end < 0 else end
        elif tag not in VOID and not attrs.endswith("/"):
            here = node
    return root


def name_says(name: str) -> int:
    """Whether one class or id names something that is no main text; MAYBE leaves it to the block's content.

    ``post-comments`` are comments and ``main-menu`` is a menu, as the last word tells; ``notice-of-meeting`` may be anything.
    """
    words = WORDS.findall(INNER_UPPER.sub("-", name).lower())
    if not words or words[0] in STATE_WORDS:
        return NO
    if any(w in TELLING_WORDS for w in words):
        return YES
    while len(words) > 1 and words[-1] in PLACE_WORDS:
        words.pop()
    of_main = any(w in MAIN_WORDS for w in words)
    if words[-1] in UNWANTED_WORDS:
        return NO if words[-1] in ("header", "masthead") and of_main else YES
    return MAYBE if not of_main and any(w in UNWANTED_WORDS for w in words) else NO


def unwanted(node: Node) -> int:
    tag = node.tag
    if tag in UNWANTED_TAGS:
        return YES
    if tag == "header":
        up = node.parent
        while up is not None and up.tag not in MAIN_TAGS:
            up = up.parent
        return YES if up is None else NO
    if not node.attrs or tag in ("body", "html", "main"):
        return NO
    told = NO
    for name, a, b, c in ATTR.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            told = max([told, *map(name_says, value.split())])
        elif name == "role" and value.lower() in UNWANTED_ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return YES
    return YES if re.search(r"(?:^|\s)hidden(?:\s|=|$)", node.attrs) else told


def prune(root: Node, forms: bool = False) -> list[Node]:
    """Takes unwanted subtrees out; counts each element's characters and linked characters. All that are left, parents first.

    A block whose name leaves it open stays if it holds a sentence or more outside of links. A form goes, unless it is
    wrapped around the article or ``forms`` are to stay.
    """
    order, todo, open_names, wraps = [], [root], set(), {}
    while todo:
        node = todo.pop()
        order.append(node)
        kept = []
        for c in node.children:
            if not isinstance(c, str):
                told = unwanted(c)
                if told == YES:
                    continue
                if told == MAYBE:
                    open_names.add(id(c))
                todo.append(c)
            kept.append(c)
        node.children = kept
    out = set()
    for node in reversed(order):
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in out]
        inside = [c for c in node.children if not isinstance(c, str)]
        node.chars = sum(len(c) if isinstance(c, str) else c.chars for c in node.children)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in inside)
        wraps[id(node)] = node.tag in MAIN_TAGS or node.tag == "h1" or any(wraps[id(c)] for c in inside)
        if node.tag == "form" and not forms and not wraps[id(node)]:
            out.add(id(node))
        elif id(node) in open_names and (node.chars < LEAST_CHARS or node.linked > 0.25 * node.chars):
            out.add(id(node))
    return order if not out else attached(root)


def attached(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    return order


def own_text(node: Node) -> str:
    """Text of an element without that of blocks inside it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag not in BLOCKS:
            todo += reversed(c.children)
    return "".join(out)


def score(order: list[Node]) -> Node | None:
    """The best container, or none if no paragraph says enough."""
    candidates: dict[int, Node] = {}
    for node in order:
        if node.tag not in ("p", "pre", "td", "blockquote", "div", "section", "article", "main", "li", "dd"):
            continue
        text = own_text(node).strip()
        if len(text) < LEAST_CHARS:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") else node
        level = 0
        while up is not None and level < 5:
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.points = BONUS.get(up.tag, 0)
            up.points += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    for node in candidates.values():
        node.points *= 1 - node.linked / max(1, node.chars)
    return max(candidates.values(), key=lambda c: c.points, default=None)


def outermost(order: list[Node]) -> list[Node]:
    """Elements that say they are an article, outside of others, in page order."""
    out, todo = [], order[:1]
    while todo:
        node = todo.pop()
        if node.tag in MAIN_TAGS and node.chars > 0:
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def kept_parts(order: list[Node]) -> list[Node]:
    """The containers whose blocks are the main text, in page order.

    The best container's article stays whole, and so does any other article that scores like it. Outside of articles the
    siblings of the best container stay that score like it or read on: paragraphs, lists and tables with few links, blocks with
    paragraphs without any, and headings of what stays.
    """
    best, articles = score(order), outermost(order)
    if best is None:
        return articles or [c for c in order if c.tag == "body"][:1] or order[:1]
    least = max(10.0, 0.2 * best.points)
    up = best
    while up is not None and not any(up is c for c in articles):
        up = up.parent
    if up is not None:  # the whole article, with its heading
        return [c for c in articles if c is up or c.points >= least or c.linked == 0]
    if best.parent is None:
        return [best]
    keep: list[Node] = []
    follows = None
    for c in reversed(best.parent.children):
        if isinstance(c, str) or not c.chars:
            continue
        density = c.linked / c.chars
        if c.tag == "p":
            reads_on = c.chars > 80 and density < 0.25 or density == 0
        elif c.tag in LISTINGS:
            reads_on = density < 0.25
        elif c.tag in HEADINGS:
            reads_on = c.tag == "h1" or bool(follows) and any(follows is k for k in keep[-1:])
        else:
            reads_on = density == 0 and any(n.tag in ("p", *LISTINGS) for n in attached(c))
        if c is best or c.points >= least or reads_on:
            keep.append(c)
        follows = c
    return keep[::-1]


def blocks_of(node: Node, out: list[str]) -> None:
    buffer: list[str] = []

    def flush():
        text = " ".join("".join(buffer).split())
        if text:
            out.append(text)
        buffer.clear()

    todo: list = [node]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            buffer.append(unescape(c) if "&" in c else c)
        elif c.tag in BLOCKS:
            flush()
            todo.append(None)
            todo += reversed(c.children)
        elif c.tag in ("br", "td", "th"):
            buffer.append(" ")
            todo += reversed(c.children)
        else:
            todo += reversed(c.children)
    flush()


def main_text(html: str) -> str:
    if not html:
        return ""
    out: list[str] = []
    root = parse(html)
    order = prune(root)
    if not any(isinstance(c, str) and not c.isspace() for node in order for c in node.children):  # all of it is in forms
        order = prune(parse(html), forms=True)
    for part in kept_parts(order):
        blocks_of(part, out)
    return "\n\n".join(out)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty pages, and pages without main text, have an empty text."""

    def start():
        def work(cols):
            texts = [main_text(h) for h in cols["html"]]
            return {"page_id": longs(cols["page_id"]), "url": strings(cols["url"]), "text": strings(texts), "n_chars": longs([len(t) for t in texts])}

        return work

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), plain_text(html_col).alias("html"))
    return per_batch(src, start, "page_id long, url string, text string, n_chars long")
