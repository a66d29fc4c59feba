"""Main text of web pages by tree scoring: paragraphs pass points to ancestors, link density discounts them."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidied

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<(?:/?[a-z])[^<>]*>",
    re.S | re.I,
)
#: Elements whose content is no text of the page. An end is needed to leave out more than the tag, but for code.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe svg textarea select title".split()}
CODE = frozenset(["script", "style"])
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is likely not the article's: it counts DISCOUNT of its points, unless they hold most of the page's.
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: Words of class, id and role that say the same; matched as whole words between -, _, space and letter-case changes.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus topbar toolbar "
    "breadcrumb breadcrumbs sidebar sidebars side aside rail header masthead footer foot cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social related recommended recommendations widget widgets comment comments commentlist reply replies responses remarks disqus respond discussion pagination pager complementary contentinfo".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of the page's layout (has-sidebar), and of an article's own heading or head (post-header), say nothing against an element.
LAYOUT_WORDS = frozenset("no has with without layout".split())
OWN_WORDS, OWN_HEAD = frozenset("post entry article story".split()), frozenset("header head masthead".split())
#: Of these, the ones that name readers' remarks, which are never taken for the article, however long.
REMARK_WORDS = frozenset("comment comments commentlist reply replies responses remarks disqus discussion".split())
#: Blocks of prose, which no name alone takes out of what is kept.
PROSE = HEADINGS | frozenset("p pre blockquote".split())
LINKS = 0.5  # share of links from which such a block goes for its name
COMMAS = 5  # of a block that count at most, and one for COMMA_LETTERS
COMMA_LETTERS = 20
NEAR = 0.5  # share of the best score that a second article needs
LONG = 80  # letters of a text outside paragraphs that counts as one
MOST, LITTLE = 0.5, 0.25  # shares of the unlinked paragraph text, see wrappers()
DISCOUNT = 0.1
#: What a start tag closes if it is open within the nearest of its containers.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}


class Node:
    """An element: its parts, what its tag and names say against it (side), and sums over the text below it."""

    __slots__ = ("tag", "parent", "kids", "named", "score", "length", "linked", "off", "side", "prose", "own", "kept")

    def __init__(self, tag: str, parent: Node | None, off: bool, named: str = "", side: int = 0):
        self.tag, self.parent, self.off, self.named, self.side = tag, parent, off, named, side
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.length = self.linked = 0
        self.prose = self.own = 0
        self.kept = False


def sideways(value: str, within_article: bool = False) -> int:
    """1 if a class, id or role names an element that is no part of the article, 2 if it names readers' remarks, else 0. A
    head within an article is its own."""
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        found = words & ASIDE_WORDS
        if found and not words & LAYOUT_WORDS and not ((within_article or words & OWN_WORDS) and found <= OWN_HEAD):
            return 2 if found & REMARK_WORDS else 1
    return 0


def aside(tag: str, attrs: str, within_article: bool) -> tuple[bool, str, int]:
    """Whether an element is hidden, its class, and whether tag or names say that it is no part of the article. An article's own header holds its heading."""
    named, side = "", int(tag in ASIDE and not (tag == "header" and within_article))
    if attrs and not attrs.isspace():
        for name, *values in ATTRIBUTE.findall(attrs):
            value, name = next((v for v in values if v), ""), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, "", side
            if name in ("class", "id", "role"):
                named = named or value if name == "class" else named
                side = max(side, sideways(value, within_article) if tag not in ("body", "html") else 0)
    return False, named, side


def inner(root: Node) -> list[Node]:
    """All visible elements, each before those in it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if not isinstance(k, str) and not k.off)
    return order


def wrappers(order: list[Node]) -> None:
    """Takes the mark (side) from elements that tag or names put aside though they wrap the article.

    These are elements around articles and mains with at least MOST of the unlinked paragraph text of all of these. On
    pages without such, if all that is not put aside holds less than LITTLE of the text, the outermost marked one with the
    most of it loses its mark, until enough is left, but for readers' remarks. article and main are not marked for their names, but don't count if
    these put them aside.
    """
    root, link, para = order[0], {}, {}
    for node in order:
        up = node.parent
        link[node] = node.tag == "a" or up is not None and link[up]
        para[node] = node.tag in PARAGRAPHS or up is not None and para[up] and node.tag in INLINE
        for kid in node.kids:
            if isinstance(kid, str) and not link[node]:
                n = len(kid.strip())
                node.prose += n if para[node] or n >= LONG else 0
    for node in reversed(order[1:]):
        if node.tag in ("article", "main") and not node.side:
            node.own = node.prose
        node.parent.prose += node.prose
        node.parent.own += node.own
    for node in order:
        if node.tag in ("article", "main") or root.own and node.own >= MOST * root.own:
            node.side = 0
    while root.prose and not root.own:
        outer, within = [], set()
        for node in order:
            if node.parent in within:
                within.add(node)
            elif node.side:
                within.add(node)
                outer.append(node)
        best = max((n for n in outer if n.side == 1), key=lambda n: n.prose, default=None)
        if best is None or not best.prose or root.prose - sum(n.prose for n in outer) >= LITTLE * root.prose:
            break
        best.side = 0


def tree(html: str) -> Node:
    root = node = Node("#root", None, False)
    at, in_article, open_ = 0, 0, Counter()
    unclosed: set[str] = set()
    tokens = TOKEN.finditer(html)
    while (m := next(tokens, None)) is not None:
        if m.start() < at:
            continue
        if m.start() > at:
            node.kids.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            while open_[tag]:
                open_[node.tag] -= 1
                in_article -= node.tag in ("article", "main")
                done, node = node.tag == tag, node.parent
                if done:
                    break
            continue
        if tag in RAW:
            end = None if tag in unclosed else RAW[tag].search(html, at)
            if end or tag in CODE:
                at = end.end() if end else len(html)
                tokens = TOKEN.finditer(html, at)
            else:
                unclosed.add(tag)
            continue
        if tag not in INLINE:
            up = node
            if tag != "br" and open_["p"]:  # a paragraph ends where a block begins
                while up.parent is not None and (up.tag in INLINE or up.tag in HEADINGS):
                    up = up.parent
                up = up.parent if up.tag == "p" else node
            if tag in CLOSES and any(open_[t] for t in CLOSES[tag][0]):
                ends, bounds = CLOSES[tag]
                at_up, found = up, None
                while at_up.parent is not None and at_up.tag not in bounds:
                    found = at_up if at_up.tag in ends else found
                    at_up = at_up.parent
                up = found.parent if found else up
            while node is not up:
                open_[node.tag] -= 1
                in_article -= node.tag in ("article", "main")
                node = node.parent
        off, named, side = aside(tag, m["attrs"], in_article > 0)
        child = Node(tag, node, off or node.off, named, side)
        node.kids.append(child)
        if tag not in VOID and not m["attrs"].rstrip().endswith("/"):
            node = child
            open_[tag] += 1
            in_article += tag in ("article", "main")
    if at < len(html):
        node.kids.append(html[at:])
    return root


def blocks(node: Node, out: list[tuple[Node, str, int]]) -> None:
    """All blocks below in page order: the element that each stands in, its text, and how much of it is in links."""
    text: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        words = " ".join(unescape("".join(text)).split())
        if words:
            out.append((owner, words, linked))
        text.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        here, k, owner, link = stack.pop()
        if k == len(here.kids):
            if here is owner:
                flush(owner)
            continue
        stack.append((here, k + 1, owner, link))
        kid = here.kids[k]
        if isinstance(kid, str):
            text.append(kid)
            linked += len(kid) * link
        elif kid.off:
            if kid.tag not in INLINE:
                flush(owner)
        elif kid.side and kid.tag in INLINE:  # a block of its own, as it may be left out
            flush(owner)
            stack.append((kid, 0, kid, link or kid.tag == "a"))
        elif kid.tag in INLINE:
            stack.append((kid, 0, owner, link or kid.tag == "a"))
        elif kid.tag in ("br", "hr"):
            text.append(" ")
        else:
            flush(owner)
            stack.append((kid, 0, kid, link))


def main_text(html: str | None) -> str:
    """The article's text: the best-scored container's blocks, and those of its siblings that score like it.

    Of equal scores the container whose text begins first wins. Elements put aside pass on DISCOUNT of their points, and
    are left out where they stand in what is kept; headings, paragraphs and such only if they are mostly links as well."""
    if not html:
        return ""
    root = tree(html)
    order = inner(root)
    wrappers(order)
    found: list[tuple[Node, str, int]] = []
    blocks(root, found)
    if not found:
        return ""
    aside_: set[Node] = set()
    for node in order:
        if node.side or node.parent in aside_:
            aside_.add(node)
    scored: dict[Node, None] = {}
    for owner, text, linked in found:
        owner.length += len(text)
        owner.linked += linked
        container = owner.parent if (owner.tag in PARAGRAPHS or owner.tag in HEADINGS) and owner.parent is not None else owner
        points = min(len(text) / 100, 3.0) + min(text.count(","), COMMAS, len(text) // COMMA_LETTERS) + (owner.tag not in HEADINGS)
        share = DISCOUNT if owner in aside_ else 1.0
        least = share / 10
        while container is not None and share >= least:
            if container not in scored:
                container.score = {"article": 5.0, "main": 5.0}.get(container.tag, 0.0) * (DISCOUNT if container in aside_ else 1.0)
                scored[container] = None
            container.score += points * share
            container, share = container.parent, share / 2
    for node in reversed(order[1:]):
        node.parent.length += node.length
        node.parent.linked += node.linked
    worth = lambda n: n.score * (1 - min(1.0, n.linked / max(1, n.length)))
    best = max(scored, key=worth)
    if worth(best) <= 0:
        return ""
    best.kept = True
    if best.parent is not None:
        siblings = [n for n in best.parent.kids if isinstance(n, Node) and not n.off]
        place = siblings.index(best)
        for k, n in enumerate(siblings):
            dense = n.linked / max(1, n.length)
            alike = n in scored and worth(n) >= max(2.0, 0.2 * worth(best)) or n.named and n.named == best.named and worth(n) >= 0.1 * worth(best)
            if n.tag == "article" and n.named != best.named:
                alike = worth(n) >= NEAR * worth(best)
            if not n.side and n.length and dense < 0.25 and (alike or n.tag == "p" and n.length >= 80 or n.tag in HEADINGS and k < place):
                n.kept = True
    for node in order[1:]:
        leaves = node.side and (node.tag not in PROSE or node.linked >= LINKS * max(1, node.length))
        node.kept = node.kept or node.parent.kept and not leaves
    return " ".join(text for owner, text, _ in found if owner.kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of pages without the html column, with text and n_chars, which replace columns of these names; null and
    empty html give an empty text, repeated rows stay repeated, and an empty table gives no rows. Time is linear in a
    page's length and depth."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    ahead = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html).alias("_html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ahead.schema.fields[:-1]] + ["text string", "n_chars long"])
    names = [*kept, "text", "n_chars"]

    def run(batches):
        for b in tidied(batches):
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                texts = [main_text(x) for x in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return ahead.mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
