"""Main text of web pages by composite text density.

A page is read into a tree. Every node gets the characters and tags of its subtree, and those of its links;
its density is characters per tag, adjusted by how much of it is linked. A node's density sum is the sum of its
children's densities. The node of the largest sum is the body of the text; on the path from it up to <body>
the least density is the threshold. Above the body, blocks beside the path count if they reach the threshold or are
headings; within it, only lists of links below the threshold go. An <article> or <main> around the body is taken whole.

What is furniture by its tag or role (menus, footers, asides, forms, scripts, ...) has no text. Names (class and id) decide
nothing by themselves: words like "sidebar" or "advert" lower a node's density, to nothing where the whole name says so,
and a node whose lowered density is under the threshold goes. They lower no node that holds most of the page's characters, or the largest
density sum along with a third of them (nine tenths for a block without blocks inside). Reader comments may outweigh an article, so their names count unless hardly anything else is there.
"""

import html
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import read_table

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements that begin and end a line; all others, unknown ones too, are part of the line.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag of the key closes if they are open within the same container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: What ends the search for an element to close.
CONTAINERS = frozenset("html body table ul ol dl div article section main td th blockquote select".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
# Parts of a page that are never its main text.
FURNITURE = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav aside footer form button input select textarea option dialog menu title noembed noframes".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name furniture.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion promotions banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside footer masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "widget widgets pagination pager toolbar skip".split()
)
#: Words that name what readers wrote.
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond responses reply replies".split())
#: Words that say nothing beside those: a name of both kinds only is wholly furniture's.
NEUTRAL_NAMES = frozenset("area bar block bottom box container content global group holder inner item items layer left link links list main message outer page panel reader readers region right row section site strip text thread top user wrap wrapper".split())
#: First words of names that tell a state, not what a node is.
STATES = frozenset("has no not with without is js hide show".split())
#: What a name that is partly furniture's leaves of a density.
PARTLY = 0.25
#: Characters outside of reader comments from which on a page has other text.
OTHER_TEXT = 140

OPEN = regex.compile(r"<(?:!|\?|(/?)([a-zA-Z][^\s/>]*))")
QUOTE_OR_END = regex.compile(r"[>\"']")
ATTRIBUTE = regex.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", regex.S)
NAME = regex.compile(r"\p{Lu}?\p{Ll}+|\p{Lu}+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that names which are partly furniture's don't lower.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th blockquote pre figure figcaption".split())


class Node:
    __slots__ = ("tag", "items", "up", "furniture", "names", "ids", "factor", "chars", "tags", "link_chars", "link_tags", "density", "total", "block", "heading", "between", "open_p")

    def __init__(self, tag: str, up: "Node | None", furniture: bool = False, names: str = "", ids: str = ""):
        self.tag, self.up, self.furniture, self.names, self.ids, self.factor, self.between = tag, up, furniture, names, ids, 1.0, False
        self.items: list[Node | str] = []
        #: The nearest open <p> with no block between.
        self.open_p: Node | None = None if up is None else up if up.tag == "p" else None if up.tag in BLOCK else up.open_p


def _kind(tag: str, attributes: str) -> tuple[bool, str, str]:
    """Whether an element is furniture by tag, role or being hidden, and the names of its class and id."""
    if tag in FURNITURE:
        return True, "", ""
    if not attributes or tag in ("html", "body"):
        return False, "", ""
    names = ids = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "class":
            names += " " + value
            continue
        if name == "id":
            ids += " " + value
            continue
        value = value.lower()
        if name == "role" and value in FURNITURE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, "", ""
    return False, names, ids


def _judged(tag: str, names: str) -> tuple[float, bool]:
    """What the names leave of a density, and whether they name reader comments."""
    least, comments = 1.0, False
    for name in names.split():
        words = [w.lower() for w in NAME.findall(name)]
        told = [w for w in words if w in FURNITURE_NAMES or w in COMMENT_NAMES]
        if told and words[0] not in STATES:
            factor = 0.0 if all(w in NEUTRAL_NAMES for w in words if w not in told) else 1.0 if tag in PARAGRAPHS else PARTLY
            least = min(least, factor)
            comments = comments or any(w in COMMENT_NAMES for w in told)
    return least, comments


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes and attributes of each tag, in order; comments and declarations have no name.

    The page is read once: > within quotes ends no tag, unless the quotes of some tag never end; from there on the first > does. Where no > is left no tag is.
    """
    position, last, quotes = 0, page.rfind(">"), True
    while (m := OPEN.search(page, position)) is not None:
        start, at = m.span()
        if start > last and not page.startswith("<!--", start):
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            position = len(page) if end < 0 else end + 3
            yield start, position, "", False, ""
            continue
        if not m[2]:
            position = page.find(">", start) + 1
            yield start, position, "", False, ""
            continue
        end = -1
        if quotes:
            look = at
            while (q := QUOTE_OR_END.search(page, look)) is not None:
                if q[0] == ">":
                    end = q.start()
                    break
                if (look := page.find(q[0], q.end()) + 1) == 0:
                    break
            quotes = end >= 0
        if end < 0:
            end = page.find(">", at)
        position = end + 1
        yield start, position, m[2].lower(), bool(m[1]), page[at:end]


def parse(page: str) -> Node:
    """The tree of a page; misnested, unclosed and stray tags are taken as browsers do in the common cases."""
    root = at = Node("html", None)
    root.heading = False  # until densities are taken: whether there is a <header>
    end = skip = 0
    open_: dict[str, int] = defaultdict(int)
    has_body = False
    for start, stop, tag, closes, attributes in _tokens(page):
        if start < skip:
            continue
        if start > end:
            at.items.append(page[end:start])
        end = stop
        if not tag:
            continue
        if closes:
            if not open_[tag]:
                continue  # nothing of this name is open
            while at.tag != tag:
                open_[at.tag] -= 1
                at = at.up
            open_[tag] -= 1
            at = at.up
            continue
        if tag in ("html", "body"):
            if tag == "body" and not has_body:
                has_body = True
                open_.clear()
                at = Node("body", root)
                root.items.append(at)
            continue
        if tag in CLOSE_P and (p := at if at.tag == "p" else None if at.tag in BLOCK else at.open_p) is not None:
            while at is not p.up:
                open_[at.tag] -= 1
                at = at.up
        if close := CLOSES.get(tag):
            node, last = at, None
            stops = CONTAINERS - close
            while node is not None and node.tag not in stops:
                if node.tag in close:
                    last = node
                node = node.up
            while last is not None and at is not last.up:
                open_[at.tag] -= 1
                at = at.up
        if tag == "header":
            root.heading = True
        made = Node(tag, at, *_kind(tag, attributes))
        at.items.append(made)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            found = regex.compile(rf"</{tag}\s*>", regex.I).search(page, stop)
            skip = end = found.end() if found else len(page)
            continue
        open_[tag] += 1
        at = made
    if end < len(page):
        at.items.append(page[end:])
    return root


def _headers(root: Node) -> None:
    """A <header> is furniture, but for one within <article> or <main>, and one with the page's only <h1> and no link."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    headers, titles = [], 0
    while stack:
        node, inside = stack.pop()
        if node.tag == "header" and not inside and not node.furniture:
            headers.append(node)
        titles += node.tag == "h1"
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside) for x in node.items if isinstance(x, Node)]
    for node in headers:
        tags, todo = Counter(), [node]
        while todo:
            x = todo.pop()
            tags[x.tag] += 1
            todo += [y for y in x.items if isinstance(y, Node)]
        node.furniture = not (tags["h1"] == titles == 1 and not tags["a"] and not tags["nav"] and tags["header"] == 1)


def _measure(root: Node) -> list[Node]:
    """All nodes outside furniture, parents first, with their densities."""
    if root.heading:
        _headers(root)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node) and not x.furniture]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.block = node.tag in BLOCK
        node.heading = node.tag in HEADINGS
        for x in node.items:
            if x.__class__ is str:
                node.chars += len(" ".join(x.split()))
            elif not x.furniture:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
                node.block |= x.block
                node.heading |= x.heading
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        node.density = _density(node, share) if node.chars else 0.0
    _total(order)
    for node in order:
        if node.link_tags > 1:
            _neighbours(node)
    if named := [(n, *_judged(n.tag, f"{n.names} {n.ids}")) for n in order if n.names or n.ids]:
        _lower([x for x in named if x[1] < 1], order)
    return order


def _neighbours(node: Node) -> None:
    """Marks the blocks of a node that stand between text."""
    parts = [x for x in node.items if (not x.furniture and x.block and x.chars if isinstance(x, Node) else not x.isspace())]
    told = [isinstance(x, str) or 2 * x.link_chars <= x.chars for x in parts]
    for before, x, after in zip(told, parts[1:], told[2:]):
        if before and after and isinstance(x, Node):
            x.between = True


def _total(order: list[Node]) -> None:
    """Density sums; elements within a line (no block, none inside) are part of it and no children of their own."""
    for node in order:
        node.total = sum(x.density * x.factor for x in node.items if isinstance(x, Node) and not x.furniture and x.block)


def _path(node: Node | None) -> list[Node]:
    """A node and those above it."""
    path = []
    while node is not None:
        path.append(node)
        node = node.up
    return path


def _lower(named: list[tuple[Node, float, bool]], order: list[Node]) -> None:
    """Lowers the densities of nodes with names of furniture, but for those that hold the page's text, and sections like others."""
    every = order[0].chars
    for node, factor, comments in named:
        if comments and every - node.chars >= OTHER_TEXT:
            node.factor = factor
    _total(order)
    best = max(order, key=lambda n: (n.tag != "html", n.total))
    inside = {id(n) for n in _path(best)}
    suspects = {id(n) for n, *_ in named}
    peers: dict[tuple[int, str], list[Node]] = {}
    for n in order:
        if n.up is not None and n.tag in ("section", "div") and n.heading and id(n) not in suspects and 2 * n.link_chars <= n.chars:
            peers.setdefault((id(n.up), n.tag), []).append(n)
    for node, factor, comments in named:
        if not comments and not _holds(node, every, id(node) in inside) and not _section(node, peers.get((id(node.up), node.tag), [])):
            node.factor = factor
    _total(order)


def _section(node: Node, peers: list[Node]) -> bool:
    """Whether a node is a section of a text, named by its subject: only its id says otherwise, and it has a heading and text as its peers have.

    One other <section> is enough, of <div> two, as a page's columns are such too.
    """
    if not node.heading or 2 * node.link_chars > node.chars or len(peers) < (1 if node.tag == "section" else 2) or _judged(node.tag, node.names)[0] < 1:
        return False
    return 2 * node.density >= min(p.density for p in peers[:64])


def _density(node: Node, share: float) -> float:
    """Composite text density; ``share``: the page's linked characters by its characters."""
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars * node.link_chars / plain + share * node.chars + math.e)
    inner = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
    return node.chars / max(node.tags, 1) * max(math.log(max(inner, 1.0)) / math.log(max(base, math.e)), 0.0)


def _holds(node: Node, every: int, best: bool) -> bool:
    """Whether a node holds the text of a page of ``every`` characters; one of a single line must hold nearly all."""
    if not any(isinstance(x, Node) and x.block and not x.furniture for x in node.items):
        return 10 * node.chars > 9 * every
    return 2 * node.chars > every or best and 3 * node.chars > every


def _body(order: list[Node]) -> tuple[Node, Node, float]:
    """The subtree to read, the one in it that is taken whole, and the threshold."""
    dropped: set[int] = set()
    for n in order:  # parents first
        if n.factor == 0 or n.up is not None and id(n.up) in dropped:
            dropped.add(id(n))
    page = next((n for n in order if n.tag == "body"), order[0])
    best = max((n for n in order if id(n) not in dropped and n.tag != "html"), key=lambda n: n.total, default=page)
    if not best.total:
        best = page
    path = _path(best)
    way = {id(n) for n in path}
    threshold = min((n.density for n in path if n.tag != "html" and n.chars), default=0.0)
    top, whole = best, best
    for node in path[1:]:
        if node.tag in ("html", "body"):
            if node.tag == "body" and any(isinstance(x, Node) and not x.furniture and id(x) not in way and _title(x) for x in node.items):
                top = node
            break
        if node.tag in ("article", "main"):
            top = whole = node
        elif any(isinstance(x, Node) and not x.furniture and id(x) not in way and _beside(x, threshold) for x in node.items):
            top = node
    return top, whole, threshold


def _title(node: Node) -> bool:
    """Whether a block is a title that may stand alone at the page's top level."""
    return node.chars > 0 and node.factor > 0 and node.tag in ("h1", "header")


def _beside(node: Node, threshold: float) -> bool:
    """Whether a block beside the way to the body belongs to the text."""
    return node.chars > 0 and node.factor > 0 and (node.tag in HEADINGS or node.tag == "header" or node.density * node.factor >= threshold)


def _blocks(top: Node, whole: Node, threshold: float) -> str:
    """The text of a subtree, a line for each block; beside the way to ``whole`` only what belongs to the text."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if not run:
            return
        if line := " ".join(html.unescape("".join(run)).split()):
            out.append(line)
        run.clear()

    def goes(x: Node) -> bool:
        if x.furniture or x.block and not x.chars or not x.factor or x.factor < 1 and x.density * x.factor < threshold or _linked(x, threshold):
            return True
        if x.tag not in BLOCK or x.up is whole or id(x.up) not in way or id(x) in way:
            return False
        return not (_title(x) if x.up.tag == "body" else _beside(x, threshold))

    way, node = {id(whole)}, whole
    while node is not top:
        node = node.up
        way.add(id(node))
    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x is not top and goes(x):
            if x.tag in BLOCK:
                flush()
        elif x.tag in ("br", "hr"):
            flush()
        elif x.tag not in BLOCK:
            stack += reversed(x.items)
        else:
            flush()
            stack.append(None)
            stack += reversed(x.items)
    flush()
    return "\n".join(out)


def _linked(node: Node, threshold: float) -> bool:
    """Whether a block of the body is a list of links thinner than the threshold, and not between paragraphs."""
    if node.between or node.tag == "li" and node.up is not None and node.up.between:
        return False
    return node.tag in BLOCK and node.link_tags >= 2 and 2 * node.link_chars > node.chars and node.density < threshold


def main_text(page: str) -> str:
    """The main text of a page, blocks joined by line feeds; empty if there is none."""
    if not page:
        return ""
    order = _measure(parse(page))
    return _blocks(*_body(order))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py() or "") for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page, from its whole ``html``.

    One row per row; columns other than page_id, url and html are ignored. Null, empty and blank html gives
    an empty text, and so do pages of menus only. Character references are decoded once; white space within a
    block is one space; blocks follow each other in page order, each on its own line. Without a shuffle.
    """
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
