"""Operator 6: main text of web pages by tree scoring.

The page is read into a tree that tolerates what is not closed. Each paragraph gives points for its
length and its commas to its parent in full, to its grandparent by half and further up by less; a
container's points are discounted by its share of link text. The container with most points is kept,
with those siblings that have text and few links or its own tag and class, and with the texts that
stand between them; where an article element around it keeps enough of the points, that is kept instead.
Its blocks, in page order, are the text.

Element kinds, roles, classes and ids are evidence, never a verdict alone. Against a container speaks its
being a navigation, header, footer, aside or form, or a name all of whose words are those of adverts,
notices, menus and the like: it is set aside unless it holds most of the page's paragraphs, and then its
paragraphs give a quarter of their points. Reader comments are set aside unless there is nothing else.
A name that has other words too (``related-work``, ``social-history``), one that is contradicted (``id=content
class=sidebar-left``), an id that is an ordinary heading (``legal``) and the header of an article cast a
doubt: such containers go only if half of their text is links or they hold no paragraph. Headings,
paragraphs and inline elements are never judged by their names.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sliced

# a quote opens a value only after "="
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</?[a-zA-Z](?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+>|</?[a-zA-Z][^<>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
COMMAS = ",，、،"
SPACE = re.compile(r"[\s\x00]+")

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Never text, whatever is in them; and what speaks against being the article.
NEVER = frozenset(
    "script style noscript template iframe button select option textarea input label head title svg math object embed canvas audio video map dialog "
    "noembed noframes datalist optgroup".split()
)
AGAINST = frozenset("nav header footer aside form fieldset menu".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main td th".split())

# Words of a class or id, or a role, that set a block apart from the article.
APART_ARTICLE = re.compile(r"^(?:comments?|reply|replies|related|teaser|ads?|advert\w*|promo\w*|sponsor\w*)(?=$|[_-])")
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
APART_WORD = re.compile(
    r"ads?|advert(?:s|isements?|ising)?|adsense|banners?|promo(?:s|tions?)?|sponsor(?:s|ed)?|comments?|commentlist|disqus|respond|reply|replies|sidebar\w*|side|"
    r"widget\w*|menu(?:s|bar|box|wrap)?|nav(?:s|bar\w*|igation|menu|box|wrap|links?)?|breadcrumbs?|footer\w*|foot|header\w*|masthead|"
    r"cookies?(?:bar|notice|banner|consent)?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|signup|share(?:bar|box|buttons?|links?|this)?|sharing|"
    r"social(?:bar|box|icons?|links?|share)?|related(?:posts|articles|links)?|recommend(?:ed|ations?)?|pagination|pager|toolbar|login|"
    r"search(?:bar|box|form|field)?|tags|toc|skip|hidden|copyright|legal|disclaimer|alerts?|teasers?"
)
FURNITURE = frozenset(
    "site page main top bottom left right box bar block wrap wrapper container inner outer list area panel links link buttons button icons icon form posts "
    "post articles article items item content primary secondary global mobile desktop slot unit row col column holder zone sticky fixed entry".split()
)
# Words that are an ordinary heading too: as an id alone they only cast a doubt.
SUBJECT = frozenset("side social legal alert alerts search sharing consent copyright disclaimer cookies notices advertising banners promotions headers navigation menus login".split())
TITLE_PART = re.compile(r"^(?:entry|post|article|story|content|section|chapter)[_-]+header$")
WORDS = re.compile(r"[\W\d_]+")
APART_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form alertdialog".split())
#: Elements that class and id may set apart: containers, never headings, paragraphs and inline elements.
JUDGED = BLOCK - set("body html main h1 h2 h3 h4 h5 h6 p pre blockquote hgroup figcaption caption summary hr".split())
#: How far the evidence against a container goes.
NONE, DOUBT, STRONG, READERS = range(4)
#: Of the points of paragraphs in a container that strong evidence is against; of a container whose names speak for it; of the best that an article around it must have.
QUARTER, SPOKEN_FOR, ENOUGH = 0.25, 1.25, 0.12
MAIN = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?=$|[\s_-])", re.I)


class Node:
    """An element: its name, evidence, children (nodes and texts) and what a survey finds.

    ``text`` and ``link`` are the lengths of its texts and of those in links, ``run`` (text, link, commas) is of
    what stands in it outside inner blocks, ``paragraphs`` the points of all paragraphs in it.
    """

    __slots__ = ("against", "apart", "children", "kind", "link", "main", "name", "paragraphs", "parent", "points", "run", "text")

    def __init__(self, name: str, parent: Node | None, apart: bool = False, against: int = NONE, main: bool = False, kind: str = ""):
        self.name, self.parent, self.children, self.apart, self.against, self.main, self.kind = name, parent, [], apart, against, main, kind
        self.text = self.link = 0
        self.run, self.paragraphs, self.points = (0, 0, 0), 0.0, 0.0


def _evidence(value: str, is_id: bool) -> int:
    """What a class or an id says against its container, by its words."""
    words = [w for w in WORDS.split(value) if w]
    named = [w for w in words if APART_WORD.fullmatch(w)]
    if not named or words[0] in ("no", "has", "with", "without", "hide", "show", "layout", "category", "tag", "topic"):
        return NONE
    if TITLE_PART.search(value) or not all(w in named or w in FURNITURE for w in words):
        return DOUBT
    if COMMENTS.intersection(named):
        return READERS
    return DOUBT if is_id and len(words) == 1 and words[0] in SUBJECT else STRONG


def _marks(name: str, tag: str, parent: Node) -> tuple[bool, int, bool, str]:
    """Whether an element is never text, the evidence against it, whether its names speak for it, and its class."""
    if name in NEVER:
        return True, NONE, False, ""
    against, spoken, kind, names = STRONG if name in AGAINST else NONE, False, "", []
    if name == "header":
        up = parent
        while up is not None and up.name not in ("article", "main"):
            up = up.parent
        against = DOUBT if up is not None else STRONG
    if " " in tag or "\n" in tag or "\t" in tag:
        for key, value in ATTRIBUTE.findall(tag, len(name) + 1):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return True, NONE, False, ""
            if key == "role" and value in APART_ROLE:
                against = STRONG
            elif key == "class":
                kind = value
                names += [(word, False) for word in value.split()]
            elif key == "id":
                names.append((value, True))
    if names and (name in JUDGED or "-" in name):
        says = [(word, _evidence(word, is_id) if name != "article" or APART_ARTICLE.search(word) else NONE) for word, is_id in names]
        spoken = any(e == NONE and MAIN.search(word) for word, e in says)
        worst = max(e for _, e in says)
        against = max(against, DOUBT if worst == STRONG and spoken else worst)
    return False, against, spoken or name in ("article", "main") or (name == "body" and any(MAIN.search(w) for w, _ in names)), kind


def parse(page: str) -> Node:
    """The page's tree; what isn't closed ends where its parent or the page ends."""
    root = here = Node("#root", None)
    at, n = 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        tag, at = found[0], found.end()
        if tag[1] in "!?":
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            up = here
            while up is not root and up.name != name:
                if name in ("p", "b", "i", "a", "span", "em", "strong", "li") and up.name in SCOPE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = up.parent
            elif name == "br":
                here.children.append(Node("br", here))
            continue
        if name in CLOSES_P:
            up = here
            while up is not root and up.name not in SCOPE and up.name != "p":
                up = up.parent
            if up.name == "p":
                here = up.parent
        if name in SAME:
            up = here
            while up is not root and up.name not in ("ul", "ol", "dl", "table") and up.name not in SAME[name]:
                up = up.parent
            if up.name in SAME[name]:
                here = up.parent
        node = Node(name, here, *_marks(name, tag, here))
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            node.children.append(page[at : end.start()])
            at = end.end()
        elif name not in VOID and not (tag.endswith("/>") and name not in BLOCK):
            here = node
    return root


def _clean(text: str) -> str:
    return SPACE.sub(" ", html.unescape(text)).strip()


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node``, in page order, without what is set apart."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            if text := _clean("".join(now)):
                out.append(text)
            now.clear()

    stack: list = [iter(node.children)]
    ends: list[bool] = [True]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                close()
        elif isinstance(child, str):
            now.append(child)
        elif child.name == "br":
            now.append(" ")
        elif not child.apart:
            block = child.name in BLOCK
            if block:
                close()
            stack.append(iter(child.children))
            ends.append(block)
    close()
    return out


def _survey(root: Node) -> list[Node]:
    """Every element not set apart, children before parents, with its sizes."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.apart)
    order.reverse()
    for node in order:
        text = link = run_text = run_link = commas = 0
        paragraphs = 0.0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                text, run_text, commas = text + n, run_text + n, commas + sum(map(c.count, COMMAS))
            elif not c.apart:
                text, link, paragraphs = text + c.text, link + c.link, paragraphs + c.paragraphs
                if c.name not in BLOCK:
                    run_text, run_link, commas = run_text + c.run[0], run_link + c.run[1], commas + c.run[2]
        if node.name == "a":
            link, run_link = text, run_text
        node.text, node.link, node.run = text, link, (run_text, run_link, commas)
        node.paragraphs, node.points = paragraphs + _own_points(node), 0.0
    return order


def _own_points(node: Node) -> float:
    """Points of what stands in a block itself: paragraphs with any text, other blocks with a good line of it; runs of links have none."""
    text, link, commas = node.run
    if node.name not in BLOCK or link >= 0.5 * text or text < (1 if node.name in PARAGRAPH else 81):
        return 0.0
    return 1 + commas + min(text / 100, 3)


def _set_apart(root: Node) -> bool:
    """Sets apart the containers that the evidence is against; whether there are any."""
    whole, turned = root.paragraphs, False
    stack = [root]
    while stack:
        node = stack.pop()
        for c in node.children:
            if not isinstance(c, Node) or c.apart:
                continue
            if c.against == DOUBT:
                named = c.name == "header" or TITLE_PART.search(c.kind)
                c.apart = (c.text > 0 and c.link >= 0.5 * c.text) or not (c.paragraphs or (named and c.text))
            elif c.against == STRONG:
                c.apart = c.paragraphs <= 0.5 * whole
            elif c.against == READERS:
                c.apart = whole - c.paragraphs >= 1 or not c.paragraphs
            if c.apart:
                turned = True
            else:
                stack.append(c)
    return turned


def _give(node: Node | None, points: float) -> None:
    """A paragraph's points: all to its parent, then a half, a quarter, a sixth and an eighth to those above."""
    level = 0
    while node is not None and level < 5:
        node.points += points / (1 if level == 0 else 2 * level)
        node, level = node.parent, level + 1


def _score(node: Node) -> float:
    return node.points * (1 - node.link / node.text) * (SPOKEN_FOR if node.main else 1) if node.text else 0.0


def extract(page: str | None) -> str:
    """The main text of a page; empty for null and empty pages and for pages without any text."""
    if not page:
        return ""
    root = parse(page)
    order = _survey(root)
    if any(n.against for n in order) and _set_apart(root):
        order = _survey(root)
    under: dict[int, float] = {}
    for node in reversed(order):
        under[id(node)] = QUARTER if node.against >= STRONG else under.get(id(node.parent), 1.0)
    for node in order:
        if points := _own_points(node):
            _give(node.parent if node.name in PARAGRAPH and node.parent else node, points * under[id(node)])
    best, most = None, 0.0
    for node in order:
        # of nested containers with the same points the inner one comes first
        if node.name not in ("#root", "html") and (score := _score(node)) > most:
            best, most = node, score
    if best is None:
        holders = [n for n in order if n.name in ("article", "main") and n.text] or [n for n in order if n.name == "body" and n.text]
        return "\n".join(blocks(holders[-1] if holders else root))
    # an article around it has its title and its other parts, if it keeps enough of the points
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    if up is not None and _score(up) >= ENOUGH * most:
        return "\n".join(blocks(up))
    if best.name == "body" or best.parent is None:
        return "\n".join(blocks(best))
    # a container alone in its parent stands for it
    while best.parent.parent is not None and best.parent.name not in ("body", "html") and best.parent.text == best.text:
        best = best.parent
    return "\n".join(blocks(_with_siblings(best)))


def _with_siblings(best: Node) -> Node:
    """A container of what belongs to ``best`` among its parent's children, in order: texts, inline runs and siblings, whatever their points."""
    out, run = Node("#part", None), []

    def close() -> None:
        # texts and inline elements that follow each other are judged as one
        text = sum(len(c.strip()) if isinstance(c, str) else c.text for c in run)
        link = sum(c.link for c in run if not isinstance(c, str))
        if link < 0.5 * text:
            out.children += run
        run.clear()

    for sibling in best.parent.children:
        if isinstance(sibling, str) or (sibling.name not in BLOCK and sibling is not best):
            run.append(sibling)
            continue
        close()
        if sibling is best:
            out.children.append(sibling)
        elif not sibling.apart and sibling.against < STRONG and sibling.text:
            alike = sibling.name == best.name and best.kind and sibling.kind == best.kind
            if alike or sibling.name in HEADING or sibling.link < 0.5 * sibling.text:
                out.children.append(sibling)
    close()
    return out


def extracted(page: Column) -> Column:
    """The main text of whole pages."""

    @F.arrow_udf("string")
    def texts(pages):
        import pyarrow as pa

        return sliced(pages, pa.string(), lambda part: list(map(extract, part)), 64)

    return texts(page)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the main text of every page of ``pages``.

    Null and empty pages have an empty text; a page of any length is read whole; every row, repeated ones too, has
    its own answer; other columns take no part; an empty table gives no rows."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", extracted(F.col("html").cast("string")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
