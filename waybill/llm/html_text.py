"""Main text of web pages by consensus of their hosts.

Each page scores its containers and votes for the generalised tag-class path of the best one; votes are added up per
host, and every page is read again from the path that its host prefers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.storage import stored

# An attribute by the rules of HTML: a quote opens a value only straight after "=", elsewhere it is a character like others.
VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+"""
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)" + VALUE)
INSIDE = re.sub(r"\((?=\[)", "(?:", f"(?:[\\s/]++|([^\\s/>][^\\s/>=]*+){VALUE})*+")
# Comments, tags, other markup, text. What is not closed by the end of the page is no text.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)({INSIDE})>|<(?:[!?]|/(?=[^A-Za-z]))[^>]*+(?:>|\Z)|</?[A-Za-z].*|[^<]++|<", re.S
)
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is not markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("body div section article main td center".split())
# A start tag of the key ends an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = frozenset("ul ol dl table div section article main body td th".split())
# Never part of an article.
BOILERPLATE_TAGS = frozenset("nav footer aside button select dialog menu svg canvas object head audio video map".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
BOILERPLATE_NAMES = re.compile(
    r"^(ads?|advert\w*|adsense|adslot|adbox|banner\w*|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side|"
    r"rail|footer\w*|masthead|breadcrumb\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|register|share|sharing|social|related|recommend\w*|comment\w*|disqus|"
    r"reply|replies|respond|discussion|widget\w*|pagination|pager|toolbar|hidden|copyright|legal|disclaimer|outbrain|taboola)$"
)
# Of these, words that a layout adds to the names of what it surrounds, and words that name passages of articles as well.
LAYOUT_NAMES = re.compile(r"^(banner\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side|rail|footer\w*|masthead|breadcrumb\w*|widget\w*|toolbar)$")
PASSAGE_NAMES = re.compile(
    r"^(promo\w*|side|notice\w*|notification\w*|alert\w*|consent|subscription|register|share|sharing|social|related|"
    r"recommend\w*|discussion|copyright|legal|disclaimer)$"
)
HEADER_NAMES = re.compile(r"^((site|page|global|top|main|blog)[-_])?(header|topbar)$")
CONTENT_NAMES = re.compile(r"^(article\w*|content|post\w*|entry\w*|story\w*|main|maincontent|text|body|page)$")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# The share of a page's unlinked letters up to which a passage of an article with such a name is left out.
SMALL = 0.05
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCK_ENDS = HEADINGS | {"p"}


@dataclass
class Node:
    tag: str
    step: str  # the tag with its generalised names; empty for inline elements, which are no part of paths
    path: int  # number of the path in its page
    depth: int
    parent: Node | None
    left_out: bool
    linked: bool
    content: bool
    doubt: str = ""  # "layout", "passage" or "other": its name says boilerplate, what it holds decides
    subject: bool = False  # an article or the like, or a container that its name calls one
    letters: int = 0
    link_letters: int = 0
    headings: int = 0
    matched: int = -1  # how much of a wanted path ends here


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):  # of attributes with one name the first holds
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def _names(attributes: dict[str, str]) -> list[str]:
    """Class and id words; numbers are generalised, so that numbered names of a template agree."""
    words = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return sorted({DIGITS.sub("0", w) for w in words})


def _boilerplate(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag in RAW or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attributes:
        return True
    return attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))


def _doubt(tag: str, names: list[str], in_article: bool) -> str:
    """What kind of boilerplate an element's names (or a form) may stand for; empty if for none."""
    kinds = {"layout"} if tag == "form" else set()
    for name in names:
        parts = re.split(r"[-_:]+", name)
        hits = [p for p in parts if BOILERPLATE_NAMES.match(p)]
        if hits:
            layout = len(parts) > 1 and all(LAYOUT_NAMES.match(p) for p in hits)
            kinds.add("layout" if layout else "passage" if all(PASSAGE_NAMES.match(p) for p in hits) else "other")
        elif HEADER_NAMES.match(name) and not in_article:
            kinds.add("other")
    return next((k for k in ("other", "passage", "layout") if k in kinds), "")


def _decide(nodes: list[Node], plain: dict[int, int], linked: dict[int, int]) -> None:
    """Leave out doubtful elements, but not those around the page's text; ``nodes`` in page order, letters by node.

    An element is kept that holds the article (of the articles, the one with most unlinked letters outside other
    doubtful elements). On a page without one, a layout's element is kept that holds more unlinked letters than stand
    outside all doubtful ones (four times as many, if content is named there); then the largest other one, if it holds
    four times as many as are kept so far and no content is named outside. A passage of an article that its name calls
    legal, related or the like is kept if most of it is unlinked and it is no small share of the page.
    """
    if not any(node.doubt and not node.left_out for node in nodes):
        return
    clean, solid = dict(plain), dict(plain)  # letters outside doubtful elements, and outside all of them but layouts
    for node in reversed(nodes):
        up = id(node.parent)
        if not node.left_out:
            plain[up] = plain.get(up, 0) + plain.get(id(node), 0)
            linked[up] = linked.get(up, 0) + linked.get(id(node), 0)
            clean[up] = clean.get(up, 0) + (0 if node.doubt else clean.get(id(node), 0))
            solid[up] = solid.get(up, 0) + (0 if node.doubt in ("other", "passage") else solid.get(id(node), 0))
    root = id(nodes[0].parent)
    kept: set[int] = set()
    foreign: set[int] = set()  # articles with doubtful names, as of comments, and what they hold
    doubtful: set[int] = set()  # doubtful elements and what they hold
    best, named = None, False
    for node in nodes:
        if id(node.parent) in foreign or (node.tag == "article" and node.doubt == "" and node.subject is False):
            foreign.add(id(node))
        if node.doubt or id(node.parent) in doubtful:
            doubtful.add(id(node))
        if not node.subject or node.left_out or not clean.get(id(node)) or id(node) in foreign:
            continue
        if node.tag in ("article", "main") or node.content and not node.parent.content:
            if best is None or clean[id(node)] > clean[id(best)]:
                best = node
        elif id(node) not in doubtful:
            named = True
    up = best
    while up is not None:
        kept.add(id(up))
        up = up.parent
    if best is None:
        outside = clean.get(root, 0)
        layouts = [n for n in nodes if n.doubt == "layout" and solid.get(id(n), 0) > outside * (4 if named else 1)]
        kept.update(map(id, layouts))
        outside += sum(clean.get(id(n), 0) for n in layouts)
        others = [n for n in nodes if n.doubt in ("other", "passage") and plain.get(id(n), 0) > 4 * outside]
        if others and not named:  # the largest one, the outer one of equals
            kept.add(id(max(others, key=lambda n: plain[id(n)])))
    for node in nodes:
        own = plain.get(id(node), 0)
        if node.doubt == "passage" and node.parent.content and own > linked.get(id(node), 0) and own > SMALL * plain[root]:
            kept.add(id(node))
    for node in nodes:
        node.left_out |= node.parent.left_out or (bool(node.doubt) and id(node) not in kept)


def walk(html: str) -> Events:
    """The events of ``_events``, after it was decided for the whole page which elements are left out."""
    events = list(_events(html))
    nodes, plain, linked = [], {}, {}
    for kind, node, text in events:
        if kind == "open":
            nodes.append(node)
        elif kind == "text" and not node.left_out:
            held = linked if node.linked else plain
            held[id(node)] = held.get(id(node), 0) + len(text) - text.count(" ") - text.count("\n")
    _decide(nodes, plain, linked)
    return events


class _Open:
    """The open elements, innermost last, and where those of each tag stand among them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        self.at[node.tag].pop()
        if node.tag in SCOPE:
            self.scopes.pop()
        return node

    def last(self, tags) -> int:
        """The place of the innermost open element with one of ``tags``; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def _events(html: str) -> Iterator[tuple[str, Node, str]]:
    """("open" | "close" | "break", node, "") and ("text", node, text) in page order; the work is linear in the page."""
    root = Node("", "", 0, 0, None, False, False, False)
    opened, paths = _Open(root), {}
    at, end = 0, len(html)
    while at < end:
        match = TOKEN.match(html, at)
        at = match.end()
        token, tag = match[0], (match[2] or "").lower()
        if not tag:
            if token[0] != "<" or token == "<":
                yield "text", opened.stack[-1], unescape(token)
            continue
        if match[1]:
            place = opened.last((tag,))
            if place:  # an end tag without its start tag says nothing
                while len(opened.stack) > place:
                    yield "close", opened.pop(), ""
            elif tag in ("p", "br"):
                yield "break", opened.stack[-1], ""
            continue
        if tag not in INLINE:
            # A paragraph ends where another block begins, and items end where their like begins.
            place = opened.last(CLOSES.get(tag, frozenset()) | (BLOCK_ENDS if tag not in VOID or tag == "hr" else frozenset()))
            if place and place >= (opened.scopes[-1] if opened.scopes else 0):
                while len(opened.stack) > place:
                    yield "close", opened.pop(), ""
        node = opened.stack[-1]
        if tag in VOID:
            yield "break", node, tag
            continue
        attributes = _attributes(match[3]) if match[3].strip(" /\n") else {}
        names = _names(attributes) if attributes else []
        in_article = node.content
        content = node.content or tag in ("article", "main") or attributes.get("role") == "main"
        left_out = node.left_out or _boilerplate(tag, attributes, in_article)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = end if close is None else (html.find(">", close.start()) + 1 or end)
            continue
        step, path, depth = "", node.path, node.depth
        if tag not in INLINE:
            step, depth = ".".join([tag, *names]), depth + 1
            path = paths.setdefault((path, step), len(paths) + 1)
        child = Node(tag, step, path, depth, node, left_out, node.linked or tag == "a", content)
        doubt = _doubt(tag, names, in_article) if names or tag == "form" else ""
        if tag not in ("body", "html", "article", "main"):
            child.doubt = doubt
        article = tag in ("article", "main") or attributes.get("role") == "main"
        called = tag in CONTAINERS and any(CONTENT_NAMES.match(p) for n in names for p in re.split(r"[-_:]+", n))
        child.subject = tag == "main" or attributes.get("role") == "main" or (not doubt and (article or called))
        opened.push(child)
        yield "open", child, ""
    while len(opened.stack) > 1:
        yield "close", opened.pop(), ""


Events = list[tuple[str, Node, str]]


def _path(node: Node) -> str:
    steps = []
    while node is not None:
        if node.step:
            steps.append(node.step)
        node = node.parent
    return "".join(f">{s}" for s in reversed(steps))


def _scores(events: Events) -> list[tuple[Node, float]]:
    """A node of each path with a score from 0 to 1.

    A container scores by the letters of its article text, less those in links, as a share of all of the page. One that
    its names or its tag call an article gains; of two that hold the same, the inner one gains, unless the outer one
    adds a heading.
    """
    nodes: list[Node] = []
    for kind, node, text in events:
        if kind == "open":
            nodes.append(node)
            node.headings += node.tag in HEADINGS and not node.left_out
        elif kind == "text" and not node.left_out:
            size = len(text) - text.count(" ") - text.count("\n")
            node.letters += size
            node.link_letters += size if node.linked else 0
    own: dict[int, list] = {}
    for node in reversed(nodes):  # whatever an element holds comes after it
        node.parent.letters += node.letters
        node.parent.link_letters += node.link_letters
        node.parent.headings += node.headings
        if node.tag in CONTAINERS and not node.left_out and node.letters:
            held = own.setdefault(node.path, [node, 0.0, 0])
            held[1] += node.letters - node.link_letters
            held[2] = max(held[2], node.headings)
    total = max((v[1] for v in own.values()), default=0.0)
    headings = max((v[2] for v in own.values()), default=0)
    scores = []
    for node, letters, found in own.values() if total else ():
        named = any(CONTENT_NAMES.match(p) for n in node.step.split(".")[1:] for p in re.split(r"[-_:]+", n))
        kind = 1.0 if node.tag in ("article", "main") else 0.5 if named else 0.0
        inner = 0.05 * node.depth / (1 + node.depth)
        scores.append((node, (letters / total) * (0.7 + 0.15 * kind + 0.1 * (found > 0 or not headings) + inner)))
    return scores


def scored_paths(html: str | None) -> list[tuple[str, float]]:
    """Paths of the page's containers with their scores, the best ones only."""
    scores = _scores(walk(html or ""))
    best = max((s for _, s in scores), default=0.0)
    return sorted((_path(n), round(s, 6)) for n, s in scores if s >= 0.75 * best)


def blocks(events: Events, path: str) -> list[str] | None:
    """The blocks of text below ``path``, boilerplate left out; None where the page has no such container."""
    found, open_at, held = False, None, []
    out: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    for kind, node, text in events:
        if kind == "open":
            before = node.parent.matched if node.parent.parent is not None else 0
            fits = before >= 0 and (not node.step or path.startswith(f">{node.step}", before))
            node.matched = before + (len(node.step) + 1 if node.step else 0) if fits else -1
            if open_at is None and node.matched == len(path) and node.tag in CONTAINERS and not node.left_out:
                open_at, found = node, True
            if node.tag not in INLINE:
                flush()
        elif kind == "text":
            if open_at is not None and not node.left_out:
                held.append(text)
        elif kind == "break":
            if text in INLINE:
                held.append(" ")
            else:
                flush()
        else:
            if node.tag not in INLINE:
                flush()
            if node is open_at:
                open_at = None
    flush()
    return out if found else None


def best_path(events: Events) -> tuple[str, float] | None:
    """The path that a page votes for, with its score; the larger path of equals."""
    scores = _scores(events)
    best = max((s for _, s in scores), default=0.0)
    return (max(_path(n) for n, s in scores if s == best), round(best, 6)) if scores else None


def main_text(html: str | None, path: str | None) -> str:
    """The text below the host's path, or below the page's own best one where that path is missing or empty."""
    events = walk(html or "")
    found = blocks(events, path) if path else None
    if not found:
        own = best_path(events)
        found = blocks(events, own[0]) if own else None
    return "\n".join(found or [])


VOTES = "host string, path string, score double"
VOTES_ARROW = pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            best = best_path(walk(html.as_py() or ""))
            if best:
                rows.append((host, *best))
        host, path, score = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], schema=VOTES_ARROW
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes over all pages of a host; of equals the one with the higher scores.

    Each page votes for its best path. Votes are added up before they are shuffled, so a host with a third of all pages is no larger than others.
    """
    votes = pages.select("host", "html").mapInArrow(_vote, VOTES).groupBy("host", "path").agg(
        F.count("*").alias("votes"), F.sum("score").alias("score")
    )
    # Sums of floats depend on their order; equal ones must stay equal.
    ranked = F.struct("votes", F.round("score", 4).alias("score"), F.col("path"))
    return votes.groupBy("host").agg(F.max(ranked)["path"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points of text).

    The whole html is read; a null one is empty and has an empty text. Markup is read by the rules of HTML: what a tag or
    comment without its end swallows is no text. ``noscript`` is left out like a script, as browsers show either; a note
    on the author inside the article is part of it. Pages whose url is null or names no host vote
    together. The preferred paths are joined by host: they are broadcast only if their stored size is below the
    session's threshold. Other columns of ``pages`` are not read.
    """
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    chosen = stored(host_paths(own), "host-paths")
    joined = own.join(chosen, "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), p) for h, p in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
