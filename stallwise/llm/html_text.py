"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small
    span strike strong sub sup time tt u var wbr br img""".split())
PARAGRAPH_ENDS = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul body""".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table div article section body html".split())
FURNITURE = frozenset("nav footer aside form button select menu dialog head object canvas audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_\s])(ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|widget|related|"
    r"recommended|share|sharing|social|comments?|commentlist|disqus|discussion|replies|respond|footer|masthead|pagination|pager|"
    r"toolbar|site-header|page-header|skip)(?:$|[-_\s\d])", re.I)
CONTENT_TAGS = frozenset("article main".split())
SIDE_ARTICLES = re.compile(r"(?:^|[-_\s])(comments?|reply|replies|responses?|ads?|sponsored|promo|related|recommended)(?:$|[-_\s\d])", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLANK = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    path: str
    dropped: bool
    parent: Node | None = None


@dataclass
class Block:
    """Text of one block element between two borders."""

    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass(frozen=True)
class RatioSettings:
    """``width``: neighbours on each side that smooth a path's ratio; ``share``: part of the best smoothed ratio that makes a
    path content; ``link_share``: paths with more of their text in links are not content.
    """

    width: int = 1
    share: float = 0.1
    link_share: float = 0.5


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order.  Furniture, scripts and comments are left out here; unclosed tags end as in browsers."""
    root = Node("", "", False)
    open_nodes, out, current, links, at, size = [root], [], None, 0, 0, len(page)

    def add(raw: str) -> None:
        nonlocal current
        node = open_nodes[-1]
        if node.dropped:
            return
        if current is None:
            holder = node
            while holder.tag in INLINE and holder.parent is not None:
                holder = holder.parent
            current = Block(holder)
            out.append(current)
        text = entities.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag not in INLINE:
            current = None
        if m.group(1):
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    links -= sum(n.tag == "a" for n in open_nodes[k:])
                    del open_nodes[k:]
                    break
                if tag in INLINE and open_nodes[k].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = size if end is None else end.end()
            continue
        closing = SAME_ENDS.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDS else set())
        if closing:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in closing:
                    links -= sum(n.tag == "a" for n in open_nodes[k:])
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in SCOPES:
                    break
        parent, names, role = open_nodes[-1], "", ""
        if m.group(3):
            for a in ATTRIBUTE.finditer(m.group(3)):
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if a.group(1).lower() == "role":
                    role = value.lower()
                else:
                    names += " " + value
        inside = f"/{parent.path}/"
        # an article is what the page is for, whatever its class says of its surroundings, unless it is a remark or an advert
        telling = SIDE_ARTICLES if tag in CONTENT_TAGS else FURNITURE_NAMES
        named = bool(names) and tag not in ("html", "body") and telling.search(names) is not None
        furniture = (tag in FURNITURE or role in FURNITURE_ROLES or named
                     or tag == "header" and not any(f"/{c}/" in inside for c in CONTENT_TAGS))
        label = tag if tag in INLINE or not names else tag + "." + ".".join(names.split())
        open_nodes.append(Node(tag, f"{parent.path}/{label}" if parent.path else label, parent.dropped or furniture, parent))
        links += tag == "a"
    for b in out:
        b.text = BLANK.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text]


def content_paths(found: list[Block], settings: RatioSettings = RatioSettings()) -> set[str]:
    """Paths whose fused, smoothed ratio is above the threshold.

    A path's text ratio is its text length over its blocks, its punctuation ratio its marks over its blocks.  Both are
    smoothed along the paths in page order, multiplied, and compared with a share of the best.
    """
    paths: dict[str, list[float]] = {}
    for b in found:
        p = paths.setdefault(b.node.path, [0.0, 0.0, 0.0, 0.0])
        p[0] += 1
        p[1] += len(b.text)
        p[2] += len(PUNCTUATION.findall(b.text))
        p[3] += b.linked
    names = list(paths)
    raw = [(p[1] / p[0], (p[2] + 1) / p[0], p[1]) for p in paths.values()]

    def smooth(i: int, which: int) -> float:
        near = raw[max(0, i - settings.width):i + settings.width + 1]
        return (raw[i][which] + sum(x[which] for x in near) / len(near)) / 2

    fused = [smooth(i, 0) * smooth(i, 1) * raw[i][2] for i in range(len(names))]
    best = max(fused, default=0.0)
    return {n for n, f in zip(names, fused) if f >= settings.share * best and paths[n][3] <= settings.link_share * paths[n][1]}


def main_text(page: str | None, settings: RatioSettings = RatioSettings()) -> str:
    """Main text of one page: its blocks joined by line ends; empty for a null page or one without content.

    The content paths name the article: the innermost article or main element around the most of their text, else the innermost
    element around nearly all of it.  Everything inside that is not furniture or mostly links belongs to it, short
    paragraphs and headings included.
    """
    found = blocks_of(page or "")
    if not found:
        return ""
    chosen = content_paths(found, settings)
    weight: dict[int, int] = {}
    nodes: dict[int, Node] = {}
    total = 0
    for b in found:
        if b.node.path in chosen:
            total += len(b.text)
            node = b.node
            while node is not None:
                weight[id(node)] = weight.get(id(node), 0) + len(b.text)
                nodes[id(node)] = node
                node = node.parent
    if not total:
        return ""
    deep = lambda k: nodes[k].path.count("/") + bool(nodes[k].path)
    marked = [k for k in weight if nodes[k].tag in CONTENT_TAGS]
    frame = max(marked, key=lambda k: (weight[k], deep(k))) if marked else max(
        (k for k in weight if weight[k] >= 0.9 * total and nodes[k].tag not in ("p", "li")), key=deep, default=None)

    def within(node: Node | None) -> bool:
        while node is not None:
            if id(node) == frame:
                return True
            node = node.parent
        return frame is None

    return "\n".join(b.text for b in found if within(b.node) and (
        b.node.path in chosen or b.linked <= settings.link_share * len(b.text)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars), one row per row of ``pages``.

    The whole page is read; character references are decoded, white space inside a block is one space, blocks are joined by
    one line end.  Null and empty pages, and pages without content, give an empty text.  Null keys and addresses stay; repeated
    rows give repeated results; an empty table gives none; extra columns are ignored.
    """
    arrow_rows(pages.sparkSession, 128)

    def mapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["k", "url", "text"])

    narrow = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return narrow.mapInArrow(mapped, "k long, url string, text string").select(
        F.col("k").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
