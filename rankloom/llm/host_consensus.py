"""Main text of web pages by consensus paths of their host.

1. Each page is parsed into blocks of text inside containers. Containers are scored by the text of their own blocks outside links,
   children count by half; menus, adverts, forms, comments and the like count nothing. The best container votes for its path: tags
   with their classes from the root, digits generalised, so that ``div.post-17`` and ``div.post-18`` are one.
2. Spark sums the votes per host and path; the paths with a fair share of the pages of a host win.
3. Pages are extracted again along the winning paths of their host, in order of votes; containers beside the article's that are on another
   winning path belong to it, so that an article in several parts is whole. A page that has none of them falls back to its own best container.

The text is that of the container without the parts that are not article text, character references decoded, white space inside a
block made one space, blocks joined in page order by one space.

Defined results: null, empty or text-free pages give an empty text; unclosed tags, comments and scripts are read as browsers do in
outline; a null url is a host of its own; repeated rows are repeated; very long, deep or broken pages are read whole in time and memory
that grow with their length; of paths with equal votes the one first in text order is read first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices, texts_of
from rankloom.llm.decontaminate import bounded

OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-z][^\s/>]*))", re.I)
DELIMITER = re.compile("[>\"']")
RAW = frozenset("script style textarea template iframe noframes xmp".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body center dd div main section td".split())
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote li td dd figcaption".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROPPED_TAGS = frozenset("head nav footer aside form button select option noscript svg canvas dialog object audio video menu title".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted related respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog form alert menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    tag: str
    path: int  # hash of the tags and classes from the root
    parent: int
    dropped: bool
    header: bool  # inside a page header, of which headings may stay
    heading: bool  # in a heading
    box: int  # the nearest container, itself included
    label: str = ""
    score: float = 0.0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str, int, str]] = field(default_factory=list)  # node, text, characters in links, tag


def named(attrs: str) -> tuple[str, str, list[str]]:
    """Classes, role, and the words of the class and id names."""
    classes = role = ids = ""
    for name, *values in ATTRIBUTE.findall(attrs):
        value = "".join(values).lower()
        if name.lower() == "class":
            classes = value
        elif name.lower() == "id":
            ids = value
        else:
            role = value
    return classes, role, re.split(r"[\s_-]+", f"{classes} {ids}")


def tokens(text: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``start, end, whether it closes, tag, attributes`` of the tags of a page; comments and raw elements have no tag.

    The page is read once from front to back: what has been looked for in vain is not looked for again.
    """
    missing: dict[str, int] = {}

    def find(what: str, at: int) -> int:
        if at >= missing.get(what, len(text) + 1):
            return -1
        found = text.find(what, at)
        if found < 0:
            missing[what] = at
        return found

    lower, at = None, 0
    while m := OPENING.search(text, at):
        if m["comment"] or m["other"]:
            close = "-->" if m["comment"] else ">"
            found = find(close, m.end())
            at = len(text) if found < 0 else found + len(close)
            yield m.start(), at, False, "", ""
            continue
        at = m.end()
        while (stop := DELIMITER.search(text, at)) and stop[0] != ">":
            pair = find(stop[0], stop.end())
            at = stop.end() if pair < 0 else pair + 1  # a quote that is never closed is an ordinary character
        if not stop:
            return  # a tag that never ends: the rest is text
        attrs, at = text[m.end():stop.start()], stop.end()
        tag = m["tag"].lower()
        if tag in RAW and not m["end"]:
            lower = text.lower() if lower is None else lower
            if len(lower) != len(text):  # letters that change their length in lower case
                lower = re.sub(r"[A-Z]", lambda c: c[0].lower(), text)
            key = f"</{tag}"
            found = -1 if at >= missing.get(key, len(text) + 1) else lower.find(key, at)
            if found < 0:
                missing[key] = min(at, missing.get(key, at))
            over = find(">", found) if found >= 0 else -1
            at = len(text) if over < 0 else over + 1
            tag = ""
        yield m.start(), at, bool(m["end"]), tag, attrs


def path_hash(up: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, up)


def hash_of(path: str) -> int:
    """Hash of a path as text, ``/label/label``."""
    out = 0
    for label in path.split("/")[1:]:
        out = path_hash(out, label)
    return out


def parse(text: str) -> Page:
    page = Page()
    nodes = page.nodes
    nodes.append(Node("#", 0, -1, False, False, False, 0))
    stack = [0]
    opened: Counter[str] = Counter()
    words: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if words:
            clean = " ".join(html.unescape("".join(words)).split())
            if clean:
                page.blocks.append((stack[-1], clean, linked, nodes[stack[-1]].tag))
            words.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal in_link
        if any(nodes[i].tag not in INLINE for i in stack[k:]):
            flush()
        if any(nodes[i].tag == "a" for i in stack[k:]):
            in_link = 0
        opened.subtract(nodes[i].tag for i in stack[k:])
        del stack[k:]

    for start, end, closing, tag, attrs in tokens(text):
        if start > at:
            piece = text[at:start]
            words.append(piece)
            if in_link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in CLOSES_P or tag in CLOSES:
            ends = CLOSES.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1) if any(opened[e] > 0 for e in ends) else ():
                own = nodes[stack[k]].tag
                if own in ends:
                    close(k)
                    break
                if own in CONTAINERS or own in ("ul", "ol", "dl", "table", "nav", "footer", "header", "aside", "form"):
                    break
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        up = nodes[stack[-1]]
        classes, role, names = named(attrs) if attrs.strip() else ("", "", [])
        dropped = up.dropped or tag in DROPPED_TAGS or role in DROPPED_ROLES or (tag not in ("html", "body") and not DROPPED_NAMES.isdisjoint(names))
        header = up.header or tag == "header" or (tag not in ("html", "body") and "header" in names and tag not in HEADINGS)
        label = "" if tag in INLINE else ".".join([tag, *sorted(re.sub(r"[0-9]+", "#", c).replace("/", "|") for c in classes.split())])
        box = len(nodes) if tag in CONTAINERS else up.box
        nodes.append(Node(tag, path_hash(up.path, label) if label else up.path, stack[-1], dropped, header, up.heading or tag in HEADINGS, box, label))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        if tag == "a":
            in_link = 1
        if attrs.rstrip().endswith("/") and tag not in CONTAINERS and tag not in PARAGRAPHS:
            close(len(stack) - 1)
    words.append(text[at:])
    flush()
    return page


def kept_block(page: Page, block: tuple[int, str, int, str]) -> bool:
    node = page.nodes[block[0]]
    return not node.dropped and (not node.header or node.heading)


def lineage(page: Page, i: int) -> Iterator[int]:
    while i > 0:
        yield i
        i = page.nodes[i].parent


def best_container(page: Page) -> tuple[str, float]:
    """Path and score of the container with most article text; of equal ones the outer."""
    nodes = page.nodes
    for block in page.blocks:
        if kept_block(page, block):
            i = block[0]
            in_paragraph = 1.0 if nodes[i].tag in PARAGRAPHS else 0.6
            nodes[nodes[i].box].score += in_paragraph * max(0, len(block[1]) - 3 * block[2])
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in CONTAINERS or nodes[i].score:
            nodes[nodes[nodes[i].parent].box].score += 0.5 * nodes[i].score
    best = max(range(len(nodes)), key=lambda i: (nodes[i].score, -i))
    score = nodes[best].score
    for tag in ("article", "main"):
        outer = [i for i in lineage(page, best) if nodes[i].tag == tag and not nodes[i].dropped]
        if outer:
            best = outer[-1]
            break
    labels = [nodes[i].label for i in lineage(page, best) if nodes[i].label]
    return "".join(f"/{label}" for label in reversed(labels)), score


def text_along(page: Page, paths: list[int]) -> str:
    """Article text of all containers with the first of the paths, and of the containers beside them with another of them, in page order."""
    nodes = page.nodes
    main = [n.label != "" and n.path == paths[0] for n in nodes]
    main[0] = paths[0] == 0
    beside = {nodes[i].parent for i in range(len(nodes)) if main[i]}
    others = frozenset(paths[1:])
    inside = main
    for i in range(1, len(nodes)):
        inside[i] = inside[i] or inside[nodes[i].parent] or (nodes[i].parent in beside and nodes[i].label != "" and nodes[i].path in others)
    return " ".join(b[1] for b in page.blocks if inside[b[0]] and kept_block(page, b))


def extract(text: str, paths: list[str]) -> tuple[str, str]:
    """Text and path: the first of the given paths that yields text, with what stands beside it along another one, or else the page's own best container."""
    page = parse(text)
    hashes = [hash_of(p) for p in paths]
    for k, path in enumerate(paths):
        if found := text_along(page, [hashes[k], *hashes[:k], *hashes[k + 1:]]):
            return found, path
    path, _ = best_container(page)
    return text_along(page, [hash_of(path)]), path


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = 0.05) -> DataFrame:
    """``host, paths``: the paths with at least ``least_share`` of the votes of a host, most votes first."""

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            votes = [best_container(parse(t)) for t in texts_of(part, "html")]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())],
                                             names=["host", "path", "score"])

    rows = picked(pages, url=url_col, html=html_col).select(host_of("url").alias("host"), "html").mapInArrow(vote, "host string, path string, score double")
    votes = rows.where("score > 0").groupBy("host", "path").agg(F.count("*").alias("votes"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))
    return votes.withColumn("share", share).where(F.col("share") >= least_share).groupBy("host").agg(F.transform(ordered, lambda s: s["path"]).alias("paths"))


def main_texts(pages: DataFrame, winners: DataFrame, n_hosts: int, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, path`` of every page. The hosts are broadcast if ``n_hosts`` is within the limit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = [extract(t, p or []) for t, p in zip(texts_of(part, "html"), part.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.string())], names=["page_id", "url", "text", "n_chars", "path"])

    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).withColumns({"page_id": F.col("page_id").cast("long"), "host": host_of("url")})
    joined = rows.join(bounded(winners, n_hosts), "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
