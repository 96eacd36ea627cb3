"""Raw HTML to a stream of elements.

The markup is tokenised by the standard library parser inside Arrow batches; everything that is concluded from the
elements is done with column expressions in ``page_facts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

_WANTED = {"title", "meta", "link", "script", "a", "img", "iframe", "video", "audio", "source", "nav", "li"} | {f"h{i}" for i in range(1, 7)}
_HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "iframe", "svg"}
_WITH_TEXT = {"title", "a", "li", "script"} | {f"h{i}" for i in range(1, 7)}
_HEADINGS = tuple(f"h{i}" for i in range(1, 7))
_VOID = {"meta", "link", "img", "source", "br", "hr", "input", "area", "base", "col", "embed", "track", "wbr"}

SLICE_CHARS = 500_000

ELEMENTS = T.StructType(
    [
        T.StructField(
            "elements",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tag", T.StringType()),
                        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("text", T.StringType()),
                        T.StructField("nav", T.StringType()),  # aria-label of the navigation list around it
                        T.StructField("item", T.IntegerType()),  # number of the list item around it, else null
                    ]
                )
            ),
        ),
        T.StructField("text", T.StringType()),
    ]
)


class _Elements(HTMLParser):
    """Collects the wanted elements with their own text, and the visible text of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open: dict[str, list[int]] = {}  # wanted elements that collect text, by tag
        self.pieces: list[str] = []  # all text; an element's own text is a range of it
        self.hidden: list[str] = []
        self.navs: list[str] = []
        self.items = 0
        self.item: int | None = None
        self.texts: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag == "nav":
            self.navs.append(values.get("aria-label", ""))
        if tag == "li":
            self.items += 1
            self.item = self.items
            self._close("li")
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if tag in _WANTED:
            if tag in _WITH_TEXT:
                # none of these holds another of its kind, so an unclosed one ends here
                for other in _HEADINGS if tag in _HEADINGS else (tag,):
                    self._close(other)
                self.open.setdefault(tag, []).append(len(self.found))
            self.found.append([tag, values, (len(self.pieces), None), self.navs[-1] if self.navs else None, self.item])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        if self.open.get(tag):
            element = self.found[self.open[tag].pop()]
            element[2] = (element[2][0], len(self.pieces))

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)
        if tag == "nav" and self.navs:
            self.navs.pop()
        if tag in ("li", "ul", "ol", "nav"):  # a list also ends its last item
            self._close("li")
            self.item = None
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if not self.hidden:
            self.texts.append(data)


def _read(html: str | None) -> dict:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    own = lambda x: parser.pieces[x[0]:x[1]]
    rows = [
        {"tag": t, "attrs": a, "text": "" if t not in _WITH_TEXT else "".join(own(x)) if t == "script" else "".join(p.strip() for p in own(x)), "nav": n, "item": i}
        for t, a, x, n, i in parser.found
    ]
    return {"elements": rows, "text": " ".join(" ".join(parser.texts).split())}


def page_slices(html: pd.Series) -> Iterator[pd.Series]:
    """The pages cut so that each slice holds about ``SLICE_CHARS`` characters; one longer page is a slice of its own."""
    ends = html.str.len().fillna(0).astype("int64").cumsum().to_numpy()
    start = 0
    while start < len(html):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(ends.searchsorted(done + SLICE_CHARS, "right")))
        yield html.iloc[start:end]
        start = end


@F.pandas_udf(ELEMENTS)
def html_elements(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The elements of each page, given back some pages at a time: they take many times the memory of the markup."""
    for batch in batches:
        for html in page_slices(batch):
            yield pd.DataFrame([_read(h) for h in html], columns=["elements", "text"])
