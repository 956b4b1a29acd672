"""Document text of HTML: headings in capitals, links and images with their target in brackets, list items marked, paragraphs apart, lines wrapped; and the links of a document. Arrow UDFs over a parser.

A table is a block of its own whose cells follow each other as words do; a rule is a line of dashes.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADINGS | {"p", "div", "ul", "ol", "table", "pre", "blockquote", "section", "article", "header", "footer", "main", "nav", "aside", "li", "form"}
_APART = _HEADINGS | {"p", "ul", "ol", "table", "pre", "blockquote"}
_LISTS = {"ul", "ol"}
_SKIPPED = {"script", "style", "head", "title", "noscript", "template"}
_VOID = {"br", "img", "hr", "meta", "link", "input"}


#: Characters of a line. A longer word stands alone.
WIDTH = 80


def wrapped(line: str, width: int | None) -> str:
    """A line of single-spaced words, broken where the next word would pass the width."""
    out, used = [], 0
    for word in line.split(" "):
        if out and width and used + 1 + len(word) > width:
            out.append("\n" + word)
            used = len(word)
        else:
            out.append(" " + word if out else word)
            used += len(out[-1])
    return "".join(out)


class _Text(HTMLParser):
    def __init__(self, width: int | None = WIDTH):
        super().__init__(convert_charrefs=True)
        self.width, self.pre = width, 0
        self.blocks: list[tuple[bool, str]] = []  # (stands apart, text)
        self.words, self.skip, self.upper, self.links, self.apart = "", 0, 0, [], False
        self.lists: list[list] = []  # of each open list: ordered, items so far, what goes before the item's first block, and before its other lines

    def _close(self, apart: bool) -> None:
        mark, indent = "".join(k[2] for k in self.lists), "".join(k[3] for k in self.lists)
        if self.pre:
            text = self.words.replace("\0", "\n").strip("\n")
        else:
            width = self.width and max(1, self.width - len(indent))
            text = "\n".join(wrapped(" ".join(line.split()), width) for line in self.words.split("\0")).strip()
        if text:
            self.blocks.append((self.apart, mark + text.replace("\n", "\n" + indent)))
            for k in self.lists:
                k[2] = k[3]
            self.apart = False
        self.words = ""
        if not (self.lists and self.lists[-1][2] != self.lists[-1][3]):  # an item's first block stands by its mark
            self.apart |= apart

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _BLOCKS:
            self._close(tag in _APART and not (tag in _LISTS and self.lists))
            self.upper += tag in _HEADINGS
            self.pre += tag == "pre"
            if tag in _LISTS:
                self.lists.append([tag == "ol", 0, "", ""])
            elif tag == "li" and self.lists:
                own = self.lists[-1]
                own[1] += 1
                own[2] = f" {own[1]}. " if own[0] else " * "
                own[3] = " " * len(own[2])
        elif tag == "br":
            self.words += "\0"
        elif tag == "hr":
            self._close(True)
            self.words = "-" * (self.width or 40)
            self._close(True)
        elif tag == "img" and not self.skip:
            own = dict(attrs)
            alt, src = own.get("alt") or "", own.get("src") or ""
            self.words += f"{alt} [{src}]" if alt and src else alt or (f"[{src}]" if src else "")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            self._close(tag in _APART and not (tag in _LISTS and len(self.lists) > 1))
            if tag in _LISTS and self.lists:
                self.lists.pop()
            elif tag == "li" and self.lists:
                self.lists[-1][2:] = "", ""
            self.upper = max(0, self.upper - (tag in _HEADINGS))
            self.pre = max(0, self.pre - (tag == "pre"))
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.words += f" [{href}]"

    def handle_data(self, data):
        if not self.skip:
            self.words += data.upper() if self.upper else data

    def text(self) -> str:
        self._close(False)
        out = ""
        for i, (apart, block) in enumerate(self.blocks):
            out += ("" if not i else "\n\n" if apart else "\n") + block
        return out


def document_text(html: str | None, width: int | None = WIDTH) -> str | None:
    """width: None leaves lines whole."""
    if html is None:
        return None
    parser = _Text(width)
    parser.feed(html)
    parser.close()
    return parser.text()


@F.pandas_udf(StringType())
def html_document_text(html: pd.Series) -> pd.Series:
    return html.map(document_text)


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.hrefs += [v or "" for k, v in attrs if k == "href"][:1]


def anchors(html: str | None) -> list[str]:
    """The href of every anchor element in document order, repeats kept, quoted or not, entities resolved. Comments and scripts hold none; null gives none."""
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    return parser.hrefs


@F.pandas_udf(ArrayType(StringType()))
def document_hrefs(html: pd.Series) -> pd.Series:
    return html.map(anchors)
