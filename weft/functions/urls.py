"""URL predicates, link extraction and resolution."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weft.functions.html_text import document_hrefs

#: Fixed values, which decide what is crawled and indexed: extensions of assets that are not crawled; the pattern
#: of an anchor's quoted href; of an e-book mirror, names that are no books, and patterns of names that may be.
ASSETS = "css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|map|pdf|zip|gz|mp3|mp4|avi|mov"
HREF = r"""(?i)<a\s+[^>]*href=["']([^"']+)["'][^>]*>"""
NO_BOOKS = ("books.txt", "indextree.txt", "donate-howto.txt")
BOOK_NAMES = (r"(?i)\.txt(?:\.[a-z0-9-]+)?$", r"(?i)\.x?html?$")
_PORTS = {"http": 80, "https": 443}


def path_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def should_crawl(url: Column) -> Column:
    """An http or https url whose path is no asset's; false for null and malformed ones."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & host.isNotNull() & ~path_of(url).rlike(rf"(?i)\.({ASSETS})$"), F.lit(False))


def catalogue_page(url: Column) -> Column:
    """Detail pages of a product catalogue, not its categories."""
    path = path_of(url)
    return path.contains("/catalogue/") & ~path.contains("/catalogue/category/") & path.rlike(r"(?i)_[0-9]+/index\.html$")


def named_file(url: Column, host: str, root: str, names: Sequence[str], skip: Sequence[str] = (), digits: bool = False) -> Column:
    """Files below `root` of a host whose name fits one of the patterns, is none of `skip` (in lower case) and, if so asked, has a digit."""
    path = path_of(url)
    name = F.substring_index(path, "/", -1)
    out = (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host) & F.startswith(path, F.lit(root)) & functools.reduce(Column.__or__, [name.rlike(p) for p in names])
    if skip:
        out = out & ~F.lower(name).isin(*skip)
    return out & name.rlike(r"\d") if digits else out


def ebook_file(url: Column, host: str, root: str, skip: Sequence[str] = NO_BOOKS) -> Column:
    """Text or HTML files of an e-book mirror whose name has a digit."""
    return named_file(url, host, root, BOOK_NAMES, skip, digits=True)


def text_file(url: Column, host: str, root: str) -> Column:
    return named_file(url, host, root, (r"(?i)\.txt$",))


def is_indexable(url: Column, *corpora: Column) -> Column:
    """A page worth indexing: a catalogue page, or one of the further corpus predicates (see ebook_file, text_file)."""
    catalogue = path_of(url).contains("/catalogue/")
    out = F.lit(False)
    for c in corpora:
        out = out | F.coalesce(c, F.lit(False))
    return F.coalesce(F.when(catalogue, catalogue_page(url)).otherwise(out), F.lit(False))


def hrefs(html: Column) -> Column:
    """The quoted href of every anchor, in order, repeats kept. Null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(HREF), 1), F.array().cast("array<string>"))


def normal_url(href: str, base: str) -> str | None:
    """href seen from base, normalised: scheme and host in lower case, no default port, a path, escaped blanks. None if malformed."""
    try:
        parts = urlsplit(urljoin(base, href.strip()))
        if not parts.scheme or (parts.scheme in _PORTS and not parts.hostname):
            return None
        if parts.scheme not in _PORTS:
            return urlunsplit(parts)
        port = f":{parts.port}" if parts.port and parts.port != _PORTS[parts.scheme] else ""
        login = parts.netloc.rpartition("@")[0]
        safe = "!$%&'()*+,-./:;=?@_~[]|^\\{}`"
        return urlunsplit((parts.scheme, (login + "@" if login else "") + parts.hostname.encode("idna").decode() + port, quote(parts.path or "/", safe=safe), quote(parts.query, safe=safe), quote(parts.fragment, safe=safe)))
    except ValueError:
        return None


@F.pandas_udf(ArrayType(StringType()))
def resolve(base: pd.Series, links: pd.Series) -> pd.Series:
    """Each link seen from the base url; malformed ones are left out."""
    return pd.Series([[u for u in (normal_url(h, b) for h in (own if own is not None else []) if b) if u] for b, own in zip(base, links, strict=True)])


def page_links(url: Column, html: Column) -> Column:
    """Crawlable links of a page without repeats, the page's own url first."""
    return F.array_distinct(F.concat(F.array(url), F.filter(resolve(url, hrefs(html)), should_crawl)))


def local_base(url: Column) -> Column:
    """index.html goes, anything else gets a slash."""
    return F.when(F.endswith(url, F.lit("index.html")), F.substring(url, F.lit(1), F.length(url) - 10)).otherwise(F.concat(url, F.lit("/")))


def local_links(url: Column, html: Column) -> Column:
    """Every link of the parsed document in order, repeats kept, seen from local_base()."""
    return resolve(local_base(url), document_hrefs(html))
