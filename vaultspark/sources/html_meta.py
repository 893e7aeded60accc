"""Metadata of web pages by native expressions: title, language, canonical address, meta names."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as T

_REFERENCE = r"&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,10}|[A-Za-z][A-Za-z0-9]{1,31});?"


def _named() -> Column:
    """Characters by the names that references have, with their semicolon where they need it: the standard's own table, as one literal."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point; what is none is the replacement character, and 128 to 159 are those of Windows."""
    windows = F.create_map(*[F.lit(x) for n in range(0x80, 0xA0) for x in (n, bytes([n]).decode("cp1252", "replace"))])
    fine = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(number.between(0x80, 0x9F), F.element_at(windows, number.cast("int"))).when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")


def unescape(c: Column) -> Column:
    """c with its character references decoded: decimal and hexadecimal numbers and all names of the standard.

    A name without its semicolon counts where the standard lets it, but only as a whole word. Anything else that
    looks like a reference stays.
    """

    def decoded(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[&#xX;]", "")
        number = F.when(F.lower(F.substr(ref, F.lit(3), F.lit(1))) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        name = F.substr(ref, F.lit(2))
        return F.when(ref.startswith("&#"), _character(number)).otherwise(F.coalesce(F.try_element_at(_named(), name), ref))

    refs = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), decoded)
    parts = F.zip_with(F.split(c, _REFERENCE), refs, lambda text, ref: F.concat(text, F.coalesce(ref, F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute in double, single or no quotes; empty where it has none."""
    quoted = [F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*{q}([^{q}]*){q}""", 1) for q in "\"'"]
    bare = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)""", 1)
    return F.coalesce(*[F.when(x != "", x) for x in (*quoted, bare)], F.lit(""))


#: References that plain escapers write, each with its semicolon; & comes last, so that nothing is decoded twice.
WRITTEN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def title(html: Column, references: dict[str, str] | None = None) -> Column:
    """A page's title with all references decoded; with `references`, those alone, in their order, and a cut one stays as it is."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    if references is None:
        return T.clean_field(unescape(found), 300)
    for written, char in references.items():
        found = F.replace(found, F.lit(written), F.lit(char))
    return T.clean_field(found, 300)


def language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1))
    return F.when(found != "", found)


def charset(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"""(?is)<meta[^>]*charset=["']?([A-Za-z0-9_-]+)""", 1))
    return F.when(found != "", found)


def canonical(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\srel\s*=\s*["']?canonical["'\s/>])[^>]*>""", 0)
    return T.canonical_url(unescape(_attribute(tag, "href")))


def meta(html: Column, *names: str) -> Column:
    """Content of the first of several meta names or properties that is there."""
    out = []
    for n in names:
        tag = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\s(?:name|property)\s*=\s*["']?{n}["'\s/>])(?:"[^"]*"|'[^']*'|[^>"'])*>""", 0)
        out.append(T.clean_field(unescape(_attribute(tag, "content")), 2000))
    return F.coalesce(*out)


def kind_of(og_type: Column) -> Column:
    """Bookmark kind of an og:type; null for types that say nothing."""
    t = F.lower(F.trim(og_type))
    return (
        F.when(t.isin("article", "blog", "blog.post"), F.lit("article")).when(t == "website", F.lit("website"))
        .when((t == "product") | t.startswith("product."), F.lit("product")).when((t == "video") | t.startswith("video."), F.lit("video"))
    )


def metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    h = F.col(html)
    return pages.withColumns({"title": title(h), "language": language(h), "charset": charset(h), "canonical_url": F.coalesce(canonical(h), T.canonical_url(F.col(url))), "site_name": meta(h, "og:site_name", "application-name"), "description": meta(h, "description", "og:description"), "author": meta(h, "author", "article:author"), "kind": kind_of(meta(h, "og:type"))})
