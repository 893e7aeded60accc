"""Text functions as column expressions: folding, tokens, tolerant spelling, names, titles and URLs."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+"
LONGEST_TOKEN = 64
WORD_ENDINGS = ("e", "en", "es", "n", "s")  # fixed values, in the order they are tried


#: Letters, digits and marks that lower case folds exactly but for ß: most of what Latin and Cyrillic texts hold, and CJK.
PLAIN = r"\x00-\x7f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u012f\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0481\u048a-\u052f\u2010\u2012-\u2016\u2018-\u2023\u2030\u2039\u203a\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"


#: Any other character; ASCII, the bulk of most texts, is told apart by one comparison.
OTHER = rf"[\x{{80}}-\x{{10ffff}}&&[^{PLAIN}]]"


def _folded(char: str) -> str:
    return unicodedata.normalize("NFKC", char).casefold()


@cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, what each folds to, characters that fold to several with these), by rule from the Unicode tables.

    Several: only letters of European scripts, punctuation and ligatures, as each costs a pass over the text.
    """
    singles, several = {}, []
    for code in range(0xA0, 0xFFFE):
        char = chr(code)
        made = _folded(char)
        if 0xD800 <= code < 0xE000 or made == char.lower() and char != "Σ" or 0x13A0 <= code < 0x13FE or 0xAB70 <= code < 0xABC0:
            continue  # surrogates, and Cherokee, whose folding is upward
        if len(made) == 1:
            singles[char] = made
        elif made and (code < 0x0590 or 0x1E00 <= code < 0x2190 or 0xFB00 <= code < 0xFB18):
            several.append((char, made))
    return "".join(singles), "".join(singles.values()), tuple(several)


def fold(c: Column) -> Column:
    """NFKC and full case folding on the JVM, character by character.

    Texts of plain characters need lower case and ß as ss only; others go through a table, and those of characters
    that fold to several through one replacement after another. What a table cannot do is to compose a letter and a
    combining mark that follow each other: for that, see fold_exact.
    """
    singles, made, several = _folding()
    other = F.translate(c, singles, made)
    pairs = F.from_json(F.lit(json.dumps([{"one": x, "many": y} for x, y in several])), "array<struct<one:string,many:string>>")  # a constant, and one expression for all
    spread = F.aggregate(pairs, other, lambda text, p: F.replace(text, p["one"], p["many"]))
    other = F.when(other.rlike(_class([x for x, _ in several])), spread).otherwise(other)
    return F.replace(F.lower(F.when(c.rlike(OTHER), other).otherwise(c)), F.lit("ß"), F.lit("ss"))


def _class(chars: list[str]) -> str:
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in chars) + "]"


def fold_text(text: str) -> str:
    """What fold() makes of a text, on the driver: for queries and other single values."""
    singles, made, several = _folding()
    if re.search(rf"[^{PLAIN}]", text):
        text = text.translate(str.maketrans(singles, made))
        for one, many in several:
            text = text.replace(one, many)
    return text.lower().replace("ß", "ss")


def tokens_of(text: str) -> list[str]:
    """What tokens() makes of a text, on the driver."""
    return [w for w in re.findall(r"[^\W_]+", fold_text(text)) if len(w) <= LONGEST_TOKEN]


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """NFKC and full case folding, batch by batch."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


#: A whole run of at most LONGEST_TOKEN characters; longer runs are no token.
WHOLE_TOKEN = rf"(?<![\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}]{{1,{LONGEST_TOKEN}}}+(?![\p{{L}}\p{{N}}])"


def tokens(c: Column, exact: bool = False) -> Column:
    """Array of folded runs of letters and digits of at most 64 characters, repeats included."""
    return F.regexp_extract_all(fold_exact(c) if exact else fold(c), F.lit(WHOLE_TOKEN), F.lit(0))


def eligible(w: Column, least: int) -> Column:
    """May this word be matched loosely? Letters only, long enough, and not like a hexadecimal id."""
    return w.rlike(r"^\p{L}+$") & (F.char_length(w) >= least) & ~w.rlike("^[a-f]{8,}$")


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one insertion, deletion, substitution or swap of neighbours."""
    distance = F.levenshtein(a, b)
    swaps = F.when(F.char_length(a) > 1, F.sequence(F.lit(1), F.char_length(a) - 1)).otherwise(F.array().cast("array<int>"))
    swapped = F.exists(swaps, lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (distance == 1) | ((distance == 2) & (F.char_length(a) == F.char_length(b)) & swapped)


def _first_two(terms: list[str], words: Column, test) -> Column:
    """At most two words that pass test(term, word), in (term, word) order; words are sorted and different."""

    def passing(term: str) -> Column:
        return F.filter(words, lambda w: test(term, w))

    found = F.flatten(F.array(*map(passing, sorted(set(terms))))) if terms else F.array().cast("array<string>")
    return F.slice(F.array_distinct(found), 1, 2)


def _loose(term: str, least: int) -> bool:
    return term.isalpha() and len(term) >= least and not (len(term) >= 8 and set(term) <= set("abcdef"))


def typo_terms(terms: list[str], words: Column, least: int = 5) -> Column:
    """Words one edit from a term; five letters for titles and aliases, seven for bodies. At most two."""
    return _first_two([t for t in terms if _loose(t, least)], words, lambda t, w: F.char_length(w).between(max(least, len(t) - 1), len(t) + 1) & (w != t) & eligible(w, least) & one_edit(w, F.lit(t)))


def component_terms(terms: list[str], words: Column) -> Column:
    """Longer words that begin or end with a term: term of six or more, word of nine and three longer. At most two."""
    return _first_two([t for t in terms if _loose(t, 6)], words, lambda t, w: (w.startswith(t) | w.endswith(t)) & (F.char_length(w) >= len(t) + 3) & eligible(w, 9))


def _starting(words: Column, prefix: str) -> Column:
    return F.filter(words, lambda w: w.startswith(prefix))


def vocabulary(bag: Column) -> Column:
    """Sorted different words. The tolerant rules read it often, so it belongs in a projection of its own."""
    return F.array_sort(F.array_distinct(bag))


def letters_only(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))


def word_form_terms(terms: list[str], letters: Column) -> Column:
    """Other forms of a term among the sorted alphabetic words of a text, first hit only.

    A term of five letters or more meets the term with an ending, or without one if five letters stay. Else it
    is split into two parts of five or more, at least one a whole word of the text, each standing for the first
    word that begins with it; two different words make the hit.
    """
    none = F.array().cast("array<string>")
    hits = []
    for t in sorted({t for t in terms if t.isalpha() and len(t) >= 5}):
        for end in WORD_ENDINGS:
            hits.append((F.array_contains(letters, t + end), F.array(F.lit(t + end))))
            stem = t[: -len(end)]
            if t.endswith(end) and len(stem) >= 5:
                hits.append((F.array_contains(letters, stem), F.array(F.lit(stem))))
        for k in range(5, len(t) - 4):
            a, b = t[:k], t[k:]
            first, second = (F.get(_starting(letters, p), F.lit(0)) for p in (a, b))
            whole = F.array_contains(letters, a) | F.array_contains(letters, b)
            hits.append((whole & first.isNotNull() & second.isNotNull() & (first != second), F.array(first, second)))
    out = none
    for test, value in reversed(hits):
        out = F.when(test, value).otherwise(out)
    return out


def name_key(c: Column) -> Column:
    return fold(F.trim(c))


def title_of(c: Column) -> Column:
    """First line with anything on it, without heading marks, up to the first sentence's end, 80 characters at most."""
    line = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"^\s*(\S[^\n]*)", 1), r"\s+$", ""), r"^#+\s*", "")
    title = F.rtrim(F.left(F.regexp_replace(line, r"^(.*?[.!?])\s.*$", "$1"), F.lit(80)))
    return F.when(c.rlike(r"\S"), title).when(c.isNotNull(), F.lit("Untitled"))


@cache
def _unaccented() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, the ASCII character each decomposes to, characters that decompose to several), by rule."""
    singles, several = {}, []
    for code in range(0xA0, 0x10000):
        made = "" if 0xD800 <= code < 0xE000 else unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(made) == 1:
            singles[chr(code)] = made
        elif made and (code < 0x2190 or 0xFB00 <= code < 0xFB07):
            several.append((chr(code), made))
    return "".join(singles), "".join(singles.values()), tuple(several)


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, 64 characters at most; `entry` where none is left.

    Letters with marks give their base letter (NFKD), other letters beyond ASCII go.
    """
    singles, bases, several = _unaccented()
    other = F.translate(c, singles, bases)
    for char, many in several:
        other = F.replace(other, F.lit(char), F.lit(many))
    plain = F.lower(F.regexp_replace(F.when(c.rlike(r"[^\x00-\x7f]"), other).otherwise(c), r"[^\x00-\x7f]", ""))
    made = F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(64))
    return F.when(made == "", F.lit("entry")).otherwise(made)


TRACKING = r"^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$"  # fixed values: query names that do not identify a page


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, default port and fragment off, tracking names off, query pairs sorted, path at least /.

    Null where the address is not http or https with a host, or carries credentials.
    """
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^[^=]*", 0)).rlike(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (host != "") & ~host.contains("@"), made)


LONGEST_URL = 4096


def fetchable_url(c: Column) -> Column:
    """An address as a fetcher may open it, or null: http or https with a host of ASCII letters, standard port, no credentials.

    Scheme and host in lower case, the fragment off, path at least /, query as it is; an explicit standard port
    stays. Hosts beyond ASCII are null: their encoding (IDNA) is for the fetcher.
    """
    t = F.trim(c)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(t, r"^[A-Za-z]+://([^/?#]*)", 1)
    host, port = F.lower(F.regexp_extract(authority, r"^(\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._-]+)(:\d*)?$", 1)), F.regexp_extract(authority, r":(\d*)$", 1)
    own = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))
    rest = F.regexp_extract(t, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(t, r"^[^?#]*(\?[^#]+)", 1)
    good = scheme.isin("http", "https") & (host != "") & (port.isin("") | (port == own)) & (F.char_length(t) <= LONGEST_URL) & ~t.rlike(r"[\r\n]")
    return F.when(good, F.concat(scheme, F.lit("://"), host, F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(rest == "", F.lit("/")).otherwise(rest), query))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts but for a leading www."""
    return F.regexp_replace(F.lower(a), r"^www\.", "") == F.regexp_replace(F.lower(b), r"^www\.", "")


def clean_field(c: Column, limit: int) -> Column:
    """Controls to spaces, white space collapsed, cut to `limit`; null where nothing is left."""
    made = F.left(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), F.lit(limit))
    return F.when(made != "", made)


def normal_tags(tags: Column) -> Column:
    """Tags trimmed, one spelling (the first) for each folded key, sorted."""
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    firsts = F.filter(trimmed, lambda t, i: F.array_position(F.transform(trimmed, fold), fold(t)) == i + 1)
    return F.array_sort(firsts)


def tag_union(a: Column, b: Column) -> Column:
    """Tags of a, then those of b whose key is new; sorted."""
    return normal_tags(F.concat(a, b))


def tag_remove(a: Column, b: Column) -> Column:
    keys = F.transform(b, lambda t: fold(F.trim(t)))
    return F.array_sort(F.filter(a, lambda t: ~F.array_contains(keys, fold(F.trim(t)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length, null where their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def uuid5(name: Column, namespace: bytes = bytes.fromhex("6ba7b8119dad11d180b400c04fd430c8")) -> Column:
    """Version-5 UUID of a name (the URL namespace by default), from SHA-1."""
    h = F.sha1(F.concat(F.lit(namespace), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
