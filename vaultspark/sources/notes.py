"""Constructs of foreign note formats: wikilinks, inline tags, headings, observations and typed relations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})(.*)$")


def without_code(text: str) -> str:
    """Text with code fences and spans blanked; the number of lines stays."""
    out, fence = [], None
    for line in text.split("\n"):
        met = _FENCE.match(line)
        if fence is None and met and not (met[1][0] == "`" and "`" in met[2]):
            fence = met[1]
            out.append("")
        elif fence is not None:
            if met and met[1][0] == fence[0] and len(met[1]) >= len(fence) and not met[2].strip():
                fence = None
            out.append("")
        else:
            out.append(re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", lambda m: " " * len(m[0]), line))
    return "\n".join(out)


@F.pandas_udf(StringType())
def strip_code(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else without_code(t))


def wikilinks(body: Column) -> Column:
    """Array of (embed, target, section, display) of [[links]] outside code."""
    found = F.regexp_extract_all(strip_code(body), F.lit(r"(!?\[\[[^\[\]\n]+\]\])"), F.lit(1))
    inner = lambda x: F.regexp_extract(x, r"^!?\[\[([^\]]*)\]\]$", 1)
    part = lambda x, p: F.trim(F.regexp_extract(inner(x), p, 1))
    return F.transform(found, lambda x: F.struct(x.startswith("!").alias("embed"), part(x, r"^([^#|]*)").alias("target"), part(x, r"^[^#|]*#([^|]*)").alias("section"), part(x, r"\|(.*)$").alias("display")))


def inline_tags(body: Column) -> Column:
    """#tags outside code, at least one of their characters no digit, in order. A tag begins where no word, slash, hash or hyphen ends."""
    found = F.regexp_extract_all(strip_code(body), F.lit(r"(?<![\p{L}\p{N}_/#-])#([\p{L}\p{N}_/-]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.rlike(r"^[\d/_-]+$")))


def first_heading(text: Column) -> Column:
    made = F.regexp_extract(strip_code(text), r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    return F.when(made != "", made)


def note_title(prop: Column, text: Column, stem: Column) -> Column:
    """The title property, else the first heading, else the file's stem."""
    own = F.trim(prop)
    return F.coalesce(F.when(own != "", own), first_heading(text), F.trim(F.regexp_replace(stem, "_", " ")))


def lossy(body: Column) -> Column:
    """Counts of constructs that do not survive an import."""
    return F.struct(F.regexp_count(body, F.lit(r"(?m)^```dataview(js)?\b")).alias("dataview"), F.regexp_count(body, F.lit(r"<%[\s\S]*?%>")).alias("templater"), F.regexp_count(body, F.lit(r"\{\{(date|time|title)[^}]*\}\}")).alias("core_template"))


_OBSERVATION = re.compile(r"^[-*]\s+\[([^\[\]\s][^\[\]]*)\]\s+(.+?)\s*$")
_RELATION = re.compile(r"^[-*]\s+(?:(\S.*?)\s+)?\[\[([^\[\]]+)\]\]\s*$")


def _texts(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


_SEEN = StructType([*_texts("category", "content"), StructField("tags", ArrayType(StringType()))])


@F.pandas_udf(StructType([StructField("observations", ArrayType(_SEEN)), StructField("relations", ArrayType(StructType(_texts("predicate", "target"))))]))
def observed(texts: pd.Series) -> pd.DataFrame:
    """Lines `- [category] content #tag` below Observations, and `- predicate [[target]]` below Relations."""
    rows = []
    for t in texts:
        section, seen, edges = "", [], []
        for line in (t or "").split("\n"):
            if line.startswith("#"):
                section = line.lstrip("#").strip().casefold()
            elif section == "observations" and (m := _OBSERVATION.match(line)):
                seen.append({"category": m[1].strip(), "content": m[2], "tags": re.findall(r"(?<!\S)#([^\s#]+)", m[2])})
            elif section == "relations" and (m := _RELATION.match(line)):
                edges.append({"predicate": m[1] or "relates_to", "target": m[2].split("|")[0].strip()})
        rows.append((seen, edges))
    return pd.DataFrame(rows, columns=["observations", "relations"])


def property_list(value: Column) -> Column:
    """A comma-separated scalar as an array of its parts."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def safe_target(link: Column) -> Column:
    """A relative path without . and .. steps, or null where it leaves the folder or is absolute."""
    parts = F.filter(F.split(F.regexp_replace(link, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    bad = link.rlike(r"^([/\\]|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def image_kind(content: Column) -> Column:
    """Media type by leading bytes; null for anything else."""
    h = F.hex(F.substring(content, 1, 16))
    return (
        F.when(h.startswith("FFD8FF"), F.lit("image/jpeg")).when(h.startswith("89504E470D0A1A0A"), F.lit("image/png"))
        .when(h.startswith("474946383761") | h.startswith("474946383961"), F.lit("image/gif")).when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), F.lit("image/webp"))
    )
