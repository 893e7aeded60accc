"""Whole entries as text and as results: the searchable projection, compact results, details and review summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.operators import sections
from vaultspark.operators.filters import review_reasons

#: Columns of a compact result that are copied as they are, in order.
COPIED = ("servings", "prep_minutes", "cook_minutes", "reading_status", "bookmark_kind", "read_at", "place_kind", "product_kind", "experience_kind", "interest_status", "last_experienced_at", "occurred_at", "occurred_precision", "rating")


def _words(c: Column) -> Column:
    return F.array_join(c, " ")


def searchable_text(entries: DataFrame, fields: dict[str, list[str]] | None = None, attributes: list[str] | None = None) -> Column:
    """What a search looks through, not folded: title, aliases, the type's searchable fields, attributes, tags, body.

    `fields` names the searchable columns of each type, `attributes` those of the struct `attributes` that are
    searchable; absent columns are left out, and null ones are empty. Fence markers around fetched text are no text.
    """
    has = set(entries.columns)
    parts = [F.coalesce(F.col("title"), F.lit(""))] if "title" in has else []
    if "aliases" in has:
        parts.append(_words(F.coalesce("aliases", F.array().cast("array<string>"))))
    for kind, names in sorted((fields or {}).items()):
        for name in sorted(n for n in names if n in has):
            value = _words(F.col(name)) if entries.schema[name].dataType.typeName() == "array" else F.col(name).cast("string")
            parts.append(F.when(F.col("type") == kind, F.coalesce(value, F.lit(""))))
    if attributes and "attributes" in has:
        chosen = [F.col(f"attributes.{a}").alias(a) for a in sorted(attributes)]
        parts.append(F.to_json(F.struct(*chosen)))
    if "tags" in has:
        parts.append(_words(F.coalesce("tags", F.array().cast("array<string>"))))
    if "body" in has:
        parts.append(F.coalesce(sections.searchable("body"), F.lit("")))
    return F.concat_ws("\n", *parts)


def haystack(entries: DataFrame, fields: dict[str, list[str]] | None = None, attributes: list[str] | None = None, key: str = "id") -> DataFrame:
    """(id, text): the searchable text of every entry, for every operator that searches a text column."""
    return entries.select(F.col(key).alias("id"), searchable_text(entries, fields, attributes).alias("text"))


def compact(entries: DataFrame, *more: str) -> DataFrame:
    """(id, result): a compact result as JSON, without the keys that have no value; `more` adds columns of the search."""
    has = set(entries.columns)
    col = lambda n: F.col(n) if n in has else F.lit(None).cast("string")
    either = lambda a, b: F.coalesce(F.when(col(a) != "", col(a)), col(b))
    count = lambda n: F.greatest(F.lit(0), F.coalesce(F.size(n), F.lit(0))) if n in has else F.lit(0)
    values = [col(n).alias(n) for n in ("id", "type", "title", "aliases", "status", "updated_at", "sensitivity")]
    values += [either("canonical_url", "source_url").alias("url"), either("domain", "source_domain").alias("domain"), either("site_name", "source_site_name").alias("site_name")]
    values += [col(n).alias(n) for n in COPIED]
    values += [count("relations").alias("relation_count"), count("attachments").alias("attachment_count"), *[F.col(n) for n in more]]
    return entries.select("id", F.to_json(F.struct(*values), {"ignoreNullFields": "true"}).alias("result"))


def detail(entries: DataFrame) -> DataFrame:
    """(id, entry): everything of an entry as JSON, nulls and all, with its web fields named."""
    more = [F.array_sort(F.map_keys(F.map_filter("provenance", lambda k, v: v == "web"))).alias("from_web")] if "provenance" in entries.columns else []
    return entries.select("id", F.to_json(F.struct(*[F.col(c) for c in entries.columns], *more), {"ignoreNullFields": "false"}).alias("entry"))


def review_summary(entries: DataFrame, excerpt: int = 240) -> DataFrame:
    """(id, type, title, created_at, reasons, excerpt) of entries that need a look, oldest first."""
    rows = entries.withColumn("reasons", review_reasons()).filter(F.size("reasons") > 0)
    start = F.left(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " ")), F.lit(excerpt))
    return rows.select("id", "type", "title", "created_at", "reasons", start.alias("excerpt")).orderBy(F.col("created_at").asc_nulls_first(), "id")


def page_of(found: DataFrame, entries: DataFrame, by: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of (id, ...) with the entries' columns joined behind it: wide rows are read for the page only."""
    from vaultspark.operators.paging import page

    chosen = page(found, by, limit, offset)
    return F.broadcast(chosen).join(entries, "id")  # 50 rows at most


def alias_errors(aliases: Column, title: Column) -> Column:
    """Array of what is wrong with alternative names: empty, too long, equal to the title, repeated, too many."""
    trimmed = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a))
    keys = F.transform(trimmed, lambda a: T.name_key(a))
    return F.array_compact(
        F.array(
            F.when(F.array_contains(trimmed, ""), F.lit("an alias is empty")),
            F.when(F.exists(trimmed, lambda a: F.char_length(a) > LONGEST_ALIAS), F.lit("an alias is too long")),
            F.when(F.array_contains(keys, T.name_key(title)), F.lit("an alias equals the title")),
            F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.lit("aliases repeat")),
            F.when(F.size(trimmed) > MOST_ALIASES, F.lit("too many aliases")),
        )
    )


LONGEST_ALIAS, MOST_ALIASES = 200, 64


def normal_aliases(aliases: Column, title: Column) -> Column:
    """Alternative names trimmed and sorted by folded key; null where alias_errors finds anything."""
    trimmed = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a))
    pairs = F.array_sort(F.transform(trimmed, lambda a: F.struct(T.name_key(a).alias("k"), a.alias("a"))))
    return F.when(F.size(alias_errors(aliases, title)) == 0, F.transform(pairs, lambda p: p["a"]))
