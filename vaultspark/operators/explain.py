"""Why an entry was found: excerpts of the fields that match, and results with what matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.functions.instants import holds_at, instant
from vaultspark.operators import entries as E
from vaultspark.operators import ranking, sections
from vaultspark.operators.paging import unfolded
from vaultspark.session import where

MOST, WIDTH, LEAD = 5, 240, 60  # excerpts, their characters, and how many stand before the match


def _listed(values: Column) -> Column:
    """An array of texts as it is shown in evidence: quoted, in brackets."""
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def _shown(entries: DataFrame, name: str) -> Column:
    """A searchable field as JSON, with a space behind commas; null where it has no value."""

    def quoted(x: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    kind = entries.schema[name].dataType
    if kind.typeName() == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(name, lambda x: quoted(x.cast("string"))), ", "), F.lit("]"))
    return quoted(F.col(name)) if kind.typeName() == "string" else F.col(name).cast("string")


def _places(text: Column, query: str, terms: Column) -> tuple[Column, Column]:
    """Where the folded query and the first whole token of `terms` begin in the folded text; 0 where they don't."""
    hay = T.fold(text)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.position(T.fold(F.lit(query)), hay), F.when(F.size(terms) > 0, F.regexp_instr(hay, pattern)).otherwise(0)


def matches(text: Column, query: str, terms: Column) -> Column:
    literal, token = _places(text, query, terms)
    return F.coalesce((literal > 0) | (token > 0), F.lit(False))


def match_start(text: Column, query: str, terms: Column) -> Column:
    """Character of a matching text at which the query begins, or else the first of the terms."""
    literal, token = _places(text, query, terms)
    return unfolded(text, F.when(literal > 0, literal).otherwise(token))


def evidence(entries: DataFrame, query: str, searchable: dict[str, list[str]] | None = None, ranked: bool = True, matched: str | None = None, key: str = "id") -> DataFrame:
    """(id, n, field, line, excerpt, origin, truncated): at most five excerpts of each entry, in the order of its fields.

    Fields are title, aliases, tags, the type's `searchable` ones by name, then the body line by line. With `ranked`
    the query's words count as well as the query itself, and so do the words of the array column `matched`, which a
    tolerant match was made by. The origin is that of the map `provenance`, or unknown, and for the body that of its
    section; it is never inferred. The empty query has no evidence. Absent columns are left out, null ones hold nothing.
    Only bodies that match somewhere are taken apart, and only lines that match are numbered.
    """
    if not query:
        return entries.sparkSession.createDataFrame([], f"id {entries.schema[key].dataType.simpleString()}, n int, field string, line int, excerpt string, origin string, truncated boolean")
    has, none = set(entries.columns), F.array().cast("array<string>")
    own = sorted(set(T.tokens_of(query))) if ranked else []
    words = F.array(*map(F.lit, own)) if own else none
    if matched is not None:
        words = F.array_union(words, F.coalesce(matched, none))

    def field(name: str, text: Column, label: str | None = None) -> Column:
        origin = F.coalesce(F.try_element_at("provenance", F.lit(name)), F.lit("unknown")) if "provenance" in has else F.lit("unknown")
        return F.struct(F.lit(label or name).alias("field"), text.alias("text"), origin.alias("origin"))

    parts = [field("title", F.col("title"))] if "title" in has else []
    parts += [field(n, _listed(F.col(n))) for n in ("aliases", "tags") if n in has]
    for name in sorted({n for names in (searchable or {}).values() for n in names} & has):
        of = [t for t, names in searchable.items() if name in names]
        parts.append(field(name, F.when(F.col("type").isin(*of), _shown(entries, name)), f"attributes.{name}"))
    found = []
    if parts:
        rows = entries.select(F.col(key).alias("id"), words.alias("words"), F.posexplode(F.array(*parts)).alias("place", "f"))
        found.append(rows.select("id", "words", "place", "f.field", F.lit(None).cast("int").alias("line"), "f.text", "f.origin"))
    if "body" in has:
        some = where(entries.select(F.col(key).alias("id"), "body", words.alias("words")), matches(F.col("body"), query, F.col("words")))
        body = sections.lines(some).filter("fence is null").join(some.select("id", "words"), "id")
        found.append(body.select("id", "words", F.lit(1 << 20).alias("place"), F.lit("body").alias("field"), F.col("no").alias("line"), F.col("line").alias("text"), "origin"))
    fields = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    hits = where(fields, matches(F.col("text"), query, F.col("words")))
    placed = hits.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place", "line"))).filter(F.col("n") <= MOST)
    start = F.greatest(F.lit(1), match_start(F.col("text"), query, F.col("words")) - LEAD)
    shown = placed.select("id", "n", "field", "line", "text", "origin", start.alias("start"))
    cut = (F.col("start") > 1) | (F.col("start") - 1 + WIDTH < F.char_length("text"))
    return shown.select("id", "n", "field", "line", F.substr(F.col("text"), F.col("start"), F.lit(WIDTH)).alias("excerpt"), "origin", cut.alias("truncated"))


def results(found: DataFrame, entries: DataFrame, as_of: str | None = None) -> DataFrame:
    """(id, result) of found entries (id, score, and where a search has them terms and evidence), as compact JSON.

    match_kind is there for tolerant matches only, with the words they were made by; query_matches for fused wordings;
    relation_count counts the relations in force at `as_of`, and not_in_force_relation_count the others, if any.
    """
    has, none = set(found.columns), F.lit(None).cast("string")
    rows = entries.join(found.select("id", *[F.col(c).alias(f"_{c}") for c in ("score", "terms", "evidence") if c in has]), "id")
    late = none
    if as_of is not None and "relations" in entries.columns:
        at = instant(F.lit(as_of))

        def holds(r: Column) -> Column:
            return F.coalesce(holds_at(instant(r["valid_from"]), instant(r["valid_until"]), at), F.lit(False))

        rows = rows.withColumn("_late", F.size(F.filter("relations", lambda r: ~holds(r)))).withColumn("relations", F.filter("relations", holds))
        late = F.when(F.col("_late") > 0, F.col("_late"))
    tolerant = F.col("_score") < 0 if "score" in has else F.lit(False)
    rows = rows.withColumns({
        "match_kind": F.when(tolerant, ranking.match_kind(F.col("_score"))) if "score" in has else none,
        "matched_terms": F.when(tolerant, F.col("_terms")) if "terms" in has else none,
        "query_matches": F.col("_evidence") if "evidence" in has else none,
        "not_in_force_relation_count": late,
    })
    return E.compact(rows, "match_kind", "matched_terms", "query_matches", "not_in_force_relation_count")
