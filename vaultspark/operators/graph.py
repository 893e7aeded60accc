"""Relations in both directions, referential checks, duplicates, candidates, link resolution and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.session import dealt


def outgoing(edges: DataFrame, entries: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Edges with their target's columns, null where the target is missing."""
    return edges.join(entries.select(F.col(key).alias("target"), *columns), "target", "left")


def inverse_name(predicate: str = "predicate") -> Column:
    """A symmetric predicate's own name, the configured inverse, or inverse_of_<predicate>."""
    return F.when(F.coalesce(F.col("symmetric"), F.lit(False)), F.col(predicate)).otherwise(F.coalesce(F.col("inverse"), F.concat(F.lit("inverse_of_"), F.col(predicate))))


def incoming(edges: DataFrame, definitions: DataFrame, target=None) -> DataFrame:
    """(source, target, predicate, inverse): edges read from their target; definitions (predicate, symmetric, inverse)."""
    rows = edges if target is None else edges.filter(F.col("target") == target)
    return rows.join(definitions, "predicate", "left").select("source", "target", "predicate", inverse_name().alias("inverse"))


def missing_targets(edges: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    return edges.join(entries.select(F.col(key).alias("target")), "target", "left_anti")


def trashed_targets(edges: DataFrame, trash: DataFrame, key: str = "id") -> DataFrame:
    return edges.join(trash.select(F.col(key).alias("target")), "target", "left_semi")


def orphans(things: DataFrame, key: str, references: DataFrame, reference: str) -> DataFrame:
    """Things that nothing refers to."""
    return things.join(references.select(F.col(reference).alias(key)), key, "left_anti")


def duplicates(entries: DataFrame, keys: list[Column], names: list[str], key: str = "id") -> DataFrame:
    """(names, n, first) of key values that several entries share; null keys are no value."""
    rows = dealt(entries, key).select(F.col(key).alias("_id"), *[k.alias(n) for k, n in zip(keys, names)])
    there = F.lit(True)
    for n in names:
        there &= F.col(n).isNotNull()
    return rows.groupBy(*names).agg(F.count_if(there).alias("n"), F.min("_id").alias("first")).filter("n > 1")


def candidate_pairs(entries: DataFrame, key: str, name: str, least_shared: int = 2) -> DataFrame:
    """(a, b, same_name, shared) of entries with equal folded names or at least `least_shared` title words in common.

    Pairs meet on combinations of two of an entry's own words, so a word that everyone uses makes no pairs of
    its own; entries with equal names are paired to the first of them, not to each other.
    """
    rows = entries.select(F.col(key).alias("id"), T.name_key(F.col(name)).alias("name"), F.array_sort(F.array_distinct(T.tokens(F.col(name)))).alias("words"))
    first = rows.withColumn("first", F.min("id").over(Window.partitionBy("name")))
    same = first.filter(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(True).alias("same_name"), F.size("words").cast("long").alias("shared"))
    kinds = rows.groupBy("name").agg(F.min("id").alias("id"), F.first("words").alias("words"))
    combos = kinds.select("id", "words", F.explode("words").alias("x")).select("id", "words", "x", F.explode("words").alias("y")).filter("x < y")
    left, right = combos.select(F.col("id").alias("a"), F.col("words").alias("wa"), "x", "y"), combos.select(F.col("id").alias("b"), F.col("words").alias("wb"), "x", "y")
    met = left.join(right, ["x", "y"]).filter("a < b").select("a", "b", F.lit(False).alias("same_name"), F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared")).distinct()
    return same.unionByName(met.filter(F.col("shared") >= least_shared))


def candidates_of(entries: DataFrame, one: dict, key: str = "id", name: str = "title") -> DataFrame:
    """(id, reasons) of entries that may be the same as `one`: shared names, equal URLs, two shared title words. Strong reasons first."""
    words = F.array(*map(F.lit, one.get("words", []))) if one.get("words") else F.array().cast("array<string>")
    names = F.array(*map(F.lit, one.get("names", []))) if one.get("names") else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col(name))), words)) >= 2
    url = F.lit(False)
    for column in ("canonical_url", "source_url"):
        if column in entries.columns and one.get(column):
            url |= F.col(column) == one[column]
    reasons = F.array_compact(F.array(F.when(F.array_contains(names, T.name_key(F.col(name))), F.lit("shared_name")), F.when(url, F.lit("same_url")), F.when(shared, F.lit("shared_title_terms"))))
    rows = entries.filter(F.col(key) != one["id"]).select(F.col(key).alias("id"), reasons.alias("reasons")).filter(F.size("reasons") > 0)
    return rows.orderBy(F.col("reasons") == F.array(F.lit("shared_title_terms")), "id")


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links (source, link) with `resolved`: exact path, path without suffix, else a name that one note alone claims.

    notes: (id, path, names array). Names are folded; a name that two notes claim resolves to neither.
    """
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    by_path = notes.groupBy(F.col("path").alias("link")).agg(F.max("id").alias("by_path"))
    by_stem = notes.groupBy(stem(F.col("path")).alias("stem")).agg(F.max("id").alias("by_stem"))
    own_name = F.array(F.regexp_extract(stem(F.col("path")), "[^/]*$", 0))
    claims = notes.select("id", F.explode(F.concat(own_name, F.coalesce("names", F.array().cast("array<string>")))).alias("n")).select("id", T.name_key(F.col("n")).alias("name"))
    by_name = claims.groupBy("name").agg(F.count_distinct("id").alias("c"), F.min("id").alias("by_name")).filter("c = 1").drop("c")
    met = links.join(by_path, "link", "left").withColumn("stem", stem(F.col("link"))).join(by_stem, "stem", "left").withColumn("name", T.name_key(F.col("link"))).join(by_name, "name", "left")
    return met.select(*links.columns, F.coalesce("by_path", "by_stem", "by_name").alias("resolved"))


def resolve_assets(links: DataFrame, assets: DataFrame) -> DataFrame:
    """links (source, link) with `resolved`: the asset at the folded path, else the only one of that file name.

    assets: (path). Links that leave the folder, or that two assets could be, resolve to nothing.
    """
    from vaultspark.sources.notes import safe_target

    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    folded = assets.select("path", T.fold(F.col("path")).alias("key")).distinct()
    by_path = folded.groupBy("key").agg(F.min("path").alias("by_path"))
    by_name = folded.groupBy(name("key").alias("name")).agg(F.count("*").alias("many"), F.min("path").alias("by_name")).filter("many = 1").drop("many")
    keyed = links.withColumn("key", T.fold(safe_target(F.col("link")))).withColumn("name", name("key"))
    return keyed.join(by_path, "key", "left").join(by_name, "name", "left").select(*links.columns, F.coalesce("by_path", "by_name").alias("resolved"))


def attachment_of(entries: DataFrame, entry: str, attachment: str) -> DataFrame:
    """(id, attachment) of one entry's attachment by its id: one row, or none."""
    return entries.filter(F.col("id") == entry).select("id", F.explode("attachments").alias("attachment")).filter(F.col("attachment.id") == attachment)


def redirect(entries: DataFrame, old: str, new: str, column: str = "relations") -> DataFrame:
    """Relations to `old` point to `new`, repeats and links of `new` to itself gone."""
    moved = F.transform(column, lambda r: r.withField("target", F.when(r["target"] == old, F.lit(new)).otherwise(r["target"])))
    return entries.withColumn(column, F.array_distinct(F.filter(moved, lambda r: ~((r["target"] == new) & (F.col("id") == new)))))


def merge(entries: DataFrame, keep: str, drop: str, lists: tuple[str, ...] = ("aliases", "tags"), column: str = "relations") -> DataFrame:
    """The collection after `drop` went into `keep`: ordered distinct unions of lists, edges redirected, `drop` gone.

    Where either is absent, or both are the same, the collection stays as it is.
    """
    gone = entries.filter(F.col("id") == drop).select(*[F.col(c).alias(f"_{c}") for c in lists])
    if keep == drop or gone.isEmpty() or entries.filter(F.col("id") == keep).isEmpty():
        return entries
    rows = entries.filter(~F.col("id").eqNullSafe(drop)).crossJoin(F.broadcast(gone.limit(1)))  # one row
    for c in lists:
        both = F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_{c}", F.array().cast("array<string>"))))
        rows = rows.withColumn(c, F.when(F.col("id") == keep, both).otherwise(F.col(c)))
    return redirect(rows.drop(*[f"_{c}" for c in lists]), drop, keep, column)
