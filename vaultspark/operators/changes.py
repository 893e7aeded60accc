"""Changes to a collection as pure functions from one snapshot to the next, and the migration ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import text as T

KEEP_DAYS = 90  # days that a trashed entry is kept


class Conflict(ValueError):
    pass


def one(entries: DataFrame, key: str, column: str = "id"):
    """The entry with this id; an error if there is none, or more than one."""
    found = entries.filter(F.col(column) == key).limit(2).collect()
    if len(found) != 1:
        raise (KeyError if not found else Conflict)(key)
    return found[0]


def expect_revision(entries: DataFrame, key: str, revision: str) -> None:
    if one(entries, key)["revision"] != revision:
        raise Conflict(f"{key} has changed since it was read")


def insert(entries: DataFrame, new: DataFrame, unique: list[Column], exempt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, refused rows): new rows whose key is taken are refused; null keys and exempt rows never are.

    A key is taken by an entry, or by a new row before it: of new rows with one key the first by `id` (else by all
    columns) is inserted, and the others are refused.
    """
    names = [f"_k{i}" for i in range(len(unique))]
    keyed = new.withColumns({n: F.when(~exempt, u) if exempt is not None else u for n, u in zip(names, unique)})
    taken = entries.select(*[u.alias(n) for n, u in zip(names, unique)]).distinct().withColumn("_taken", F.lit(True))
    whole = F.lit(True)
    for n in names:
        whole &= F.col(n).isNotNull()
    by = [F.col("id")] if "id" in new.columns else [F.to_json(F.struct(*new.columns))]
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*by))
    # Rows without a whole key compete for nothing and stay out of the window, whose null group could be large.
    rivals = keyed.filter(whole).withColumn("_place", place).join(taken, names, "left")
    again = F.coalesce(F.col("_taken"), F.lit(False)) | (F.col("_place") > 1)
    fresh = rivals.filter(~again).select(*new.columns).unionByName(keyed.filter(~whole).select(*new.columns))
    return entries.unionByName(fresh, allowMissingColumns=True), rivals.filter(again).select(*new.columns)


def update(entries: DataFrame, key: str, values: dict[str, Column], now: str) -> DataFrame:
    """Sets columns of one entry and stamps updated_at."""
    mine = F.col("id") == key
    return entries.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in {**values, "updated_at": F.lit(now)}.items()})


def append_body(entries: DataFrame, key: str, text: str, now: str) -> DataFrame:
    return update(entries, key, {"body": F.concat(F.rtrim(F.coalesce("body", F.lit(""))), F.lit("\n\n" + text))}, now)


def fill_only(entries: DataFrame, fetched: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Fetched values where the entry has none (null or blank); never over a value."""
    joined = entries.join(fetched.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    return joined.withColumns({c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def attach(entries: DataFrame, key: str, attachment: Column, digest: str, now: str) -> DataFrame:
    """Appends an attachment unless one with this digest is there."""
    there = F.exists("attachments", lambda a: a["sha256"] == digest)
    return update(entries, key, {"attachments": F.when(F.coalesce(there, F.lit(False)), F.col("attachments")).otherwise(F.array_append(F.coalesce("attachments", F.array()), attachment))}, now)


def relate(entries: DataFrame, key: str, relation: Column, predicate: str, target: str, now: str) -> DataFrame:
    """Adds a relation; one with the same predicate and target is replaced."""
    rest = F.filter("relations", lambda r: ~((r["predicate"] == predicate) & (r["target"] == target)))
    return update(entries, key, {"relations": F.array_append(F.coalesce(rest, F.array()), relation)}, now)


def unrelate(entries: DataFrame, key: str, predicate: str, target: str, now: str) -> DataFrame:
    return update(entries, key, {"relations": F.filter("relations", lambda r: ~((r["predicate"] == predicate) & (r["target"] == target)))}, now)


def supersede(entries: DataFrame, key: str, predicate: str, old: str, new: str, at: str) -> DataFrame:
    """Closes the relation to `old` at an instant and names its successor."""
    close = lambda r: F.when((r["predicate"] == predicate) & (r["target"] == old), r.withField("valid_until", F.coalesce(r["valid_until"], F.lit(at))).withField("superseded_by", F.lit(new))).otherwise(r)
    return update(entries, key, {"relations": F.transform("relations", close)}, at)


def tag(entries: DataFrame, key: str, add: list[str], remove: list[str], now: str) -> DataFrame:
    made = T.tag_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>"))
    return update(entries, key, {"tags": T.tag_remove(made, F.array(*map(F.lit, remove)).cast("array<string>"))}, now)


def reading_status(entries: DataFrame, key: str, status: str, now: str) -> DataFrame:
    """Sets the reading status; `read` stamps read_at, anything else clears it."""
    return update(entries, key, {"reading_status": F.lit(status), "read_at": F.lit(now if status == "read" else None).cast("string")}, now)


def complete_review(entries: DataFrame, key: str, now: str) -> DataFrame:
    return update(entries, key, {"status": F.when(F.col("status") == "unreviewed", F.lit("active")).otherwise(F.col("status")), "reviewed_at": F.lit(now)}, now)


def retype(entries: DataFrame, key: str, kind: str, keep: list[str], defaults: dict[str, str], now: str) -> DataFrame:
    """Another type: attributes (a map) the new type has stay, others go, its defaults fill in."""
    kept = F.map_filter("attributes", lambda k, v: k.isin(*keep)) if keep else F.map_filter("attributes", lambda k, v: F.lit(False))
    missing = F.map_filter(F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))]), lambda k, v: ~F.map_contains_key("attributes", k)) if defaults else None
    return update(entries, key, {"type": F.lit(kind), "attributes": F.map_concat(kept, missing) if missing is not None else kept}, now)


def trash(entries: DataFrame, key: str, reason: str, now: str) -> DataFrame:
    purge = F.date_format(F.to_timestamp(F.lit(now)) + F.expr(f"INTERVAL {KEEP_DAYS} DAYS"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return update(entries, key, {"previous_status": F.col("status"), "status": F.lit("trashed"), "deleted_at": F.lit(now), "deletion_reason": F.lit(reason), "purge_after": purge}, now)


def restore(entries: DataFrame, key: str, now: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return update(entries, key, {"status": F.coalesce("previous_status", F.lit("active")), "previous_status": none, "deleted_at": none, "deletion_reason": none, "purge_after": none}, now)


def purge(entries: DataFrame, due: Column, dry_run: bool = True) -> DataFrame:
    """The rows that would go, or the snapshot without them."""
    gone = (F.col("status") == "trashed") & due
    return entries.filter(gone) if dry_run else entries.filter(~F.coalesce(gone, F.lit(False)))


def migrate(entries: DataFrame, steps: dict[int, Callable[[DataFrame], DataFrame]], newest: int, column: str = "schema_version") -> DataFrame:
    """Every row walks the ladder from its own version to `newest`; a missing step only counts up. Newer rows are refused."""
    ahead = F.col(column) > newest
    out = entries.withColumn(column, F.when(ahead, F.raise_error(F.concat(F.lit("schema version "), F.col(column).cast("string"), F.lit(" is newer than this engine")))).otherwise(F.col(column)))
    for version in range(newest):
        if version in steps:
            moved = steps[version](out.filter(F.col(column) == version))
            out = out.filter((F.col(column) != version) | F.col(column).isNull()).unionByName(moved.withColumn(column, F.lit(version + 1).cast(entries.schema[column].dataType)), allowMissingColumns=True)
        else:
            out = out.withColumn(column, F.when(F.col(column) == version, F.lit(version + 1)).otherwise(F.col(column)).cast(entries.schema[column].dataType))
    return out


def import_state(sources: DataFrame, existing: DataFrame, taken: DataFrame | None = None, new_id: str = "id") -> DataFrame:
    """sources (original_id, digest) with `state`: new, imported, changed, duplicate_source, id_collision or no_source.

    existing: (original_id, digest) of the entries that were imported before; one without a digest counts as imported.
    duplicate_source: several rows of sources or several entries have the id. id_collision, where `taken` (id) is
    given: the source is new, but the id that its entry would get, in the column `new_id`, is taken. no_source: the
    original_id is null; such rows are told before anything is grouped. Other columns stay.
    """
    named = sources.filter(F.col("original_id").isNotNull())
    times = named.groupBy(F.col("original_id").alias("_id")).agg(F.count("*").alias("_n"))
    old = existing.filter(F.col("original_id").isNotNull()).groupBy(F.col("original_id").alias("_id")).agg(F.count("*").alias("_m"), F.min("digest").alias("_digest"))
    told = named.join(times.join(old, "_id", "left"), F.col("original_id") == F.col("_id"))
    collides = F.lit(False)
    if taken is not None:
        told = told.join(taken.select(F.col("id").alias("_taken")).distinct(), F.col(new_id) == F.col("_taken"), "left")
        collides = F.col("_taken").isNotNull()
    state = (
        F.when((F.col("_n") > 1) | (F.col("_m") > 1), F.lit("duplicate_source")).when(F.col("_m").isNull(), F.when(collides, F.lit("id_collision")).otherwise("new"))
        .when(F.col("_digest").isNull() | (F.col("_digest") == F.col("digest")), F.lit("imported")).otherwise("changed")
    )
    told = told.withColumn("state", state).drop("_id", "_n", "_m", "_digest", "_taken")
    return told.unionByName(sources.filter(F.col("original_id").isNull()).withColumn("state", F.lit("no_source")))


def provenance(explicit: Column, fetched: list[str]) -> Column:
    """Origin by field: fetched ones are `web` unless said otherwise."""
    web = F.map_filter(F.create_map(*[x for f in fetched for x in (F.lit(f), F.lit("web"))]), lambda k, v: ~F.map_contains_key(explicit, k))
    return F.map_concat(explicit, web)


def fields_from(origin: str, column: str = "provenance") -> Column:
    return F.array_sort(F.map_keys(F.map_filter(column, lambda k, v: v == origin)))


