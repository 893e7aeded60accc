"""Row and collection rules: one array of errors for each row, and joins for what only the collection shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions.instants import instant, interval_errors
from vaultspark.operators.entries import LONGEST_ALIAS, MOST_ALIASES

#: Fixed values of the envelope.
STATUSES = ("active", "unreviewed", "archived", "trashed")
SENSITIVITIES = ("normal", "personal", "sensitive")
ID = r"^kn_[0-9a-f]{32}$"


@dataclass(frozen=True)
class Field:
    """A declared field: its kind and constraints, turned into an error expression."""

    name: str
    kind: str = "string"
    required: bool = False
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] = ()
    max_items: int = 1000

    def error(self, c: Column) -> Column:
        bad = F.lit(False)
        if self.kind in ("string", "text"):
            n = F.char_length(c)
            bad |= (n < self.least if self.least is not None else F.lit(False)) | (n > self.most if self.most is not None else F.lit(False))
        elif self.kind in ("integer", "number"):
            v = c.cast("double")
            bad |= F.isnan(v) | (F.abs(v) == float("inf")) | (v < self.least if self.least is not None else F.lit(False)) | (v > self.most if self.most is not None else F.lit(False))
        elif self.kind == "date":
            bad |= F.to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c))).isNull()
        elif self.kind == "datetime":
            bad |= instant(c).isNull()
        elif self.kind == "url":
            bad |= ~c.rlike(r"^https?://[^/?#@\s]+([/?#]\S*)?$")
        elif self.kind == "enum":
            bad |= ~c.isin(*self.values)
        elif self.kind == "array":
            bad |= (F.size(c) > self.max_items) | (F.size(F.array_distinct(c)) != F.size(c))
        missing = F.when(c.isNull(), F.lit(f"{self.name} is required")) if self.required else F.lit(None).cast("string")
        return F.coalesce(missing, F.when(c.isNotNull() & bad, F.lit(f"{self.name} is not valid")))


def row_errors(entries: DataFrame, fields: list[Field] = ()) -> DataFrame:
    """entries with `errors`; rules for columns that are not there are left out."""
    has, tests = set(entries.columns), []
    say = lambda test, text: tests.append(F.when(test, F.lit(text)))
    if "id" in has:
        say(~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "id is not valid")
    for column, values in (("status", STATUSES), ("sensitivity", SENSITIVITIES)):
        if column in has:
            say(~F.coalesce(F.col(column).isin(*values), F.lit(False)), f"{column} is not valid")
    for column in ("created_at", "updated_at"):
        if column in has:
            say(instant(F.col(column)).isNull(), f"{column} is not an instant")
    if "aliases" in has:
        say((F.size("aliases") > MOST_ALIASES) | F.exists("aliases", lambda a: F.char_length(a) > LONGEST_ALIAS), "aliases are not valid")
    if {"status", "deleted_at"} <= has:
        say((F.col("status") == "trashed") & F.col("deleted_at").isNull(), "trashed without deleted_at")
    if "relations" in has:
        say(F.exists("relations", lambda r: F.size(interval_errors(r["valid_from"], r["valid_until"])) > 0), "a relation's interval is not valid")
        key = lambda r: F.struct(r["predicate"], r["target"])
        say(F.size(F.array_distinct(F.transform("relations", key))) != F.size("relations"), "a relation is repeated")
    if "attachments" in has:
        say(F.size(F.array_distinct(F.transform("attachments", lambda a: a["sha256"]))) != F.size("attachments"), "an attachment is repeated")
    tests += [f.error(F.col(f.name)) for f in fields if f.name in has]
    return entries.withColumn("errors", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def unknown_fields(entries: DataFrame, known: list[str]) -> list[str]:
    return sorted(set(entries.columns) - set(known))


def with_defaults(entries: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return entries.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def report(entries: DataFrame, edges: DataFrame, trash: DataFrame, fields: list[Field] = ()) -> DataFrame:
    """(id, level, problem) of everything that is wrong: row rules, repeated ids, missing and trashed targets."""
    rows = row_errors(entries, fields).select("id", F.lit("error").alias("level"), F.explode("errors").alias("problem"))
    twice = entries.groupBy("id").count().filter("count > 1").select("id", F.lit("error").alias("level"), F.lit("id is repeated").alias("problem"))
    known = entries.select(F.col("id").alias("target")).unionByName(trash.select(F.col("id").alias("target")))
    missing = edges.join(known, "target", "left_anti").select(F.col("source").alias("id"), F.lit("error").alias("level"), F.concat(F.lit("missing target "), F.col("target")).alias("problem"))
    trashed = edges.join(trash.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"), F.lit("warning").alias("level"), F.concat(F.lit("trashed target "), F.col("target")).alias("problem"))
    return rows.unionByName(twice).unionByName(missing).unionByName(trashed)
