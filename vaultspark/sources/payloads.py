"""Structured inputs: JSON payloads with a closed set of keys, relation definitions, and relation arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vaultspark.sources import markdown

PREDICATE = re.compile("[a-z][a-z0-9_]*")


def payloads(spark: SparkSession, path: str, schema: str | StructType, closed: bool = True) -> DataFrame:
    """A row for each file of a path, whose text is one JSON object: `path` and the fields of `schema`.

    Anything else than an object, and with `closed` any key beyond the schema's, is an error that names the file
    when the frame is read; absent keys are null. Files without a byte give no row.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("value"))
    keys = F.json_object_keys("value")
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in kind.names]).cast("array<string>")))
    whole = F.coalesce(keys.isNotNull() & F.trim("value").startswith("{"), F.lit(False))
    fault = F.when(~whole, F.concat(F.col("path"), F.lit(" holds no JSON object")))
    if closed:
        fault = F.coalesce(fault, F.when(F.size(unknown) > 0, F.concat(F.col("path"), F.lit(" has unknown fields: "), F.array_join(unknown, ", "))))
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("value"))
    return files.select("path", F.from_json(checked, kind).alias("p")).select("path", "p.*")


def relation_definitions(spark: SparkSession, text: str) -> DataFrame:
    """(predicate, symmetric, inverse) of a definition text: the maps below its key `relations`, as frontmatter is read.

    A handful of rows, made on the driver. Names that are no predicates (lower-case letters, digits and underscores,
    a letter first) and entries that are no maps are left out.
    """
    named = markdown.tolerant(text.splitlines()).get("relations")
    found = {n: p or {} for n, p in named.items() if PREDICATE.fullmatch(n) and isinstance(p, dict | None)} if isinstance(named, dict) else {}
    rows = [(n, p.get("symmetric") is True, p["inverse"] if isinstance(p.get("inverse"), str) else None) for n, p in found.items()]
    return spark.createDataFrame(rows, "predicate string, symmetric boolean, inverse string")


def relation_argument(value: Column) -> Column:
    """(predicate, target) of `predicate:target`, cut at the first colon; null where there is none."""
    return F.when(value.contains(":"), F.struct(F.substring_index(value, ":", 1).alias("predicate"), F.regexp_replace(value, "^[^:]*:", "").alias("target")))
