"""Vectors that a provider computed beside a collection: a sidecar of JSON lines with a header, and a query vector."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DIMENSIONS, MOST_BYTES = 8192, 512 * 1024 * 1024
ID, REVISION = "^kn_[0-9a-f]{32}$", "^sha256:[0-9a-f]{64}$"  # fixed values


class VectorError(ValueError):
    pass


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines with their order in the file, by the block they are read from and their place in it."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))


def _head(spark: SparkSession, path: str) -> tuple[dict, tuple[int, int]]:
    """The header, and where it stands."""
    lines = _lines(spark, path).orderBy("at").head(1)
    try:
        found = json.loads(lines[0]["value"]) if lines else None
    except ValueError as e:
        raise VectorError("the header is no JSON") from e
    if not isinstance(found, dict):
        raise VectorError("there is no header")
    return found, tuple(lines[0]["at"])


def query_vector(spark: SparkSession, path: str, form: str) -> tuple[str, list[float]]:
    """(model, vector) of a JSON document with format, model, dimensions and vector."""
    text = spark.read.text(path, wholetext=True).head(1)
    try:
        found = json.loads(text[0]["value"]) if text else None
    except ValueError as e:
        raise VectorError("the query vector is no JSON") from e
    if not isinstance(found, dict) or found.get("format") != form:
        raise VectorError(f"the query vector is not of the format {form}")
    model, size, vector = (found.get(k) for k in ("model", "dimensions", "vector"))
    if not isinstance(model, str) or not model:
        raise VectorError("the query vector names no model")
    if type(size) is not int or not 1 <= size <= MOST_DIMENSIONS:
        raise VectorError("dimensions are out of range")
    if not isinstance(vector, list) or len(vector) != size or any(type(x) not in (int, float) or not math.isfinite(x) for x in vector):
        raise VectorError("the vector is not as long as it says, or not of finite numbers")
    return model, [float(x) for x in vector]


def sidecar(spark: SparkSession, path: str, form: str, model: str, dimensions: int, wanted: DataFrame | None = None) -> DataFrame:
    """(id, revision, vector) of a file of JSON lines below a header line (format, model, dimensions).

    The header has to fit the query vector. With `wanted` (id, revision), only rows for these are read further,
    as a vector of another revision says nothing about the present text. Of rows that repeat an id and revision the
    last one counts. A row below the first line that is no object, or has no valid id or revision, and a kept row with
    a vector of another length or a number that is not finite, is an error when the frame is read. Files beyond
    MOST_BYTES are refused.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() > MOST_BYTES:
        raise VectorError(f"the file is larger than {MOST_BYTES} bytes")
    head, first = _head(spark, path)
    for name, want in (("format", form), ("model", model), ("dimensions", dimensions)):
        if head.get(name) != want:
            raise VectorError(f"{name} of the file is {head.get(name)!r} and not {want!r}")
    lines = _lines(spark, path).filter("trim(value) <> ''").filter(F.col("at") > F.struct(*[F.lit(x).cast("long") for x in first]))
    rows = lines.select(F.from_json("value", "id string, revision string, vector array<double>").alias("r"), "at").select("r.*", "at")
    valid = F.coalesce(F.col("id").rlike(ID) & F.col("revision").rlike(REVISION), F.lit(False))
    rows = rows.withColumn("id", F.when(valid, F.col("id")).otherwise(F.raise_error(F.lit("a line has no valid id and revision"))))
    if wanted is not None:
        rows = rows.join(wanted.select("id", "revision").distinct(), ["id", "revision"], "left_semi")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce((F.size("vector") == dimensions) & finite, F.lit(False))
    checked = F.when(good, F.col("vector")).otherwise(F.raise_error(F.lit("a vector is not of the length or not finite")))
    return rows.groupBy("id", "revision").agg(F.max_by(checked, "at").alias("vector"))
