"""Vectors that take part, and their directions: shared by operators 7 and 10."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of rows whose vector takes part: not null, not zero, all components finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(ok)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge components under- or overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
