"""Operator 13: quality by compression with two zstandard dictionaries.

One dictionary is built from good labelled texts and one from bad ones. A text is compressed piece by piece with each;
the class whose dictionary leaves fewer bytes is the likelier one. The difference of the two sizes, over the square
root of the text's bytes (its noise grows so), goes through a logistic curve that is fitted on sampled texts that
neither dictionary was built from, at the classes' own shares. Lines that several sampled texts hold are left out of
the dictionaries: a passage that is copied about marks no class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import give_back

SAMPLE = 1200  # labelled texts of each class that are learned from, at most
WINDOW = 2000  # characters of each that are learned from; longer texts give a window at a place drawn by hash
PIECE = 4096  # bytes that are compressed together; every piece of a text counts
DICTIONARY, LEVEL = 110_000, 3  # bytes at most


@dataclass(frozen=True)
class Model:
    """Two dictionaries (None: nothing to tell the classes by) and the curve's slope and offset."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)  # plain bytes count as content
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def differences(texts: Iterable[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Bytes that the bad dictionary leaves more than the good one, over the square root of a text's bytes and one."""
    out, (by_good, by_bad) = [], (_compressor(good), _compressor(bad))
    for t in texts:
        more = 0
        for k in range(0, len(t), PIECE):
            piece = t[k : k + PIECE]
            more += len(by_bad.compress(piece)) - len(by_good.compress(piece))
        out.append(more / (len(t) + 1) ** 0.5)
    return np.array(out, dtype=np.float64)


def _dictionary(texts: list[bytes]) -> bytes | None:
    """A trained dictionary; of samples that are too few to train on, their bytes one behind the other."""
    parts = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(parts)[-DICTIONARY:] or None


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the log-odds of class 1, by Newton steps; `share` is the share of class 1 among all labels."""
    ones, zeros = y.sum(), (1 - y).sum()
    want = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # drawn in a little, so that the curve stays finite
    scale = x.std() + 1e-9
    u, w = np.stack([(x - x.mean()) / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ u, -30, 30)))
        w = w - np.linalg.solve((u * (p * (1 - p))) @ u.T + 1e-3 * np.eye(2), u @ (p - want) + 1e-3 * w)
    prior = np.log(share / (1 - share)) - np.log(ones / zeros)  # classes are sampled evenly, not at their shares
    slope = max(0.0, w[0]) / scale
    return float(slope), float(w[1] - slope * x.mean() + prior)


def train(texts: list[str | None], good: list[int], share: float | None = None) -> Model:
    """Dictionaries from half of the texts of each class, drawn at random, the curve from the rest. `share`: of good texts among all that are labelled.

    With fewer than two texts of a class there is nothing to compare: every score is then that of the larger class.
    """
    raw, y = [(t or "").encode() for t in texts], np.array(good, dtype=np.float64)
    if min(y.sum(), (1 - y).sum()) < 2:
        return Model(None, None, 0.0, 4.0 if len(y) and y.mean() >= 0.5 else -4.0)
    seen = Counter(line for t in raw for line in set(t.split(b"\n")))
    own = [b"\n".join(line for line in t.split(b"\n") if seen[line] == 1) for t in raw]
    order = np.random.default_rng(13).permutation(len(y))
    rows = {c: order[y[order] == c] for c in (1, 0)}
    books = {c: _dictionary([own[i] for i in rows[c][::2]]) for c in (1, 0)}
    if books[1] is None or books[0] is None:
        return Model(None, None, 0.0, 4.0 if y.mean() >= 0.5 else -4.0)
    rest = np.concatenate([rows[1][1::2], rows[0][1::2]])
    slope, offset = _curve(differences([raw[i] for i in rest], books[1], books[0]), y[rest], min(max(y.mean() if share is None else share, 0.01), 0.99))
    return Model(books[1], books[0], slope, offset)


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows of each class whose crc32(key) mod 4 is not 2, those of smallest hash.

    Of each sampled text a window of WINDOW characters is learned from, at a place drawn by hash, so a long text
    teaches like a short one and at most 2 x sample x WINDOW characters are collected. Only the text is an input.
    Rows labelled null or without a document teach nothing; of repeated labels the largest counts, of rows that repeat
    a key the largest window. Null texts teach as empty ones. Empty tables, or labels of one class, give a constant
    score. The sampled keys, at most 2 x sample, are broadcast. Other columns, whatever their names, are not looked at.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    shares = {int(r["y"] > 0): r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    parts = [known.filter((F.col("y") > 0) == bool(y)).orderBy(F.xxhash64(key), key).limit(sample) for y in (1, 0)]
    chosen = parts[0].unionByName(parts[1]).select(F.col(key).alias("k"), (F.col("y") > 0).cast("int").alias("y"))
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("k"))
    start = F.pmod(F.xxhash64("k", F.lit(13)), F.greatest(F.lit(1), F.char_length("t") - WINDOW + 1)) + 1
    rows = found.select("k", "y", F.substr("t", start.cast("int"), F.lit(WINDOW)).alias("t")).groupBy("k", "y").agg(F.max("t").alias("t")).collect()
    rows = sorted(rows, key=lambda r: r["k"])
    total = sum(shares.values())
    return train([r["t"] for r in rows], [r["y"] for r in rows], shares.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability from 0 to 1 that each whole text is good. No shuffle.

    Null and empty texts have a difference of zero; texts of any length are compressed in all their pieces. Repeated
    rows and other columns stay, but for an `out` that is there already; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        model = sent.value
        if model.good is None or model.bad is None:
            x = np.zeros(len(column))
        else:
            x = differences(((t.as_py() or b"") for t in column.cast(pa.binary())), model.good, model.bad)
        give_back()
        return pa.array(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30))))

    return docs.withColumn(out, run(F.col(text)))
