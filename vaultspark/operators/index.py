"""A persisted inverted index in segments: a base and the patches that followed it.

Layout below the index folder: `segments/<name>/{postings,lengths,gone}` as Parquet. Postings lie in buckets of
terms, sorted by term in each file, so a query opens the buckets of its own terms and skips row groups by their
bounds. A bucket is written in slices of its documents, so that neither many documents nor a term that is in all of
them make one task large. `gone` names the documents whose rows in earlier segments no longer count. `manifests` holds one small JSON
file for each state of the index, read by the driver without a job; the highest number that is whole counts, so a
reader sees the state before or after a change and never one between. A state is published by renaming its file to
the number behind the one that it was made from; of two writers that began at the same state one gets Conflict and
nothing of it stays (on stores where a rename replaces what is there, writers must take turns). A patch writes the
changed documents only; after `SEGMENTS` patches all is compacted. States older than the last KEPT go with what only
they refer to, so a reader may be that many changes late.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.operators import bm25

FORMAT = 3
TOKENS = 20_000_000  # tokens in a bucket of terms, about
FEWEST, MOST = 16, 4096  # buckets
TASK = 2_000_000  # tokens that one task sorts and writes, about
SEGMENTS = 8
KEPT = 3  # states of the index
REBUILD = 4  # an index of which more than a REBUILD-th has changed is built anew: patching costs a join with all of it


class Corrupt(ValueError):
    pass


class Conflict(RuntimeError):
    """Another writer has published since the state that this change was made from."""


def _place(spark: SparkSession, path: str):
    """(file system, path) on the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def signature(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, sig): what changes when a document does."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("sig"))


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change): added, changed or vanished, from two (id, sig) frames."""
    joined = stored.withColumnRenamed("sig", "old").join(current.withColumnRenamed("sig", "new"), "id", "full_outer")
    kind = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("vanished")).when(~F.col("old").eqNullSafe(F.col("new")), F.lit("changed"))
    return joined.select("id", kind.alias("change")).filter("change is not null")


def files_state(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files below a path: the cheap sign that a table is as it was."""
    system, where = _place(spark, path)
    files, seen = system.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _bucket_of(term: str, buckets: int) -> int:
    """What _bucket gives for a term: the hash as a signed number."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _write_segment(spark: SparkSession, folder: str, postings: DataFrame, lengths: DataFrame, gone: DataFrame) -> dict:
    """Writes a segment; returns what the manifest says of it."""
    name = uuid.uuid4().hex
    at = f"{folder}/segments/{name}"
    lengths.write.parquet(f"{at}/lengths")
    gone.select("id").write.parquet(f"{at}/gone")
    size = spark.read.parquet(f"{at}/lengths").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.sum(F.xxhash64("id", "length", "sig") % (1 << 40)).alias("sum")).first()
    buckets = min(MOST, max(FEWEST, -(-(size["total"] or 0) // TOKENS)))
    slices = max(1, -(-(size["total"] or 0) // (buckets * TASK)))
    lot = F.col("bucket") * slices + F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    postings.withColumn("bucket", _bucket(buckets)).repartitionById(buckets * slices, lot).sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{at}/postings")
    return {"name": name, "buckets": buckets, "documents": size["n"], "sum": size["sum"]}


def _publish(spark: SparkSession, folder: str, segments: list[dict], fingerprint: str, state: str | None, before: dict | None) -> None:
    """Makes `segments` the state that follows `before`, as manifest() gave it; Conflict where that is not the newest any more."""
    number = before["newest"] + 1 if before else 1
    body = {"format": FORMAT, "number": number, "fingerprint": fingerprint, "state": state, "segments": segments}
    text = json.dumps({"body": body, "check": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()})
    system, draft = _place(spark, f"{folder}/manifests/.{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(text.encode())
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    rules = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rules[0] = getattr(fs.Options, "Rename").NONE
    target = fs.Path(f"{folder}/manifests/{number:020d}.json")
    try:
        fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(draft), system.makeQualified(target), rules)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if not system.exists(target):
            raise
        held = {x["name"] for x in before["segments"]} if before else set()
        for segment in segments:
            if segment["name"] not in held:
                system.delete(fs.Path(f"{folder}/segments/{segment['name']}"), True)
        raise Conflict(f"state {number} of the index was published by another writer") from e
    _forget(spark, folder)


def _states(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, path) of the published states, newest first; none where there is no folder of them."""
    system, where = _place(spark, f"{folder}/manifests")
    if not system.exists(where):
        return []
    found = [(f.getPath().getName(), f.getPath().toString()) for f in system.listStatus(where)]
    return sorted(((int(name[:-5]), path) for name, path in found if name.endswith(".json") and name[:-5].isdigit()), reverse=True)


def _read(spark: SparkSession, path: str) -> dict | None:
    """A state's body; None where it is not whole or of another format. What can't be read is an error."""
    system, where = _place(spark, path)
    stream = system.open(where)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        whole = hashlib.sha256(json.dumps(found["body"], sort_keys=True).encode()).hexdigest() == found["check"]
        return found["body"] if whole and found["body"]["format"] == FORMAT else None
    except (ValueError, KeyError, TypeError):
        return None
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The newest whole state of this format, with `newest`, the highest number published; None where there is none."""
    states = _states(spark, folder)
    for _, path in states:
        if found := _read(spark, path):
            return found | {"newest": states[0][0]}
    return None


def _none(spark: SparkSession, folder: str) -> dict | None:
    """What a first whole state follows where states of other formats or broken ones lie."""
    states = _states(spark, folder)
    return {"newest": states[0][0], "segments": []} if states else None


def _forget(spark: SparkSession, folder: str) -> None:
    """Deletes states before the last KEPT, and segments that only they refer to."""
    states = _states(spark, folder)
    kept = {s["name"] for _, path in states[:KEPT] for s in (_read(spark, path) or {"segments": []})["segments"]}
    for _, path in states[KEPT:]:
        for segment in (_read(spark, path) or {"segments": []})["segments"]:
            if segment["name"] not in kept:
                system, where = _place(spark, f"{folder}/segments/{segment['name']}")
                system.delete(where, True)
        system, where = _place(spark, path)
        system.delete(where, False)


def vacuum(spark: SparkSession, folder: str, seconds: float = 86_400) -> list[str]:
    """Deletes what writers that failed have left: segments of no state, and drafts, older than `seconds`. Their names."""
    named = {s["name"] for _, path in _states(spark, folder) for s in (_read(spark, path) or {"segments": []})["segments"]}
    gone = []
    for part in ("segments", "manifests"):
        system, where = _place(spark, f"{folder}/{part}")
        for f in system.listStatus(where) if system.exists(where) else []:
            name = f.getPath().getName()
            orphan = name not in named if part == "segments" else name.startswith(".")
            if orphan and f.getModificationTime() <= (time.time() - seconds) * 1000:
                system.delete(f.getPath(), True)
                gone.append(name)
    return sorted(gone)


def build(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", fingerprint: str = "", state: str | None = None) -> None:
    """Indexes all documents anew. Like every change it raises Conflict if another writer was faster."""
    spark = docs.sparkSession
    before = manifest(spark, folder) or _none(spark, folder)
    postings, lengths = bm25.postings(docs, key, text)
    segment = _write_segment(spark, folder, postings, lengths.join(signature(docs, key, text), "id"), docs.select(F.col(key).alias("id")).limit(0))
    _publish(spark, folder, [segment], fingerprint, state, before)


def open_index(spark: SparkSession, folder: str, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(postings (term, id, tf), lengths (id, length, sig)), or None. With `terms`, only the buckets of these are opened."""
    found = manifest(spark, folder)
    if found is None:
        return None
    postings = lengths = None
    for segment in found["segments"]:
        at = f"{folder}/segments/{segment['name']}"
        more, sizes, gone = (spark.read.parquet(f"{at}/{part}") for part in ("postings", "lengths", "gone"))
        if terms is not None:
            more = more.filter(F.col("bucket").isin(sorted({_bucket_of(t, segment["buckets"]) for t in terms})) & F.col("term").isin(terms))
        more, sizes = more.select("term", "id", "tf"), sizes.select("id", "length", "sig")
        postings = more if postings is None else postings.join(gone, "id", "left_anti").unionByName(more)
        lengths = sizes if lengths is None else lengths.join(gone, "id", "left_anti").unionByName(sizes)
    return postings, lengths


def status(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", fingerprint: str = "", state: str | None = None) -> str:
    """absent, stale_format, stale or fresh. A fingerprint of other settings makes an index stale.

    With `state` (such as files_state) equal to the one the index was brought up to, no text is read: the caller
    vouches that equal states mean equal documents.
    """
    spark = docs.sparkSession
    found = manifest(spark, folder)
    if found is None:
        return "absent"
    if found["fingerprint"] != fingerprint:
        return "stale_format"
    if state is not None and found["state"] == state:
        return "fresh"
    _, lengths = open_index(spark, folder)
    return "fresh" if changes(lengths.select("id", "sig"), signature(docs, key, text)).isEmpty() else "stale"


def verify(spark: SparkSession, folder: str) -> dict:
    """The manifest, after every segment's rows are counted and summed again; Corrupt where they are not those written."""
    found = manifest(spark, folder)
    if found is None:
        raise Corrupt("there is no index")
    for segment in found["segments"]:
        at = f"{folder}/segments/{segment['name']}"
        size = spark.read.parquet(f"{at}/lengths").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.sum(F.xxhash64("id", "length", "sig") % (1 << 40)).alias("sum")).first()
        held = spark.read.parquet(f"{at}/postings").agg(F.sum("tf")).first()[0] or 0
        if size["n"] != segment["documents"] or size["sum"] != segment["sum"] or held != (size["total"] or 0):
            raise Corrupt(f"segment {segment['name']} is not what was written")
    return found


def drop(spark: SparkSession, folder: str) -> bool:
    """Deletes the index; False where there was none."""
    system, where = _place(spark, folder)
    return bool(system.delete(where, True))


def patch(spark: SparkSession, folder: str, docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: str = "", state: str | None = None) -> None:
    """Takes new versions of documents up and ids of `gone` (id) out: one more segment, or all compacted into one."""
    found = manifest(spark, folder)
    if found is None:
        raise Corrupt("there is no index")
    postings, lengths = bm25.postings(docs, key, text)
    lengths = lengths.join(signature(docs, key, text), "id")
    replaced = gone.select("id").unionByName(docs.select(F.col(key).alias("id"))).distinct()
    if len(found["segments"]) < SEGMENTS:
        segments = [*found["segments"], _write_segment(spark, folder, postings, lengths, replaced)]
    else:
        old_postings, old_lengths = open_index(spark, folder)
        postings, lengths = (old.join(replaced, "id", "left_anti").unionByName(new) for old, new in ((old_postings, postings), (old_lengths, lengths)))
        segments = [_write_segment(spark, folder, postings, lengths, replaced.limit(0))]
    _publish(spark, folder, segments, fingerprint, state, found)


def refresh(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", fingerprint: str = "", state: str | None = None) -> str:
    """Brings the index up to date: unchanged, patched or rebuilt. A patch tokenises and writes changed documents only."""
    spark = docs.sparkSession
    found = manifest(spark, folder)
    if found is None or found["fingerprint"] != fingerprint:
        build(docs, folder, key, text, fingerprint, state)
        return "rebuilt"
    if state is not None and found["state"] == state:
        return "unchanged"
    _, lengths = open_index(spark, folder)
    delta = changes(lengths.select("id", "sig"), signature(docs, key, text)).persist()
    try:
        n = delta.count()
        if n == 0:
            if state is not None:
                _publish(spark, folder, found["segments"], fingerprint, state, found)
            return "unchanged"
        if n * REBUILD > max(256, lengths.count()):
            build(docs, folder, key, text, fingerprint, state)
            return "rebuilt"
        new = docs.join(delta.filter("change <> 'vanished'").select(F.col("id").alias(key)), key, "left_semi")
        patch(spark, folder, new, delta.filter("change = 'vanished'"), key, text, fingerprint, state)
        return "patched"
    finally:
        delta.unpersist()


def search(docs: DataFrame, folder: str, queries: dict[str, str], key: str = "doc_id", text: str = "text", fingerprint: str = "", state: str | None = None, **how) -> DataFrame:
    """BM25 from the index if it is provably fresh, else from a scan; the answers are equal.

    Without `state` the proof hashes every text; with it, it reads none.
    """
    if status(docs, folder, key, text, fingerprint, state) == "fresh":
        spark = docs.sparkSession
        terms = sorted({t for _, t in bm25.query_terms(queries)})
        postings, lengths = open_index(spark, folder, terms)
        return bm25.score_postings(postings, lengths.select("id", "length"), queries, **how)
    return bm25.score(docs, queries, key, text, **how)
