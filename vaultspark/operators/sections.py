"""Body sections: runs of lines under one heading, as gaps and islands within each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fence around fetched text; a collection that uses other markers passes its own.
BEGIN, END = "<!-- web-content -->", "<!-- /web-content -->"


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading: str = r"^#{1,6}\s+(.*)$") -> DataFrame:
    """(id, section, heading, first_line, last_line): a heading line begins a section; lines before any are section 0."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    mark = lines.withColumn("heads", F.col("line").rlike(heading).cast("int"))
    run = mark.withColumn("section", F.sum("heads").over(Window.partitionBy("id").orderBy("no")))
    return run.groupBy("id", "section").agg(F.max(F.when(F.col("heads") == 1, F.regexp_extract("line", heading, 1))).alias("heading"), (F.min("no") + 1).alias("first_line"), (F.max("no") + 1).alias("last_line"))


#: What ends a line of a body, in any notation.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Headings under which older entries keep fetched text without a fence.
SUMMARY = ("Generated summary",)


def lines(docs: DataFrame, key: str = "id", body: str = "body", summaries: tuple[str, ...] = SUMMARY, begin: str = BEGIN, end: str = END) -> DataFrame:
    """(id, no, line, fence, heading, origin, marked) of every line of each body, numbered from 1.

    `fence` is 1 on a line that opens a fence and 0 on one that closes it. Between the two a line is marked and its
    origin is web; a fence that is never closed runs to the end. In a body without any fence the lines below a
    heading of `summaries`, however it is written, are web too, but not marked. All others are the user's.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    parts = F.split(text, LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = docs.select(F.col(key).alias("id"), text.contains(begin).alias("fenced"), F.posexplode(parts).alias("no", "line"))
    bare = F.trim("line")
    rows = rows.withColumn("no", F.col("no") + 1).withColumn("fence", F.when(bare == begin, 1).when(bare == end, 0))
    rows = rows.withColumn("own", F.when(F.col("fence").isNull() & F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4)))))
    so_far = Window.partitionBy("id").orderBy("no")
    rows = rows.withColumns({"marked": F.coalesce(F.last("fence", True).over(so_far), F.lit(0)) == 1, "heading": F.last("own", True).over(so_far)})
    named = ~F.col("fenced") & F.coalesce(F.lower("heading").isin(*[x.lower() for x in summaries]), F.lit(False))
    origin = F.when(F.col("marked") | named, F.lit("web")).otherwise("user")
    return rows.select("id", "no", "line", "fence", "heading", origin.alias("origin"), "marked")


def origins(docs: DataFrame, key: str = "id", body: str = "body", summaries: tuple[str, ...] = SUMMARY, begin: str = BEGIN, end: str = END) -> DataFrame:
    """(id, section, heading, origin, marked, first_line, last_line): runs of lines of one heading and one origin.

    The line that opens a fence belongs to the section behind it, the one that closes it to the section before it; a
    fence with nothing in it belongs to none. Numbering is by windows within a document, so a document is one task's.
    """
    every = Window.partitionBy("id").orderBy("no")
    behind = every.rowsBetween(Window.unboundedPreceding, -1)
    told = lines(docs, key, body, summaries, begin, end).withColumn("kind", F.when(F.col("fence").isNull(), F.struct("heading", "origin", "marked")))
    told = told.withColumn("starts", F.col("kind").isNotNull() & ~F.last("kind", True).over(behind).eqNullSafe(F.col("kind")))
    # A line that opens a fence counts from the last section's start, or the last line that closed one.
    told = told.withColumn("since", F.coalesce(F.count_if(F.col("starts") | F.coalesce(F.col("fence") == 0, F.lit(False))).over(behind), F.lit(0)))
    opened = F.min(F.when(F.col("fence") == 1, F.col("no"))).over(Window.partitionBy("id", "since").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumns({"opened": opened, "section": F.count_if("starts").over(every)})
    closes = (F.col("fence") == 0) & F.col("opened").isNull()
    told = told.filter((F.col("section") > 0) & (F.col("kind").isNotNull() | closes))
    first = F.min(F.when(F.col("starts"), F.coalesce("opened", "no")))
    runs = told.groupBy("id", "section").agg(F.first("kind", True).alias("kind"), first.alias("first_line"), F.max(F.when(F.col("kind").isNotNull(), F.col("no"))).alias("last"), F.max(F.when(closes, F.col("no"))).alias("closed"))
    last = F.when(F.col("kind.marked"), F.greatest("last", "closed")).otherwise(F.col("last"))
    return runs.select("id", (F.col("section") - 1).alias("section"), "kind.heading", "kind.origin", "kind.marked", "first_line", last.alias("last_line"))


def fence(text: str, begin: str = BEGIN, end: str = END) -> str:
    """Fetched text between its markers."""
    return f"{begin}\n{text}\n{end}"


def has_web(body: str, begin: str = BEGIN):
    return F.coalesce(F.col(body).contains(begin), F.lit(False))


def searchable(body: str, begin: str = BEGIN, end: str = END):
    """The body without fence markers; what is between them stays."""
    return F.replace(F.replace(F.col(body), F.lit(begin), F.lit("")), F.lit(end), F.lit(""))
