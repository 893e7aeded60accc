"""Sorts, offset pages, shared budgets and match evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.session import dealt

SORTS = ("relevance", "updated_desc", "updated_asc", "occurred_desc", "occurred_asc", "title_asc", "title_desc")
MOST = 50


def order(sort: str, key: str = "id") -> list[Column]:
    """Columns of a sort. A missing time counts as before all others: last going down, first going up. Ties by key."""
    if sort == "relevance":
        return [F.desc("tier"), F.desc("score"), F.asc(key)]
    if sort in ("title_asc", "title_desc"):
        name = T.fold(F.coalesce(F.col("title"), F.lit("")))
        return [name.asc() if sort == "title_asc" else name.desc(), F.asc(key)]
    if sort in SORTS:
        column = F.col(sort.rsplit("_", 1)[0])
        return [column.asc_nulls_first() if sort.endswith("asc") else column.desc_nulls_last(), F.asc(key)]
    raise ValueError(f"no such sort: {sort}")


def auto_sort(ranked: bool, terms: int, experiences: bool) -> str:
    if ranked and terms:
        return "relevance"
    return "occurred_desc" if experiences else "updated_desc"


def page(df: DataFrame, by: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit: a top-k over limit + offset rows, whatever the input."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError("limit lies between 1 and 50, and offset is not negative")
    return df.orderBy(*by).offset(offset).limit(limit)


def envelope(df: DataFrame, by: list[Column], limit: int = 20, offset: int = 0) -> dict:
    """One page with total, returned, has_more and next_offset."""
    total, rows = df.count(), page(df, by, limit, offset).collect()
    more = offset + len(rows) < total
    return {"total": total, "returned": len(rows), "has_more": more, "next_offset": offset + len(rows) if more else None, "items": [r.asDict(True) for r in rows]}


def budget(page_rows: DataFrame, by: list[Column], text: str, most: int) -> DataFrame:
    """One page's rows with `granted` characters of a shared budget, in page order. A page is 50 rows at most."""
    before = F.coalesce(F.sum(F.char_length(text)).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(F.char_length(text).cast("long"), F.lit(most) - before))
    return page_rows.withColumn("granted", granted.cast("long"))


MOST_RETRIEVED, MOST_BUDGET = 10, 100_000


def retrieve(found: DataFrame, by: list[Column], text: str, limit: int = 5, most: int = 20_000, offset: int = 0) -> DataFrame:
    """A page of ten entries at most with `granted` characters of a shared budget of 100,000 at most."""
    if not 1 <= limit <= MOST_RETRIEVED or not 1 <= most <= MOST_BUDGET:
        raise ValueError("limit lies between 1 and 10, and the budget between 1 and 100000")
    return budget(page(found, by, limit, offset), by, text, most)


def newest(df: DataFrame, at: str, key: str, most: int = 64) -> DataFrame:
    """The newest `most` rows, oldest first."""
    return df.orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(most).orderBy(F.col(at).asc_nulls_first(), key)


def evidence(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", most: int = 5, width: int = 240, lead: int = 60) -> DataFrame:
    """(id, n, line, excerpt): the first lines of each text that hold the folded query, five excerpts at most.

    An excerpt begins `lead` characters before the match. Lines are an array of the row's own, nothing is shuffled.
    """
    needle = T.fold(F.lit(query))
    numbered = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    hits = F.slice(F.filter(numbered, lambda x: T.fold(x["text"]).contains(needle)), 1, most)
    some = T.fold(F.coalesce(F.col(text), F.lit(""))).contains(needle)  # the other texts, most of them, are not split
    rows = dealt(docs.select(F.col(key).alias("id"), text), "id").select("id", F.posexplode(F.when(some, hits)).alias("n", "hit"))
    found = F.position(needle, T.fold(F.col("hit.text")))
    start = F.greatest(F.lit(1), unfolded(F.col("hit.text"), found) - lead)
    return rows.select("id", (F.col("n") + 1).alias("n"), F.col("hit.line").alias("line"), F.substr(F.col("hit.text"), start, F.lit(width)).alias("excerpt"))


def unfolded(line: Column, place: Column) -> Column:
    """The character of a line that its folded form's character number `place` comes from. Folding can lengthen a line."""
    sizes = F.transform(F.split(line, ""), lambda char: F.char_length(T.fold(char)))
    zero = F.struct(F.lit(0).alias("folded"), F.lit(1).alias("at"))
    walked = F.aggregate(sizes, zero, lambda s, n: F.when(s["folded"] + n < place, F.struct((s["folded"] + n).alias("folded"), (s["at"] + 1).alias("at"))).otherwise(F.struct(place.cast("int").alias("folded"), s["at"].alias("at"))))
    return F.when(F.char_length(T.fold(line)) == F.char_length(line), place).otherwise(walked["at"])
