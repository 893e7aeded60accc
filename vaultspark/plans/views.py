"""Saved searches: named, bounded specifications that run as they are, with limit, offset and as_of alone overridable."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.functions.instants import instant
from vaultspark.operators import bm25, filters, paging, ranking
from vaultspark.session import dealt, where
from vaultspark.sources import markdown

MOST_VIEWS = 128
NAME = re.compile("[a-z][a-z0-9_]{0,62}")
RANKS = ("substring", "bm25", "hybrid")


@dataclass(frozen=True)
class Search:
    """A search: words, filters that all have to hold, a rank, a sort, and a page.

    `where` are exact filters by column, `attributes` those by attribute. Windows are half-open and take ISO texts with
    an offset. `related_id` and `relation_predicate` ask for one relation that has both, in force at `as_of` if given.
    """

    query: str = ""
    where: dict[str, object] = field(default_factory=dict)
    sort: str | None = None
    limit: int = 20
    offset: int = 0
    rank: str = "hybrid"
    attributes: dict[str, object] = field(default_factory=dict)
    domain: str | None = None
    experienced: bool | None = None
    min_rating: int | None = None
    read_after: str | None = None
    read_before: str | None = None
    occurred_after: str | None = None
    occurred_before: str | None = None
    related_id: str | None = None
    relation_predicate: str | None = None
    as_of: str | None = None

    def check(self) -> None:
        filters.check_bounds(self.limit, self.offset, after=self.read_after, before=self.read_before)
        filters.check_bounds(after=self.occurred_after, before=self.occurred_before)
        if self.rank not in RANKS:
            raise ValueError(f"rank is one of {', '.join(RANKS)}")
        if self.sort is not None and self.sort not in paging.SORTS:
            raise ValueError(f"no such sort: {self.sort}")
        if self.min_rating is not None and not 1 <= self.min_rating <= 5:
            raise ValueError("min_rating lies between 1 and 5")
        if self.as_of is not None:
            filters.moment(self.as_of)
        if self.relation_predicate is not None and not NAME.fullmatch(self.relation_predicate):
            raise ValueError("relation_predicate is no name")

    def condition(self) -> Column:
        """All filters as one predicate."""
        tests = [filters.exact(c, v) for c, v in self.where.items()] + [filters.attribute(n, v) for n, v in self.attributes.items()]
        if self.domain is not None:
            tests.append(filters.domain(self.domain))
        if self.experienced is not None:
            tests.append(filters.experienced(self.experienced))
        if self.min_rating is not None:
            tests.append(filters.min_rating(self.min_rating))
        for column, after, before in (("read_at", self.read_after, self.read_before), ("occurred_at", self.occurred_after, self.occurred_before)):
            if after is not None or before is not None:
                tests.append(filters.window(column, after, before))
        if self.related_id is not None or self.relation_predicate is not None:
            tests.append(filters.related(self.related_id, self.relation_predicate, self.as_of))
        return filters.all_of(*tests)

    def scored(self, entries: DataFrame, key: str, text: str) -> DataFrame:
        """(id, score) by the rank, of the whole collection."""
        if self.rank == "hybrid" or not self.query:
            return ranking.hybrid(entries, self.query, key, text)
        if self.rank == "substring":
            return ranking.literal(entries, self.query, key, text)
        return bm25.score(entries, {"q": self.query}, key, text).select("id", "score")

    def run(self, entries: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """The page. Scores come from the whole collection; filters apply to what was scored."""
        self.check()
        kept = entries.filter(self.condition())
        if self.rank == "substring" or not self.query:
            rows = where(dealt(kept, key), ranking.holds(text, self.query)) if self.query else kept
            rows = rows.withColumn("score", F.lit(0.0))
        else:
            scored = self.scored(entries, key, text).withColumnRenamed("id", "_id")
            rows = kept.drop("score").join(scored, F.col(key) == F.col("_id")).drop("_id")
        sort = self.sort or paging.auto_sort(self.rank != "substring", len(T.tokens_of(self.query)), self.where.get("type") == "experience")
        extra = {"tier": F.lit(1)}
        for at in ("updated", "occurred"):  # sorts go by the instant, whatever its offset; what is none counts as missing
            if at not in rows.columns:
                extra[at] = instant(F.col(f"{at}_at")) if f"{at}_at" in rows.columns else F.lit(None).cast("long")
        return paging.page(rows.withColumns(extra), paging.order(sort, key), self.limit, self.offset).drop(*extra)


def read(specifications: dict[str, dict]) -> dict[str, Search]:
    """Searches by name from plain mappings, as a file of saved views holds them; what is not allowed is an error.

    Keys of exact filters stand beside the others; `attribute_filters` holds attributes; title and description are
    for people. `offset` and the text columns of a run are not part of a view.
    """
    if len(specifications) > MOST_VIEWS:
        raise ValueError("too many views")
    plain = {"query", "sort", "limit", "rank", "domain", "experienced", "min_rating", "read_after", "read_before", "occurred_after", "occurred_before", "related_id", "relation_predicate", "as_of"}
    out = {}
    for name, given in specifications.items():
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name of a view")
        unknown = set(given) - plain - set(filters.EXACT) - {"title", "description", "attribute_filters"}
        if unknown:
            raise ValueError(f"{name}: unknown {', '.join(sorted(unknown))}")
        if not isinstance(given.get("title"), str) or not given["title"].strip():
            raise ValueError(f"{name} has no title")
        out[name] = Search(where={k: given[k] for k in filters.EXACT if k in given}, attributes=given.get("attribute_filters") or {}, **{k: given[k] for k in plain if k in given})
        out[name].check()
    return out


def load(text: str) -> dict[str, Search]:
    """Searches of a file of saved views: `format_version: 1` and the map `views`, in the dialect that frontmatter has."""
    found = markdown.tolerant(text.splitlines())
    if set(found) != {"format_version", "views"} or found["format_version"] != 1 or not isinstance(found["views"], dict | None):
        raise ValueError("no file of saved views")
    return read(found["views"] or {})


def run(views: dict[str, Search], name: str, entries: DataFrame, limit: int | None = None, offset: int | None = None, as_of: str | None = None, **how) -> DataFrame:
    if len(views) > MOST_VIEWS:
        raise ValueError("too many views")
    view = views[name]
    return replace(view, limit=view.limit if limit is None else limit, offset=view.offset if offset is None else offset, as_of=as_of or view.as_of).run(entries, **how)
