"""Literal, lexical and hybrid matching, tolerant fallbacks, fusion of wordings, and vector reranking."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.operators import bm25, ranks
from vaultspark.session import dealt, where

FUSION = 60  # fixed value: the constant of reciprocal-rank fusion
STAGES = ("lexical", "word_form", "title_typo", "component", "body_typo")
STAGE_SCORES = {"lexical": 0.0, "word_form": -1.0, "title_typo": -2.0, "component": -1.5, "body_typo": -3.0}
#: Tiers of fusion, highest first: component stands before title typo, unlike in the cascade.
TIERS = ("lexical", "word_form", "component", "title_typo", "body_typo")
MOST_VARIANTS, LONGEST_QUERY = 3, 2000
MOST_TERMS = 16  # longer queries get no tolerant fallback


def terms_of(query: str) -> list[str]:
    folded = unicodedata.normalize("NFKC", query).casefold()
    return sorted({w for w in re.findall(r"[^\W_]+", folded) if len(w) <= T.LONGEST_TOKEN})


def holds(text: str, query: str) -> Column:
    """Does the folded text hold the folded query? The empty query is in all."""
    return T.fold(F.coalesce(F.col(text), F.lit(""))).contains(T.fold(F.lit(query)))


def literal(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score 0) of documents that hold the folded query; the empty query is in all."""
    own = dealt(docs.select(F.col(key).alias("id"), F.col(text).alias("body")), "id")
    return where(own, holds("body", query)).select("id", F.lit(0.0).alias("score"))


def hybrid(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, score): ranked documents, and those that only hold the query literally, at score 0. One scan."""
    if not query:
        return docs.select(F.col(key).alias("id"), F.lit(0.0).alias("score"))
    return bm25.score(docs, {"q": query}, key, text, literals=(query,), **how).select("id", "score")


def stages(docs: DataFrame, query: str, title: str | None = None, key: str = "doc_id", text: str = "text", keep=None, only: str | None = None) -> DataFrame:
    """(id, stage, terms) of kept documents at the first stage that any of them reaches, 0 being lexical or literal.

    Every document gets the first predicate it satisfies; those at the smallest number found anywhere remain,
    which is what trying stage after stage until one has hits gives. The gate looks at kept documents only. With
    `only`, the name of a stage, there is no cascade: every kept document that satisfies this stage's predicate.
    """
    if only is not None and only not in STAGES:
        raise ValueError(f"{only} is no stage")
    terms = terms_of(query)
    rows = docs if keep is None else docs.filter(keep)
    body = F.coalesce(F.col(text), F.lit(""))
    name = T.title_of(body) if title is None else F.coalesce(F.col(title), F.lit(""))
    bag = dealt(rows, key).select(F.col(key).alias("id"), T.fold(body).alias("hay"), T.vocabulary(T.tokens(body)).alias("words"), T.vocabulary(T.tokens(name)).alias("names"))
    bag = bag.withColumn("letters", T.letters_only(F.col("words")))
    none = F.array().cast("array<string>")
    forms, typos, parts, slips = none, none, none, none
    if len(terms) <= MOST_TERMS:
        forms, parts = T.word_form_terms(terms, F.col("letters")), T.component_terms(terms, F.col("letters"))
        typos, slips = T.typo_terms(terms, F.col("names"), 5), T.typo_terms(terms, F.col("letters"), 7)
    hit = F.arrays_overlap("words", F.array(*map(F.lit, terms))) if terms else F.lit(False)
    found = bag.select("id", (hit | F.col("hay").contains(T.fold(F.lit(query)))).alias("hit"), *[x.alias(f"t{k}") for k, x in enumerate((forms, typos, parts, slips), 1)])
    tests = [(F.col("hit"), none), *[(F.size(f"t{k}") > 0, F.col(f"t{k}")) for k in range(1, 5)]]
    first = F.lit(None)
    for k, (test, terms) in reversed(list(enumerate(tests))):
        if only in (None, STAGES[k]):
            first = F.when(test, F.struct(F.lit(k).alias("stage"), terms.alias("terms"))).otherwise(first)
    # A filter here would be pushed below the projections and compute every column again; an exploded array is not.
    staged = found.select("id", F.explode(F.array_compact(F.array(first))).alias("s")).select("id", "s.stage", "s.terms")
    if only is not None:
        return staged
    # The gate is one number, so it is an aggregate of its own, not a window over one partition.
    lowest = staged.agg(F.min("stage").alias("lowest"))
    return staged.join(F.broadcast(lowest), F.col("stage") == F.col("lowest")).select("id", "stage", "terms")


def wordings(query: str, variants: list[str] | None = None) -> dict[str, str]:
    """Query texts by id (q0, q1, ...): a query and up to three other wordings, all different once folded.

    A query alone may be anything; with variants, each text has 1 to 2000 characters, something but white space
    and no NUL.
    """
    texts = [query, *(variants or [])]
    if len(texts) > 1 + MOST_VARIANTS:
        raise ValueError(f"at most {MOST_VARIANTS} variants")
    if variants:
        if any(not t.strip() or "\0" in t or len(t) > LONGEST_QUERY for t in texts):
            raise ValueError(f"a wording is blank, holds NUL or is longer than {LONGEST_QUERY} characters")
        if len({unicodedata.normalize("NFKC", t).casefold().strip() for t in texts}) < len(texts):
            raise ValueError("wordings must differ")
    return {f"q{k}": t for k, t in enumerate(texts)}


def match_kind(score: Column) -> Column:
    """typo, word_form or lexical, by a score that may stand for a stage."""
    typos = [STAGE_SCORES["title_typo"], STAGE_SCORES["body_typo"]]
    forms = [STAGE_SCORES["word_form"], STAGE_SCORES["component"]]
    return F.when(score.isin(typos), F.lit("typo")).when(score.isin(forms), F.lit("word_form")).otherwise(F.lit("lexical"))


def fusion_tier(score: Column) -> Column:
    """4 for lexical scores down to 0 for typos of the body."""
    tier = F.when(score >= 0, F.lit(len(TIERS) - 1))
    for place, name in enumerate(reversed(TIERS)):
        tier = tier.when(score == STAGE_SCORES[name], F.lit(place))
    return tier.otherwise(F.lit(0))


def fuse(scored: DataFrame) -> DataFrame:
    """(id, tier, rrf, best, evidence) from (query_id, id, score): sum of 1 / (60 + rank) over the wordings.

    `tier` is that of the best score, and goes before rrf in an order; `evidence` lists (query_id, match_kind) of
    every wording that found the document, by query_id. With a column `path`, an id that stands for two paths is an
    error, as candidates would be mixed up.
    """
    ranked = ranks.placed(scored, ["query_id"], [F.desc("score"), F.asc("id")])
    found = F.array_sort(F.collect_list(F.struct("query_id", (1.0 / (FUSION + F.col("rank"))).alias("w"), match_kind(F.col("score")).alias("match_kind"))))
    paths = [F.min("path").alias("one"), F.max("path").alias("other")] if "path" in scored.columns else []
    rows = ranked.groupBy("id").agg(found.alias("found"), F.max("score").alias("best"), *paths)
    if paths:
        rows = rows.withColumn("id", F.when(F.col("one") != F.col("other"), F.raise_error(F.concat(F.lit("two entries have the id "), F.col("id").cast("string")))).otherwise(F.col("id")))
    rrf = F.aggregate("found", F.lit(0.0), lambda s, x: s + x["w"])
    evidence = F.transform("found", lambda x: F.struct(x["query_id"].alias("query_id"), x["match_kind"].alias("match_kind")))
    return rows.select("id", fusion_tier(F.col("best")).alias("tier"), F.round(rrf, bm25.DIGITS).alias("rrf"), "best", evidence.alias("evidence"))


def rerank(candidates: DataFrame, vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", revision: str | None = None) -> DataFrame:
    """(id, tier, relevance): cosine for candidates with a vector (tier 1), else their lexical score (tier 0). Adds none.

    With `revision`, a column of both sides, only a vector made from the entry's present text counts.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    by = ["id"] if revision is None else ["id", revision]
    known = vectors.select(F.col(key).alias("id"), *by[1:], T.cosine(F.col(vector), asked).alias("cosine"))
    joined = candidates.join(known, by, "left")
    return joined.select("id", F.col("cosine").isNotNull().cast("int").alias("tier"), F.round(F.coalesce("cosine", "score"), bm25.DIGITS).alias("relevance"))
