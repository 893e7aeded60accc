"""Okapi BM25 from a scan or from persisted postings.

Statistics are those of the whole corpus, whatever is filtered afterwards. Terms of a query are a set; many
queries are scored in one plan, keyed by query_id. Weights are added in the order of terms, so scores do not
depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vaultspark.functions import text as T
from vaultspark.session import dealt, written

K1, B = 1.2, 0.75
DIGITS = 9  # scores are rounded, so that equal ones compare equal on every engine


def _counted(tokens: Column) -> Column:
    """Array of (term, tf) of an array of tokens: sorted, equal ones are neighbours, and a term's count is the way to where the next begins."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        both = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.size(words)), F.array(F.size(words))), lambda i, j: F.struct(F.get(words, i).alias("term"), (j - i).cast("long").alias("tf")))
        return F.flatten(F.transform(F.array(starts), both))

    # A lambda's argument is computed once, where a column that is used twice is computed twice.
    return F.flatten(F.transform(F.array(F.sort_array(tokens)), lambda words: F.when(F.size(words) > 0, runs(words)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))))


def postings(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, length) of every document; lengths count repeats. Keys are taken to be unique.

    A document's tokens are counted in its own row, so nothing is shuffled. Only where a key repeats, which a job
    over the keys finds out while the plan is built, are the counts of its rows added.
    """
    own = dealt(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")), "id")
    terms = own.select("id", F.explode(_counted(T.tokens(F.col("body")))).alias("c")).select("c.term", "id", "c.tf")
    if not docs.groupBy(F.col(key).alias("id")).count().filter("count > 1").isEmpty():
        terms = terms.groupBy("id", "term").agg(F.sum("tf").alias("tf")).select("term", "id", "tf")
    lengths = own.select("id", F.regexp_count(T.fold(F.col("body")), F.lit(T.WHOLE_TOKEN)).cast("long").alias("length"))
    return terms, lengths


def query_terms(queries: dict[str, str]) -> list[tuple[str, str]]:
    """(query_id, term) for each different term of each query, in order."""
    return [(q, t) for q, text in sorted(queries.items()) for t in sorted(set(T.tokens_of(text)))]


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def score_postings(terms: DataFrame, lengths: DataFrame, queries: dict[str, str], k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score) of every document that holds a term of the query."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, and b lies between 0 and 1")
    rows = query_terms(queries)
    if not rows:
        return terms.sparkSession.createDataFrame([], f"query_id string, id {terms.schema['id'].dataType.simpleString()}, score double")
    asked = F.broadcast(terms.sparkSession.createDataFrame(rows, "query_id string, term string"))
    # A list of literals is pushed into the postings' scan, where a join is not.
    mine = terms.filter(F.col("term").isin(*sorted({t for _, t in rows})))
    met = mine.join(asked, "term")
    found = mine.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term asked
    corpus = lengths.agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    known = met.join(F.broadcast(found), "term").join(lengths, "id").crossJoin(F.broadcast(corpus))  # corpus is one row
    weighed = known.withColumn("w", idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("length"), F.col("total") / F.col("n"), k1, b))
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("term", "w"))), F.lit(0.0), lambda s, x: s + x["w"])
    return weighed.groupBy("query_id", "id").agg(F.round(in_order, DIGITS).alias("score"))


def _term(term: str) -> Column:
    """Pattern of a whole token: a term is letters and digits only."""
    return F.lit(rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])")


def counts(docs: DataFrame, terms: list[str], key: str, text: str, literals: tuple[str, ...] = ()) -> DataFrame:
    """(id, length, tf array, held array): tokens of each document, how often it holds each term, and which literals; the text is folded once a row.

    The array that is exploded keeps filters and projections above from being computed below, each with a folding of its own.
    """

    def counted(hay: Column) -> Column:
        tf = [F.when(hay.contains(t), F.regexp_count(hay, _term(t))).otherwise(0).cast("long") for t in terms]
        held = [hay.contains(T.fold(F.lit(x))) for x in literals]
        arrays = [F.array(*x) if x else F.array().cast(f"array<{kind}>") for x, kind in ((tf, "bigint"), (held, "boolean"))]
        return F.struct(F.regexp_count(hay, F.lit(T.WHOLE_TOKEN)).cast("long").alias("length"), arrays[0].alias("tf"), arrays[1].alias("held"))

    own = dealt(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")), "id")
    once = F.transform(F.array(T.fold(F.col("body"))), counted)
    return own.select("id", F.explode(once).alias("c")).select("id", "c.length", "c.tf", "c.held")


def score(docs: DataFrame, queries: dict[str, str], key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, literals: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score) of every document that holds a term of the query, by one scan.

    The scan counts the queries' own terms in each document, observes the statistics of the corpus on the way, and
    writes a few numbers for each document with a hit; nothing is exploded or shuffled. It runs while the plan is
    built. With `literals`, texts that documents are looked through for as they are, those hold them without a
    term count as a hit of score 0 of every query.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative, and b lies between 0 and 1")
    spark = docs.sparkSession
    asked = query_terms(queries)
    terms = sorted({t for _, t in asked})
    if not terms and not literals:
        return spark.createDataFrame([], f"query_id string, id {docs.schema[key].dataType.simpleString()}, score double")
    corpus = Observation()
    rows = counts(docs, terms, key, text, literals).observe(corpus, F.count("*").alias("n"), F.sum("length").alias("total"), *[F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(terms))])
    hits = written(rows.filter(F.exists("tf", lambda n: n > 0) | F.exists("held", lambda x: x)))
    found = corpus.get
    n, average = F.lit(found["n"]), F.lit((found["total"] or 0) / max(1, found["n"]))
    scores = []
    for q in queries:
        total = F.lit(0.0)
        for t in sorted(t for i, t in asked if i == q):
            k = terms.index(t)
            total = total + F.when(F.col("tf")[k] > 0, idf(n, F.lit(found[f"df{k}"])) * weight(F.col("tf")[k], F.col("length"), average, k1, b)).otherwise(0.0)
        scores.append(F.struct(F.lit(q).alias("query_id"), F.round(total, DIGITS).alias("score")))
    scored = hits.select("id", "held", F.explode(F.array(*scores)).alias("s")).select("s.query_id", "id", "s.score", "held")
    return scored.filter((F.col("score") > 0) | F.exists("held", lambda x: x)).drop("held")
