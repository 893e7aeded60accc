"""Operator 6: near-duplicate lines by a segment-partition edit join. Native.

Lines within `threshold` edits of each other are cut into threshold + 1 segments: one segment of the shorter
line then stands unchanged in the longer one, at a place that its length difference bounds. Every line posts
its own segments under (length, segment number, hash of the segment) and probes with the substrings that such
a place allows in lines as long or shorter (Li, Deng, Wang and Feng, Pass-Join, 2011). Candidates are verified
by a banded bit-parallel edit distance (Hyyro, 2003): a column of the band is two words of 2 x threshold + 1
bits, folded over the characters.

Equal lines are one before that. A segment that very many different lines share is not paired out. For
threshold one, such lines are posted again under everything but a sixteenth of the line, then everything but a
sixteenth of that, and so on, down to one character, where a key holds no more lines than there are characters.
For larger thresholds, they are compared with a few pivots a round, until all are connected or have met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import cut, small
from vaultspark.llm.components import components, pivoted

MIN_CHARS = 20  # shorter lines are compared for equality only: one edit makes another word of a short line
HOT = 24  # different lines under a key that are still paired out
FAN = 16


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, no, line) of every line of rows with a key; null texts have none. `row` tells apart rows that repeat a key."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("no", "line"))


def marks() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(5), "line").alias("g")]


def _bound(n: str, i: int, parts: int) -> str:
    return f"cast({n} as bigint) * {i} div {parts}"


def posted(lines: DataFrame, threshold: int) -> DataFrame:
    """(k, h, own) for every segment that a line posts (own) and every substring that it probes with."""
    parts, rows = threshold + 1, []
    for less in range(parts):
        n = f"(n - {less})"
        for i in range(parts):
            start, size = _bound(n, i, parts), f"({_bound(n, i + 1, parts)} - {_bound(n, i, parts)})"
            for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1):
                # A probe of the line's own length at the segment's own place is what the line posts.
                own = less == 0 and shift == 0
                rows.append(f"named_struct('k', xxhash64({n}, {i}, substring(line, cast({start} + {shift} + 1 as int), cast({size} as int))), 'own', {str(own).lower()})")
    return lines.select("h", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).select("x.k", "h", "x.own")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that different lines share, at least one of which posts there."""
    grouped = keys.groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own"))
    return grouped.filter("low <> high and own").select("k")


def _refined(hot: DataFrame, texts: DataFrame, windows: int) -> DataFrame:
    """(k, h, own, win): lines under all of them but window `win` of `windows`; hot: (h, win) of the level above."""
    child = hot.select("h", F.explode(F.expr(f"sequence(win * {FAN}, win * {FAN} + {FAN - 1})")).alias("win")).distinct()
    rows = []
    for less in (0, 1):
        n = f"(n - {less})"
        start, stop = f"cast(cast({n} as bigint) * win div {windows} as int)", f"cast(cast({n} as bigint) * (win + 1) div {windows} as int)"
        rows.append(f"named_struct('k', xxhash64({n}, win, left(line, {start}), right(line, {n} - {stop})), 'own', {str(less == 0).lower()})")
    return child.join(texts, "h").select("h", "win", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).select("x.k", "h", "x.own", "win")


def candidates(docs: DataFrame, key: str, text: str, threshold: int, min_chars: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(a, b) hashes of lines to verify, (h, line, n) of the lines met, and what is left to pivots: (k, id, n), n being 1 where a line posts."""
    lines = lines_of(docs, key, text).withColumn("n", F.char_length("line")).filter(F.col("n") >= min_chars).select(F.xxhash64("line").alias("h"), "line", "n")
    keys = posted(lines, threshold)
    shared = small(cut(_shared(keys)))
    members = cut(keys.join(shared, "k").distinct())
    texts = cut(lines.join(small(members.select("h").distinct()), "h").dropDuplicates(["h"]))
    pairs, longest, windows, level, rest = None, None, 1, members.withColumn("win", F.lit(0).cast("bigint")), None
    while True:
        width = level.groupBy("k").agg(F.count("*").alias("lines"))
        heat = width.filter(F.col("lines") > HOT).select("k")
        if longest is not None and windows > 2 * longest:
            heat = heat.limit(0)
        own, probe = level.filter("own").select("k", F.col("h").alias("a")), level.select("k", F.col("h").alias("b"))
        heat = cut(heat)
        now = own.join(heat, "k", "left_anti").join(probe, "k").filter("a <> b")
        pairs = now.select("a", "b") if pairs is None else pairs.unionByName(now.select("a", "b"))
        if threshold > 1:
            rest = cut(level.join(heat, "k", "left_semi").groupBy("k", F.col("h").alias("id")).agg(F.max(F.col("own").cast("int")).alias("n")))
        if threshold > 1 or heat.isEmpty():
            break
        if longest is None:
            longest = texts.agg(F.max("n")).first()[0]
        windows *= FAN
        hot = level.join(heat, "k", "left_semi").select("h", "win").distinct()
        level = cut(_refined(hot, texts, windows).distinct())
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), texts, rest


def within(a: str, b: str, threshold: int) -> Column:
    """Is the edit distance of columns a and b at most `threshold`? Banded and bit-parallel, in code points."""
    t, w = threshold, 2 * threshold + 1
    full, top = (1 << w) - 1, 2 * threshold
    # Bit k of a column's words is row j - t + k of the matrix.
    match = " | ".join(f"if(coalesce(get(ca, j - {t} + {k} - 1) = y, false), {1 << k}L, 0L)" for k in range(w))
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    down = f"if(j <= m - {t}, s.d + if((d0 & {1 << top}L) = 0, 1, 0), s.d + cast(shiftright(hp, m - j + {t}) & 1 as int) - cast(shiftright(hn, m - j + {t}) & 1 as int))"
    after = f"named_struct('vp', (hn | ~(shiftright(d0, 1) | hp)) & {full}L, 'vn', shiftright(d0, 1) & hp & {full}L, 'd', {down})"
    step = let("hn", "d0 & s.vp", after)
    step = let("hp", f"(s.vn | ~(d0 | s.vp)) & {full}L", step)
    step = let("d0", f"((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {full}L", step)
    step = let("pm", match, step)
    step = let("y", "get(cb, j - 1)", step)
    step = f"if(s.d > {3 * t}, s, {step})"  # the last rows can take back 2 x threshold at most
    start = f"named_struct('vp', {full & ~((1 << t) - 1)}L, 'vn', 0L, 'd', least({t}, m))"
    run = f"if(n = 0, m, aggregate(sequence(1, n), {start}, (s, j) -> {step}, s -> s.d))"
    run = let("m", "size(ca)", let("n", "size(cb)", f"if(abs(m - n) > {t}, {t + 1}, {run})"))
    chars = lambda c: f"filter(split({c}, ''), c -> c <> '')"
    return F.expr(let("ca", chars(a), let("cb", chars(b), run)) + f" <= {t}")


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, dropped array<int>): numbers (from 0) of the lines of each document that repeat an earlier line.

    Lines of at least `min_chars` code points are linked if they are within `threshold` edits, shorter ones if they
    are equal; empty lines never. Of each connected group the first line, by key and then number, stays. Only
    documents that lose lines have a row. Rows with a null key or text have no lines; rows that repeat a key are
    documents of their own, told apart by `row`, a hash of the text, and with the same text they are one; an empty
    table gives no rows; extra columns are ignored. Lines of any length are compared whole.
    """
    lines = cut(lines_of(docs, key, text).filter("line <> ''").select("doc", "row", "no", *marks()))
    distinct = cut(lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc", "no", "row")).alias("first")))
    maybe, texts, rest = candidates(docs, key, text, threshold, min_chars)

    def verified(some: DataFrame) -> DataFrame:
        sided = some.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
        return sided.filter(within("x", "y", threshold)).select("a", "b")

    groups = components(verified(maybe))
    if rest is not None:
        groups = pivoted(rest, cut(groups), verified, F.col("pn") + F.col("n") > 0)
    classed = distinct.join(groups, F.col("h") == F.col("id"), "left").withColumn("class", F.coalesce("component", "h")).withColumn("half", F.when(F.col("id").isNull(), F.col("g")))
    # Lines with near neighbours are grouped by component, all others by their own 128 bits.
    firsts = classed.groupBy("class", "half").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).filter("all > 1")
    again = classed.join(firsts, (classed["class"] == firsts["class"]) & classed["half"].eqNullSafe(firsts["half"])).select("h", "g", "keep")
    gone = lines.join(again, ["h", "g"]).filter(F.struct("doc", "no", "row") != F.col("keep"))
    return gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("no")).alias("dropped"))


def _with_dropped(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """(r struct of docs' columns, dropped array<int> or null): a row for every row of docs."""
    found = duplicate_lines(docs, key, text, **how)
    rows = docs.select(F.struct("*").alias("r"), F.col(key).alias("k"), F.xxhash64(text).alias("t"))
    return rows.join(found, (F.col("k") == F.col("doc")) & (F.col("t") == F.col("row")), "left").select("r", "dropped")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_lines, n_dropped, dropped): one row for every row of docs. Null texts have no lines; see duplicate_lines."""
    joined = _with_dropped(docs.select(key, text), key, text, **how)
    n_lines = F.greatest(F.lit(0), F.coalesce(F.size(F.split(F.col("r")[text], "\n")), F.lit(0))).cast("long")
    return joined.select(F.col("r")[key].alias(key), n_lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.expr("cast(array() as array<int>)")).alias("dropped"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the repeating lines taken out of `text`; rows, and all other columns, whatever their names, stay. See duplicate_lines."""
    joined = _with_dropped(docs, key, text, **how)
    kept = F.expr(f"array_join(filter(transform(split(r.`{text}`, '\\n'), (x, i) -> if(array_contains(dropped, i), null, x)), x -> x is not null), '\\n')")
    return joined.select(*[F.when(F.col("dropped").isNull(), F.col("r")[c]).otherwise(kept).alias(c) if c == text else F.col("r")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for report() of documents at threshold one: halves meet, single edits are spelled out, links are closed."""
    half = lambda n, i: f"left(line, cast({n} as integer) // 2)" if i == 0 else f"right(line, {n} - {n} // 2)"
    own = " UNION ALL ".join(f"SELECT line, n, n AS m, {i} AS i, {half('n', i)} AS part FROM d WHERE n >= {MIN_CHARS}" for i in (0, 1))
    probe = " UNION ALL ".join(f"SELECT line, n, n - 1 AS m, {i} AS i, {half('(n - 1)', i)} AS part FROM d WHERE n >= {MIN_CHARS}" for i in (0, 1))
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, no, line FROM l WHERE line <> ''),
d AS (SELECT line, length(line) AS n, min({{'doc': doc_id, 'no': no}}) AS first FROM e GROUP BY line),
own AS ({own}), probe AS ({probe}),
met AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n FROM own a JOIN (SELECT * FROM own UNION ALL SELECT * FROM probe) b ON a.m = b.m AND a.i = b.i AND a.part = b.part AND a.line <> b.line),
near AS (SELECT a, b FROM met WHERE CASE WHEN length(b) = n THEN len(list_filter(range(1, n + 1), lambda k: a[k] <> b[k])) <= 1 ELSE len(list_filter(range(1, n + 2), lambda k: left(b, k - 1) || substr(b, k + 1) = a)) > 0 END),
x AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
r(a, b) AS (SELECT line, line FROM d UNION SELECT r.a, x.b FROM r JOIN x ON r.b = x.a),
keep AS (SELECT r.a AS line, min(d.first) AS first FROM r JOIN d ON d.line = r.b GROUP BY r.a),
gone AS (SELECT doc_id, list_sort(list(no)) AS dropped FROM e JOIN keep USING (line) WHERE {{'doc': doc_id, 'no': no}} <> first GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint AS n_lines, coalesce(len(dropped), 0)::bigint AS n_dropped, coalesce(dropped, [])::integer[] AS dropped
FROM documents LEFT JOIN gone USING (doc_id)"""
