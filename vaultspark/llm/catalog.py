"""Queries op1 to op13: thin applications of the operators to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.llm import bpe, chat, compression_quality, embedding_dedup, html_text, licenses, line_dedup, merkle, mixing, permutation_index, simhash, toxicity, wand
from vaultspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each, by the contract's weights."""
    return mixing.annotate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation and one made of control strings, and reads the result back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(own)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; digests of the ids and of the decoded bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files source/lang/doc_id, zero-padded; one that ends in a notice is its directory's licence file."""
    path = F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 19, "0"))
    found = licenses.scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"), licence_file=licenses.LAST_LINE)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "own_licence", "own_score", "own_unit", "own_line", "licence", "inherited_from")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by three-word shingles and three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line of any document within one edit."""
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every vec_id divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, each row's proof, and where it leads from a row that may be tampered with."""
    docs = table(spark, sf_dir, "documents")

    def leaf(n_chars: Column) -> Column:
        return merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    n = F.col("n_chars").cast("decimal(20,0)")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(n + 1)).otherwise(leaf(n))
    found = merkle.manifest(docs, leaf(n), keep=(claimed.alias("claimed"),))
    folded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wand.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by dictionaries learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", compression_quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat, op3_bpe, op4_licenses, op5_simhash, op6_line_dedup, op7_embedding_dedup, op8_html_text, op9_toxicity, op10_permutation_index, op11_merkle, op12_wand, op13_compression_quality)}
_LOOSE = r"<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<ROLE:|<\\*</ROLE>>"

ORACLES: dict[str, str] = {
    "op2_chat": f"""
WITH own AS (SELECT * FROM (VALUES (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM own),
s AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_LOOSE}')) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE length('<<ROLE:' || role || '>>') + 11 END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::bigint AS formatted_chars
FROM s GROUP BY conv_id""",
    "op4_licenses": licenses.oracle(),
    "op6_line_dedup": line_dedup.oracle(),
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
x AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, x.b FROM r JOIN x ON r.b = x.a),
n AS (SELECT a, count(*) AS n FROM x GROUP BY a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, c AS component_id, vec_id = c AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id""",
    "op11_merkle": """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, [doc_id::varchar, source, lang] AS head, text, list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
d AS (SELECT doc_id, lang, sha256(array_to_string(list_transform(list_concat(head, [n_chars::varchar, text]), lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS leaf,
  sha256(array_to_string(list_transform(list_concat(head, [(n_chars::hugeint + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::varchar, text]), lambda x: coalesce(strlen(x) || ':' || x, '-')), '')) AS claimed FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
trees(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[(i + 1):(i + 2)], ''))) FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM trees WHERE len(nodes) = 1),
top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM subroots
  UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(array_to_string(nodes[(i + 1):(i + 2)], ''))) FROM top WHERE len(nodes) > 1),
steps AS (
  SELECT p.doc_id, p.lang, p.pos, t.level, (p.pos >> t.level) % 2 AS side, coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') AS sibling
  FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, 100 + t.level, (s.pos >> t.level) % 2, coalesce(t.nodes[xor(s.pos >> t.level, 1) + 1], '')
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top t ON len(t.nodes) > 1),
proofs AS (SELECT p.lang, p.pos, p.doc_id, p.leaf, p.claimed, coalesce(list(struct_pack(side := side, sibling := sibling) ORDER BY level) FILTER (level IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang AND p.pos = s.pos GROUP BY ALL),
folds(lang, pos, k, acc) AS (
  SELECT lang, pos, 0, claimed FROM proofs
  UNION ALL SELECT f.lang, f.pos, k + 1, sha256(CASE WHEN path[k + 1].side = 1 THEN path[k + 1].sibling || acc ELSE acc || path[k + 1].sibling END)
  FROM folds f JOIN proofs p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos WHERE k < len(path)),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(array_to_string(list_transform(p.path, lambda x: x.sibling), '')) AS proof_sha256, f.acc AS folded_root, f.acc = root.root AS verified
FROM proofs p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN folds f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.k = len(p.path) CROSS JOIN root""",
    "op12_wand": """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::bigint AS n FROM held GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n)::bigint AS total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM held, stats GROUP BY term, docs),
norms AS (SELECT doc_id, 10 + (90 * n * docs) // total AS m FROM sizes, stats),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint AS score FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::int AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10""".replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
}
