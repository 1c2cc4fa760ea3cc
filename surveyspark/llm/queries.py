"""Registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import (
    alignment, automata, conversations, jaccard, language, mixing, quality, secrets, sharding, suffix_array, tiling, topk, url_sql, urls)
from surveyspark.llm.texts import table

COUNT = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', chr(1), 'g'), '[\x20\x09-\x0D]+', '', 'g'))"


def _removed():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 400 bytes that occur twice."""
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_units").alias("n_bytes"), _removed(), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 3, 1, 2, repeating, and share 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "epochs")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and P(good) of all documents, and whether the pipeline keeps them."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 20: its 20 best inner products with all other rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.expr("vec_id % 20 = 0"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 90 % Jaccard similarity of their 3-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.Params(words=3, percent=90, part=200))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of 5 regions with 2 racks each, and where they go with a 41st shard."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items covered by tiles in each document."""
    return tiling.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 50 words that an earlier document holds."""
    return automata.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_units").alias("n_words"), _removed(), F.sha2("kept", 256).alias("kept_sha256"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages allowed or blocked, by rules or by the ratio of two character models."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under two public tokenizers, aligned, and how common their links are."""
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by a checksum and repaired at the least cost."""
    return conversations.audit(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array, op2_mixing, op3_quality, op4_top_k, op5_language, op6_jaccard_join, op7_sharding, op8_secrets, op9_decontamination,
    op10_suffix_automata, op11_url_filter, op12_alignment, op13_conversations)}

SQL = {
    "op11_url_filter": url_sql.twin(),
    "op4_top_k": """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
       FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM d, unnest(range(1, greatest(1, len(w) - 2) + 1)) t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op10_suffix_automata": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) t(i)),
 r AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM v),
 g AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 50)) t(p) WHERE again),
 a AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce((SELECT string_agg(w[p], ' ' ORDER BY p) FROM unnest(range(1, len(w) + 1)) t(p)
                        WHERE gone IS NULL OR NOT list_contains(gone, p)), '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)""",
    "op2_mixing": rf"""
WITH s AS (SELECT doc_id, source, CAST({COUNT} AS BIGINT) AS size,
                  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
 g AS (SELECT source, sum(size) AS ss FROM s GROUP BY source),
 w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM g),
 c AS (SELECT *, sum(2 * ss) OVER o AS caps, sum(w) OVER o AS ws, sum(ss) OVER () * 150 AS t, sum(w) OVER () AS aw
       FROM w WINDOW o AS (ORDER BY 2.0 * ss / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT coalesce(arg_min(CAST(t - 100 * coalesce(caps, 0) AS DOUBLE) / 100 / (aw - coalesce(ws, 0)), 2.0 * ss / w)
                       FILTER ((t - 100 * coalesce(caps, 0)) * w <= 200 * ss * (aw - coalesce(ws, 0))), 1e300) AS level FROM c),
 q AS (SELECT source, ss, least(w * level, CAST(2 * ss AS DOUBLE)) AS target FROM c, l),
 r AS (SELECT s.*, ss, target, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole,
              sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
       FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target + 0.5) - whole * ss - before)) AS BIGINT) AS taken FROM r""",
}
