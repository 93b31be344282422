"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archives, htmltext, licenses, lm, mixing, neardup, ngramjoin, packing, repeats, topk, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), remains=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_components(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html": op1_html,
    "op2_lm": op2_lm,
    "op3_packing": op3_packing,
    "op4_neardup": op4_neardup,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_licenses": op7_licenses,
    "op8_repeats": op8_repeats,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_alignment": op13_alignment,
}

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nosrc, coalesce(source, '') AS src,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT nosrc, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY nosrc, src) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / weight AS stop_at,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w
  FROM w
), f AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(stop) OVER o, 0)) / (all_w - coalesce(sum(weight) OVER o, 0)) AS lev
  FROM l WINDOW o AS (ORDER BY stop_at, nosrc, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT nosrc, src, source_size, least(stop, weight * (SELECT lev FROM f WHERE lev <= stop_at ORDER BY stop_at, nosrc, src LIMIT 1)) AS target
  FROM f
), c AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.nosrc, d.src ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t USING (nosrc, src)
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM c
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = vec_id) AS BIGINT) AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id) AS kept
FROM embeddings
"""

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
         list_reduce(list_transform(range(1, 41, 5), lambda i: list_reduce(list_transform([15, 10, 5, 0],
           lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, i, 5) AS INTEGER) >> k) & 31 AS INTEGER) + 1, 1)),
           lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
  FROM p
), f AS (
  SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS n FROM d
  WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST, url)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to
FROM f
"""

ORACLES = {"op12_warc": OP12_SQL, "op4_neardup": OP4_SQL, "op6_topk": OP6_SQL, "op5_mixing": OP5_SQL}
