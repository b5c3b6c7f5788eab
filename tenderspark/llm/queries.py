"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, language_id, license_scan, line_dedup, mixing, pivot_dedup, quality, simhash, threshold_topk, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.roundtrip(_table(spark, sf_dir, "documents"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(_table(spark, sf_dir, "embeddings"))


def pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"))


def simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language,
        "op2_quality_classifier": rating,
        "op3_byte_bpe": bpe,
        "op4_threshold_topk": topk,
        "op5_pivot_near_dedup": pivots,
        "op6_source_mixing": mixture,
        "op7_license_scan": licenses,
        "op8_token_store": store,
        "op9_simhash_near_dedup": simhashes,
        "op10_line_dedup": line_runs,
    }


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

PIVOT_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id,
       vec_id <= coalesce(m.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM w),
f AS (SELECT *, CAST(coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS full_,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM o),
g AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * full_) / open_ AS level FROM f),
water AS (SELECT arg_min(level, place) AS water FROM g WHERE level * weight < 2 * source_size),
t AS (SELECT source, source_size, CAST(least(2.0 * source_size, coalesce(water * weight, 2.0 * source_size)) AS DOUBLE) AS target FROM g LEFT JOIN water ON true),
m AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS times FROM t),
c AS (SELECT d.doc_id, d.size, m.source_size, m.target, m.times, m.target - m.times * m.source_size AS left_,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before_
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN left_ > 0 AND before_ + size / 2.0 <= left_ THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

#: Every run of at most 10 lines that are not blank, with 10 words or more; the later copies' lines go.
LINES_SQL = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
l AS (SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS seq
      FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
""" + ",\n".join(
    f"r{k} AS (SELECT doc_id, seq, {k} AS size, string_agg(line, chr(10)) OVER w AS run, sum(words) OVER w AS words, count(*) OVER w AS n "
    f"FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING))"
    for k in range(1, 11)
) + """,
runs AS (""" + " UNION ALL ".join(f"SELECT * FROM r{k} WHERE n = {k} AND words >= 10" for k in range(1, 11)) + """),
copies AS (SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, seq) AS copy FROM runs),
late AS (SELECT DISTINCT doc_id, unnest(range(seq, seq + size)) AS seq FROM copies WHERE copy > 1),
gone AS (SELECT l.doc_id, list(l.ln) AS lns, count(*) AS n FROM l JOIN late USING (doc_id, seq) GROUP BY l.doc_id),
kept AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY ln) AS text, bool_or(regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS more
         FROM raw JOIN gone ON gone.doc_id = raw.doc_id WHERE NOT list_contains(gone.lns, ln) GROUP BY raw.doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       md5(CASE WHEN gone.n IS NULL THEN d.text WHEN kept.more THEN kept.text ELSE '' END) AS text_md5
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_threshold_topk": TOPK_SQL, "op5_pivot_near_dedup": PIVOT_SQL, "op6_source_mixing": MIXING_SQL, "op10_line_dedup": LINES_SQL}
