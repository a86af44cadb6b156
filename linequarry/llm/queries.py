"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .audit import SQL as AUDIT_SQL
from .resampling import SQL as RESAMPLE_SQL
from .secrets import sql as secrets_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(_docs(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_shards, write_shards

    return read_shards(write_shards(_docs(spark, sf_dir)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_quality

    return judge_quality(_docs(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeat_removal

    return repeat_removal(_docs(spark, sf_dir)).drop("kept")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(_docs(spark, sf_dir)).drop("text_hash", "stays")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digests

    return secret_digests(_docs(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_docs(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL_OP4 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_SQL_COMPONENTS = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
lowest AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""

SQL_OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9::DOUBLE),
{_SQL_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, m.vec_id) AS component_id, coalesce(component, m.vec_id) = m.vec_id AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN lowest ON lowest.id = m.vec_id
"""

SQL_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
{_SQL_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON lowest.id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_embedding_neardup, op3_bpe, op4_exact_dedup, op5_quality, op6_wavelet_shards, op7_suffix_dedup, op8_ngram_jaccard, op9_secret_scans, op10_sharding, op11_filter_audit, op12_source_mixing, op13_importance_resampling)}
ORACLE = {"op2_embedding_neardup": SQL_OP2, "op8_ngram_jaccard": SQL_OP8, "op4_exact_dedup": SQL_OP4, "op9_secret_scans": secrets_sql(), "op11_filter_audit": AUDIT_SQL, "op13_importance_resampling": RESAMPLE_SQL}
