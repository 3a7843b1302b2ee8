"""The registered queries of this subpackage, one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.llm import fmindex, html, media, minhash, mixing, quality, sharding, suffix, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.clip_rows(media.films(_table(spark, sf_dir, "embeddings")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced_sample(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.sharded(docs, sharding.map_path(docs, "documents"))


def sharding_slot_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the map of op7 is made of."""
    return sharding.slot_bytes(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_toxicity, op3_minhash, op4_suffix_array, op5_media, op6_mixing, op7_sharding, op8_decontamination, op9_quality, op10_token_counts, pipeline, sharding_slot_bytes)}

_WORDS = "regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+')"
# windows that stand in the corpus twice, or phrases of the benchmark; those that touch or overlap are one stretch
_ISLANDS = """, marked AS (SELECT *, CASE WHEN s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {n}, -1) THEN 1 ELSE 0 END AS new FROM hits),
placed AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""

#: Trained models, samples, parsers and vocabularies have no SQL; tests/llm holds those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "sharding_slot_bytes": f"SELECT coalesce(('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {sharding.SLOTS}, 0)::INTEGER AS slot, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, count(*) AS records FROM documents GROUP BY 1",
    "op4_suffix_array": f"""WITH w AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS s, md5(array_to_string(w[i:i + {suffix.MIN_WORDS - 1}], ' ')) AS h FROM w, unnest(range(1, len(w) - {suffix.MIN_WORDS - 2})) AS t(i)),
hits AS (SELECT doc_id, s FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1))"""
    + _ISLANDS.format(n=suffix.MIN_WORDS)
    + f" SELECT doc_id, min(s) AS start_word, max(s) + {suffix.MIN_WORDS} AS end_word, max(s) + {suffix.MIN_WORDS} - min(s) AS n_words FROM placed GROUP BY doc_id, island",
    "op8_decontamination": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), phrases AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {fmindex.PHRASE - 1}], ' ') AS p FROM b, unnest(range(1, len(w) - {fmindex.PHRASE - 2})) AS t(i)),
w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, i - 1 AS s, array_to_string(w[i:i + {fmindex.PHRASE - 1}], ' ') AS p FROM w, unnest(range(1, len(w) - {fmindex.PHRASE - 2})) AS t(i)),
matched AS (SELECT doc_id, s, item_id FROM g JOIN phrases USING (p)), hits AS (SELECT DISTINCT doc_id, s FROM matched)"""
    + _ISLANDS.format(n=fmindex.PHRASE)
    + f""", spans AS (SELECT doc_id, island, min(s) AS a, max(s) + {fmindex.PHRASE} AS b FROM placed GROUP BY doc_id, island)
SELECT spans.doc_id, a AS start_word, b AS end_word, b - a AS n_words, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM spans JOIN matched ON spans.doc_id = matched.doc_id AND s >= a AND s < b GROUP BY spans.doc_id, a, b""",
}
