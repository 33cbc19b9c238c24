"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bloom_lm, centroids, decontaminate, exact_dedup, html_text, impact_search, license_scan, mixing, ngram_join, preference, quality_cnn, sharding, toxicity_gru
from lodestream.llm.common import table
from lodestream.llm.labelled import fold


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    pairs = preference.format_pairs(turns, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)) == 0)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["from"].cast("string"), s["to"].cast("string"))), ";")
    return pairs.withColumns({"chosen_spans": joined(F.col("chosen_spans")), "rejected_spans": joined(F.col("rejected_spans"))})


OP6_SQL = """
WITH t AS (
  SELECT (conv_id - ((conv_id % 2) + 2) % 2) // 2 AS pair_id, ((conv_id % 2) + 2) % 2 = 0 AS is_chosen, conv_id,
         coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(coalesce(role, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS safe_role,
         replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS safe_text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, '<|im_start|>' || safe_role || chr(10) AS head, safe_text || '<|im_end|>' AS body FROM t
), ids AS (
  SELECT pair_id, max(conv_id) FILTER (is_chosen) AS chosen_id, max(conv_id) FILTER (NOT is_chosen) AS rejected_id,
         count(*) FILTER (is_chosen) AS na, count(*) FILTER (NOT is_chosen) AS nb
  FROM t GROUP BY pair_id
), differ AS (
  SELECT a.pair_id, min(a.i) AS i FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.is_chosen AND NOT b.is_chosen
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY 1
), p AS (
  SELECT ids.*, CAST(coalesce(differ.i - 1, least(na, nb)) AS INTEGER) AS n FROM ids LEFT JOIN differ USING (pair_id)
), c AS (
  SELECT r.*, p.n, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, r.i > p.n ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM r JOIN p USING (pair_id)
), s AS (
  SELECT pair_id,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (is_chosen AND i <= n), '') AS prompt,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (is_chosen AND i > n), '') AS chosen,
    coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ';' ORDER BY i) FILTER (is_chosen AND i > n AND role = 'assistant'), '') AS chosen_spans,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (NOT is_chosen AND i > n), '') AS rejected,
    coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ';' ORDER BY i) FILTER (NOT is_chosen AND i > n AND role = 'assistant'), '') AS rejected_spans
  FROM c GROUP BY pair_id
)
SELECT pair_id, chosen_id, rejected_id,
       CASE WHEN chosen_id IS NULL OR rejected_id IS NULL THEN 'unpaired' WHEN na = n AND nb = n THEN 'identical' ELSE 'pair' END AS status,
       n AS n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans
FROM p JOIN s USING (pair_id)
"""


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _predictions(scores: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = quality_cnn.train(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    return _predictions(quality_cnn.score(docs, network), 5, 0, 0.3)


def op9_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity_gru.train(docs, table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return _predictions(toxicity_gru.score(docs, network), 3, 1, 0.7)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op13_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sharding": op3_sharding,
        "op4_html_text": op4_html_text,
        "op5_mixing": op5_mixing,
        "op6_preference": op6_preference,
        "op7_decontaminate": op7_decontaminate,
        "op8_quality_cnn": op8_quality_cnn,
        "op9_toxicity_gru": op9_toxicity_gru,
        "op10_license_scan": op10_license_scan,
        "op11_impact_search": op11_impact_search,
        "op12_centroids": op12_centroids,
        "op13_bloom_lm": op13_bloom_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_preference": OP6_SQL, "op11_impact_search": impact_search.ORACLE, "op12_centroids": centroids.oracle()}
