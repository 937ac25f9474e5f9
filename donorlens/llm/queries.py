"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.llm import (costpacking, licenses, merkle, mixing, packing, repetition, simhash, spelling, suffixfamily,
                           surrogates, toxicity, urlfilter, vafile)
from donorlens.llm.common import documents


def op2_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(documents(spark, sf_dir), carry=["doc_id"])
    return mix.select("row.doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = surrogates.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), key=surrogates.session_key(spark))
    return made.select("row.doc_id", "text", "n_entities", "entity_types")


def op3_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vafile.top_k(vectors, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op4_license_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the longest repeat decides within the operator; SQL checks it by its limit
    made = repetition.quality(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "n_covered_words")


OP5_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT r, l, i, array_to_string(w[i + 1:i + l], ' ') AS g
  FROM d, (VALUES (3), ({repetition.MIN_REPEAT}), ({repetition.MAX_REPEAT + 1})) v(l),
    unnest(range(greatest(len(w) - l + 1, 0))) u(i)
), rep AS (
  SELECT r, l, i FROM (SELECT r, l, i, count(*) OVER (PARTITION BY r, l, g) AS c FROM win) WHERE c > 1
), cov AS (SELECT r, l, count(DISTINCT i + k) AS n FROM rep, unnest(range(l)) u(k) GROUP BY r, l),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce((SELECT n FROM cov WHERE cov.r = d.r AND l = 3), 0) AS n_repeat_words,
    coalesce((SELECT n FROM cov WHERE cov.r = d.r AND l = {repetition.MIN_REPEAT}), 0) AS n_covered_words,
    EXISTS (SELECT 1 FROM rep WHERE rep.r = d.r AND l = {repetition.MAX_REPEAT + 1}) AS long_repeat
  FROM d LEFT JOIN dup USING (r)
), f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND NOT long_repeat AND n_covered_words <= {repetition.MAX_COVERED} * n_words AS kept
FROM f
"""


def op6_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    # besides the digest the text that remains
    cut = suffixfamily.remove_repeats(documents(spark, sf_dir))
    return cut.withColumn("text", suffixfamily.as_text(F.col("kept"))).drop("kept")


def op8_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = urlfilter.judge(urlfilter.dated_captures(pages), urlfilter.list_changes(pages))
    return judged.withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op11_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.tampered_manifest(documents(spark, sf_dir), tampered).verified()
    hexes = {c: F.lower(F.hex(f)) for c, f in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"),
                                               ("proof_sha256", "proof"), ("folded_root", "version_root"))}
    return made.select(F.col("key").alias("doc_id"), *[h.alias(c) for c, h in hexes.items()],
                       (F.col("version_root") == F.col("root")).alias("verified"))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costpacking.pack_documents(documents(spark, sf_dir))


def op13_spelling_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_simhash_bk_trees": op2_simhash_bk_trees,
        "op3_va_file_top_k": op3_va_file_top_k,
        "op4_license_rare_tokens": op4_license_rare_tokens,
        "op5_suffix_array_repetition": op5_suffix_array_repetition,
        "op6_suffix_array_family": op6_suffix_array_family,
        "op7_certified_packing": op7_certified_packing,
        "op8_temporal_url_filter": op8_temporal_url_filter,
        "op9_zstd_toxicity": op9_zstd_toxicity,
        "op10_mixing_tree": op10_mixing_tree,
        "op11_merkle_versions": op11_merkle_versions,
        "op12_cost_balanced_packing": op12_cost_balanced_packing,
        "op13_spelling_kd_trees": op13_spelling_kd_trees,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_va_file_top_k": OP3_SQL,
        "op4_license_rare_tokens": licenses.oracle_sql(),
        "op5_suffix_array_repetition": OP5_SQL,
        "op8_temporal_url_filter": urlfilter.SQL,
        "op11_merkle_versions": merkle.SQL,
        "op13_spelling_kd_trees": spelling.SQL,
    }
