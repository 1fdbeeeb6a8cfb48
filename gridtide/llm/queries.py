"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import decontam, kk_shards, langid, line_chunks, mil_quality, pfair_mix, phrase_streams, pii_votes
from gridtide.llm import ranked_search, risk_rules, simhash_vptree, sstable, url_filter
from gridtide.llm.shared import crc32_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.fingerprint_components(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc32_mod("doc_id", 5) != 0)
    scored = mil_quality.with_score(docs.select("doc_id", "text"), mil_quality.fit_quality_model(docs, labels))
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs.filter(crc32_mod("doc_id", 4) != 2))
    out = langid.predict_language(docs, model)
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: op1's rules: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.unwanted_hosts(pages).withColumn("flag", F.lit(url_filter.LISTED))
    return url_filter.judge(pages, listed.union(url_filter.rule_entries(spark, RULES)))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.without_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_passages", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents")).drop("in_share")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_votes.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def added(kind: str, name: str) -> Column:
        return F.size(F.filter("added", lambda s: s["kind"] == kind)).cast("long").alias(name)

    counts = [count(k) for k in pii_votes.BASE] + [added("secret", "n_secret"), added("email", "n_added_email"), added("phone", "n_added_phone")]
    base = F.sha2(pii_votes.spelled(F.col("base")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii_votes.spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kk_shards.balanced(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_streams.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_chunks": op2_line_chunks,
    "op2_line_passages": op2_line_passages,
    "op3_simhash": op3_simhash,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_token_shards": op7_token_shards,
    "op8_quality_mil": op8_quality_mil,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_sharding": op12_sharding,
    "op13_collocations": op13_collocations,
}

#: op1 in DuckDB: the rules and the block list as relations, the longest fitting rule by row number.
OP1_SQL = f"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
l AS (SELECT DISTINCT regexp_extract(host, '{url_filter.UNWANTED_HOST}', 1) AS host FROM u),
fit AS (SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
               row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC) AS n
        FROM u JOIN r ON ('.' || u.host) LIKE ('%.' || r.host) AND starts_with(u.path, r.path)),
bad AS (SELECT DISTINCT u.host FROM u JOIN l ON l.host <> '' AND (u.host = l.host OR ends_with(u.host, '.' || l.host)))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       b.host IS NOT NULL AS listed
FROM u LEFT JOIN fit f ON f.n = 1 AND f.page_id = u.page_id AND f.host = u.host AND f.path = u.path LEFT JOIN bad b ON b.host = u.host
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_line_chunks": line_chunks.ORACLE,
    "op2_line_passages": line_chunks.PASSAGES_ORACLE,
    "op4_pfair_mix": pfair_mix.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op13_collocations": phrase_streams.ORACLE,
}
