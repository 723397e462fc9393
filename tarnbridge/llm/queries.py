"""The queries opN_<name> with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_files, html_blocks, imatch, licenses, mixing, near_copies, packing, quality, sharding, urls
from .common import read

SHARDS = 16
RULES = (urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"), urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "/es/", "block"))

#: Domains of sources, by the sources' numbers, and target weights by path; a missing weight is 1.
DOMAINS = {"web": range(0, 10), "reference": range(10, 15), "forum": range(15, 20)}
WEIGHTS = {("web",): 5.0, ("reference",): 3.0, ("forum",): 2.0, ("web", "en"): 4.0, ("reference", "en"): 3.0, ("forum", "en"): 3.0, ("web", "en", "src0"): 2.0}


def domain_of(source: Column) -> Column:
    out = F.lit("other")
    for name, numbers in DOMAINS.items():
        out = F.when(source.isin([f"src{n}" for n in numbers]), name).otherwise(out)
    return out


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), as_crc=True)
    return packing.pack(pieces, tasks=packing.tasks_for(docs))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(read(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), arrow_files.ids_folder(spark)
    manifest = arrow_files.write_ids(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return arrow_files.read_ids(manifest, folder, docs.schema["doc_id"].dataType, as_crc=True)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    mixed = mixing.mix(docs, domain_of(F.col("source")), WEIGHTS, share=1.0, tokens=F.col("__n_tokens"))
    return mixed.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__budget").alias("leaf_budget"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), sharding.even_tree(SHARDS), sharding.even_tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies.group_near_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_best_fit_packing, op3_document_fingerprints, op4_html_extraction, op5_token_files, op6_source_mixing, op7_quality_rules, op8_hash_tree_sharding, op9_url_filter, op10_simhash_near_dedup)}


def _url_sql() -> str:
    def any_of(terms: tuple[str, ...]) -> str:
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)" for t in terms)

    by_length = sorted(RULES, key=lambda r: -len(r.name))
    when = lambda value: " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in by_length)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH rest AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {when(lambda r: r.name)} END AS rule, CASE {when(lambda r: r.verdict)} END AS by_rule FROM parts)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN ({any_of(urls.STRICT)}) >= 1 OR ({any_of(urls.SOFT)}) >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""


SQL = {"op9_url_filter": _url_sql()}
