"""A query per corpus operator over the driver's tables, in the form its contract asks for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keycast.llm import oracles

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query; without `sql` it is tested against brute force in tests/llm."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_collision_counting_neighbours")
def op1_collision_counting_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.ann import nearest_every

    return nearest_every(_table(spark, sf, "embeddings"), every=100, k=10)


@query("op2_template_removal")
def op2_template_removal(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.html import main_text

    return main_text(_table(spark, sf, "pages"))


@query("op3_bootstrapped_personal_data")
def op3_bootstrapped_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.pii import report

    return report(_table(spark, sf, "documents"))


@query("op4_prefix_token_counts")
def op4_prefix_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.prefix_tokens import token_counts

    return token_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op5_minhash_coordinate_join")
def op5_minhash_coordinate_join(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.minhash import near_duplicates

    found = near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "n_links")


@query("op6_imatch_lexicons")
def op6_imatch_lexicons(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.imatch import compared

    return compared(_table(spark, sf, "documents"))


@query("op7_ranked_token_files")
def op7_ranked_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.tokenfile import round_trip

    return round_trip(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_apportioned_mix")
def op8_apportioned_mix(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.mixing import mix

    return mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op9_best_two_fit_packing")
def op9_best_two_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.encoding import MANY
    from keycast.llm.packing import pack_documents

    return pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), most=MANY)


@query("op10_ngram_toxicity")
def op10_ngram_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.toxicity import toxicity

    return toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op11_rare_token_licences", oracles.licence_sql())
def op11_rare_token_licences(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.licences import licence_scan

    return licence_scan(_table(spark, sf, "documents")).drop("found")


@query("op12_centroid_prefix_trie", oracles.TRIE_SQL)
def op12_centroid_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.turn_trie import prefix_trie

    return prefix_trie(_table(spark, sf, "conversations"))


@query("op13_trie_filter_audit", oracles.audit_sql())
def op13_trie_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    from keycast.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
