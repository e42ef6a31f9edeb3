"""Queries of the corpus operators over the test tables, each through its operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seglume.llm import audio, decontaminate, licenses, merkle, mixing, quality, repeats, secrets, sharding, simhash, spelling, tokenfile, urls
from seglume.session import table


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op2_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, d, "documents")))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def token_params() -> tokenfile.TokenParams:
    import public_tokenizers

    return tokenfile.TokenParams(public_tokenizers.path("word_bpe_49k.json"))


def op5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenfile.encode(table(spark, d, "documents"), token_params())


def op6_hilbert_shards(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents"))


def op7_secrets(spark: SparkSession, d: str) -> DataFrame:
    return secrets.summary(secrets.scan(table(spark, d, "documents")))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def op9_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return urls.judge(urls.dated_pages(pages), urls.dated_list(pages))


def op10_audio_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no sound, so each whole text is played as notes."""
    return audio.align(table(spark, d, "documents"), "doc_id", "text", audio.notes())


def op11_merkle(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(table(spark, d, "documents"))


def op12_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def op13_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.dedup(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  absent together with this folder

    return {f.__name__: f for f in (op1_simhash, op2_licenses, op3_decontamination, op4_source_mix, op5_tokens, op6_hilbert_shards, op7_secrets, op8_quality, op9_url_filter, op10_audio_fingerprints, op11_merkle, op12_spelling, op13_repeats, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": mixing.mix_sql(), "op6_hilbert_shards": sharding.shard_sql(), "op9_url_filter": urls.judge_sql(), "op11_merkle": merkle.manifest_sql(), "op12_spelling": spelling.variants_sql()}
