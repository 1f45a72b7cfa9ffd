"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.llm import alignment, bpe, chat, decontam, importance, langid, line_dedup, monoid_bpe, neardup, quality, suffix_dedup, syncmers, warc
from netgauge.llm.common import table
from netgauge.llm.oracles import ORACLES


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), grow=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.by_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate(table(spark, sf_dir, "conversations"))
    return r.select("conv_id", "speaker", "block", "part", "n_turns", "first_char", "n_chars", "masked_chars", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(table(spark, sf_dir, "documents"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_monoid_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monoid_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_syncmers, op3_line_dedup, op4_decontamination, op5_language, op6_quality, op7_warc, op8_perspectives, op9_minhash, op10_suffixes, op11_alignment, op12_monoid_bpe, op13_resampling, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
