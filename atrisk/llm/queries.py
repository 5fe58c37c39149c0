"""The corpus operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrisk.llm import align, bpe, chat, fingerprint, html_text, jaccard, langid, media, negatives, packing, pii, substrings, urlfilter
from atrisk.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.train(docs.filter(F.coalesce(~held_out, F.lit(True))))
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.surrogates(docs, "surrogates")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urlfilter.filter_captures(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages))
    return found.withColumn("lists", F.array_join("lists", ","))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.derived(table(spark, sf_dir, "conversations")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


_ALL = [op1_language_id, op2_pii_surrogates, op3_media_columns, op4_url_filter, op5_fingerprints, op6_bpe, op7_ngram_jaccard, op8_tool_calls, op9_main_text, op10_packing, op11_suffix_dedup, op12_hard_negatives, op13_token_alignment]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urlfilter.ORACLE, "op8_tool_calls": chat.ORACLE, "op12_hard_negatives": negatives.ORACLE}
