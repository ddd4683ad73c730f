"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import align, bpe, chains, chat, decontaminate, html, infill, lm, neardup, oracle, quality, repeats, secrets, urls
from tidewatch.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: The two vocabularies that are aligned.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


#: Rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_records(turns: DataFrame) -> DataFrame:
    """conv_id, turn, record: each row of a turn table as JSON in one of four layouts, as its sources would have it.

    Shared role names are written as the layout has them (human, gpt); other roles go to a layout without such names.
    """
    made = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    role, text = F.col("role").cast("string").alias("role"), F.col("text").cast("string")
    speaker = F.when(F.col("role") == "user", "human").otherwise("gpt")
    flat = made(F.struct(role, text.alias("text")))
    listed = made(F.struct(F.array(F.struct(role, text.alias("content"))).alias("messages")))
    spoken = made(F.struct(F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations")))
    nested = made(F.struct(F.struct(role.alias("speaker"), F.struct(text.alias("content")).alias("body")).alias("turn")))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    record = F.when(kind == 0, flat).when(kind == 1, listed).when((kind == 2) & F.col("role").isin("user", "assistant"), spoken).otherwise(nested)
    return turns.select("conv_id", "turn", record.alias("record"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    # The added conversation is one record of a layout with a prompt and a response.
    extra = spark.createDataFrame([(-7, 0, json.dumps({"prompt": said, "response": said}))], "conv_id long, turn long, record string")
    return chat.digest_chats(chat.canonical_turns(chat_records(turns).unionByName(extra)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.shared_passages(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_infills(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_html": op2_html,
    "op3_urls": op3_urls,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_chat": op6_chat,
    "op7_passages": op7_passages,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_language_model": op11_language_model,
    "op12_align": op12_align,
    "op13_infill": op13_infill,
}
ORACLE: dict[str, str] = dict(oracle.ORACLE)
