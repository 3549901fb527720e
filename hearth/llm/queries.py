"""The queries of the numbered operators over the tables, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from . import chat, decontaminate, filter_audit, importance, langid, line_dedup, lm_score, near_dup, piece_codec, quality, secrets, simhash, warc_fixity
from .common import crc_mod
from .oracles import SQL

#: Where the public tokenizers' files are; HEARTH_TOKENIZERS names another folder.
TOKENIZERS = os.environ.get("HEARTH_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # null-safe: a document without an id is never learned from
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2), PIECES, sample_by=("doc_id", "text"))
    return langid.predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.counted(piece_codec.encode(docs, PIECES)).select("doc_id", "ids", "n_ids", "parity", "round_trip")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    found = chat.format_chats(turns.unionByName(more)).withColumn("back", chat.parse(F.col("formatted")))
    # what the mask covers, cut out of the rendered string itself
    masked = F.transform("loss_spans", lambda s: chat.unescape(F.col("formatted").substr((s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    loss = F.array_join(masked, "")
    text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip"
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), RANKS)
    part = lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda x: ~x["kind"].isin("random", "part")), part), ",")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", part), ",").alias("spans")
    )


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(table(spark, sf_dir, "documents"), size=2, percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["begin"], x["end"])), ",")
    return cut.select("doc_id", F.size("removed").cast("long").alias("n_removed"), size.alias("removed_chars"), spans.alias("removed_spans"), "text")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm_score.fit(docs.where(crc_mod("doc_id", 7) != 2), PIECES)
    scored = lm_score.score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Records of an archive, on average.
ARCHIVE_RECORDS = 512


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage: some bodies altered, some records missing, some extra."""
    of = F.col("page_id") % 101
    kept = pages.where(of.isNull() | (of != 11)).withColumn("html", F.when(of == 7, F.concat("html", F.lit("."))).otherwise(F.col("html")))
    return kept.unionByName(pages.where(of == 13).withColumn("url", F.concat("url", F.lit("#copy"))))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = max(1, -(-pages.count() // ARCHIVE_RECORDS))
    path = new_path(spark, "warc-replica")
    warc_fixity.write(damaged_copy(pages), path, archives)
    return warc_fixity.audit(warc_fixity.build(pages, archives), warc_fixity.build_from_files(spark, path))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024)


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.find(table(spark, sf_dir, "documents"), size=3, max_bits=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_decontaminate, op3_sentencepiece, op4_quality_rules, op5_chat_format, op6_secrets, op7_minhash_dedup, op8_line_dedup, op9_lm_score, op10_warc_fixity, op11_filter_audit, op12_importance, op13_simhash_dedup)
}
