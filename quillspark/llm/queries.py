"""The opN_<name> queries: thin wrappers that return the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return pack(docs, tokenizer, ranks)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text, fit_on

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages, fit_on(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=2, share=(80, 100))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, masked_text, parsed, text_part

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = rows.unionByName(probe)
    chats = format_chats(rows.withColumn("parts", text_part(F.col("text"))))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select(
        "conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, kept_text=False).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model)
    predicted = (scored["score"] >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", quality_model.held_out("doc_id").alias("held_out"), "score", predicted)


def op9_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .viterbi import encode, read_back

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    docs = docs.select("doc_id", "text", read_back(F.col("ids"), model).alias("r"))
    same = (F.col("r.text") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return docs.select("doc_id", "r.n_ids", F.col("r.crc32").alias("ids_crc32"), same)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import scratch_path
    from .token_shards import read_slots, write_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    layout = write_shards(docs, scratch_path(spark, "token-shards"), tokenizer, ranks, key=20_240_601)
    return read_slots(spark, layout).select("slot", "shard", "position", "sequence", "n_tokens", "ids_crc32", "slot_is_keyed")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extraction": op6_html_extraction,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op10_token_shards": op10_token_shards,
    "op9_sentencepiece_viterbi": op9_sentencepiece_viterbi,
}
