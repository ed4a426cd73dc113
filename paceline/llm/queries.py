"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import chat, codes, fim, forest, html, mixing, packing, pii, quality, simhash, topk, warc
from paceline.llm import lines as line_dedup
from paceline.llm.text import read
from paceline.session import cut, own_place


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    out = cut(chat.conversations(chat.reply_chain(rows)))
    turns = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = out.select(
        F.col("tree").alias("conv_id"), F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.with_bitmap(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = line_dedup.apply_bitmap(F.col("text"), F.col("keep_runs"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_place(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    # responses answer from their payloads, revisits from their headers alone
    responses = warc.read(spark, path).where(F.col("record_type") == "response")
    responses = responses.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
    revisits = warc.read(spark, path, payload=False).where(F.col("record_type") == "revisit")
    return responses.unionByName(revisits.select(responses.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codes.compress(read(spark, sf_dir, "embeddings"))
    rows = codes.with_label_error(done.rows).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error")
    return rows.withColumn("codebooks_sha256", F.lit(codes.books_digest(done.books)))


_ALL = (
    op1_html_extraction, op2_packing, op3_chat_formatting, op4_mixing, op5_simhash, op6_top_k, op7_pii, op8_line_dedup,
    op9_warc, op10_quality_rules, op11_minhash_forest, op12_fill_in_middle,
    op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
