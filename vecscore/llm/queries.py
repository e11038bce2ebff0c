"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from vecscore.llm import chat_format, exact_dedup, line_dedup, mixing, near_dedup, oracles, packing, quality, repeats, url_filter, weak_labels
from vecscore.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


#: What both turns of the added conversation say.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    types = {f.name: f.dataType for f in rows.schema.fields}
    added = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(HARD_TEXT)}
    hard = spark.range(2).select(*[v.cast(types[k]).alias(k) for k, v in added.items()])
    records = chat_format.from_rows(rows.unionByName(hard))
    out = chat_format.format_chats(chat_format.canonical_turns(records))
    out = out.withColumn("pieces", chat_format.split_turns(F.col("formatted")))
    turns = F.transform("pieces", chat_format.read_turn)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat_format.unescape(F.substring(F.get("pieces", s["turn"]), s["inside"] + 1, s["length"]))), "")
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).drop("runs")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.weak_label_scores(table(spark, sf_dir, "documents"))


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes", "n_chunks")


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_quality_rules, op3_chat_format, op4_line_dedup, op5_mix_sources, op6_packing, op7_near_dedup, op8_weak_labels, op9_remove_repeats, op10_exact_dedup)
}
ORACLES = {"op2_quality_rules": oracles.rules(), "op3_chat_format": oracles.chat(HARD_TEXT), "op4_line_dedup": oracles.lines(), "op10_exact_dedup": oracles.EXACT}
