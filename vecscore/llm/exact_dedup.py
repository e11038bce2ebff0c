"""Exact dedup by content-defined chunk recipes.

A text, with A to Z lower-cased, is cut where its own content says so (after a line end or a sentence end that
certain letters follow). Each chunk gets a 64-bit identifier. The identifiers are verified over the whole
corpus: no identifier may stand for chunks that differ in a second 64-bit hash with a seed of its own; where
one does, all are made again with another seed. What moves between executors is then a document's list of
identifiers, never its text; documents with equal lists form a group. SHA-256 is a column of the result and decides nothing.

Defined cases: null text counts as empty, and empty texts are equal. Of a group the row with the largest id stays;
rows that repeat both id and text are one document, so all of them say kept and all count in group_size. Null ids
never stay where the group has another id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.llm.common import lower_az, suspects, written

#: A chunk runs for MIN_CHUNK characters or more, up to a cut or to MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 8192
CUT = r"(?:\n|[.!?] [a-h])"


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of text, in order; together they are the text. An empty text has none."""
    pattern = rf"(?s).{{{min_chunk},{max_chunk}}}?{CUT}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def row_keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """128 bits that tell rows with different ids or texts apart."""
    return {"key": F.xxhash64(doc_id, text), "key2": F.xxhash64(F.lit(2), text, doc_id)}


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **sizes: int) -> DataFrame:
    """A row for each document: doc_id, n_bytes, text_sha256, and of each chunk its identifier and what verifies it."""
    norm = docs.select(F.col(id_col).alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"), F.col(text_col).alias("raw"))
    cut = norm.withColumn("chunk", chunks(F.col("norm"), **sizes))
    return cut.select(
        "doc_id",
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform("chunk", lambda c: F.xxhash64(F.lit(seed), c)).alias("ids"),
        F.transform("chunk", lambda c: F.xxhash64(F.lit(f"check {seed}"), c)).alias("checks"),
        *[k.alias(n) for n, k in row_keys(F.col("doc_id"), F.col("raw")).items()],
    )


def clashes(found: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk. Each task sends one row an identifier, however often its chunk is copied."""
    pairs = found.select(F.explode(F.arrays_zip("ids", "checks")).alias("c")).select("c.ids", "c.checks")
    return pairs.groupBy("ids").agg(F.min("checks").alias("low"), F.max("checks").alias("high")).filter("low <> high")


def grouped(docs: DataFrame, id_col: str, text_col: str, **sizes: int) -> DataFrame:
    """A row for each document, with its group: recipes() and keep_id, group_size and stay, the key of the row that stays (null where the text occurs once)."""
    seed = 0
    while True:
        found = written(recipes(docs, id_col, text_col, seed, **sizes), "recipes")
        if clashes(found).isEmpty():
            break
        seed += 1
    last = F.max(F.struct("doc_id", "key", "key2")).alias("last")
    groups = written(found.groupBy("ids").agg(last, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    groups = groups.select("ids", F.col("last.doc_id").alias("keep_id"), "group_size", F.struct("last.key", "last.key2").alias("stay"))
    out = found.join(groups, "ids", "left").drop("checks")
    return out.withColumn("keep_id", F.when(F.col("stay").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks."""
    found = grouped(docs, id_col, text_col, **sizes)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes", F.size("ids").cast("long").alias("n_chunks"))


def exact_dedup_stage(docs: DataFrame) -> DataFrame:
    """docs without the copies: one row for each different text, that with the largest id; of rows with this id, one. Rows are told apart by id and text, so a repeated id costs no other text. Texts of which there is one copy are not exchanged."""
    found = written(grouped(docs, "doc_id", "text").filter("stay is not null").select("key", "key2", "stay"), "copies")
    again = found.filter("key = stay.key and key2 = stay.key2").groupBy("key", "key2").count().filter("count > 1").select("key", "key2", F.lit(True).alias("again"))
    gone = found.filter("key <> stay.key or key2 <> stay.key2").select("key", "key2", F.lit(False).alias("again")).distinct()
    marks = written(gone.unionByName(again), "marks")
    keys = row_keys(F.col("doc_id"), F.col("text"))
    rest, looked = suspects(docs, marks, keys["key"])
    looked = looked.select(F.struct(*docs.columns).alias("__row"), *[k.alias(n) for n, k in keys.items()]).join(marks, ["key", "key2"], "left")
    one = looked.filter("again").dropDuplicates(["key", "key2"])
    return rest.unionByName(looked.filter("again is null").unionByName(one).select("__row.*"))
