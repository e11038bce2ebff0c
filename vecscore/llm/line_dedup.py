"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

The corpus is the sequence of each document's lines. A suffix's rank is the number of suffixes before its class, the
class being all suffixes that agree on their first h lines. Doubling sorts the pairs (own rank, rank h lines on): the
different pairs are range-partitioned and sorted, so a class as common as one line of a third of all documents is spread over tasks,
counts are summed before the exchange, and only one number a partition comes to the driver. Suffixes whose class is
theirs alone have their final rank and drop out, and with them documents that have no others.

Doubling ends when no class is divided any more, so the array is whole. Neighbours in it are then compared, and its intervals
are those whose common prefix is MIN_LINES long or longer, or holds more than LONG_WORDS words in fewer lines. In
each the first suffix, by document id and place, stays; the lines that the others begin with are later copies.
Overlapping copies together are the maximal repeated runs, and these are removed.

Defined cases: lines are what stands between line feeds, lines without a word are not part of the sequence and stay; null
text has no lines. Lines are told apart by 64-bit hashes. Ids are taken to be unique: rows that repeat one are read as one
document. A document with fewer lines and words than a run needs loses none. Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecscore.llm.common import words, written

MIN_LINES = 3
#: A run of fewer lines counts if it holds more words than this.
LONG_WORDS = 50


def line_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line with a word: doc_id, pos (from 0), line (its id), n_words."""
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(words(x)).alias("n_words")))).alias("pos", "at")).select("doc_id", "pos", "at.line", "at.n_words")


def starts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys and n. With start: the sum of n over all rows before, in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            sums = pc.add(pc.cumulative_sum(b.column("n")), before)
            own = pc.subtract(sums, b.column("n"))
            if len(sums):
                before = sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, own, pa.array([part] * len(own), pa.int32())], names=[*b.schema.names, "own", "part"])

    sorted_pairs = pairs.select(*keys, "n").repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{k} bigint" for k in keys) + ", n bigint, own bigint, part int"
    found = written(sorted_pairs.mapInArrow(run, schema), "sorted")
    sums = found.groupBy("part").agg(F.sum("n").alias("total"))
    base = sums.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    return found.join(F.broadcast(base), "part").select(*keys, "n", (F.col("own") + F.col("base")).alias("start"))


def suffix_ranks(lines: DataFrame, depth: int | None = None, settled: bool = False) -> DataFrame:
    """lines: doc_id, pos, line. doc_id, pos, rank and n, the size of the class that agrees on depth lines (None: on all lines, so the whole suffix array), of suffixes that share their class with others; with settled also of those that no longer do, except in documents none of whose lines occurs again."""
    columns, out = ["doc_id", "pos", "rank", "n"], []
    own = starts(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")), ["line"])
    ranks = lines.join(own, "line").select("doc_id", "pos", F.col("start").alias("rank"), "n")
    h = 1
    while depth is None or h < depth:
        shift = h if depth is None else min(h, depth - h)
        by = Window.partitionBy("doc_id").orderBy("pos")
        # documents all of whose suffixes are settled are no longer looked up by anyone
        live = F.max(F.col("n")).over(Window.partitionBy("doc_id")) > 1
        ranks = ranks.withColumn("next", F.coalesce(F.lead("rank", shift).over(by), F.lit(-1))).withColumn("live", live)
        ranks = written(ranks if settled and h > 1 else ranks.filter("live"), "ranks")
        if settled and h > 1:
            out.append(ranks.filter(~F.col("live")).select(*columns))
        ranks = ranks.filter("live").drop("live")
        open_ranks = ranks.filter("n > 1")
        pairs = written(starts(open_ranks.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")), ["rank", "next"]), "pairs")
        base = pairs.groupBy("rank").agg(F.min("start").alias("base"), F.count(F.lit(1)).alias("kinds"))
        if depth is None and base.filter("kinds > 1").isEmpty():
            break
        new = pairs.join(base, "rank").select("rank", "next", (F.col("rank") + F.col("start") - F.col("base")).alias("to"), F.col("n").alias("size"))
        moved = open_ranks.select("doc_id", "pos", "rank", "next").join(new, ["rank", "next"]).select("doc_id", "pos", F.col("to").alias("rank"), F.col("size").alias("n"))
        ranks = written(moved.unionByName(ranks.filter("n = 1").select("doc_id", "pos", "rank", "n")), "ranks")
        h += shift
    if not settled:
        return ranks.filter("n > 1").select(*columns)
    return reduce(DataFrame.unionByName, out, ranks.select(*columns))


def intervals(lines: DataFrame, min_lines: int, long_words: int) -> DataFrame:
    """lines: as line_ids(). A row for each suffix, in each interval of the suffix array whose common prefix has min_lines lines, or fewer with more than long_words words: doc_id, pos, length (of the prefix), key (the interval's number among those of the length).

    Neighbours in the array are compared line by line; an interval ends where they have fewer lines in common. The array is sorted in ranges, and what goes from one range to the next is its last suffix and its number of ends."""
    at = Window.partitionBy("doc_id").orderBy("pos")
    depths = range(1, min_lines + 1)
    heads = [F.lead("line", k).over(at).alias(f"l{k}") if k else F.col("line").alias("l0") for k in range(min_lines)]
    sums = [F.sum("n_words").over(at.rowsBetween(0, d - 1)).alias(f"w{d}") for d in depths]
    rows = suffix_ranks(lines, settled=True).select("doc_id", "pos", "rank").join(lines.select("doc_id", "pos", *heads, *sums), ["doc_id", "pos"])
    placed = written(rows.repartitionByRange("rank", "doc_id", "pos").withColumn("part", F.spark_partition_id()), "sorted")
    head, order = F.struct(*(f"l{k}" for k in range(min_lines))), Window.partitionBy("part").orderBy("rank", "doc_id", "pos")
    ranges = Window.orderBy("part")
    edges = placed.groupBy("part").agg(F.max_by(head, F.struct("rank", "doc_id", "pos")).alias("last")).select("part", F.lag("last").over(ranges).alias("edge"))
    both = placed.join(F.broadcast(edges), "part").withColumn("before", F.coalesce(F.lag(head).over(order), "edge"))
    same, ends = F.lit(True), []
    for d in depths:
        same = same & F.coalesce(F.col(f"l{d - 1}") == F.col("before")[f"l{d - 1}"], F.lit(False))
        ends.append((~same).cast("int").alias(f"end{d}"))
    both = written(both.select("doc_id", "pos", "rank", "part", *(f"w{d}" for d in depths), *(f"l{k}" for k in range(min_lines)), *ends), "neighbours")
    base = both.groupBy("part").agg(*[F.sum(f"end{d}").alias(f"n{d}") for d in depths])
    base = base.select("part", *[F.coalesce(F.sum(f"n{d}").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"base{d}") for d in depths])
    found = []
    for d in depths:
        number = F.sum(f"end{d}").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"base{d}")
        counts = F.col(f"l{d - 1}").isNotNull() & (F.lit(True) if d == min_lines else F.col(f"w{d}") > long_words)
        found.append(F.when(counts, F.struct(F.lit(d).alias("length"), number.alias("key"))))
    found = both.join(F.broadcast(base), "part").select("doc_id", "pos", F.array_compact(F.array(*found)).alias("w"))
    return found.select("doc_id", "pos", F.explode("w").alias("w")).select("doc_id", "pos", "w.length", "w.key")


def later_copies(found: DataFrame, keys: list[str]) -> DataFrame:
    """found: doc_id, pos, length and keys. doc_id, pos, length of all but the first with the same keys."""
    first = found.groupBy(*keys).agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(first.select(*keys, "first"), keys).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    return later.select("doc_id", "pos", "length")


def repeated_runs(lines: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """The lines to remove: doc_id, runs (array of start and length, in lines with a word)."""
    later = later_copies(written(intervals(lines, min_lines, long_words), "repeated"), ["length", "key"])
    by = Window.partitionBy("doc_id").orderBy("pos", "length")
    end = F.max(F.col("pos") + F.col("length"))
    later = later.withColumn("new", F.coalesce((F.col("pos") > end.over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    runs = later.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "run").agg(F.min("pos").alias("start"), (end - F.min("pos")).alias("length"))
    return runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_removed, n_runs, longest_run, runs."""
    lines = written(line_ids(docs, id_col, text_col), "lines")
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    runs = repeated_runs(lines, min_lines, long_words)
    # only narrow columns of the documents meet the counts; their texts were read once, above
    out = docs.select(F.col(id_col).alias("doc_id")).join(counts, "doc_id", "left").join(runs, "doc_id", "left")
    lengths = F.transform("runs", lambda x: x["length"].cast("long"))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("n_lines", zero).alias("n_lines"),
        F.coalesce(F.aggregate(lengths, zero, lambda a, x: a + x), zero).alias("n_removed"),
        F.coalesce(F.when(F.col("runs").isNotNull(), F.size("runs").cast("long")), zero).alias("n_runs"),
        F.coalesce(F.array_max(lengths), zero).alias("longest_run"),
        "runs",
    )


def remove_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines of the runs that line_dedup() found; all other columns stay."""
    gone = found.select(F.col("doc_id").alias("__id"), F.col("runs").alias("__runs")).filter("__runs is not null")
    df = docs.join(gone, docs[id_col] == F.col("__id"), "left")
    df = df.withColumn("__lines", F.split(text_col, "\n"))
    seen = F.transform("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]").cast("int"))
    number = F.transform(seen, lambda x, i: F.aggregate(F.slice(seen, F.lit(1), i + 1), F.lit(0), lambda a, v: a + v) - 1)
    inside = lambda k: F.exists("__runs", lambda r: (r["start"] <= k) & (k < r["start"] + r["length"]))
    kept = F.filter(F.zip_with("__lines", number, lambda x, k: F.struct(x.alias("x"), (x.rlike(r"[^\x20\x09-\x0D]") & inside(k)).alias("gone"))), lambda s: ~s["gone"])
    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return df.withColumn(text_col, text).drop("__id", "__runs", "__lines")
