"""What the operators share: reading a table, normal forms of text, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that ends a word and the words between.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one process, as in tests, a local one; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local[:] = _local or [tempfile.mkdtemp(prefix="vecscore-")]
        found = _local[0]
    return found.rstrip("/")


_local: list[str] = []
_written: list = []


def _clean() -> None:
    for path, fs in _written:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor costs no earlier work. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecscore-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    parents = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}
    for path, fs in [x for x in _written if x[0].getName() in parents]:
        fs.delete(path, True)
        _written.remove((path, fs))


#: Bits of the map of rows to look at.
MAP_BITS = 1 << 23


def suspects(docs: DataFrame, marks: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """docs whose key (a 64-bit hash) no row of marks has in its column key, and the others, a few of which are there by chance. A bitmap of MAP_BITS decides, a row for each of its 64-bit words, so what is broadcast is bounded and the first rows stay where they are."""
    bit = lambda k: F.pmod(k, F.lit(MAP_BITS))
    word, place = lambda k: F.shiftright(bit(k), 6), lambda k: bit(k).bitwiseAND(63).cast("int")
    bitmap = marks.select(word(F.col("key")).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("key"))).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    found = docs.withColumn("__word", word(key)).withColumn("__place", place(key)).join(F.broadcast(written(bitmap, "bitmap")), "__word", "left")
    hit = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("long")), F.col("__place")).bitwiseAND(1) == 1
    return found.filter(~hit).select(*docs.columns), found.filter(hit).select(*docs.columns)


def lower_az(text: Column) -> Column:
    """text with A to Z lower-cased and nothing else changed. lower() does the same to ASCII and is several times faster there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The words of text, as array<string>; null text gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python makes of one stays small."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


def kept(name: str, make: Callable):
    """What make() gives, made once in each Python worker and kept for its later tasks. Functions that travel by value have module variables of their own in each task, so this is kept in a module."""
    state = sys.modules.setdefault("vecscore_worker_state", types.ModuleType("vecscore_worker_state")).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def let_go() -> None:
    """Drop what kept() holds in this Python worker and give unused memory back to the system."""
    state = sys.modules.get("vecscore_worker_state")
    if state is not None and state.__dict__:
        state.__dict__.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: None)(0)


def lean(run: Callable) -> Callable:
    """run, a function of mapInArrow, between two let_go(). Spark reuses its Python workers, so what one operator or task left would else stay in memory beside the next one's."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        let_go()

    return go


def free_heap(spark: SparkSession) -> None:
    """Have the executors' JVMs give the heap that they don't use back to the system: a heap that one stage has grown stays that large otherwise, beside the Python workers of the next. Two tasks a core, so that each executor gets some."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
