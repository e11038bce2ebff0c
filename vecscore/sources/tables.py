"""Tables in the folder that driver and executors share: what is read more than once is computed once, and a lost executor costs no earlier work."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The JVM compiles no method of more bytes than this; what is larger stays interpreted, several times slower than Spark's plan without whole-stage code.
LIMIT, BYTES = "spark.sql.codegen.hugeMethodLimit", 8000

_local: list[str] = []
_made: list = []


def _clean() -> None:
    for path, fs in _made:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def fresh_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir or, where that is unset and all runs in one process, in a local folder; a cluster without it is an error. What is there goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local[:] = _local or [tempfile.mkdtemp(prefix="vecscore-")]
        base = _local[0]
    path = f"{base.rstrip('/')}/vecscore-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())))
    return path


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs inside makes no whole-stage code that the JVM would not compile. The session's own setting comes back."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, str(min(int(before), BYTES)))
    try:
        yield
    finally:
        spark.conf.set(LIMIT, before)


def written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession)
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
