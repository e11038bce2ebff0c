"""The cells of the index: integer k-means with evenly spaced first centroids and a fixed number of rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vecscore.functions.schema import CELLS, DIMS, ITERATIONS
from vecscore.sources.tables import written

#: Distances that are held at once: they stay in a core's cache.
HELD = 1 << 17
Q, C = [f"q{d}" for d in range(DIMS)], [f"c{d}" for d in range(DIMS)]


def first_centroids(vectors: DataFrame, cells: int = CELLS, count: int | None = None) -> DataFrame:
    """cell_id, c0..c13: vector number (cell * (count div cells)) mod count. vec_id must run from 0 to count - 1."""
    n = vectors.count() if count is None else count
    if not n:
        return vectors.sparkSession.createDataFrame([], "cell_id INT, " + ", ".join(f"{c} BIGINT" for c in C))
    wanted = vectors.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell_id"), ((F.col("id") * (n // cells)) % n).alias("vec_id"))
    return F.broadcast(wanted).join(vectors.select("vec_id", *Q), "vec_id").select("cell_id", *[F.col(q).cast("bigint").alias(c) for q, c in zip(Q, C, strict=True)])


def centroid_array(centroids: DataFrame) -> list:
    """The centroids on the driver: as many rows as there are cells, a parameter."""
    return sorted((r["cell_id"], [int(r[c]) for c in C]) for r in centroids.collect())


def cell_finder(centroids: list, probes: int = 1):
    """A function from batches with q0..q13 to the numbers (in centroids) of the probes nearest cells and their distances; of equally near ones the first. Products and sums of 16-bit numbers are whole in double precision, also times the number of cells, up to 100,000 of them.

    A column of ones beside the vectors takes the centroids' squares, and, for several probes, the cells' numbers into the product, a few rows at a time."""
    table = np.array([c for _, c in centroids], np.float64).reshape(-1, DIMS)
    n = len(table)
    scale = 1 if probes == 1 else n
    weights = np.vstack([-2 * scale * table.T, scale * (table * table).sum(1) + (0 if probes == 1 else np.arange(n))])
    step, most = max(HELD // max(n, 1), 1), min(probes, n)

    def find(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([*(b.column(q).to_numpy(zero_copy_only=False) for q in Q), np.ones(b.num_rows)], 1).astype(np.float64)
        at, least = np.empty((len(x), most), np.int64), np.empty((len(x), most), np.int64)
        for first in range(0, len(x), step):
            d = x[first : first + step] @ weights
            own = slice(first, first + len(d))
            if probes == 1:
                at[own, 0] = d.argmin(1)
                least[own] = np.take_along_axis(d, at[own], 1)
            else:
                order = np.sort(np.partition(d, most - 1, 1)[:, :most], 1).astype(np.int64)
                least[own], at[own] = np.divmod(order, n)
        return at, least + (x[:, :-1] * x[:, :-1]).sum(1).astype(np.int64)[:, None]

    return find


def assign(vectors: DataFrame, centroids: list) -> DataFrame:
    """vectors with cell_id, the nearest centroid; of equally near ones the least. One scan, no exchange. centroids: as centroid_array() gives, as many as there are cells, a parameter."""
    vectors = vectors.drop("cell_id")
    ids = np.array([cell for cell, _ in centroids], np.int32)
    find = cell_finder(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[find(b)[0][:, 0]])], names=[*b.schema.names, "cell_id"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cell_id", IntegerType())]))


def update(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """The mean of each cell, cut to a whole number; an empty cell keeps its centroid."""
    sums = assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(q).cast("bigint")).alias(f"s_{q}") for q in Q])
    new = [F.coalesce(F.call_function("div", F.col(f"s_{q}"), F.col("n")), F.col(c)).alias(c) for q, c in zip(Q, C, strict=True)]
    return centroids.join(sums, "cell_id", "left").select("cell_id", *new)


def build(vectors: DataFrame, cells: int = CELLS, iterations: int = ITERATIONS, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The vectors with the cells of the last round's assignment, and the centroids after its update, which are one update ahead of the assignment. Each round comes to the driver as its centroids, so plans don't grow. keep: the last assignment is written, so that it is not made for the update and again for whoever reads it."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, cells)
    schema, assigned = centroids.schema, vectors
    for i in range(iterations):
        found = centroid_array(centroids)
        if not found:
            return vectors.withColumn("cell_id", F.lit(None).cast("int")), centroids
        assigned = assign(vectors, found)
        if keep and i == iterations - 1:
            assigned = written(assigned)
        new = centroid_array(update(assigned, spark.createDataFrame([(k, *c) for k, c in found], schema)))
        centroids = spark.createDataFrame([(k, *c) for k, c in new], schema)
    return assigned, centroids
