"""Boxes in space for exact search: vectors are dealt into cells by halving along coordinates, and what a cell's vectors can be nearest to is bounded by their least and greatest coordinates.

Where space is halved is read from a bounded sample, which decides the cells' sizes alone: every vector is in a cell, and a box holds all of its cell's vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Vectors of a cell, about, and cells at most: one row for each comes to the driver and goes to the tasks.
CELL, MOST_CELLS = 4096, 8192
#: Vectors that the driver halves space by: between so many and twice as many.
SAMPLE = 1 << 16
#: Distances from boxes that are held at once: they stay in a core's cache.
HELD = 1 << 17


def matrix(b: pa.RecordBatch | pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(b.column(c)).astype(np.int64) for c in columns], 1)


def halved(sample: np.ndarray, rows: int) -> np.ndarray:
    """The cuts, a row each: coordinate, value (below it to the left), then where left and right lead to, a cut's number or -1 - a cell's. Parts of rows vectors or fewer, and those of one vector only, are cells."""
    cuts: list[list[int]] = []
    cells = 0
    todo = [(np.arange(len(sample)), -1, 0)]
    while todo:
        own, above, side = todo.pop()
        spread = sample[own].astype(np.float64).var(0) if len(own) else np.zeros(1)
        d = int(spread.argmax())
        if len(own) <= rows or not spread[d]:
            to, cells = -1 - cells, cells + 1
        else:
            values = np.sort(sample[own, d])
            middle = values[len(values) // 2]
            if middle == values[0]:
                middle = values[np.searchsorted(values, middle, "right")]
            left = sample[own, d] < middle
            to = len(cuts)
            cuts.append([d, int(middle), 0, 0])
            todo += [(own[~left], to, 3), (own[left], to, 2)]
        if above >= 0:
            cuts[above][side] = to
    return np.array(cuts, np.int64).reshape(-1, 4)


def cuts_of(vectors: DataFrame, vector: list[str], key: str = "vec_id") -> np.ndarray:
    """The cuts that deal vectors into cells of about CELL."""
    n = vectors.count()
    cells = min(-(-n // CELL), MOST_CELLS)
    if cells < 2:
        return np.zeros((0, 4), np.int64)
    some = vectors.filter(F.pmod(F.xxhash64(key), F.lit(max(n // SAMPLE, 1))) == 0).select(*vector).toArrow()
    return halved(matrix(some, vector), max(some.num_rows // cells, 1))


def with_cell(df: DataFrame, cuts: np.ndarray, vector: list[str]) -> DataFrame:
    """df with cell_id. One scan, no exchange."""
    df = df.drop("cell_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, vector)
            at = np.zeros(len(x), np.int64) if len(cuts) else np.full(len(x), -1)
            while len(live := np.flatnonzero(at >= 0)):
                own = cuts[at[live]]
                at[live] = np.where(x[live, own[:, 0]] < own[:, 1], own[:, 2], own[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((-1 - at).astype(np.int32))], names=[*b.schema.names, "cell_id"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell_id", IntegerType())]))


def boxes_of(vectors: DataFrame, vector: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vectors with cell_id: the cells that hold any, and their least and greatest coordinates."""
    ends = [f(c).cast("bigint").alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in vector]
    found = vectors.groupBy("cell_id").agg(*ends).toArrow()
    return np.asarray(found.column("cell_id")), matrix(found, [f"low_{c}" for c in vector]), matrix(found, [f"high_{c}" for c in vector])


def other_cells(queries: DataFrame, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], vector: list[str]) -> DataFrame:
    """queries: query_id, cell_id, bound (null: none) and vector columns. A row with its cell_id for each other cell whose box is no farther from the query than bound, so that it may hold a vector as near as that."""
    ids, low, high = boxes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(HELD // max(len(ids), 1), 1)
            for first in range(0, b.num_rows, step):
                own = b.slice(first, step)
                x, far = matrix(own, vector), np.zeros((own.num_rows, len(ids)), np.int64)
                for d in range(len(vector)):
                    out = np.maximum(low[:, d] - x[:, d, None], x[:, d, None] - high[:, d])
                    far += np.square(np.maximum(out, 0, out), out)
                bound = own.column("bound").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                row, cell = np.nonzero((far <= bound[:, None]) & (ids != np.asarray(own.column("cell_id"))[:, None]))
                at = own.schema.get_field_index("cell_id")
                yield own.take(pa.array(row)).set_column(at, own.schema.field(at), pa.array(ids[cell].astype(np.int32)))

    slim = queries.select("query_id", "cell_id", F.col("bound").cast("bigint").alias("bound"), *vector)
    return slim.mapInArrow(run, slim.schema)
