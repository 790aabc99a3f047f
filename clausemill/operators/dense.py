"""The k nearest of every query, by matrix products of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and vectors of a cell of the grid, and vectors of one product.
QUERIES, VECTORS, STEP = 4096, 1 << 16, 1024


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat, float).reshape(len(column), -1)


class Best:
    """The k best units of each query so far: by score, rounded to six digits, then by unit."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.query, self.score, self.unit = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, units: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(units), STEP):
            some, ids = vectors[at : at + STEP], units[at : at + STEP]
            scores = np.round(self.queries @ some.T, 6)
            if len(ids) > self.k:  # whatever is not below the k-th, ties included
                query, column = np.nonzero(scores >= np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None])
            else:
                query, column = (x.ravel() for x in np.indices(scores.shape))
            query, score, unit = np.concatenate((self.query, query)), np.concatenate((self.score, scores[query, column])), np.concatenate((self.unit, ids[column]))
            order = np.lexsort((unit, -score, query))
            query, score, unit = query[order], score[order], unit[order]
            first = np.searchsorted(query, query)
            held = np.arange(len(query)) - first < self.k
            self.query, self.score, self.unit = query[held], score[held], unit[held]

    def table(self, ids: list) -> pa.Table:
        return pa.table({"query_id": pa.array([ids[i] for i in self.query], pa.int64()), "unit_id": pa.array(self.unit, pa.int64()), "score": pa.array(self.score)})


def blocks_of(n: int, least: int, wanted: int) -> int:
    """Number of blocks of n queries: what is wanted, as long as blocks hold at least `least` and at most VECTORS."""
    return max(-(-n // VECTORS), min(-(-n // least), wanted))


def partial_best(vectors: DataFrame, queries: DataFrame, k: int, most: int = QUERIES) -> DataFrame:
    """query_id, unit_id, score: of each part of the vectors the k best of each query, by the product of their vectors.

    vectors(vec_id, unit), queries(query_id, unit), ids whole numbers. A set of at most `most` queries is sent to the tasks,
    and vectors stay where they are. A larger one is cut to blocks of that many or more, and vectors to blocks of VECTORS,
    by hash: each block of one side goes to every block of the other, each such cell is one group of known size, and k units
    a query leave it. Blocks of queries are as large as cells for all cores allow, VECTORS at most, since each block of one
    side is a copy of the other; products within a cell take QUERIES at a time. Rows with a null id or vector are left out.
    """
    schema = "query_id long, unit_id long, score double"
    vectors = vectors.where("vec_id is not null and unit is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("unit").cast("array<double>").alias("unit"))
    queries = queries.where("query_id is not null and unit is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("unit").cast("array<double>").alias("unit"))
    few = queries.limit(most + 1).collect()
    if len(few) <= most:
        ids, matrix = [r["query_id"] for r in few], np.array([r["unit"] for r in few])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(matrix, k)
            for batch in batches:
                if ids and batch.num_rows:
                    best.add(batch.column("vec_id").to_numpy(), _rows(batch.column("unit")))
            yield from best.table(ids).to_batches()

        return vectors.mapInArrow(run, schema)

    down = max(1, -(-vectors.count() // VECTORS))
    across = blocks_of(queries.count(), most, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // down))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = vectors.select(block("vec_id", down).alias("v"), every(across).alias("q"), "vec_id", "unit")
    right = queries.select(every(down).alias("v"), block("query_id", across).alias("q"), "query_id", "unit")

    def cell(some: pa.Table, asked: pa.Table) -> pa.Table:
        ids, matrix, vectors = asked.column("query_id").to_pylist(), _rows(asked.column("unit")), _rows(some.column("unit"))
        found = [Best(np.zeros((0, 0)), k).table([])]
        for at in range(0, len(ids), QUERIES):
            best = Best(matrix[at : at + QUERIES], k)
            if some.num_rows:
                best.add(some.column("vec_id").to_numpy(), vectors)
            found.append(best.table(ids[at : at + QUERIES]))
        return pa.concat_tables(found)

    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(cell, schema)
