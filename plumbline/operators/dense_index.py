"""A stored dense index: vectors in coarse cells around centroids; a search reads as many cells a query as the session's breadth says."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from plumbline.operators.fusion import top_k
from plumbline.operators.retrieval import QUERY_BLOCK, best_in_cells, cogrouped, unit_matrix

#: The session's setting of the breadth, cells that a query reads, and what holds where it is unset.
BREADTH, DEFAULT_BREADTH = "plumbline.search.breadth", 10
#: Rows that centroids are fitted on, about, and cells, at most, for each value of by; rounds of k-means.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 10
#: Rows, about, of a block of cells; a search sends a query to each block once, whatever cells it reads there.
BLOCK_ROWS = 8192


def breadth(spark: SparkSession) -> int:
    found = int(spark.conf.get(BREADTH, str(DEFAULT_BREADTH)))
    if found < 1:
        raise ValueError(f"{BREADTH} must be positive")
    return found


def _centroids(x: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """k-means of vectors of length one, by largest cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        label = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        c = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), c)
    return c


@dataclass
class DenseIndex:
    """Vectors of chunks(*by, chunk_id, vector) under path: centroids, one table; rows, in a folder for each value of by and each cell.

    by: columns of strings, such as the strategy; a search reads only the folders of its queries' values. Rows with null vectors, or of another
    length than most, are not stored. At a breadth of all cells a search is exact.
    """

    spark: SparkSession
    path: str
    by: tuple[str, ...] = ()

    def build(self, chunks: DataFrame, cells: int | None = None) -> None:
        """Fits centroids on a sample by hash, SAMPLE rows about for each value of by, and stores every row in its nearest cell. cells: the square root of the rows, CELLS at most, where not given."""
        rows = chunks.where("vector IS NOT NULL").select(*self.by, "chunk_id", F.col("vector").cast("array<double>").alias("vector"))
        sizes = rows.groupBy(*self.by, F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()  # values of by times lengths
        dim = max(sizes, key=lambda r: (r["n"], r["dim"]))["dim"] if sizes else 0
        rows = rows.where(F.size("vector") == dim)
        count = {tuple(r[c] for c in self.by): r["n"] for r in sizes if r["dim"] == dim}
        share = F.lit(1.0)
        for values, n in count.items():
            same = F.lit(True)
            for c, v in zip(self.by, values, strict=True):
                same = same & F.col(c).eqNullSafe(F.lit(v))
            share = F.when(same, F.lit(SAMPLE / n)).otherwise(share)
        sample = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < share * (1 << 30)).toArrow()
        names, parts, made = list(self.by), {}, []
        for values, n in count.items():
            own = [r for r in range(sample.num_rows) if tuple(sample.column(c)[r].as_py() for c in names) == values]
            x = unit_matrix(sample.column("vector").combine_chunks().take(pa.array(own, pa.int64())), dim) if own else np.zeros((1, dim))
            parts[values] = _centroids(x, min(CELLS, cells or int(np.ceil(np.sqrt(n)))))
            made += [(*values, k, c.tolist()) for k, c in enumerate(parts[values])]
        key = "".join(f"{c} string, " for c in names)
        self.spark.createDataFrame(made, f"{key}cell int, centroid array<double>").write.mode("overwrite").parquet(f"{self.path}/centroids")

        def place(batches):
            for b in batches:
                x = unit_matrix(b.column("vector"), dim)
                owners = list(zip(*(b.column(c).to_pylist() for c in names), strict=True)) if names else [()] * b.num_rows
                cell = np.zeros(b.num_rows, np.int32)
                for values in set(owners):
                    at = np.array([o == values for o in owners])
                    cell[at] = (x[at] @ parts[values].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

        placed = rows.mapInArrow(place, StructType([*rows.schema.fields]).add("cell", "integer"))
        placed.repartition(*self.by, "cell").write.mode("overwrite").partitionBy(*self.by, "cell").parquet(f"{self.path}/rows")

    def rows(self, chunk_id: str = "long") -> DataFrame:
        key = "".join(f"{c} string, " for c in self.by)
        return self.spark.read.schema(f"{key}chunk_id {chunk_id}, vector array<double>, cell int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 50, probes: int | None = None, digits: int | None = None) -> DataFrame:
        """(*by, query_id, rank, chunk_id, score) of queries(*by, query_id, vector): the best of the rows in each query's nearest cells, as many as probes or else the session's breadth says."""
        probes, key, names = probes or breadth(self.spark), [*self.by, "query_id"], list(self.by)
        table = self.spark.read.parquet(f"{self.path}/centroids").orderBy(*names, "cell").collect()  # CELLS for each value of by
        centres: dict[tuple, list] = {}
        for r in table:
            centres.setdefault(tuple(r[c] for c in names), []).append(r["centroid"])
        centres = {v: np.array(c) for v, c in centres.items()}
        dim = len(table[0]["centroid"]) if table else 0
        asked = queries.where(F.size("vector") == dim).select(*key, "vector")
        rows = self.rows(queries.sparkSession.read.parquet(f"{self.path}/rows").schema["chunk_id"].dataType.simpleString()) if dim else None
        schema = StructType([queries.schema[c] for c in key])
        if rows is None:
            return self.spark.createDataFrame([], schema.add("rank", "integer").add("chunk_id", "long").add("score", "double"))
        # A cell with many rows is compared by parts, each of which its queries go to; parts are dealt into blocks.
        sizes = rows.groupBy(*names, "cell").count().collect()  # CELLS for each value of by
        n_blocks = max(1, -(-sum(r["count"] for r in sizes) // BLOCK_ROWS))
        listed = [(*(r[c] for c in names), r["cell"], -(-r["count"] // BLOCK_ROWS)) for r in sizes]
        parts = self.spark.createDataFrame(listed, "".join(f"{c} string, " for c in names) + "cell int, parts int")
        block = F.pmod(F.xxhash64("cell", "part"), F.lit(n_blocks)).cast("int").alias("block")
        dealt: dict[tuple, dict[int, set[int]]] = {}
        for r in parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*names, "cell", block).collect():
            dealt.setdefault(tuple(r[c] for c in names), {}).setdefault(r["block"], set()).add(r["cell"])
        in_blocks = {v: {n: np.array(sorted(cells), np.int32) for n, cells in own.items()} for v, own in dealt.items()}

        def nearest(batches):
            for b in batches:
                x = unit_matrix(b.column("vector"), dim)
                owners = list(zip(*(b.column(c).to_pylist() for c in names), strict=True)) if names else [()] * b.num_rows
                at, where, cells = [], [], []
                for i, o in enumerate(owners):
                    if o in centres:
                        near = np.zeros(len(centres[o]), bool)
                        near[np.argsort(-(x[i] @ centres[o].T), kind="stable")[:probes]] = True
                        found = [(n, own[near[own]]) for n, own in in_blocks.get(o, {}).items()]
                        found = [(n, own) for n, own in found if len(own)]
                        at += [i] * len(found)
                        where += [n for n, _ in found]
                        cells += [own for _, own in found]
                columns = b.take(pa.array(at, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(where, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "block", "cells"])

        q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        probed = asked.mapInArrow(nearest, StructType([*asked.schema.fields]).add("block", "integer").add("cells", ArrayType(IntegerType())))
        left = probed.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
        right = rows.join(parts, [*names, "cell"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        right = right.select(*names, "chunk_id", "vector", "cell", block, F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
        found = cogrouped(left, right, [*names, "q_block", "block"], k, digits, self.by, schema.add(rows.schema["chunk_id"]).add("score", "double"), best_in_cells)
        return top_k(found, key, k, F.desc("score"), F.asc("chunk_id")).select(*key, "rank", "chunk_id", "score")


def recall(found: DataFrame, exact: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (n, hits, recall): the share of the exact lists' rows that found has."""
    key = [*by, "query_id", "chunk_id"]
    both = exact.select(*key).join(found.select(*key).withColumn("is_found", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("n"), F.count("is_found").alias("hits")).withColumn("recall", F.try_divide("hits", "n"))
