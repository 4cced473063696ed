"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, walked best bin first.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the greatest norm, so that the largest inner product is the least
Euclidean distance. The tree is fitted on a bounded sample, and leaves that get many vectors are split again, each on a sample of its
own; every vector is put into a leaf. A query walks the tree through a priority
queue; how many leaves all queries visit is calibrated against brute force over all vectors on a bounded set of queries.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_tables, materialize, table

#: Bound on the rows the tree is fitted on, children of a node.
SAMPLE, BRANCHES = 20_000, 16
#: A leaf with more rows is split again by a tree on a sample of its own of that size; nodes of the whole tree, which tasks get by broadcast, at most.
LEAF_ROWS, NODES = 500, 200_000
#: Sample rows of a leaf, as a part of LEAF_ROWS.
LEAF_SHARE = 2.5
#: Bound on the calibration queries, and the share of their true neighbours that the visited leaves must hold.
CALIBRATION, RECALL = 400, 0.93
#: Rows of a leaf that one task compares with queries; larger leaves are split.
SPLIT = 20_000
#: Scores this close, as a share of the product of both lengths, are compared again by an exact sum; a matrix product errs by less.
NEAR = 1e-12


def leaf_sample() -> int:
    """Sample rows of a leaf."""
    return max(1, int(LEAF_ROWS / LEAF_SHARE))


class Tree:
    """Centroids of all nodes; children of inner nodes; leaf numbers."""

    def __init__(self, x: np.ndarray, branches: int = BRANCHES, leaf: int | None = None, seed: int = 5):
        self.rng, self.centres, self.children, self.leaf_of, self.n_leaves = np.random.default_rng(seed), [], [], [], 0
        if len(x):
            self._grow(x, branches, leaf or leaf_sample())
        self.centres = np.array(self.centres) if self.centres else np.zeros((0, x.shape[1]))

    def _grow(self, x: np.ndarray, branches: int, leaf: int) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(axis=0))
        self.children.append([])
        self.leaf_of.append(-1)
        if len(x) > leaf:
            label = self._kmeans(x, branches)
            if label.max() > 0:
                self.children[node] = [self._grow(x[label == k], branches, leaf) for k in range(label.max() + 1)]
        if not self.children[node]:
            self.leaf_of[node] = self.n_leaves
            self.n_leaves += 1
        return node

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
        centres = [x[self.rng.integers(len(x))]]
        away = ((x - centres[0]) ** 2).sum(axis=1)
        while len(centres) < k and away.max() > 1e-12:
            centres.append(x[self.rng.choice(len(x), p=away / away.sum())])
            away = np.minimum(away, ((x - centres[-1]) ** 2).sum(axis=1))
        centres = np.array(centres)
        for _ in range(rounds):
            label = (((centres**2).sum(axis=1)) - 2 * x @ centres.T).argmin(axis=1)
            centres = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        return np.unique((((centres**2).sum(axis=1)) - 2 * x @ centres.T).argmin(axis=1), return_inverse=True)[1]

    def graft(self, leaf: int, below: Tree) -> None:
        """Puts a tree in the place of a leaf; the leaf's number is not used again."""
        node, offset = self.leaf_of.index(leaf), len(self.children)
        self.centres = np.concatenate((self.centres, below.centres))
        self.children += [[c + offset for c in kids] for kids in below.children]
        self.leaf_of += [x + self.n_leaves if x >= 0 else -1 for x in below.leaf_of]
        self.children[node], self.leaf_of[node] = self.children[offset], -1
        self.children[offset], self.leaf_of[offset] = [], -1
        self.n_leaves += below.n_leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child at each node."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            kids = self.children[node]
            c = self.centres[kids]
            label = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(kid, rows[label == k]) for k, kid in enumerate(kids)]
        return out

    def walk(self, q: np.ndarray, visits: int, counts: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order: visits of them, and more while they hold fewer than least vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if kids := self.children[node]:
                away = ((self.centres[kids] - q) ** 2).sum(axis=1).tolist()
                for kid, d in zip(kids, away, strict=True):
                    heapq.heappush(queue, (d, kid))
            else:
                out.append(self.leaf_of[node])
                held += int(counts[self.leaf_of[node]])
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))[:, None]))


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of the rows x by exact score, then smaller id: (query_id, vec_id, score)."""
    out = []
    longest = np.sqrt((x**2).sum(axis=1).max(initial=0.0))
    for lo in range(0, len(q), step := max(1, 4_000_000 // max(1, len(x)))):
        scores = q[lo : lo + step] @ x.T
        for row, own, vector in zip(scores, query_ids[lo : lo + step], q[lo : lo + step], strict=True):
            row[ids == own] = -np.inf
            least = np.partition(row, -k)[-k] - NEAR * longest * np.sqrt(vector @ vector) if len(row) > k else -np.inf
            at = np.flatnonzero((row >= least) & (row > -np.inf))
            exact = (x[at] * vector).sum(axis=1)
            order = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(order), own), ids[at][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


FOUND = "query_id long, vec_id long, score double"


def _topped(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, x) whose vector has the commonest length, only finite components and one that is not zero."""
    x = F.col("embedding")
    good = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(kind).alias("x"))


def _first(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n of the rows, the first in the order of their ids' hashes, so that each row has the same chance, whatever their number."""
    return rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n)


def brute_force(rows: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """The k nearest of all rows for a bounded list of (query_id, vector)."""
    query_ids, q = np.array([r[0] for r in queries], np.int64), np.array([r[1] for r in queries], float).reshape(-1, dim)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(b.column(0).to_numpy(), _matrix(b.column(1), dim), query_ids, q, k)], names=["query_id", "vec_id", "score"])

    return _topped(rows.select("vec_id", "x").mapInArrow(run, FOUND), k)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """For each query, a row of vectors(vec_id, embedding) whose vec_id is divisible by every, its k nearest found: (query_id, rank, vec_id, score).

    Nearness is the largest inner product in double precision, ties to the smaller vec_id; a query is no candidate of its own.
    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. With fewer
    than k candidates all are found. A repeated vec_id should not occur; its rows count as candidates one by one. An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = sizes[0]["dim"], sizes[0]["most"]
    rows, kind = rows.where(F.size("x") == dim), dict(rows.dtypes)["x"]
    sample = _first(rows, SAMPLE, 3).select("x").toArrow()
    tree = Tree(_lifted(_matrix(sample.column(0), dim), most))
    placed, counts = grown(rows, tree, dim, most)
    model = spark.sparkContext.broadcast(tree)  # of at most NODES nodes
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0)

    asked = _first(queries, CALIBRATION, 7).select("vec_id", "x").collect()
    true = brute_force(placed, [(r[0], r[1]) for r in asked], dim, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # k rows per calibration query
    place_of = {}
    for r in asked:
        q = np.append(np.array(r[1]), 0.0)
        place_of[r[0]] = {leaf: i for i, leaf in enumerate(tree.walk(q, tree.n_leaves, counts, 0))}
    depths = sorted(place_of[r["query_id"]][r["leaf"]] + 1 for r in true)
    visits = depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))) - 1)] if depths else tree.n_leaves

    splits = np.maximum(1, -(-counts // SPLIT))
    parts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(splits)], "leaf int, parts int")

    def walk(batches):
        for b in batches:
            found = [model.value.walk(q, visits, counts, k + 1) for q in np.pad(_matrix(b.column(1), dim), ((0, 0), (0, 1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["query_id", "q", "leaves"])

    walked = queries.select("vec_id", "x").mapInArrow(walk, f"query_id long, q {kind}, leaves array<int>").select("query_id", "q", F.explode("leaves").alias("leaf"))
    walked = walked.join(F.broadcast(parts), "leaf").select("query_id", "q", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    data = placed.join(F.broadcast(parts), "leaf").select("vec_id", "x", "leaf", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best(left.column("vec_id").to_numpy(), _matrix(left.column("x"), dim), right.column("query_id").to_numpy(), _matrix(right.column("q"), dim), k) if left.num_rows and right.num_rows else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = data.groupBy("leaf", "part").cogroup(walked.groupBy("leaf", "part")).applyInArrow(compare, FOUND)
    return _topped(found, k).select("query_id", "rank", "vec_id", "score")


def _placed(rows: DataFrame, tree: Tree, dim: int, most: float) -> tuple[DataFrame, np.ndarray]:
    """Every row with its leaf, as a stored table, and the number of rows of each leaf."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["x"]
    model = spark.sparkContext.broadcast(tree)  # of at most NODES nodes

    def place(batches):
        for b in batches:
            leaf = model.value.place(_lifted(_matrix(b.column(1), dim), most))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["vec_id", "x", "leaf"])

    placed = materialize(rows.select("vec_id", "x").mapInArrow(place, f"vec_id long, x {kind}, leaf int"), "leaves")
    counts = np.zeros(max(1, tree.n_leaves), np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row per leaf
        counts[r["leaf"]] = r["count"]
    return placed, counts


def grown(rows: DataFrame, tree: Tree, dim: int, most: float) -> tuple[DataFrame, np.ndarray]:
    """Splits leaves of more than LEAF_ROWS rows again, level by level, so that the number of leaves follows the number of rows. Each is
    fitted in a task of its own, on its rows that come first in the order of hashes. Returns what _placed gives."""
    whole, leaf = set(), leaf_sample()
    while True:
        placed, counts = _placed(rows, tree, dim, most)
        large = [int(x) for x in np.flatnonzero(counts > LEAF_ROWS) if int(x) not in whole]
        if not large or len(tree.children) + len(large) * BRANCHES > NODES:
            return placed, counts
        order = Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id")
        sample = placed.where(F.col("leaf").isin(large)).withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEAF_ROWS)

        def fit(t: pa.Table) -> pa.Table:
            below = Tree(_lifted(_matrix(t.column("x"), dim), most), leaf=leaf)
            below.rng = None
            return pa.table([pa.array([t.column("leaf")[0].as_py()], pa.int32()), pa.array([pickle.dumps(below)], pa.binary())], names=["leaf", "tree"])

        for r in sample.select("leaf", "x").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect():  # NODES nodes at most
            below = pickle.loads(r["tree"])
            if below.n_leaves > 1:
                tree.graft(r["leaf"], below)
            else:
                whole.add(r["leaf"])
        drop_tables(placed)


def measured_recall(found: DataFrame, vectors: DataFrame, queries: int = 400, k: int = 20) -> float:
    """The share of the true k nearest, by brute force over all vectors, that found has, over at most that many of its queries."""
    rows = usable(vectors)
    dim = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()["dim"]
    rows = rows.where(F.size("x") == dim)
    ids = found.select(F.col("query_id").alias("vec_id")).distinct()
    asked = _first(rows.join(ids, "vec_id", "left_semi"), queries, 11).select("vec_id", "x").collect()
    true = brute_force(rows, [(r[0], r[1]) for r in asked], dim, k).select("query_id", "vec_id")
    hit, all_ = true.join(found.select("query_id", "vec_id", "rank"), ["query_id", "vec_id"], "left").agg(F.count("rank"), F.count("*")).first()
    return hit / all_ if all_ else 1.0


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
