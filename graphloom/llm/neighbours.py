"""Approximate nearest neighbours by stable projections and a kd-tree (after Sun et al., SRS, 2014).

Vectors are projected by Gaussian weights to a few dimensions. For a true distance d, the squared projected distance over
d squared follows a chi-square law, so projected neighbours are verified nearest first, and the
search ends once a vector nearer than the k-th best found would, with probability ``SURE``, have been met.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2), with M the longest length.
The top of the tree is fitted on a bounded sample; each of its leaves, dealt out further where it is full,
is a block: a kd-tree in a file of the shared folder. Every row is indexed, save copies of one vector beyond
the k + 1 of smallest ids, which no query can return.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import filesystem, fresh_dir, stage, table

DIMENSIONS, SURE, SEED = 16, 0.92, 23
#: Vectors of a block and of a leaf of its tree; of the sample that the top of the tree is fitted on; queries of a task.
BLOCK, LEAF, SAMPLED, ASKED = 4096, 64, 16_384, 512
#: Projected neighbours of a query that are verified between two tests.
STEP = 128
FOUND = "query_id long, rank int, vec_id long, score double"


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function of the chi-square law with DIMENSIONS (even) degrees of freedom."""
    h = np.minimum(x / 2, 700)
    return 1 - np.exp(-h) * sum(h**j / math.factorial(j) for j in range(DIMENSIONS // 2))


def weights(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).standard_normal((d + 1, DIMENSIONS))


def projected(x: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    """Projection of vectors with the coordinate that evens out their lengths (0 for queries)."""
    w = weights(x.shape[1])
    out = x @ w[:-1]
    return out if query else out + np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0))[:, None] * w[-1]


def splits(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete tree as (axis, value), breadth first: medians of the widest axis."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    parts, out = [points], []
    for _ in range(depth):
        halves = []
        for p in parts:
            axis = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            out.append((axis, value))
            halves += [p[p[:, axis] < value], p[p[:, axis] >= value]]
        parts = halves
    return out


def routed(tree: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    axis, value = np.array([a for a, _ in tree], np.int64), np.array([v for _, v in tree])
    at, depth = np.zeros(len(points), np.int64), (len(tree) + 1).bit_length() - 1
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] >= value[at])
    return at - len(tree)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def build(ids: np.ndarray, vectors: np.ndarray, most: float) -> dict[str, np.ndarray]:
    """A block: rows in the order of a kd-tree's leaves, each with its box of projected points."""
    points = projected(vectors.astype(np.float64), most)
    todo, leaves = [np.arange(len(ids))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            leaves.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        order = own[np.argpartition(points[own, axis], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    order = np.concatenate(leaves)
    return {
        "ids": ids[order],
        "vectors": vectors[order],
        "points": points[order],
        "starts": np.cumsum([0, *map(len, leaves)]),
        "low": np.stack([points[x].min(0) for x in leaves]),
        "high": np.stack([points[x].max(0) for x in leaves]),
    }


class Search:
    """k best of each query so far, over any number of blocks."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, most: float, k: int) -> None:
        self.own, self.q, self.k = ids, queries.astype(np.float64), k
        self.points = projected(self.q, most, query=True)
        self.level = (self.q * self.q).sum(1) + most**2
        self.score = np.full((len(ids), k), -np.inf)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.verified = 0

    def far(self, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared projected distances (queries, boxes)."""
        p = self.points[at][:, None]
        gap = np.maximum(np.maximum(low - p, p - high), 0)
        return (gap * gap).sum(-1)

    def open(self, bound: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a vector better than the k-th may still lie beyond ``bound``: the stopping test fails."""
        best = np.maximum(self.level[at] - 2 * self.score[at, -1], 1e-9 * self.level[at])
        return chi_square(np.where(np.isinf(best), 0.0, bound / best)) < SURE

    def block(self, b: dict[str, np.ndarray], at: np.ndarray) -> None:
        """Verify a block's vectors for queries ``at`` in the order of their projected distances, STEP at once, until the test
        holds for the next one. Queries for which it holds for a leaf's box do not look at the leaf at all."""
        near = self.open(self.far(b["low"], b["high"], at), at[:, None])
        vectors, points, ids = b["vectors"].astype(np.float64), b["points"], b["ids"]
        leaf = np.repeat(np.arange(len(b["low"])), np.diff(b["starts"]))
        p = self.points[at]
        far = np.maximum((p * p).sum(1)[:, None] + (points * points).sum(1) - 2 * (p @ points.T), 0.0)
        far[~near[:, leaf]] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        live = np.arange(len(at))
        for r in range(0, far.shape[1], STEP):
            live = live[self.open(far[live, r], at[live])]
            if not len(live):
                return
            rows = order[live, r : r + STEP]
            score = np.einsum("qnd,qd->qn", vectors[rows], self.q[at[live]])
            score[np.isinf(far[live, r : r + STEP])] = -np.inf
            self.verified += int((score > -np.inf).sum())
            self.offer(at[live], score, ids[rows])

    def offer(self, asked: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores of vectors, a row for each of the queries ``asked``, into the k best."""
        score = np.where(ids == self.own[asked][:, None], -np.inf, score)
        some = np.nonzero(((score >= self.score[asked, -1][:, None]) & (score > -np.inf)).any(1))[0]
        if len(some):
            scores = np.concatenate([self.score[asked[some]], score[some]], 1)
            found = np.concatenate([self.id[asked[some]], ids[some]], 1)
            pick = np.lexsort((found, -scores), axis=1)[:, : self.k]
            self.score[asked[some]], self.id[asked[some]] = np.take_along_axis(scores, pick, 1), np.take_along_axis(found, pick, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): distinct rows with an id and a vector that is not null, zero, or holding null or non-finite numbers."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), (e if dict(vectors.dtypes)["embedding"] == "array<float>" else e.cast("array<double>")).alias("embedding")).where(F.col("vec_id").isNotNull() & e.isNotNull() & good).distinct()


def neighbours(vectors: DataFrame, asked: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each row that ``asked`` holds for.

    Ties go to the smaller vec_id; a row is no neighbour of its own id; fewer candidates give fewer rows.
    Vectors null, zero, or holding null or non-finite components take no part, nor do vectors whose
    length is not the commonest (the shorter, if equally common). Equal rows count once; an id with several vectors is
    a query for each, and each is a candidate. An empty table gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "vectors")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], FOUND)
    d, n, most = sizes["d"], sizes["n"], math.sqrt(sizes["most"])
    rows = rows.where(F.size("embedding") == d)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, SAMPLED / n) * (1 << 30))).select("embedding").toArrow()
    points = projected(_matrix(sample.column("embedding").combine_chunks()).astype(np.float64).reshape(-1, d), most)
    tree = splits(points, -(-n // BLOCK))

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding")).astype(np.float64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(routed(tree, projected(x, most))), b.column("vec_id"), b.column("embedding")], ["leaf", "vec_id", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    kept = stage(kept.mapInArrow(route, f"leaf long, vec_id long, embedding {kind}"), "routed")
    parts = kept.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = kept.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(9)), "parts"))
    folder = fresh_dir(spark, "kdtree")

    def write(key, t):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        b = build(t.column("vec_id").to_numpy(), _matrix(t.column("embedding").combine_chunks()).reshape(-1, d), most)
        np.savez(data := io.BytesIO(), **b)
        path = f"{base}/block-{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(path) as f:
            f.write(data.getvalue())
        return pa.table({"path": [path], "low": [b["low"].min(0).tolist()], "high": [b["high"].max(0).tolist()]})

    blocks = dealt.groupBy("leaf", "part").applyInArrow(write, "path string, low array<double>, high array<double>").toPandas().sort_values("path")
    fs, base = filesystem(folder)
    np.savez(data := io.BytesIO(), path=blocks["path"].to_numpy(str), low=np.array(blocks["low"].tolist()), high=np.array(blocks["high"].tolist()))
    with fs.open_output_stream(f"{base}/blocks.npz") as f:
        f.write(data.getvalue())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ASKED):
                yield from _search(folder, whole.slice(at, ASKED), d, most, k)

    queries = rows.where(asked)
    n_queries = queries.count()
    return queries.repartition(max(1, -(-n_queries // ASKED), min(n_queries, spark.sparkContext.defaultParallelism))).mapInArrow(search, FOUND)


def _search(folder: str, batch: pa.RecordBatch, d: int, most: float, k: int) -> Iterator[pa.RecordBatch]:
    fs, base = filesystem(folder)

    def load(path: str) -> dict[str, np.ndarray]:
        with fs.open_input_file(path) as f:
            return dict(np.load(io.BytesIO(f.read())))

    blocks = load(f"{base}/blocks.npz")
    s = Search(batch.column("vec_id").to_numpy(), _matrix(batch.column("embedding")).reshape(-1, d), most, k)
    far = s.far(blocks["low"], blocks["high"], np.arange(batch.num_rows))
    # Blocks that are nearest to most queries first: their finds let the test close others unread.
    for x in np.argsort(far.mean(0), kind="stable"):
        at = np.nonzero(s.open(far[:, x], np.arange(batch.num_rows)))[0]
        if len(at):
            s.block(load(str(blocks["path"][x])), at)
    row, col = np.nonzero(s.score > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(s.own[row]), pa.array((col + 1).astype(np.int32)), pa.array(s.id[row, col]), pa.array(s.score[row, col])], ["query_id", "rank", "vec_id", "score"])


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query: query_id, rank, vec_id, score; see ``neighbours`` for vectors that take no part, ties,
    repeated ids and empty tables."""
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLE: dict[str, str] = {}
