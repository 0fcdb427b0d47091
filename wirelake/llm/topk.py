"""Exact top-k search by inner product with an M-tree.

Vectors are scaled to integers. One more coordinate gives all of them the norm of the longest, so that the order by
Euclidean distance to a query is the order by inner product, falling, and a metric tree applies. The tree's root level is
distributed: pivots (from a bounded sample) route every vector to the cell of the nearest, cells are cut into pages of
bounded size, and each cell has a covering radius. A query searches one page of its best cell first; the score
of its k-th result there rules out the cells whose covering ball is too far, and it searches the pages of the rest. In
a page a two-level M-tree of paged nodes is searched best first: nodes by their least possible distance, and inside a
node the stored distance to the parent spares computations by the triangle inequality. Every bound has a slack above
rounding, and scores are exact integers, so the results are exact with ties to smaller ids.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part, nor do null ids; a query
does not meet rows of its own id, a query id repeated asks once (with its least vector), other repeated rows each count;
vectors of different lengths are filled up with zeros; fewer than k candidates give all; an empty table gives an empty
result. Scores must fit 64 bits. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelake.llm.common import written

#: Vectors read for pivots; pivots at most; bounds of a page's size; queries that meet a copy of a page; a leaf's size.
SAMPLE, PIVOTS, PAGE, BLOCK, LEAF = 4096, 1024, (512, 65536), 2048, 32


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the integer vector, of the rows that take part."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
    bad = F.exists("_e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.where(~bad).select("vec_id", F.transform("_e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


class Space:
    """The metric: vectors with a coordinate more, all as long as ``most`` (squared); queries have 0 there."""

    def __init__(self, dim: int, most: float) -> None:
        self.dim, self.most = dim, most
        self.slack = 1e-6 * (1 + math.sqrt(most))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))

    def reach(self, norm2: float, score: float) -> float:
        """The distance beyond which no vector scores ``score``."""
        return math.inf if score == -math.inf else math.sqrt(max(0.0, norm2 + self.most - 2 * score)) + self.slack


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x``, each the farthest from those before; fewer if the rest are equal to one."""
    chosen = [0]
    near = Space.distances(x, x[:1])[:, 0]
    while len(chosen) < n:
        k = int(near.argmax())
        if near[k] <= 1e-9:
            break
        chosen.append(k)
        near = np.minimum(near, Space.distances(x, x[k : k + 1])[:, 0])
    return np.array(chosen)


class Node:
    """A page of the tree: entries with their distance to the node's router; of a node above, routers with radii and nodes."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> None:
        own = x[rows]
        self.children: list[Node] = []
        if len(rows) > LEAF:
            seeds = centres(own, max(2, math.ceil(len(rows) / LEAF)))
            if len(seeds) > 1:
                d = Space.distances(own, own[seeds])
                to = d.argmin(axis=1)
                kept = [k for k in range(len(seeds)) if (to == k).any()]
                self.routers = own[seeds[kept]]
                self.radii = np.array([d[to == k, k].max() for k in kept])
                self.parent = Space.distances(self.routers, parent[None])[:, 0]
                self.children = [Leaf(x, rows[to == k], own[seeds[k]]) for k in kept]
                return
        self.routers, self.radii = parent[None], np.array([Space.distances(own, parent[None]).max(initial=0.0)])
        self.parent, self.children = np.zeros(1), [Leaf(x, rows, parent)]


class Leaf:
    def __init__(self, x: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> None:
        self.rows = rows
        self.parent = Space.distances(x[rows], parent[None])[:, 0]


class MTree:
    """M-tree over one page of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, space: Space) -> None:
        self.ids, self.x, self.space = ids, x, space
        self.lifted = space.lift(x)
        self.top = self.lifted.mean(axis=0)
        self.root = Node(self.lifted, np.arange(len(x)), self.top)
        self.whole = np.abs(x).max(initial=0.0)

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = -math.inf) -> list[tuple[int, int]]:
        """(score, id) of the query's ``k`` best that score ``least`` or more, best first, ties to smaller ids."""
        space, norm2 = self.space, float(q @ q)
        exact = self.whole * np.abs(q).max(initial=0.0) * len(q) < 2**52
        whole_q = None if exact else [int(v) for v in q]
        lifted = np.append(q, 0.0)
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        reach = space.reach(norm2, least) if exact else math.inf

        def visit(leaf: Leaf, d: float) -> None:
            nonlocal reach
            rows = leaf.rows[np.abs(d - leaf.parent) <= reach] if math.isfinite(reach) else leaf.rows
            if not len(rows):
                return
            scores = self.x[rows] @ q if exact else [sum(int(a) * b for a, b in zip(r, whole_q, strict=True)) for r in self.x[rows]]
            if exact and len(best) == k:
                fit = scores >= best[0][0]
                rows, scores = rows[fit], scores[fit]
            elif exact and least != -math.inf:
                fit = scores >= least
                rows, scores = rows[fit], scores[fit]
            for s, i in zip(scores, self.ids[rows], strict=True):
                item = (int(s), -int(i))
                if int(i) == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and exact:
                reach = min(reach, space.reach(norm2, best[0][0]))

        root, d_top = self.root, float(np.linalg.norm(lifted - self.top))
        open_ = np.flatnonzero(np.abs(d_top - root.parent) - root.radii <= reach)
        queue: list[tuple[float, int, Leaf, float]] = []
        order = count()
        if len(open_):
            d = Space.distances(lifted[None], root.routers[open_])[0]
            for j, dist in zip(open_, d, strict=True):
                heapq.heappush(queue, (max(0.0, dist - root.radii[j]), next(order), root.children[j], float(dist)))
        while queue and queue[0][0] <= reach + space.slack:
            _, _, leaf, dist = heapq.heappop(queue)
            visit(leaf, dist)
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def searched(placed: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """(query_id, vec_id, score): best k of each page for the queries that were sent to it.

    Pages without queries do not move; a page that more than BLOCK queries ask goes out once for each BLOCK of them.
    """
    dim = space.dim
    copies = written(asked.groupBy("cell", "salt").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_copies")), "topk-copies")
    asked = asked.join(copies, ["cell", "salt"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.col("_copies")).cast("int")).drop("_copies")
    placed = placed.join(copies, ["cell", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")

    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(pages) and len(queries):
            tree = MTree(pages["vec_id"].to_numpy(), matrix(pages["v"], dim), space)
            q = matrix(queries["v"], dim)
            for i, (query, least) in enumerate(zip(queries["query_id"], queries["least"], strict=True)):
                rows += [(query, vec, score) for score, vec in tree.search(int(query), q[i], k, least)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ["cell", "salt", "block"]
    return placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every``, its k best among the others."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "topk-vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm2).alias("most")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(max(1, facts["dim"]), facts["most"])
    page = min(PAGE[1], max(PAGE[0], facts["n"] // 100))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    lifted = space.lift(matrix(pd.Series(sample), space.dim))
    pivots = lifted[centres(lifted, min(PIVOTS, math.ceil(facts["n"] / page)))]
    shared = spark.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = Space.distances(space.lift(matrix(pdf["v"], space.dim)), shared.value)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), far=d[np.arange(len(d)), cell])

    placed = written(rows.mapInPandas(place, "vec_id long, v array<long>, cell int, far double"), "topk-placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    salts, radii = {r["cell"]: math.ceil(r["n"] / page) for r in cells}, {r["cell"]: r["radius"] for r in cells}
    names = np.array(sorted(salts))
    salt_of = F.element_at(F.create_map(*[F.lit(x) for c in sorted(salts) for x in (int(c), salts[c])]), F.col("cell"))
    # Equal ids lie apart by their vectors.
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), salt_of).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = written(queries, "topk-queries")

    def send(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = matrix(pdf["v"], space.dim)
                norms = (q * q).sum(axis=1)
                bound = np.maximum(0.0, Space.distances(space.query(q), shared.value[names]) - np.array([radii[c] for c in names])[None])
                out = []
                for i, (query, v, least, cell, salt) in enumerate(zip(*[pdf[c] for c in ("query_id", "v", "least", "cell", "salt")], strict=True)):
                    if first:
                        c = int(names[bound[i].argmin()])
                        out.append((query, v, -math.inf, c, int(query) // every % salts[c]))
                        continue
                    reach = space.reach(norms[i], least)
                    for j in np.flatnonzero(bound[i] <= reach + space.slack):
                        c = int(names[j])
                        out += [(query, v, least, c, s) for s in range(salts[c]) if (c, s) != (cell, salt)]
                yield pd.DataFrame(out, columns=["query_id", "v", "least", "cell", "salt"])

        return run

    schema = "query_id long, v array<long>, least double, cell int, salt int"
    start = queries.select("query_id", "v", F.lit(-math.inf).alias("least"), F.lit(0).alias("cell"), F.lit(0).alias("salt"))
    asked = written(start.mapInPandas(send(True), schema), "topk-asked")
    head = written(searched(placed, asked, space, k), "topk-first")
    worst = head.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").cast("double").alias("_worst"))
    again = asked.drop("least").join(worst, "query_id", "left").withColumn("least", F.when(F.col("_n") >= k, F.col("_worst")).otherwise(F.lit(-math.inf)))
    # A float of 53 bits can lie above the score: one less is safe.
    again = again.select("query_id", "v", (F.col("least") - F.greatest(F.lit(1.0), F.abs("least") * 1e-12)).alias("least"), "cell", "salt")
    rest = searched(placed, written(again.mapInPandas(send(False), schema), "topk-again"), space, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return head.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
