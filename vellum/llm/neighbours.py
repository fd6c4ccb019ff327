"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

A tree splits at the median of a projection on the difference of two random vectors. Vectors get one more component that brings them all to
the largest length, so the largest inner product is the smallest angle. The trees are fitted on a bounded sample; every row is then put into
one leaf of every tree. A query walks all trees through one priority queue: the branch whose summed squared distance to the splits it
violates is smallest comes next, whichever tree it is in, until the share of leaves is reached that gave the recall wanted on the sample.

Each vector is shuffled once, with the numbers of its leaves, to a chunk of rows that share leaves of the first tree. A query goes to the
chunks that hold rows of its leaves; there each row in any of these leaves is a candidate, however many trees found it, and is scored once,
by the inner product of the original vectors in double precision. The best of all chunks are the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.common import materialize, sized, table

#: Fit: at most so many rows, and so many bytes of vectors as doubles, of which so many serve as queries when the share of leaves is chosen for so much recall.
SAMPLE, SAMPLE_BYTES, PROBES, RECALL = 16_384, 1 << 26, 200, 0.95
#: So many trees; at least MIN_LEAVES leaves in each, more for tables of more than LEAF_ROWS x MIN_LEAVES rows, as far as the sample carries.
TREES, MIN_LEAVES, LEAF_ROWS = 8, 256, 4096
#: Groups of leaves, about so many, each cut into chunks of at least so many rows and so many bytes of vectors as doubles; queries of one task.
CHUNKS, CHUNK_ROWS, CHUNK_BYTES, SALT = 16, 256, 1 << 25, 1 << 16
#: So many more candidates than wanted are scored exactly; where that doesn't settle the order of nearly equal ones, all of these are.
MARGIN = 8


class Tree(NamedTuple):
    """Splits: planes, thresholds and children; a negative child -i-1 is leaf i. Without splits there is one leaf."""

    planes: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int


def build(points: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    size = max(1, -(-len(points) // leaves))
    planes, cuts, low, high, n_leaves = [], [], [], [], 0

    def split(own: np.ndarray) -> int:
        nonlocal n_leaves
        if len(own) > size:
            for _ in range(4):
                a, b = points[rng.choice(own, 2, replace=False)]
                if (norm := float(np.linalg.norm(a - b))) > 1e-12:
                    plane = (a - b) / norm
                    at = points[own] @ plane
                    cut = float(np.median(at))
                    left = at <= cut
                    if 0 < left.sum() < len(own):
                        i = len(planes)
                        planes.append(plane)
                        cuts.append(cut)
                        low.append(0)
                        high.append(0)
                        low[i] = split(own[left])
                        high[i] = split(own[~left])
                        return i
        n_leaves += 1
        return -n_leaves

    split(np.arange(len(points)))
    return Tree(np.array(planes).reshape(-1, points.shape[1]), np.array(cuts), np.array(low, dtype=np.int64), np.array(high, dtype=np.int64), n_leaves)


class Forest(NamedTuple):
    trees: list[Tree]
    length2: float
    share: float

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows with one more component: what they lack of the largest squared length; queries lack nothing."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.length2 - np.einsum("nd,nd->n", x, x)))
        return np.c_[x, rest]

    @property
    def first(self) -> np.ndarray:
        """The number of each tree's first leaf."""
        return np.cumsum([0, *(t.leaves for t in self.trees)])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree (rows x trees)."""
        x, out = self.lifted(x), np.zeros((len(x), len(self.trees)), dtype=np.int64)
        for t, tree in enumerate(self.trees):
            node = np.zeros(len(x), dtype=np.int64) if len(tree.planes) else np.full(len(x), -1)
            while (inner := np.flatnonzero(node >= 0)).size:
                k = node[inner]
                at = np.einsum("nd,nd->n", x[inner], tree.planes[k])
                node[inner] = np.where(at <= tree.cuts[k], tree.low[k], tree.high[k])
            out[:, t] = -node - 1 + self.first[t]
        return out

    def search(self, x: np.ndarray, rows: np.ndarray | None, least: int) -> Iterator[list[int]]:
        """For each query the leaves in the order of the shared queue: the share, and more until one tree has given `least` rows."""
        x, first = self.lifted(x, query=True), self.first
        wanted = int(np.ceil(self.share * first[-1]))
        for q in x:
            heap = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(self.trees)]
            had, found = [0] * len(self.trees), []
            while heap and (len(found) < wanted or rows is not None and max(had) < least):
                far, t, node = heapq.heappop(heap)
                tree = self.trees[t]
                while node >= 0:
                    d = float(q @ tree.planes[node]) - tree.cuts[node]
                    near, other = (tree.low[node], tree.high[node]) if d <= 0 else (tree.high[node], tree.low[node])
                    heapq.heappush(heap, (far + d * d, t, int(other)))
                    node = int(near)
                leaf = -node - 1 + int(first[t])
                found.append(leaf)
                if rows is not None:
                    had[t] += int(rows[leaf])
            yield found


def fit(sample: np.ndarray, total: int, length2: float, k: int, seed: int = 7) -> Forest:
    """A forest over at most SAMPLE vectors for a table of `total` rows, with the smallest share of leaves that finds RECALL of the k nearest."""
    rng = np.random.default_rng(seed)
    points = np.unique(sample, axis=0) if len(sample) else sample
    forest = Forest([], length2, 1.0)
    lifted = forest.lifted(points)
    leaves = int(max(1, min(max(MIN_LEAVES, total // LEAF_ROWS), len(points) // 8)))
    forest = forest._replace(trees=[build(lifted, leaves, rng) for _ in range(TREES)])
    if len(points) <= 4 * k or leaves == 1:
        return forest
    chosen = rng.choice(len(points), min(PROBES, len(points)), replace=False)
    scores = points[chosen] @ points.T
    scores[np.arange(len(chosen)), chosen] = -np.inf
    nearest = np.argsort(-scores, axis=1)[:, :k]
    where, seen_at = forest.leaves_of(points), []
    for wanted, order in zip(nearest, forest.search(points[chosen], None, 0), strict=True):
        place = np.full(forest.first[-1], len(order))
        place[order] = np.arange(len(order))
        seen_at += place[where[wanted]].min(axis=1).tolist()
    needed = np.sort(seen_at)[int(np.ceil(RECALL * len(seen_at))) - 1] + 1
    return forest._replace(share=float(needed / forest.first[-1]))


def usable(vector: str) -> Column:
    """Whether a vector takes part: neither null nor zero, and all components finite."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def inner_products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of one vector with rows. The components are summed in their order, so equal vectors have equal products."""
    out = np.zeros(len(rows))
    for d in range(len(q)):
        out += q[d] * rows[:, d]
    return out


class Chunk:
    """Rows of one chunk in order of their ids."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = self.vectors = self.leaves = None
        self.repeats, self.largest = False, 0.0

    def add(self, ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray) -> None:
        self.parts.append((ids, vectors, leaves))

    def nearest(self, query: int, q: np.ndarray, scores: np.ndarray, searched: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest candidates; of equal scores the smaller ids. `scores` come from a matrix product, whose last bits
        depend on its shape: they tell who may be among the nearest, and these are scored again."""
        candidates = np.flatnonzero(searched[self.leaves].any(axis=1) & (self.ids != query))
        near = scores[candidates]
        if len(candidates) > k and not self.repeats:
            cut = np.partition(near, len(near) - k)[len(near) - k]
            slack = 1e-9 * float(np.abs(q).max()) * self.largest * len(q)
            candidates = candidates[near >= cut - slack]
        exact = inner_products(q, self.vectors[candidates])
        order = np.lexsort((self.ids[candidates], -exact))
        if self.repeats:  # of rows with one id the nearest counts
            order = order[np.sort(np.unique(self.ids[candidates[order]], return_index=True)[1])]
        return self.ids[candidates[order[:k]]], exact[order[:k]]

    def batch(self, queries: np.ndarray, q: np.ndarray, searched: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of each query with vector q and searched leaves (queries x leaves)."""
        scores = q @ self.vectors.T
        if self.repeats:
            return [(query, *self.nearest(int(query), v, s, own, k)) for query, v, s, own in zip(queries, q, scores, searched, strict=True)]
        candidate = np.zeros(scores.shape, dtype=bool)
        for t in range(self.leaves.shape[1]):
            candidate |= searched[:, self.leaves[:, t]]
        at = np.minimum(np.searchsorted(self.ids, queries), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[at] == queries)
        candidate[own, at[own]] = False
        near = np.where(candidate, scores, -np.inf)
        m = min(k + MARGIN, len(self.ids))
        best = np.argpartition(-near, m - 1, axis=1)[:, :m]
        rough, exact = np.take_along_axis(near, best, axis=1), np.zeros(best.shape)
        for d in range(q.shape[1]):
            exact += q[:, d : d + 1] * self.vectors[best, d]
        exact[rough == -np.inf] = -np.inf
        order = np.lexsort((self.ids[best], -exact), axis=1)[:, :k]
        ids, found = np.take_along_axis(self.ids[best], order, axis=1), np.take_along_axis(exact, order, axis=1)
        # what was left out is no nearer than the roughest one taken; close to the last one kept, that settles nothing
        slack = 1e-9 * np.abs(q).max(axis=1, initial=0) * self.largest * q.shape[1]
        unsettled = (rough.min(axis=1) >= found[:, -1] - slack) & (found[:, -1] > -np.inf) & (m < len(self.ids))
        out = []
        for i, query in enumerate(queries):
            if unsettled[i]:
                out.append((query, *self.nearest(int(query), q[i], scores[i], searched[i], k)))
            else:
                n = int((found[i] > -np.inf).sum())
                out.append((query, ids[i, :n], found[i, :n]))
        return out

    def gather(self) -> None:
        ids, vectors, leaves = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(ids, kind="stable")
        self.repeats = bool((np.diff(ids[order]) == 0).any())
        self.ids, self.vectors, self.leaves, self.parts = ids[order], vectors[order], leaves[order], []
        self.largest = float(np.abs(self.vectors).max())


def rerank(batches: Iterator[pa.RecordBatch], width: int, trees: int, leaves: int, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score): the k nearest candidates of each chunk for each query, from rows (chunk, salt, query, id, vector, own leaves,
    searched leaves as bits) sorted by the first three."""
    key, chunk = None, Chunk()
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1).astype(np.int64)
        query, own_ids, x = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy(), matrix(batch.column(4), width)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (query[1:] != query[:-1]), True]) if len(keys) else np.zeros(1, int)
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if key is None or (keys[a] != key).any():
                key, chunk = keys[a], Chunk()
            if not query[a]:
                chunk.add(own_ids[a:b], x[a:b], batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees))
            elif chunk.parts or chunk.ids is not None:
                if chunk.ids is None:
                    chunk.gather()
                step = max(1, (1 << 21) // len(chunk.ids))
                for at in range(a, b, step):
                    to = min(b, at + step)
                    bits = np.frombuffer(b"".join(batch.column(6).slice(at, to - at).to_pylist()), np.uint8).reshape(to - at, -1)
                    searched = np.unpackbits(bits, axis=1, count=leaves).astype(bool)
                    found += [(np.full(len(ids), query), ids, best) for query, ids, best in chunk.batch(own_ids[at:to], x[at:to], searched, k)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of rows(vec_id, embedding) where `queries` holds, its k nearest other rows found,
    largest inner product first, ties to the smaller vec_id; all other rows, where there are fewer.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part on either side, nor do
    rows without id. Repeated rows count once. An empty table gives no rows; other columns aren't read.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.coalesce(queries, F.lit(False)).alias("query")).where(usable("vector") & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("length2")).orderBy(F.desc("n"), "width").first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    width, total = sizes["width"], sizes["n"]
    rows = rows.where(F.size("vector") == width)
    bound = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < min(1.0, bound / total) * (1 << 30)).select("id", "vector").limit(2 * bound).collect()
    sample = np.array([r["vector"] for r in sorted(picked, key=lambda r: r["id"])[:bound]], dtype=np.float64).reshape(-1, width)
    forest = fit(sample, total, sizes["length2"], k)
    shipped = spark.sparkContext.broadcast(forest)
    kind, leaves, trees = rows.schema["vector"].dataType.simpleString(), int(forest.first[-1]), len(forest.trees)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shipped.value.leaves_of(matrix(batch.column(1), width)).astype(np.int32)
            at = pa.array(np.arange(len(own) + 1, dtype=np.int32) * trees)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(own.ravel()))], ["id", "vector", "query", "leaves"])

    indexed = materialize(rows.select("id", "vector", "query").mapInArrow(index, f"id long, vector {kind}, query boolean, leaves array<int>"))
    # one row for each leaf: TREES times a number of leaves that the sample bounds
    counts = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    held = np.zeros(leaves, np.int64)
    held[[r["leaf"] for r in counts]] = [r["n"] for r in counts]
    # neighbouring leaves of the first tree make up about CHUNKS groups; a group is cut into chunks of bounded size
    group, rows_in = np.zeros(forest.trees[0].leaves, np.int64), [0]
    for cell, n in enumerate(held[: len(group)].tolist()):
        if rows_in[-1] and rows_in[-1] + n > max(CHUNK_ROWS, total // CHUNKS):
            rows_in.append(0)
        group[cell] = len(rows_in) - 1
        rows_in[-1] += n
    parts = np.maximum(1, -(-np.array(rows_in) // max(CHUNK_ROWS, CHUNK_BYTES // (8 * width))))
    start = np.cumsum(parts) - parts
    places = spark.createDataFrame([(i, int(k), int(start[k]), int(parts[k])) for i, k in enumerate(group)], "cell int, grp int, start int, parts int")
    dealt = indexed.join(F.broadcast(places), F.element_at("leaves", 1) == F.col("cell"))
    reached = np.zeros((leaves, len(parts)), dtype=bool)
    for r in dealt.select("grp", F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.collect_set("grp").alias("groups")).collect():
        reached[r["leaf"], r["groups"]] = True
    ways = spark.sparkContext.broadcast((held, reached, start, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reached, start, parts = ways.value
        for batch in batches:
            bits, asked = [], []
            for own in shipped.value.search(matrix(batch.column(1), width), held, k + 1):
                searched = np.zeros(leaves, dtype=bool)
                searched[own] = True
                bits.append(np.packbits(searched).tobytes())
                asked.append(np.concatenate([np.arange(start[g], start[g] + parts[g]) for g in np.flatnonzero(reached[own].any(axis=0))] or [start[:0]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(asked, pa.list_(pa.int32()))], ["id", "vector", "searched", "chunks"])

    probes = materialize(indexed.where("query").select("id", "vector").dropDuplicates(["id"]).mapInArrow(probe, f"id long, vector {kind}, searched binary, chunks array<int>"))
    # one row a chunk: about CHUNKS, or the bytes of the table over CHUNK_BYTES
    asked = probes.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    asked = sized(materialize(asked))
    dealt = dealt.withColumn("chunk", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    left = dealt.join(asked, "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"), "id", "vector", "leaves", F.lit(None).cast("binary").alias("searched"))
    asking = probes.select("id", "vector", "searched", F.explode("chunks").alias("chunk")).join(asked, "chunk")
    right = asking.select("chunk", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("query"), "id", "vector", F.lit(None).cast("array<int>").alias("leaves"), "searched")
    met_rows = left.union(right).repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "query")
    found = met_rows.mapInArrow(lambda batches: rerank(batches, width, trees, leaves, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest of all embeddings, for those whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
