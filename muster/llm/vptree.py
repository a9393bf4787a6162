"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Inner products are turned into distances: with M the largest norm of a shard, a vector x gets the further component
sqrt(M^2 - |x|^2) and a query the component 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest has the largest
inner product. A tree's node holds a vantage point and the median distance to it; a search goes into the nearer
half first and into the other half unless its bound exceeds `factor` times the k-th distance found so far. Factor
1 is the triangle inequality and gives exact results; a smaller one gives up some of them. Rows as near as the last
one found are all collected and decided by their scores in double precision, then by their keys.

Every valid row is indexed, in shards of about `shard_rows` rows chosen by a hash of the key. Each shard's tree is
built once; each block of `block_queries` queries meets each tree in a task of its own, so neither side is ever
whole in one task. Equal vectors of a shard are one entry of the tree with their k + 1 smallest keys (no result can
hold more of them). Vectors that are null or zero or hold null or non-finite components take no part, as rows or as
queries; vectors only meet vectors of their own length. Null keys take no part. A key that occurs repeatedly with one
vector counts once a shard; extra columns are left out. Without valid rows there are no results.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.tables import keep, load


#: Pairs of a query and a row that a search holds before it keeps the best.
MAX_PAIRS = 1 << 21

#: Different vector lengths up to which their table of shards is broadcast.
MAX_LENGTHS = 10_000


class VpTree:
    """Over rows of a matrix; `leaf` rows at most in a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = 512, seed: int = 7):
        self.points = points
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (first, end, vantage row, radius, inner, outer); a leaf has vantage -1
        self.root = self._build(0, len(points), leaf, rng)

    def _build(self, a: int, b: int, leaf: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b, -1, 0.0, -1, -1))
        if b - a <= leaf:
            return me
        rows = self.order[a:b]
        vantage = int(rows[rng.integers(len(rows))])
        d = np.linalg.norm(self.points[rows] - self.points[vantage], axis=1)
        by = np.argsort(d, kind="stable")
        self.order[a:b] = rows[by]
        mid = (b - a) // 2
        inner = self._build(a, a + mid, leaf, rng)
        outer = self._build(a + mid, b, leaf, rng)
        self.nodes[me] = (a, b, vantage, float(d[by[mid]]), inner, outer)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float, least: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row): the k nearest rows found of each query and, but for what `least` leaves of them, all that
        are as near as the k-th, since rounding must not decide between equally near ones.

        A first descent finds the k-th distance, a second one collects what is within it. `least` gets pairs and says
        which to keep; it is asked whenever many have been collected, so that ties never fill the memory.
        """
        n = len(queries)
        self.q, self.k, self.factor = queries, k, factor
        self.squares = (queries**2).sum(axis=1)
        self.leafs = (self.points**2).sum(axis=1)
        self.best = np.full((n, k), np.inf)
        self.kth = np.full(n, np.inf)
        self.visited = 0
        self._descend(self.root, np.arange(n), self._nearest)
        # squared distances are known to about 16 digits of the squares that they come from
        self.within = self.kth**2 + 1e-12 * (self.squares + self.leafs.max(initial=0.0))
        self.kth = np.sqrt(self.within)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.least = 0, least
        self._descend(self.root, np.arange(n), self._collect)
        self._compact()
        return self.found[0]

    def _squared(self, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.squares[who, None] + self.leafs[rows][None, :] - 2 * self.q[who] @ self.points[rows].T, 0)

    def _nearest(self, who: np.ndarray, rows: np.ndarray) -> None:
        d = np.sqrt(self._squared(who, rows))
        self.visited += d.size
        some = (d < self.kth[who, None]).any(axis=1)
        who, d = who[some], d[some]
        if len(who):
            d = np.concatenate((self.best[who], d), axis=1)
            self.best[who] = np.partition(d, self.k - 1, axis=1)[:, : self.k]
            self.kth[who] = self.best[who].max(axis=1)

    def _collect(self, who: np.ndarray, rows: np.ndarray) -> None:
        q, r = np.nonzero(self._squared(who, rows) <= self.within[who, None])
        self.found.append((who[q], rows[r]))
        self.held += len(q)
        if self.held > MAX_PAIRS:
            self._compact()

    def _compact(self) -> None:
        who, rows = (np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.int64) for k in (0, 1))
        kept = self.least(who, rows)
        self.found, self.held = [(who[kept], rows[kept])], len(kept)

    def _descend(self, node: int, who: np.ndarray, at_leaf: Callable[[np.ndarray, np.ndarray], None]) -> None:
        a, b, vantage, radius, inner, outer = self.nodes[node]
        if vantage < 0:
            at_leaf(who, self.order[a:b])
            return
        d = np.linalg.norm(self.q[who] - self.points[vantage], axis=1)
        within = d < radius
        for near, far, group in ((inner, outer, within), (outer, inner, ~within)):
            mine, dist = who[group], np.abs(d[group] - radius)
            if len(mine):
                self._descend(near, mine, at_leaf)
                # a little slack, so that rounding never hides an equally near row
                left = dist <= self.factor * self.kth[mine] + 1e-9
                if left.any():
                    self._descend(far, mine[left], at_leaf)


def to_blob(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load_blob(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return keys, flat.reshape(len(keys), -1)


def _part(key: tuple, data: bytes) -> pa.Table:
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def _gather(key: tuple, table: pa.Table) -> pa.Table:
    """A block's queries as one binary value."""
    keys, x = _matrix(table)
    keys, first = np.unique(keys, return_index=True)
    return _part(key, to_blob(keys=keys, x=x[first]))


def _build_tree(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, x = _matrix(table)
        by = np.argsort(keys, kind="stable")
        keys, x = keys[by], x[by]
        _, first, group = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)  # + 0.0: one zero
        _, once = np.unique(np.stack((group.ravel(), keys)), axis=1, return_index=True)
        once.sort()
        keys, group = keys[once], group.ravel()[once]
        again = np.argsort(group, kind="stable")  # keys ascend within a group
        starts = np.searchsorted(group[again], np.arange(len(first)))
        place = np.arange(len(again)) - starts[group[again]]
        same = place <= k
        distinct = x[first]
        norms = (distinct**2).sum(axis=1)
        lifted = np.concatenate((distinct, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]), axis=1)
        tree = VpTree(lifted)
        nodes = np.array(tree.nodes, np.float64)
        return _part(key, to_blob(x=distinct, lifted=lifted, order=tree.order, nodes=nodes, owner=group[again][same], keys=keys[again][same]))

    return run


def _load_tree(data: bytes) -> tuple[VpTree, dict]:
    held = load_blob(data)
    tree = VpTree.__new__(VpTree)
    tree.points, tree.order, tree.root = held["lifted"], held["order"], 0
    tree.nodes = [(int(a), int(b), int(v), r, int(i), int(o)) for a, b, v, r, i, o in held["nodes"].tolist()]
    return tree, held


def _search(k: int, factor: float):
    def run(table: pa.Table) -> pa.Table:
        blobs = {kind: data for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True)}
        ids, found, scores = [], [], []
        if len(blobs) == 2:
            tree, held = _load_tree(blobs["tree"])
            block = load_blob(blobs["block"])
            q, q_keys = block["x"], block["keys"]
            lifted = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
            starts = np.searchsorted(held["owner"], np.arange(len(held["x"]) + 1))
            smallest = held["keys"][starts[:-1]]

            def scores_of(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
                parts = [(held["x"][rows[a : a + 8192]] * q[who[a : a + 8192]]).sum(axis=1) for a in range(0, len(who), 8192)]
                return np.concatenate(parts) if parts else np.zeros(0)

            def least(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
                """The k + 1 best rows of each query, ties by their smallest keys; one may be the query's own."""
                by = np.lexsort((smallest[rows], -scores_of(who, rows), who))
                first = np.searchsorted(who[by], np.arange(len(q)))
                return by[np.arange(len(by)) - first[who[by]] <= k]

            # one more than asked: the query's own row is among the rows
            who, rows = tree.search(lifted, min(k + 1, len(held["x"])), factor, least)
            score = scores_of(who, rows)
            counts = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            who, score, keys = np.repeat(who, counts), np.repeat(score, counts), held["keys"][at]
            other = keys != q_keys[who]
            who, score, keys = who[other], score[other], keys[other]
            by = np.lexsort((keys, -score, who))
            best = by[np.arange(len(by)) - np.searchsorted(who[by], np.arange(len(q)))[who[by]] < k]
            ids, found, scores = q_keys[who[best]], keys[best], score[best]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: float = 0.2,
    shard_rows: int = 16_384,
    block_queries: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found of every query."""
    named = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = named.where(F.col("id").isNotNull() & valid(F.col("vector"))).withColumn("dim", F.size("vector"))
    sizes = keep(rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).alias("shards"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / block_queries)).alias("blocks")))
    # one row a vector length: broadcast where these are few, so that no shuffle deals all rows out by their length
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_LENGTHS else sizes
    rows = rows.join(sizes, "dim")
    key = F.xxhash64("id")
    trees = rows.select("dim", F.pmod(key, "shards").alias("part"), "id", "vector").groupBy("dim", "part").applyInArrow(_build_tree(k), "dim int, part bigint, data binary")
    blocks = rows.where("asks").select("dim", F.pmod(key, "blocks").alias("part"), "id", "vector").groupBy("dim", "part").applyInArrow(_gather, "dim int, part bigint, data binary")
    to_blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    to_shards = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard")
    left = keep(trees).join(sizes, "dim").select("dim", F.col("part").alias("shard"), to_blocks, F.lit("tree").alias("kind"), "data")
    right = keep(blocks).join(sizes, "dim").select("dim", to_shards, F.col("part").alias("block"), F.lit("block").alias("kind"), "data")
    found = left.unionByName(right).groupBy("dim", "shard", "block").applyInArrow(_search(k, factor), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
