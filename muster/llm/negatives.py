"""Hard negatives: rows of other labels whose score lies in a window below that of a positive, by ball trees.

Vectors are made whole numbers (floor(256 x) of each component), so scores are exact. An anchor's positives are its best
rows of the same label; for each positive the best rows of other labels are sought whose score lies between `low` and
`high` percent of the positive's score. Ties go to the smaller key.

Rows are dealt out by a hash of their key, and each part gets one tree over all its rows. A node knows its rows' centre c
and radius r, so an anchor q scores between q.c - |q| r and q.c + |q| r with any of them, and it knows its labels' range. A
search leaves a node out if all its scores lie above or below the window, if they lie strictly beneath the k-th score found
so far, or if its labels can't fit. Blocks of anchors meet trees as groups of their own: first for the positives, which are
merged over all parts, then for the negatives. Nothing is given up: results are exact.

Rows with a null key, label or vector, or with a null or non-finite component take no part, nor do vectors whose squared
length times 65536 is 2**55 or more (their scores would not fit a long). Vectors meet vectors of their own length only. Of
rows that repeat a key with vectors of one length the one with the smallest label, then vector, counts; a row is never its own anchor's. Zero vectors
take part. Other columns are left out; without anchors there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.tables import keep, load
from muster.llm.vptree import MAX_LENGTHS, load_blob, to_blob

#: A score that no row has.
NONE = -(1 << 62)
#: Rows of a leaf that meet their searches at once.
CHUNK = 512
#: Squared lengths up to which sums in doubles are exact.
EXACT = 2.0**52


class BallTree:
    """Over rows of whole numbers; `leaf` rows at most in a leaf. Nodes split rows at the median along the line between two
    rows that lie far apart."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, keys: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(points))
        nodes, centres = [], []

        def build(a: int, b: int) -> int:
            me, rows = len(nodes), self.order[a:b]
            x = points[rows].astype(np.float64)
            centre = x.mean(axis=0)
            far = np.sqrt(((x - centre) ** 2).sum(axis=1))
            nodes.append([a, b, -1, -1, labels[rows].min(), labels[rows].max(), far.max() * (1 + 1e-9)])
            centres.append(centre)
            if b - a > leaf and far.max() > 0:
                one = x[far.argmax()]
                other = x[((x - one) ** 2).sum(axis=1).argmax()]
                along = np.argsort(x @ (other - one), kind="stable")
                self.order[a:b] = rows[along]
                mid = (a + b) // 2
                nodes[me][2], nodes[me][3] = build(a, mid), build(mid, b)
            return me

        build(0, len(points))
        self.nodes, self.centres = np.array(nodes, np.float64), np.array(centres)
        self.points, self.labels, self.keys = points[self.order], labels[self.order], keys[self.order]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"nodes": self.nodes, "centres": self.centres, "points": self.points, "labels": self.labels, "keys": self.keys}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BallTree:
        tree = cls.__new__(cls)
        tree.__dict__ |= arrays
        return tree

    def search(self, anchors: np.ndarray, labels: np.ndarray, keys: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each search the k best scores within [low, high] of rows with the anchor's label (`same`) or another one, and
        their keys, as arrays (searches, k); a score of NONE where there are fewer. `of` names each search's anchor."""
        exact = max(float((anchors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)), float((self.points.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) <= EXACT
        kind = np.float64 if exact else np.int64
        self.q, self.rows, self.q_float = anchors.astype(kind), self.points.astype(kind), anchors.astype(np.float64)
        self.norms = np.sqrt((self.q_float**2).sum(axis=1))
        self.who_label, self.who_key, self.of, self.low, self.high, self.k, self.same = labels, keys, of, low, high, k, same
        self.scores, self.found = np.full((len(of), k), NONE, np.int64), np.zeros((len(of), k), np.int64)
        self.computed = 0
        self._visit(0, np.arange(len(of)))
        return self.scores, self.found

    def _bounds(self, node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each search whether the node's labels and scores can fit, and the highest score that it may hold."""
        centre, radius = self.centres[node], self.nodes[node, 6]
        mid, reach = self.q_float @ centre, self.norms * radius
        reach = reach + 1e-9 * (self.norms * (radius + np.sqrt(centre @ centre))) + 1e-6
        of = self.of[who]
        upper, lower, label = (mid + reach)[of], (mid - reach)[of], self.who_label[of]
        first, last = self.nodes[node, 4], self.nodes[node, 5]
        fits = (label >= first) & (label <= last) if self.same else (first != last) | (label != first)
        return fits & (lower <= self.high[who]) & (upper >= self.low[who]), upper

    def _visit(self, node: int, who: np.ndarray) -> None:
        """`who` are searches for which this node may hold rows."""
        a, b, left, right = self.nodes[node, :4].astype(np.int64).tolist()
        if left < 0:
            for start in range(a, b, CHUNK):  # equal vectors make leaves of any size
                self._leaf(start, min(b, start + CHUNK), who)
            return
        bounds = {child: self._bounds(child, who) for child in (left, right)}
        first = bounds[left][1] >= bounds[right][1]
        for near, far, mine in ((left, right, first), (right, left, ~first)):
            for child in (near, far):
                fits, upper = bounds[child]
                # the k-th score may have risen meanwhile
                if len(some := who[mine & fits & (upper >= self.scores[who, -1])]):
                    self._visit(child, some)

    def _leaf(self, a: int, b: int, who: np.ndarray) -> None:
        anchors, inverse = np.unique(self.of[who], return_inverse=True)
        product = (self.q[anchors] @ self.rows[a:b].T).astype(np.int64)
        self.computed += product.size
        equal = self.who_label[anchors][:, None] == self.labels[None, a:b]
        may = (equal if self.same else ~equal) & (self.who_key[anchors][:, None] != self.keys[None, a:b])
        product = np.where(may, product, NONE)[inverse]
        product[(product < self.low[who, None]) | (product > self.high[who, None])] = NONE
        some = (product.max(axis=1) >= np.maximum(self.scores[who, -1], NONE + 1))
        who, product = who[some], product[some]
        if len(who):
            scores = np.concatenate((self.scores[who], product), axis=1)
            keys = np.concatenate((self.found[who], np.broadcast_to(self.keys[a:b], product.shape)), axis=1)
            by = np.lexsort((keys, -scores), axis=1)[:, : self.k]
            self.scores[who], self.found[who] = np.take_along_axis(scores, by, 1), np.take_along_axis(keys, by, 1)


def _whole(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(256 * vectors)
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (ascending), labels, vectors of whole numbers and places in the table; one row a key."""
    keys, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(keys), -1)
    by = np.lexsort((*vectors.T[::-1], labels, keys))
    _, first = np.unique(keys[by], return_index=True)
    at = by[first]
    return keys[at], labels[at], _whole(vectors[at]), at


def _part(key: tuple, data: bytes) -> pa.Table:
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def _tree(leaf: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, labels, points, _ = _rows(table)
        return _part(key, to_blob(**BallTree(points, labels, keys, leaf).arrays()))

    return run


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """A block's anchors; where rows come with positives, also those, by the anchor's number."""
    keys, labels, points, at = _rows(table)
    held = {"keys": keys, "labels": labels, "points": points}
    if "positives" in table.column_names:
        lists = [table.column("positives")[k].as_py() for k in at.tolist()]
        found = [(n, p["id"], p["score"]) for n, ps in enumerate(lists) for p in ps]
        held |= {name: np.array([f[k] for f in found], np.int64) for k, name in enumerate(("of", "positive", "score"))}
    return _part(key, to_blob(**held))


def _meet(k: int, low: int, high: int):
    """A block's best rows in one tree: positives, or negatives where the block has positives."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = dict(zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True))
        cols = [np.zeros(0, np.int64)] * 5
        if len(blobs) == 2:
            tree, block = BallTree.of(load_blob(blobs["tree"])), load_blob(blobs["block"])
            same = "of" not in block
            n = len(block["keys"])
            of = np.arange(n) if same else block["of"]
            score = np.zeros(n, np.int64) if same else block["score"]
            positive = block["keys"] if same else block["positive"]
            least, most = (np.full(n, NONE), np.full(n, -NONE)) if same else (-(-low * score // 100), high * score // 100)
            scores, found = tree.search(block["points"], block["labels"], block["keys"], of, least, most, k, same)
            search, place = np.nonzero(scores != NONE)
            cols = [block["keys"][of[search]], positive[search], score[search], found[search, place], scores[search, place]]
        names = ("anchor_id", "positive_id", "positive_score", "found_id", "found_score")
        return pa.table({"dim": pa.array([key[0].as_py()] * len(cols[0]), pa.int32())} | {n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    return run


def _met(trees: DataFrame, blocks: DataFrame, sizes: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """All pairs of a tree and a block of the same length of vectors, met, and the k best of each search over all trees."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = trees.join(sizes, "dim").select("dim", F.col("part").alias("tree"), upto("blocks").alias("block"), F.lit("tree").alias("kind"), "data")
    right = blocks.join(sizes, "dim").select("dim", upto("parts").alias("tree"), F.col("part").alias("block"), F.lit("block").alias("kind"), "data")
    kinds = "dim int, anchor_id bigint, positive_id bigint, positive_score bigint, found_id bigint, found_score bigint"
    met = left.unionByName(right).groupBy("dim", "tree", "block").applyInArrow(_meet(k, low, high), kinds)
    order = Window.partitionBy("dim", "anchor_id", "positive_id").orderBy(F.desc("found_score"), "found_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    part_rows: int = 16_384,
    block_anchors: int = 1024,
    leaf: int = 128,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `is_anchor` must go by the key alone."""
    named = table.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < 2.0**39
    rows = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & short, F.lit(False))).withColumn("dim", F.size("vector")).where("dim > 0")
    sizes = keep(rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / part_rows)).alias("parts"), F.ceil(F.count_if("asks") / block_anchors).alias("blocks")).where("blocks > 0"))
    # one row a vector length: broadcast where these are few, so that no shuffle deals all rows out by their length
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_LENGTHS else sizes
    rows = rows.join(sizes, "dim")
    part = lambda n: F.pmod(F.xxhash64("id"), n).alias("part")
    kinds = "dim int, part bigint, data binary"
    trees = keep(rows.select("dim", part("parts"), "id", "label", "vector").groupBy("dim", "part").applyInArrow(_tree(leaf), kinds))
    anchors = rows.where("asks").select("dim", part("blocks"), "id", "label", "vector")
    blocks = keep(anchors.groupBy("dim", "part").applyInArrow(_block, kinds))
    best = _met(trees, blocks, sizes, positives, 0, 0)
    lists = best.groupBy("dim", F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("found_id").alias("id"), F.col("found_score").alias("score"))).alias("positives"))
    with_positives = anchors.join(lists, ["dim", "id"]).select("dim", "part", "id", "label", "vector", "positives")
    found = _met(trees, keep(with_positives.groupBy("dim", "part").applyInArrow(_block, kinds)), sizes, negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


def oracle() -> str:
    return """
WITH valid AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END lab, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id anchor_id, b.vec_id id, a.lab = b.lab same, CAST(list_inner_product(a.v, b.v) AS BIGINT) score FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id positive_id, score positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS "rank", id negative_id, positive_score, score negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
