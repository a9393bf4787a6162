"""Near-duplicate documents by min-max hashing, every link confirmed on full shingle sets.

A document's set is its distinct `k`-word shingles over words lower-cased in A-Z; with fewer words the whole
sequence is one shingle; without words, or with a null text, the set is empty and is linked with nothing. Two
documents are linked if `100 * intersection >= percent * union`.

1. One pass over the texts makes each set's signature: under each of 64 permutations both the smallest and the
   largest value, which are two nearly independent samples of the set for one hash evaluation. Bands of rows of
   the 128 values are chosen so that a pair at the threshold shares no band with a chance below one in a million.
2. Equal sets collapse to one class (a map-side combined aggregation); all that follows is over classes.
3. Classes that share a band, directly or in turn, form a family, which is dealt over blocks of about `block` classes.
   A block's pairs never leave its task: classes that are joined already are not compared, signatures discard most of
   the others, exact sets decide the rest, and a task returns one root a class.
4. Of families larger than a block, the roots of all blocks are joined likewise, each block's by its smallest class.
   Only what is then apart from a family's largest part is compared with the rest of the family, in pairs of blocks.
5. Connected components of the links that this finds, joined back to the documents.

A signature discards a pair whose share of equal values lies six and a half standard deviations below the threshold,
which for a linked pair has a chance of less than one in 10**10.

Shingles are compared by 64-bit hashes. Sets are made again from the texts for classes that have a family,
rather than moved for all documents. Repeated rows are equal sets; rows that share a key count as one document,
linked by any of its texts (its rows with words have one component);
null keys and empty sets keep to themselves (a null key has a null component and a null `kept`). An empty table
gives no rows; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import batches, mix
from muster.llm.components import components
from muster.llm.shingles import shingle_sets
from muster.llm.tables import keep, load

PERMUTATIONS = 64
_ODD = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_FLIP = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def band_rows(percent: int) -> int:
    """The most rows a band may have so that a pair at the threshold is missed less than once in a million."""
    t = percent / 100
    return max(r for r in range(1, 9) if r == 1 or (1 - t**r) ** (2 * PERMUTATIONS // r) <= 1e-6)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value under each permutation, then largest under each."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(hashes), 4096):
        v = (hashes[None, k : k + 4096] ^ _FLIP[:, None]) * _ODD[:, None]
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate((low, high))


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = len(sig) // rows
    h = np.arange(bands, dtype=np.uint64)
    for column in sig[: bands * rows].reshape(bands, rows).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    """Two sums over a set and its size, which tell sets apart whatever the order of their hashes."""
    return int(np.add.reduce(mix(s)).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(1)), initial=0).astype(np.uint64).view(np.int64)), len(s)


def _signatures(k: int, rows: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(parts):
            n, f1, f2, bands, short = [], [], [], [], []
            for s in shingle_sets(texts, k):
                sig = signature(s)
                for column, value in zip((f1, f2, n), fingerprint(s), strict=True):
                    column.append(value)
                bands.append(band_keys(sig, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
                short.append((mix(sig) & np.uint64(255)).astype(np.uint8).tobytes())
            flat, ends = np.concatenate(bands), np.cumsum([0] + [len(b) for b in bands])
            columns = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())]
            columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "f1", "f2", "bands", "short"])

    return run


def _sets(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in batches(parts):
            sets = list(shingle_sets(texts, k))
            marks = [fingerprint(s) for s in sets]
            columns = [pa.array([m[c] for m in marks], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], names=["f1", "f2", "n", "set"])

    return run


def _groups(parts: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in parts:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            own = tuple(int(c[a]) for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _least(percent: int) -> float:
    """Share of equal values under which a signature rules a pair out: six and a half standard deviations of the
    estimate below the threshold."""
    t = percent / 100
    return t - 6.5 * np.sqrt(t * (1 - t) / (2 * PERMUTATIONS))


class _Sets:
    """Sets and signatures of some classes, and their labels: classes of one label are joined already, as those of one
    key are from the start."""

    def __init__(self, table: pa.Table, percent: int, label: np.ndarray):
        self.percent, self.least = percent, _least(percent)
        self.sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        self.sizes = np.array([len(s) for s in self.sets])
        self.short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(len(self.sets), -1)
        self.label = label

    def join(self, x: int, other: np.ndarray) -> Iterator[int]:
        """Those of `other` that are linked with `x` and were not joined with it, each once its label is x's."""
        other = other[self.label[other] != self.label[x]]
        if not len(other):
            return
        small, large = np.minimum(self.sizes[other], self.sizes[x]), np.maximum(self.sizes[other], self.sizes[x])
        other = other[100 * small >= self.percent * large]
        other = other[(self.short[other] == self.short[x]).mean(axis=1) >= self.least]
        if not len(other):
            return
        some = np.concatenate([self.sets[y] for y in other.tolist()])
        at = np.minimum(np.searchsorted(self.sets[x], some), self.sizes[x] - 1)
        ends = np.cumsum(self.sizes[other])
        both = np.add.reduceat((self.sets[x][at] == some).astype(np.int64), ends - self.sizes[other])
        for y in other[100 * both >= self.percent * (self.sizes[other] + self.sizes[x] - both)].tolist():
            if self.label[y] != self.label[x]:
                yield y
                self.label[self.label == self.label[y]] = self.label[x]


def _join_blocks(percent: int):
    """Of each block (family, own) every class with its root, the smallest class that it is joined with there; roots
    keep their sets and signatures."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(parts, ("family", "own")):
            reps = table.column("rep").to_numpy()
            held = _Sets(table, percent, np.unique(reps, return_inverse=True)[1].ravel().copy())
            rest = np.arange(len(reps))
            for x in rest.tolist():
                for _ in held.join(x, rest[x + 1 :]):
                    pass
            first = {}
            for k in np.argsort(reps, kind="stable").tolist():
                first.setdefault(int(held.label[k]), int(reps[k]))
            root = np.array([first[int(x)] for x in held.label])
            own = (root == reps).tolist()
            columns = [table.column("family").combine_chunks(), pa.array(reps), pa.array(root)]
            columns += [pa.array([v if mine else None for v, mine in zip(table.column(c).to_pylist(), own, strict=True)], pa.binary()) for c in ("short", "set")]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["family", "rep", "root", "short", "set"])

    return run


def _join_pairs(percent: int):
    """Of each pair of blocks (family, bi, bj) links between roots: no more than it has roots."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(parts, ("family", "bi", "bj")):
            roots = table.column("root").to_numpy()
            side = table.column("side").to_numpy()
            known, label = np.unique(roots, return_inverse=True)
            held = _Sets(table, percent, label.ravel().copy())
            same_block = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
            left = np.flatnonzero(side == 0)
            right = left if same_block else np.flatnonzero(side == 1)
            found = [(int(roots[x]), int(roots[y])) for k, x in enumerate(left.tolist()) for y in held.join(x, right[k + 1 :] if same_block else right)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


#: Rows of a table of large families that may be broadcast.
BROADCAST_FAMILIES = 100_000


def _small(df: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_FAMILIES else df


def _blocks(rows: DataFrame, n_of: DataFrame, block: int) -> DataFrame:
    """Rows dealt over blocks (family, own) of about `block` rows; `n_of`: rows of each family that has more."""
    own = F.pmod(F.xxhash64("rep"), F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("bigint"))
    dealt = rows.join(n_of, "family", "left").withColumn("own", own).drop("rows")
    return dealt.repartition("family", "own").sortWithinPartitions("family", "own")


JOINED = "family bigint, rep bigint, root bigint, short binary, set binary"


def _roots(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(rep, root) of all members of families: the root is the smallest class that a class is joined with.

    Families of up to `block` classes are one block and done. Of larger ones the roots of all blocks are joined in
    blocks of their own; then what is not joined with a family's largest part is compared with all the rest of it,
    unless joined already.
    """
    n_of = members.groupBy("family").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    large = _small(keep(n_of))
    inner = keep(_blocks(members, large, block).mapInArrow(_join_blocks(percent), JOINED))
    roots = inner.select("rep", "root").distinct()  # a key with several texts has several sets
    again = inner.where("rep = root").join(large.select("family"), "family").select("family", "rep", "short", "set")
    n_roots = keep(again.groupBy("family").agg(F.count("*").alias("rows")).where("rows > 1"))
    if not n_roots.limit(1).count():
        return roots
    again = again.join(_small(n_roots).select("family"), "family")
    outer = keep(_blocks(again, _small(n_roots), block).mapInArrow(_join_blocks(percent), JOINED).select("family", F.col("rep").alias("root"), F.col("root").alias("outer")).distinct())
    roots = keep(roots.join(outer.select("root", "outer"), "root", "left").select("rep", F.coalesce("outer", "root").alias("root")))
    links = _block_links(members, roots, outer, percent, block)
    if links is None:
        return roots
    moved = components(links).select(F.col("node").alias("root"), "component")
    return roots.join(moved, "root", "left").select("rep", F.coalesce("component", "root").alias("root"))


def _block_links(members: DataFrame, roots: DataFrame, outer: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between roots of families that have several still, found in pairs of blocks.

    `settled` blocks hold the classes of a family's largest part, `open` ones the others. Pairs of open blocks and pairs
    of an open and a settled block are compared; settled ones are already one component.
    """
    several = keep(outer.groupBy("family").agg(F.countDistinct("outer").alias("parts")).where("parts > 1").select("family"))
    if not several.limit(1).count():
        return None
    held = members.join(_small(several), "family").join(roots, "rep")
    parts = held.groupBy("family", "root").agg(F.count("*").alias("n"))
    blocks = parts.groupBy("family").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    blocks = keep(blocks.select(
        "family", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / block).alias("open"), F.ceil(F.col("main.n") / block).alias("settled")
    ))
    placed = held.join(_small(blocks), "family").withColumn("joined", F.col("root") == F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("joined"), F.col("settled")).otherwise(F.col("open"))))
    # open blocks are numbered from 0, settled ones from the number of open ones on
    with_open = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("open") - 1), lambda j: F.struct(F.least("own", j).alias("bi"), F.greatest("own", j).alias("bj"), (F.col("own") > j).cast("int").alias("side")))
    with_settled = F.transform(F.sequence(F.col("open"), F.col("open") + F.col("settled") - 1), lambda j: F.struct(F.col("own").alias("bi"), j.alias("bj"), F.lit(0).alias("side")))
    from_settled = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("open") - 1), lambda j: F.struct(j.alias("bi"), (F.col("own") + F.col("open")).alias("bj"), F.lit(1).alias("side")))
    to = F.when(F.col("joined"), from_settled).otherwise(F.concat(with_open, with_settled))
    spread = placed.select("family", "root", "short", "set", F.explode(to).alias("to")).select("family", "to.bi", "to.bj", "to.side", "root", "short", "set")
    dealt = spread.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
    return keep(dealt.mapInArrow(_join_pairs(percent), "a bigint, b bigint"))


def _joined_by_keys(useful: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """`found` (rep, root), with the classes of every key that has several texts joined as well."""
    same = ["f1", "f2", "n"]
    bounds = [f(c).alias(f"{c}_{side}") for c in same for side, f in (("low", F.min), ("high", F.max))]
    several = useful.groupBy("doc").agg(*bounds).where(" or ".join(f"{c}_low <> {c}_high" for c in same)).select("doc")
    own = keep(useful.select("doc", *same).join(several, "doc").distinct())
    if not own.limit(1).count():
        return found
    own = own.join(classes.select("rep", *same), same)
    links = own.join(own.groupBy("doc").agg(F.min("rep").alias("root")), "doc").select("rep", "root").where("rep <> root")
    joined = components(found.unionByName(links), "rep", "root")
    return joined.select(F.col("node").alias("rep"), F.col("component").alias("root")).where("rep <> root")


def near_duplicates(docs: DataFrame, percent: int, k: int = 5, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: its key, n_shingles, component_id (smallest key reachable over links), kept."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    rows = band_rows(percent)
    signed = keep(texts.mapInArrow(_signatures(k, rows), "doc bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, short binary"))
    useful = signed.where("n > 0 and doc is not null")
    classes = keep(useful.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("short").alias("short")))

    banded = classes.select("rep", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1")
    near = banded.join(leaders, "band").where("rep <> leader").groupBy("rep").agg(F.collect_set("leader").alias("leaders"))  # a leader a band at most
    # a class's first leader stands for it, and its other leaders are linked with that one: few links for large families
    first = F.array_min("leaders")
    stars = near.select(first.alias("a"), F.explode(F.transform("leaders", lambda x: F.when(x == first, F.col("rep")).otherwise(x))).alias("b"))
    family = keep(components(stars.distinct()).select(F.col("node").alias("rep"), F.col("component").alias("family")))

    same = ["f1", "f2", "n"]
    members = family.join(classes.select("rep", "short", *same), "rep")
    sets = texts.join(family.select(F.col("rep").alias("doc")), "doc", "left_semi").mapInArrow(_sets(k), "f1 bigint, f2 bigint, n bigint, set binary")
    members = keep(members.join(sets.groupBy(*same).agg(F.min("set").alias("set")), same).select("family", "rep", "short", "set"))
    found = _joined_by_keys(useful, classes, _roots(members, percent, block).where("rep <> root"))

    labelled = classes.join(found, "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("component"))
    # rows that are in no class are dealt by their keys and, by a size that no class has, match none
    is_useful = F.expr("n > 0 and doc is not null")
    out = signed.select("doc", F.col("n").alias("own_n"), F.when(is_useful, F.col("f1")).otherwise(F.xxhash64("doc", F.col("f2"))).alias("f1"), "f2", F.when(is_useful, F.col("n")).otherwise(F.lit(-1).cast("bigint")).alias("n"))
    out = out.join(labelled, ["f1", "f2", "n"], "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("own_n").alias("n_shingles"), component.alias("component_id"), (F.col("doc") == component).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), percent=85)
