"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups, and a proof for each row.

A row's leaf is the SHA-256 of its columns, each with its length before it. Within a group leaves stand in the order of
their keys; every two neighbours become the digest of their concatenation, an odd last one the digest of itself, until one
is left, the subroot. Subroots, in the order of their groups, become the root in the same way.

What is stored of a parent is its preimage, the concatenated digests of its children. Preimages are kept in blocks of 64
nodes (six levels), one row a block; a block also carries the preimages of all its own ancestors up to the root, so a leaf
joins one row and has them all. At each level the leaf's side is known from its place: cutting its own 64 characters out
of the preimage leaves its siblings, and putting another digest in their place and hashing is one step of folding.

Trees are built upwards block by block, all blocks of a level at once; groups of any size are cut into blocks, and places
within a group come from rows dealt by range. Only the height of the tallest tree comes to the driver.

Null columns are `-` in a leaf. Null groups are a group of their own, before all others; null keys come first, rows of
equal keys stand by their leaves, repeated rows are leaves of their own. An empty table has no rows and no root. Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.places import matched, placed
from muster.llm.tables import load, written

#: Characters of a digest, and levels of a block.
DIGEST, LEVELS = 64, 6


def leaf(*values: Column) -> Column:
    """The digest of values (strings or whole numbers), `-` where one is null, else its length in bytes, `:` and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _preimages(level: Column) -> Column:
    """Of each parent the digests of its children, one after the other."""
    pair = lambda j: F.concat(F.get(level, 2 * j), F.coalesce(F.get(level, 2 * j + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def _digests(preimages: Column) -> Column:
    return F.transform(preimages, lambda p: F.sha2(p, 256))


def _blocks(nodes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, block, `preimages` (by level, by parent), `top` (what the block becomes) and the group's levels above it.

    Of nodes with groups, place, digest and height, the levels up to their group's last node."""
    g = nodes.groupBy(*groups, F.shiftright("place", LEVELS).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda n: n["digest"]).alias("level"), F.max("height").alias("height")
    )
    steps = F.least(F.lit(LEVELS), F.col("height"))
    start = F.struct(F.col("level").alias("level"), F.array().cast("array<array<string>>").alias("preimages"))
    step = lambda acc, _: F.struct(_digests(_preimages(acc["level"])).alias("level"), F.concat(acc["preimages"], F.array(_preimages(acc["level"]))).alias("preimages"))
    built = g.withColumn("built", F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), steps), start, step))
    return built.select(*groups, "block", F.col("built.preimages").alias("preimages"), F.get("built.level", F.lit(0)).alias("top"), (F.col("height") - steps).alias("height"))


def _path(preimages: Column, place: Column) -> Column:
    """The preimages of a node's ancestors within its block, each with the number of the node's slot there."""
    at = place.bitwiseAND((1 << LEVELS) - 1).cast("int")
    right = lambda n: F.call_function("shiftright", at, n)
    return F.transform(preimages, lambda level, n: F.struct(F.get(level, right(n + 1)).alias("preimage"), right(n).bitwiseAND(1).alias("slot")))


class Forest:
    """The trees of all groups: blocks of preimages by stratum, the lowest first, and a last node for each group."""

    def __init__(self, rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str):
        """Of rows with groups, the columns of `order`, and a digest."""
        self.groups = list(groups)
        at = placed(rows, groups, order)
        last = at.groupBy(*groups).agg(F.max("place").alias("last"))
        # n nodes need as many levels as n - 1 has binary digits
        heights = last.select(*groups, F.when(F.col("last") == 0, 0).otherwise(F.length(F.bin("last"))).alias("height"))
        tallest = heights.agg(F.max("height")).first()[0] or 0
        self.nodes = at
        nodes = matched(at, heights, groups)
        self.strata: list[DataFrame] = []
        for k in range(max(1, -(-tallest // LEVELS))):
            self.strata.append(written(_blocks(nodes, groups), f"{name}-{k}"))
            nodes = self.strata[-1].select(*groups, F.col("block").alias("place"), F.col("top").alias("digest"), "height")
        self.tops = nodes.select(*groups, "digest")

    def lowest(self, above: DataFrame) -> DataFrame:
        """The lowest blocks, each with `path`, its ancestors up to the root, and what else `above` says of its group;
        `above` has the path of each group's last node."""
        found = matched(self.strata[-1].drop("top", "height"), above, self.groups)
        for blocks in reversed(self.strata[:-1]):
            upper = found.withColumnsRenamed({"block": "upper", "preimages": "upper_preimages"})
            found = matched(blocks.drop("top", "height"), upper, self.groups, {"upper": F.shiftright("block", LEVELS)})
            found = found.withColumn("path", F.concat(_path(F.col("upper_preimages"), F.col("block")), F.col("path"))).drop("upper_preimages")
        return found


def prove(rows: DataFrame, key: str, group: str, leaf_col: str, claim: Column) -> DataFrame:
    """key, leaf, subroot, root, path (of preimages and slots), proof_sha256 (the digest of all siblings, from the leaf
    upwards), folded_root (of the claimed leaf, or of the leaf itself where `claim` is null, with the siblings of the
    leaf) and verified (it equals the root)."""
    tidy = rows.select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(leaf_col).alias("digest"), claim.alias("claim"))
    leaves = written(tidy, "leaves")
    trees = Forest(leaves, ["group"], ["key", "digest"], "tree")
    subroots = trees.tops.withColumn("all", F.lit(0))
    roots = Forest(subroots, ["all"], ["group"], "root")
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    top = roots.lowest(roots.tops.select("all", none.alias("path"), F.col("digest").alias("root")))
    block, whole = {"block": F.shiftright("place", LEVELS)}, F.concat(_path(F.col("preimages"), F.col("place")), F.col("path")).alias("path")
    above = matched(roots.nodes, top, ["all"], block).select("group", whole, F.col("digest").alias("subroot"), "root")
    path = matched(trees.nodes, trees.lowest(above), ["group"], block).select("key", F.col("digest").alias("leaf"), "claim", "subroot", "root", whole)
    slot = lambda p: p["slot"] * DIGEST + 1
    siblings = F.transform("path", lambda p: F.overlay(p["preimage"], F.lit(""), slot(p), F.lit(DIGEST)))
    folded = F.aggregate("path", F.coalesce("claim", "leaf"), lambda h, p: F.sha2(F.overlay(p["preimage"], h, slot(p), F.lit(DIGEST)), 256))
    done = path.select(F.col("key").alias(key), "leaf", "subroot", "root", "path", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, tampered: Column, changes: dict[str, Column]) -> DataFrame:
    """The proofs of `docs` by doc_id and lang; where `tampered`, a row claims the leaf with `changes` made to columns."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    claimed = leaf(*(changes.get(n, F.col(n)) for n in names))
    rows = docs.select("doc_id", "lang", leaf(*(F.col(n) for n in names)).alias("leaf"), F.when(tampered, claimed).alias("claimed"))
    return prove(rows, "doc_id", "lang", "leaf", F.col("claimed"))


def tampering() -> tuple[Column, dict[str, Column]]:
    """A change to about every seventh row, by a checksum of its key: one more character than it has."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return chosen, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load(spark, sf_dir, "documents"), *tampering()).drop("path")


def oracle() -> str:
    """The same in SQL: levels by recursion, the tampered leaves folded with siblings looked up level by level."""
    enc = lambda c, v=None: f"coalesce(octet_length(encode(CAST({v or c} AS VARCHAR))) || ':' || CAST({v or c} AS VARCHAR), '-')"
    leaf_of = lambda n: f"sha256({enc('doc_id')} || {enc('source')} || {enc('lang')} || {enc('n_chars', n)} || {enc('text')})"
    levels = "SELECT {g} g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY g, level, n, pos // 2"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda k: list_reduce(list_concat([k], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) t),
docs AS (SELECT doc_id, lang, {leaf_of('n_chars')} leaf, {leaf_of('n_chars + 1')} claim,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[xor(c % 256, b) + 1], c // 256)), 4294967295) crc FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY lang) n FROM docs),
named AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 g FROM (SELECT DISTINCT lang FROM docs)),
placed AS (SELECT l.*, g FROM leaves l JOIN named m ON l.lang IS NOT DISTINCT FROM m.lang),
tree AS (SELECT g, 0 level, pos, n, leaf h FROM placed UNION ALL {levels.format(g='', t='tree')}),
subroots AS (SELECT g, level AS height, h FROM tree WHERE n = 1),
upper AS (SELECT 0 g, 0 level, g pos, count(*) OVER () n, h FROM subroots UNION ALL {levels.format(g='', t='upper')}),
root AS (SELECT level AS height, h FROM upper WHERE n = 1),
steps AS (SELECT doc_id, p.leaf, p.pos id, p.g, t.level, CAST(p.pos AS BIGINT) >> t.level AS seat FROM placed p JOIN tree t ON t.g = p.g AND t.pos = 0 AND t.n > 1
  UNION ALL SELECT doc_id, p.leaf, p.pos, p.g, s.height + u.level, CAST(p.g AS BIGINT) >> u.level FROM placed p JOIN subroots s USING (g) JOIN upper u ON u.pos = 0 AND u.n > 1),
all_nodes AS (SELECT g, level, pos, h FROM tree),
sides AS (SELECT s.g, s.id, s.level, s.seat, coalesce(CASE WHEN s.level < r.height THEN t.h ELSE u.h END, '') sib FROM steps s JOIN subroots r USING (g)
  LEFT JOIN all_nodes t ON t.g = s.g AND t.level = s.level AND t.pos = xor(s.seat, 1) LEFT JOIN upper u ON u.level = s.level - r.height AND u.pos = xor(s.seat, 1)),
proofs AS (SELECT g, id, sha256(string_agg(sib, '' ORDER BY level)) proof FROM sides GROUP BY g, id),
folds AS (SELECT g, pos id, 0 level, CASE WHEN crc % 7 = 0 THEN claim ELSE leaf END h FROM placed
  UNION ALL SELECT f.g, f.id, f.level + 1, sha256(CASE WHEN s.seat % 2 = 0 THEN f.h || s.sib ELSE s.sib || f.h END) FROM folds f JOIN sides s ON s.g = f.g AND s.id = f.id AND s.level = f.level),
folded AS (SELECT g, id, arg_max(h, level) h FROM folds GROUP BY g, id)
SELECT doc_id, leaf, s.h subroot, root.h root, coalesce(proof, sha256('')) proof_sha256, f.h folded_root, f.h = root.h verified
FROM placed p JOIN subroots s USING (g) JOIN folded f ON f.g = p.g AND f.id = p.pos LEFT JOIN proofs q ON q.g = p.g AND q.id = p.pos, root
"""
