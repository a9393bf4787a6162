"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.tables import keep

#: Links that one task may hold; a graph that has been contracted to so few is finished there.
TASK_LINKS = 16_384


def _finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, m) for all nodes of the links: m is the same for all nodes of a component."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for batch in parts:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u), root.setdefault(v, v)
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(k) for k in root], pa.int64())], names=["u", "m"])


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    The graph is contracted: in each round every node moves to the one among itself and its neighbours that comes first
    in an order drawn anew, links move with their ends, and those within one node or between the same two vanish. A
    random order leaves a fixed share of the nodes at most, so work falls geometrically, whatever the ids. A graph of
    `task_links` links or fewer is finished by one task. All rounds are joins and partial aggregations on node ids; only
    counts come to the driver; checkpoints cut off the rounds. Rows with a null node are ignored; no links give no rows.
    """
    ends = links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u is not null and v is not null and u <> v")
    one_way = lambda df: df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest, moves = keep(one_way(ends)), []
    while (left := rest.count()) > task_links:
        turn = len(moves)
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("order"), F.col(c).alias("node"))
        first = both.groupBy("u").agg(F.min(place("v")).alias("near"))
        moved = keep(first.select("u", F.least("near", place("u")).getField("node").alias("m")))
        moves.append(moved)
        at = lambda c, moved=moved: moved.select(F.col("u").alias(c), F.col("m").alias(f"{c}_to"))
        rest = keep(one_way(rest.join(at("u"), "u").join(at("v"), "v").select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))))
    if left or not moves:
        moves.append(keep(rest.coalesce(1).mapInArrow(_finish, "u bigint, m bigint")))
    found = moves[0].select(F.col("u").alias("node"), F.col("m").alias("at"))
    for moved in moves[1:]:
        found = found.join(moved.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("m", "at").alias("at"))
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(least, "at").select("node", "component")
