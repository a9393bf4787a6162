"""Continuous ingestion of captures: idempotent by content, the latest arrival wins.

The state lies in buckets by a hash of its keys. A micro-batch reads and rewrites the buckets that its own keys fall into and
no others; a manifest, written last, says in which batch each bucket was written, and is the commit: until it is there,
readers and later batches see the state before. A batch that is run again writes the same folders again, so a restart
neither loses nor doubles anything. Arrival order is (batch, ordinal), not event time; `by_batch` False orders by the
columns of `order` alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from muster.operators.kept import new_folder
from muster.operators.upsert import best_by

#: Buckets of a state, and of the hashes of its content.
BUCKETS = 64


def _listed(spark: SparkSession, folder: str) -> list[int]:
    """The batches that have a folder below this one, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [re.fullmatch(r"v=(\d+)", s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(int(m[1]) for m in found if m)


def _committed(spark: SparkSession, state_dir: str) -> list[int]:
    """The batches whose manifests are complete; of older ones none is held."""
    there = lambda v: spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/manifest/v={v}/_SUCCESS")
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [v for v in _listed(spark, f"{state_dir}/manifest") if fs(there(v)).exists(there(v))]


def _manifest(spark: SparkSession, state_dir: str, version: int) -> dict[int, int]:
    """In which batch each bucket was written; no more rows than there are buckets."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version bigint").parquet(f"{state_dir}/manifest/v={version}").collect()}


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; a local one only where none is named."""
    return new_folder(spark, "ingest")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _numbers(df: DataFrame, column: str) -> list[int]:
    """The buckets that occur, BUCKETS at most."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def merge_batch(batch: DataFrame, batch_id: int, state_dir: str, keys: list[str], content: list[str], order: list[str], by_batch: bool = True) -> None:
    """The next state: rows whose content was ever taken in are dropped, then the latest of each key stays.

    The ledger below `state_dir` has a part for each batch with the hashes of what it took in, dealt by buckets of the hash;
    parts are only added, so content that a later row superseded still counts as taken in, and a batch reads the buckets
    of its own hashes. Where batches have no part in the order (`by_batch` False) and all of the order is content, content that
    comes again never wins, so there is no ledger. The buckets of the last two states are held, which is what readers and a batch that is run again need.
    """
    spark = batch.sparkSession
    # the same content has the same place in the order, so that it never wins by coming again
    with_ledger = by_batch or not set(order) <= set(content)
    before = [v for v in _committed(spark, state_dir) if v < batch_id]
    held = _manifest(spark, state_dir, before[-1]) if before else {}
    hashed = F.sha2(F.to_json(F.struct(*content)), 256)
    rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).withColumn("content_hash", hashed).withColumn("hash_bucket", _bucket("content_hash")).persist()
    try:
        # a part of the ledger counts from the manifest of its batch on
        taken = [f"{state_dir}/ledger/v={v}" for v in _listed(spark, f"{state_dir}/ledger") if before and v <= before[-1]]
        new = rows
        if taken and with_ledger:
            schema = "content_hash string, hash_bucket int"
            seen = spark.read.schema(schema).option("basePath", f"{state_dir}/ledger").parquet(*taken).where(F.col("hash_bucket").isin(_numbers(rows, "hash_bucket")))
            new = rows.join(seen.select("content_hash"), "content_hash", "left_anti")
        if with_ledger:
            new.select("content_hash", "hash_bucket").distinct().write.mode("overwrite").partitionBy("hash_bucket").parquet(f"{state_dir}/ledger/v={batch_id}")
        new = new.drop("hash_bucket")
        touched = _numbers(new.withColumn("bucket", _bucket(*keys)), "bucket")
        old = [f"{state_dir}/data/v={held[b]}/bucket={b}" for b in touched if b in held]
        both = spark.read.schema(new.schema).parquet(*old).unionByName(new) if old else new
        latest = best_by(both, keys, F.struct("batch_id", *order) if by_batch else F.struct(*order, -F.col("batch_id")))
        latest.withColumn("bucket", _bucket(*keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/data/v={batch_id}")
    finally:
        rows.unpersist()
    now = held | dict.fromkeys(touched, batch_id)
    commit(spark, state_dir, batch_id, now)
    # what the state before the last one alone refers to
    for v in before[:-1]:
        for b, n in set(_manifest(spark, state_dir, v).items()) - set(held.items()) - set(now.items()):
            delete(spark, f"{state_dir}/data/v={n}/bucket={b}")
        delete(spark, f"{state_dir}/manifest/v={v}")


def commit(spark: SparkSession, state_dir: str, version: int, buckets: dict[int, int]) -> None:
    """Makes a state the current one."""
    spark.createDataFrame(sorted(buckets.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/manifest/v={version}")


def snapshot(spark: SparkSession, state_dir: str, schema: StructType | str) -> DataFrame:
    """The current state; without one, no rows."""
    done = _committed(spark, state_dir)
    paths = [f"{state_dir}/data/v={v}/bucket={b}" for b, v in sorted(_manifest(spark, state_dir, done[-1]).items())] if done else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def ingest(spark: SparkSession, source: str, schema: StructType, state_dir: str, checkpoint: str, keys: list[str], content: list[str], order: list[str], files_per_batch: int = 1, by_batch: bool = True) -> DataFrame:
    """Takes in all files that are there, in batches; the state afterwards. Run again, it takes in only what is new."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    step = lambda batch, k: merge_batch(batch, k, state_dir, keys, content, order, by_batch)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return snapshot(spark, state_dir, StructType(list(schema.fields)).add("batch_id", "long").add("content_hash", "string"))


def follow(spark: SparkSession, changes: str, schema: StructType, checkpoint: str, refresh: Callable[[], DataFrame], seen: Callable[[DataFrame], None]) -> None:
    """Calls `seen` with what `refresh` reads anew, once for every batch of change notices below `changes`: readers never
    apply a notice themselves, they read everything again."""
    stream = spark.readStream.schema(schema).parquet(changes)
    stream.writeStream.foreachBatch(lambda batch, _: seen(refresh())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Seconds after which a finished job is forgotten, and a pending one has failed.
FORGET_AFTER, FAIL_AFTER = 3600, 900


def sweep_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (status, payload, created_at) without finished ones older than an hour; pending ones older than 15 minutes end
    as errors with the payload of a timeout, created now."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    late = (F.col("status") == "pending") & (age > FAIL_AFTER)
    kept = jobs.where(~(F.col("status").isin("done", "error") & (age > FORGET_AFTER)))
    return kept.withColumns({"status": F.when(late, "error").otherwise(F.col("status")), "payload": F.when(late, '{"error": "timeout"}').otherwise(F.col("payload")), "created_at": F.when(late, now).otherwise(F.col("created_at"))})
