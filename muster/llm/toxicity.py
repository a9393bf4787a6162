"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 4 to 6 bytes of the text, lower-cased in A-Z, hashed to 2**20 buckets; a document has
a feature or hasn't, however often. Each bucket's log-count ratio says how much commoner it is in toxic than in
other labelled documents; the `n_features` buckets whose ratios weigh most keep their ratio as the feature's value,
and a logistic regression over these values gives the score.

The model learns from at most about `max_labelled` labelled rows (all of them, if fewer), chosen by a hash of their
key; that bound is why labels can be broadcast and the regression is one task. The sample is counted in all tasks; only
counts of buckets, of which there are 2**20 at most, and the coefficients come to the driver. Scoring is one pass over
whole texts without a shuffle. A null or empty text has the score of no features. Labels are matched by key: repeated
rows have equal scores, a null key never matches, of contradicting labels of one key the toxic one counts, null labels
are ignored; without labels of both kinds every score is 0.5 at most and nothing is rejected. Extra columns are left out
of the score and of its table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import batches
from muster.llm.shingles import _BASE, _INVERSE, _LOWER, powers
from muster.llm.tables import keep, load

BITS = 20
#: Partial counts are added up by slices of so many buckets.
SLICE = 1 << 16
SIZES = (4, 5, 6)


def buckets(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, bucket) pairs of a batch; with `wanted` (u1 by bucket), only those it marks."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    back = powers(_INVERSE, len(data) + 1)
    pairs = []
    for n in SIZES:
        if len(data) < n:
            continue
        h = (sums[n:] - sums[:-n]) * back[: len(data) - n + 1] + np.uint64(n)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(wanted[bucket]) if wanted is not None else np.arange(len(bucket))
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[text]
        pairs.append((text[inside] << BITS) | bucket[at[inside]])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.concatenate(pairs))
    return found >> BITS, found & ((1 << BITS) - 1)


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # ascending
    weights: np.ndarray  # of a feature that is present: coefficient times log-count ratio

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        wanted, weight = np.zeros(1 << BITS, np.uint8), np.zeros(1 << BITS)
        wanted[self.buckets], weight[self.buckets] = 1, self.weights
        return wanted, weight


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    p, q = (toxic + 0.5) / (n_toxic + 1), (other + 0.5) / (n_other + 1)
    return np.log(p / q)


#: Present features that a step of the regression holds at once.
FIT_FEATURES = 1 << 19


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, values: np.ndarray, penalty: float = 0.01, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and coefficients by gradient descent with momentum; rows hold the indices of present features."""
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    col = np.concatenate(rows).astype(np.int32) if n else np.zeros(0, np.int32)
    ends = np.cumsum(sizes)
    # slices of rows, so that what a step computes for each present feature stays small
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(FIT_FEATURES, int(sizes.sum()) + FIT_FEATURES, FIT_FEATURES)) + 1, n).clip(0, n))
    slices = [(a, b, int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if b > a]
    # a step no longer than the curvature allows
    squares = sum(float((values[col[first:last]] ** 2).sum()) for _, _, first, last in slices)
    rate = 1.0 / (0.25 * (1.0 + squares / max(n, 1)) + penalty)
    w, b, vw, vb = np.zeros(len(values)), 0.0, np.zeros(len(values)), 0.0
    for _ in range(steps):
        gw, gb, scaled = np.zeros(len(values)), 0.0, w * values
        for x, y, first, last in slices:
            own, row = col[first:last], np.repeat(np.arange(y - x), sizes[x:y])
            z = b + np.bincount(row, scaled[own], minlength=y - x)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[x:y]) / n
            gw += np.bincount(own, error[row], minlength=len(values))
            gb += float(error.sum())
        vw, vb = 0.9 * vw - rate * (gw * values + penalty * w / n), 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    return b, w


def held_out(key: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, n_features: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """`labels`: the key and toxic (0 or 1). Only rows of `labels` teach."""
    marks = labels.where(f"{id_col} is not null and toxic is not null").groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    sample = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(marks), id_col)
    sample = keep(sample.select(F.col("toxic").cast("int"), "text").repartition(8))

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for marks, texts in batches(parts, 500_000):  # every n-gram of a batch is sorted
            marks = np.array(marks)
            text, bucket = buckets(texts)
            for k in (0, 1):
                sums[k] += np.bincount(bucket[marks[text] == k], minlength=1 << BITS).astype(np.int32)
                n[k] += int((marks == k).sum())
        # the documents are counted with the first slice
        slices = [(k, n[0] * (k == 0), n[1] * (k == 0), *(part.tobytes() for part in sums[:, k * SLICE : (k + 1) * SLICE])) for k in range((1 << BITS) // SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*slices, strict=True), kinds, strict=True)], names=["slice", "n0", "n1", "other", "toxic"])

    def add(part: pa.Table) -> pa.Table:
        """The sums of a slice over all partial counts; the floor holds for the sums."""
        sums = [np.sum([np.frombuffer(x.as_py(), np.int32) for x in part.column(c)], axis=0, dtype=np.int32) for c in ("other", "toxic")]
        at = np.flatnonzero(sums[0] + sums[1] >= 3).astype(np.int32)  # too rare to weigh anything
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (at + np.int32(part.column("slice")[0].as_py() * SLICE), sums[0][at], sums[1][at])]
        return pa.Table.from_arrays([*(pa.array([sum(part.column(c).to_pylist())], pa.int64()) for c in ("n0", "n1")), *packed], names=["n0", "n1", "at", "other", "toxic"])

    total, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    partial = sample.mapInArrow(count, "slice int, n0 bigint, n1 bigint, other binary, toxic binary")
    for r in partial.groupBy("slice").applyInArrow(add, "n0 bigint, n1 bigint, at binary, other binary, toxic binary").collect():  # a row a slice
        at = np.frombuffer(r.at, np.int32)
        total[0][at] += np.frombuffer(r.other, np.int32)
        total[1][at] += np.frombuffer(r.toxic, np.int32)
        n = [n[0] + r.n0, n[1] + r.n1]
    if not all(n):
        return Model(-1.0 if n[0] else 0.0, np.zeros(0, np.int64), np.zeros(0))
    ratio = log_count_ratios(total[1], total[0], n[1], n[0])
    evidence = np.abs(ratio) * np.sqrt(total.sum(axis=0))
    chosen = np.sort(np.argsort(-evidence, kind="stable")[:n_features])
    chosen = chosen[total.sum(axis=0)[chosen] > 0]
    wanted = np.zeros(1 << BITS, np.uint8)
    wanted[chosen] = 1

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for marks, texts in batches(parts):
            text, bucket = buckets(texts, wanted)
            at = np.searchsorted(text, np.arange(1, len(texts)))
            rows += np.split(np.searchsorted(chosen, bucket).astype(np.uint16 if len(chosen) <= 1 << 16 else np.int32), at)
            y += marks
        bias, coefficients = fit_logistic(rows, np.array(y, float), ratio[chosen])
        yield pa.RecordBatch.from_arrays([pa.array([bias], pa.float64()), pa.array([coefficients.tolist()], pa.list_(pa.float64()))], names=["bias", "coefficients"])

    # one task: the sample is bounded by `max_labelled`, and so is what a task holds of it, the places of its features
    made = sample.coalesce(1).mapInArrow(fit, "bias double, coefficients array<double>").first()
    return Model(made.bias, chosen, np.array(made.coefficients) * ratio[chosen])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The key and its score, 0 to 1, higher where toxic is likelier."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_kind = to_arrow_type(docs.schema[id_col].dataType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, weight = model.tables()
        for keys, texts in batches(parts):
            text, bucket = buckets(texts, wanted)
            z = model.bias + np.bincount(text, weight[bucket], minlength=len(texts))
            values = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_kind), pa.array(values, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def reject(docs: DataFrame, model: Model, threshold: float, text_col: str = "text", chars: int = 2_000_000) -> DataFrame:
    """The rows of `docs` whose texts score below `threshold`, with all their columns; no join, so keys do not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, weight = model.tables()
        for batch in parts:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                # as many rows as hold `chars` characters, or a single longer text
                upto = np.searchsorted(ends, (ends[first - 1] if first else 0) + chars, side="right")
                part = batch.slice(first, max(1, int(upto) - first))
                first += part.num_rows
                texts = part.column(place).to_pylist()
                text, bucket = buckets(texts, wanted)
                z = model.bias + np.bincount(text, weight[bucket], minlength=len(texts))
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold))

    return docs.mapInArrow(run, docs.schema)


THRESHOLD = 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").where(~held_out("doc_id"))
    scored = score(docs, train(docs, labels))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", predicted)
