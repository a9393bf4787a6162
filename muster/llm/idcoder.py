"""Token ids as compressed files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block holds about `block_ids` ids. It is cut into lanes, equally long stretches that are coded side by side, one
id of each lane a step; all lanes share one model, which learns from a step's ids before the next step.

Model. Order 2 and order 1 each predict one id from the last two ids or the last id, with a confidence from 0 to
7; order 0 is an adaptive frequency table over the vocabulary. How often each of the three is right is counted by
the pair of confidences (and whether both predict the same id); these counts mix the predictions: the next id is
coded as "what order 2 says", "what order 1 says" or "another", and then, in the last case, by order 0. Both
decisions are one coding step.

Coder. A 64-bit range coder without carries, emitting 16 bits at a time, one stream a lane.

Block (little-endian): ``magic 4s, version u2, flags u2, documents u4, ids u8, lanes u4, vocabulary u4, crc32 of the
ids as u4 u4``; per document ``key i8, has_key u1, ids of it before the block u8, ids of it here u8, whether it ends
here u1, crc32 of its earlier ids u4``; per lane the number of 16-bit words u4; the words; crc32 of all that u4. A block
needs no other to be decoded, and a damaged one is reported, never decoded to something else.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import batches
from muster.llm.hf_tokens import MemoTokenizer, read_tokenizer
from muster.llm.tables import checkpoint_dir, load

MAGIC, VERSION = b"MIDC", 1
_HEAD = struct.Struct("<4sHHIQIII")
_DOC = np.dtype([("key", "<i8"), ("has_key", "u1"), ("before", "<u8"), ("here", "<u8"), ("ends", "u1"), ("crc", "<u4")])
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48 = np.uint64(16), np.uint64(48)
_EVENT_BITS = 12


class Model:
    """What encoder and decoder know before a step; both update it alike.

    Table entries are packed: a predicted id and its confidence, the start and the width of an interval.
    """

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.bits = max(16, vocabulary.bit_length() + 2)
        if self.bits + _EVENT_BITS > 32:
            raise ValueError("the vocabulary is too large for this coder")
        self.seen = np.zeros(vocabulary, np.int64)
        self.fresh: list[np.ndarray] = []  # ids of the steps since the last refresh, which alone asks how often each was seen
        self.mask2 = (1 << 18) - 1
        self.order2 = np.zeros(self.mask2 + 1, np.int32)  # id << 3 | confidence
        self.order1 = np.zeros(vocabulary + 1, np.int32)
        self.events = np.tile(np.array([1, 1, 2], np.int64), 128)
        self.before1 = np.full(lanes, vocabulary, np.int32)
        self.before2 = np.full(lanes, vocabulary, np.int32)
        self.step, self.due = 0, 0
        self.slots: np.ndarray | None = None

    def refresh(self, decoding: bool) -> None:
        """The order-0 table is made anew after 1, 2, 4, ... 32 steps, then every 32."""
        if self.step < self.due:
            return
        self.due = max(1, min(2 * self.step, self.step + 32))
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=self.vocabulary)
            self.fresh = []
        room = (1 << self.bits) - self.vocabulary
        total = int(self.seen.sum())
        freq = (self.seen * room // total if total else np.full(self.vocabulary, room // self.vocabulary, np.int64)) + 1
        freq[-1] += (1 << self.bits) - int(freq.sum())
        self.order0 = (np.cumsum(freq) - freq) << 32 | freq  # start << 32 | width
        if decoding:
            self.slots = np.repeat(np.arange(self.vocabulary, dtype=np.int32), freq)

    def predict(self, lanes: int) -> None:
        self.at1 = b1 = self.before1[:lanes]
        h = b1 * np.int32(0x2C1B3C6D) + self.before2[:lanes] * np.int32(0x297A2D39)
        self.at2 = (h ^ (h >> 15)) & np.int32(self.mask2)
        self.e2, self.e1 = self.order2.take(self.at2), self.order1.take(b1)
        self.p2, self.p1 = self.e2 >> 3, self.e1 >> 3
        self.context = ((self.e2 & 7) << 3 | (self.e1 & 7)) + ((self.p1 == self.p2) << 6)
        counts = self.events.reshape(128, 3)
        size = 1 << _EVENT_BITS
        freq = 1 + counts * (size - 3) // counts.sum(axis=1, keepdims=True)
        freq[:, 2] += size - freq.sum(axis=1)
        self.mixed = ((np.cumsum(freq, axis=1) - freq) << 16 | freq).ravel()  # start << 16 | width

    def learn(self, ids: np.ndarray, case: np.ndarray) -> None:
        """case: three times the context, plus the event."""
        self.events += 24 * np.bincount(case, minlength=384)
        if self.step & 31 == 31:
            self.events -= self.events >> 1
            np.maximum(self.events, 1, out=self.events)
        for table, at, e, p in ((self.order2, self.at2, self.e2, self.p2), (self.order1, self.at1, self.e1, self.p1)):
            c = e & 7
            table[at] = np.where(p == ids, e + (c < 7), np.where(c > 0, e - c + (c >> 1), ids << 3))
        self.fresh.append(ids)
        n = len(ids)
        self.before2[:n] = self.before1[:n]
        self.before1[:n] = ids
        self.step += 1


def lane_count(n: int) -> int:
    return max(1, min(4096, n // 64))


def _lengths(n: int, lanes: int) -> np.ndarray:
    return np.full(lanes, n // lanes) + (np.arange(lanes) < n % lanes)


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lanes in turn (u2), and how many each lane has (u4)."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u2"), np.zeros(0, "<u4")
    lanes = lane_count(n)
    lengths = _lengths(n, lanes)
    starts = np.cumsum(lengths) - lengths
    ids = ids.astype(np.int32)
    model = Model(vocabulary, lanes)
    shift = np.uint64(model.bits + _EVENT_BITS)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.zeros((lanes, 3 * int(lengths[0]) + 8), np.uint16)
    used = np.zeros(lanes, np.int64)
    for step in range(int(lengths[0])):
        live = lanes if step < lengths[-1] else int((lengths > step).sum())
        x = ids[starts[:live] + step]
        model.refresh(False)
        model.predict(live)
        event = np.where(x == model.p2, 0, 2 - (x == model.p1))
        case = model.context * 3 + event
        _code(model, low[:live], span[:live], case, event == 2, x, shift)
        while len(lane := _settle(low, span, live)):
            out[lane, used[lane]] = low[lane] >> _U48
            used[lane] += 1
            low[lane] <<= _U16
            span[lane] <<= _U16
        model.learn(x, case)
    for _ in range(4):
        out[np.arange(lanes), used] = low >> _U48
        used += 1
        low <<= _U16
    return out[np.arange(out.shape[1])[None, :] < used[:, None]].astype("<u2"), used.astype("<u4")


def _code(model: Model, low: np.ndarray, span: np.ndarray, case: np.ndarray, other: np.ndarray, x: np.ndarray, shift: np.uint64) -> None:
    """Narrows each lane's interval to that of its event and, where that is "another", of its id."""
    mixed = model.mixed.take(case)
    start, width = mixed >> 16 << model.bits, mixed & 0xFFFF
    order0 = model.order0.take(x)
    start += np.where(other, width * (order0 >> 32), 0)
    width *= np.where(other, order0 & 0xFFFFFFFF, 1 << model.bits)
    unit = span >> shift
    low += unit * start.view(np.uint64)
    np.multiply(unit, width.view(np.uint64), out=span)


def _settle(low: np.ndarray, span: np.ndarray, live: int) -> np.ndarray:
    """The lanes that must shift 16 bits out; spans that straddle a boundary are cut down to it."""
    lo, sp = low[:live], span[:live]
    settled = (lo ^ (lo + sp)) < _TOP
    short = ~settled & (sp < _BOTTOM)
    if short.any():
        sp[short] = (np.uint64(0) - lo[short]) & (_BOTTOM - np.uint64(1))
    return np.flatnonzero(settled | short)


def decode_ids(words: np.ndarray, used: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    lanes = len(used)
    if lanes != lane_count(n):
        raise ValueError("the block's lanes do not fit its ids")
    lengths = _lengths(n, lanes)
    starts = np.cumsum(lengths) - lengths
    model = Model(vocabulary, lanes)
    shift = np.uint64(model.bits + _EVENT_BITS)
    words = np.concatenate((words, np.zeros(8, "<u2"))).astype(np.uint64)
    at = np.cumsum(used.astype(np.int64)) - used
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _U16) | words[at]
        at += 1
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    top = (1 << (model.bits + _EVENT_BITS)) - 1
    ids = np.empty(n, np.int64)
    for step in range(int(lengths[0])):
        live = lanes if step < lengths[-1] else int((lengths > step).sum())
        model.refresh(True)
        model.predict(live)
        unit = span[:live] >> shift
        value = np.minimum((code[:live] - low[:live]) // unit, np.uint64(top)).astype(np.int64)
        part = value >> model.bits
        first = model.context * 3
        event = (part >= model.mixed.take(first + 1) >> 16).astype(np.int32) + (part >= model.mixed.take(first + 2) >> 16)
        case = first + event
        x = np.where(event == 1, model.p1, model.p2)
        rest = np.flatnonzero(event == 2)
        mixed = model.mixed.take(case[rest])
        x[rest] = model.slots.take((value[rest] - (mixed >> 16 << model.bits)) // (mixed & 0xFFFF))
        _code(model, low[:live], span[:live], case, event == 2, x, shift)
        while len(lane := _settle(low, span, live)):
            code[lane] = (code[lane] << _U16) | words[at[lane]]
            at[lane] += 1
            low[lane] <<= _U16
            span[lane] <<= _U16
        ids[starts[:live] + step] = x
        model.learn(x, case)
    return ids


def write_block(docs: list[tuple], ids: np.ndarray, vocabulary: int) -> bytes:
    """docs: (key or None, ids before, ids here, ends here, crc32 of the earlier ids)."""
    table = np.zeros(len(docs), _DOC)
    for k, (key, before, here, ends, crc) in enumerate(docs):
        table[k] = (key or 0, key is not None, before, here, ends, crc)
    words, used = encode_ids(ids, vocabulary)
    head = _HEAD.pack(MAGIC, VERSION, 0, len(docs), len(ids), len(used), vocabulary, zlib.crc32(ids.astype("<u4").tobytes()))
    body = b"".join((head, table.tobytes(), used.tobytes(), words.tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document table and the ids; ValueError for a damaged block."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block of ids is damaged: its checksum differs")
    magic, version, _, n_docs, n, lanes, vocabulary, crc = _HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of ids of this format")
    at = _HEAD.size
    table = np.frombuffer(block, _DOC, n_docs, at)
    at += table.nbytes
    used = np.frombuffer(block, "<u4", lanes, at)
    at += used.nbytes
    ids = decode_ids(np.frombuffer(block[at:-4], "<u2"), used, n, vocabulary)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of ids is damaged: its ids differ")
    return table, ids


class BlockWriter:
    """Collects documents; gives blocks of about `size` ids, cutting a longer document into several."""

    def __init__(self, vocabulary: int, size: int):
        self.vocabulary, self.size = vocabulary, size
        self.docs: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        before, crc = 0, 0
        while True:
            here = ids[before : before + self.size]
            ends = before + len(here) == len(ids)
            self.docs.append((key, before, len(here), ends, crc))
            self.parts.append(here)
            self.held += len(here)
            if self.held >= self.size:
                yield self.close()
            if ends:
                return
            crc = zlib.crc32(here.astype("<u4").tobytes(), crc)
            before += len(here)

    def close(self) -> tuple[int, bytes]:
        ids = np.concatenate(self.parts)
        block = write_block(self.docs, ids, self.vocabulary)
        self.docs, self.parts, self.held = [], [], 0
        return len(ids), block


def write_ids(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 2, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids below `path`, in ascending key order (null keys first, equal keys by text): one
    shard a task, shards in key order, a shard's blocks numbered from 0. Blocks are rows of a Parquet table, so a
    lost or repeated task leaves nothing half written.

    A null or empty text has only the end id. Keys must be of an integer type. One range shuffle of the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MemoTokenizer(tokenizer, kind))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        end = np.array([end_id], tok.dtype)
        writer = BlockWriter(max(tok.vocab_size, end_id + 1), block_ids)
        shard, number = TaskContext.get().partitionId(), 0

        def row(made: tuple[int, bytes]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            values = ([shard], pa.int32()), ([number - 1], pa.int64()), ([made[0]], pa.int64()), ([made[1]], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["shard", "block", "n_ids", "data"])

        for keys, texts in batches(rows, 2_000_000):
            for key, ids in zip(keys, tok.encode_batch(texts), strict=True):
                for made in writer.add(key, np.concatenate((ids, end))):
                    yield row(made)
        if writer.held:
            yield row(writer.close())

    key, text = F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text")
    # texts begin to order rows of equal keys and of none, so that these too are dealt over tasks
    head = F.left(text, F.lit(16)).alias("head")
    ordered = docs.select(key, text, head).repartitionByRange("key", "head").sortWithinPartitions("key", "text").select("key", "text")
    ordered.mapInArrow(run, "shard int, block bigint, n_ids bigint, data binary").write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files below `path`: its key, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded wherever they lie. Only one number a shard comes to the driver.
    """
    blocks = spark.read.schema("shard int, block bigint, n_ids bigint, data binary").parquet(path)
    sizes = blocks.groupBy("shard", "block").agg(F.max("n_ids").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    offsets, total = [], 0
    for shard, n in sorted(map(tuple, sizes.collect())):
        offsets.append((shard, total))
        total += n
    within = blocks.select("shard", "block", "n_ids")
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    at = within.select("shard", "block", F.coalesce(before, F.lit(0)).alias("at"))
    at = at.join(spark.createDataFrame(offsets, "shard int, first bigint"), "shard")
    at = at.select("shard", "block", (F.col("first") + F.col("at")).alias("at"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for shard, number, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                table, ids = read_block(data)
                raw = memoryview(ids.astype("<u4").tobytes())
                last = np.cumsum(table["here"].astype(np.int64))
                first = last - table["here"].astype(np.int64)
                out = []
                for doc, a, b in zip(table, first.tolist(), last.tolist(), strict=True):
                    if doc["ends"]:
                        whole = int(doc["before"]) + b - a
                        out.append((int(doc["key"]) if doc["has_key"] else None, a - int(doc["before"]), whole, zlib.crc32(raw[4 * a : 4 * b], int(doc["crc"]))))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(out), pa.int32()), pa.array([number] * len(out), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                        names=["shard", "block", id_col, "in_block", "n_tokens", "ids_crc32"],
                    )

    decoded = blocks.select("shard", "block", "data").mapInArrow(run, f"shard int, block bigint, `{id_col}` bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint")
    start = (F.col("at") + F.col("in_block")).alias("start")
    return decoded.join(at, ["shard", "block"]).select(id_col, start, "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(load(spark, sf_dir, "documents"), path, read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
    return read_ids(spark, path)
