"""Packing documents into sequences of bounded length by order-preserving dynamic programming.

The documents of an input partition, in their order, form one stream of ids. A window is a stretch of the stream
and becomes one sequence. Cuts between windows are chosen among document ends (free), sentence ends inside
documents (`sentence_penalty`) and, only where a sentence is longer than a sequence, single positions
(`hard_penalty`), so that padding plus penalties is least:

    f(j) = penalty(j) + window_cost + min( capacity - c(j) + min over c(i) >= c(j) - capacity of f(i) + c(i),
                                           min over c(i) = c(j) - 2**t of f(i) )

The inner minimum over the sliding range is kept in a monotone queue. A window as long as a power of two is not
padded, hence the second form. Streams are cut into buffers of about `buffer_ids` ids; the last two windows of a
buffer are not final but packed again with what follows.

No shuffle: each input split is packed on its own, so at most one sequence a split has padding that a longer
stream could have avoided. Every id lies in exactly one piece. A null or empty text is a document of its end id
alone; repeated rows are packed as often as they occur; a null key stays null; an empty table gives no pieces;
extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.bpe import batches
from muster.llm.hf_tokens import MemoTokenizer, read_tokenizer

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def choose_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int, window_cost: float) -> list[int]:
    """Indices into `places` (ascending, first 0, gaps of at most `capacity`) of the cheapest cuts, both ends included."""
    m = len(places)
    by_power: list[list[int]] = [[] for _ in range(m)]
    t = 1
    while t < capacity:
        found = np.searchsorted(places, places - t)
        for k in np.flatnonzero((places >= t) & (places[found] == places - t)).tolist():
            by_power[k].append(int(found[k]))
        t *= 2
    c, pen = places.tolist(), penalties.tolist()
    cost, back = [0.0] * m, [0] * m
    queue: deque[int] = deque([0])
    level = [0.0] * m  # f(i) + c(i)
    for k in range(1, m):
        least = c[k] - capacity
        while c[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        best = level[i] + capacity - c[k]
        for p in by_power[k]:
            if cost[p] < best:
                best, i = cost[p], p
        cost[k], back[k] = best + pen[k] + window_cost, i
        here = level[k] = cost[k] + c[k]
        while queue and level[queue[-1]] >= here:
            queue.pop()
        queue.append(k)
    out = [m - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class Packer:
    """Takes documents' ids in order; gives the pieces of windows as they become final."""

    def __init__(self, ends_sentence: np.ndarray, capacity: int, sentence_penalty: float, hard_penalty: float, window_cost: float, first_id: int):
        self.ends_sentence, self.capacity = ends_sentence, capacity
        self.penalty, self.hard, self.window_cost = sentence_penalty, hard_penalty, window_cost
        self.next_id = first_id
        self.parts: list[tuple] = []  # (key, ids of the document in all, place of the part in it, ids)
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.parts.append((key, len(ids), 0, ids))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        stream = np.concatenate([p[3] for p in self.parts]).astype("<u4")
        doc_ends = np.cumsum([len(p[3]) for p in self.parts])
        penalties = np.full(len(stream) + 1, np.inf)
        penalties[1:][self.ends_sentence[stream]] = self.penalty
        penalties[doc_ends] = 0.0
        penalties[0] = 0.0
        places = np.flatnonzero(penalties < np.inf)
        gaps = np.flatnonzero(np.diff(places) > self.capacity)
        if len(gaps):  # a sentence longer than a sequence
            for g in gaps.tolist():
                step = max(1, self.capacity // 8)
                penalties[places[g] + step : places[g + 1] : step] = self.hard
            places = np.flatnonzero(penalties < np.inf)
        cuts = places[choose_cuts(places, penalties[places], self.capacity, self.window_cost)]
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        done = int(cuts[-1])
        bounds = np.union1d(cuts, doc_ends[doc_ends < done])
        part = np.searchsorted(doc_ends, bounds[:-1], side="right")
        window = np.searchsorted(cuts, bounds[:-1], side="right") - 1
        starts = doc_ends - np.array([len(p[3]) for p in self.parts])
        data = memoryview(stream.tobytes())
        out = []
        for a, b, p, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), part.tolist(), window.tolist(), strict=True):
            key, total, at, _ = self.parts[p]
            out.append((key, at + a - int(starts[p]), b - a, zlib.crc32(data[4 * a : 4 * b]), total, self.next_id + w, a - int(cuts[w])))
        self.next_id += len(cuts) - 1
        rest = []
        for k in range(int(np.searchsorted(doc_ends, done, side="right")), len(self.parts)):
            key, total, at, ids = self.parts[k]
            gone = max(0, done - int(starts[k]))
            rest.append((key, total, at + gone, ids[gone:]))
        self.parts, self.held = rest, self.held - done
        return out


def sentence_ends(tokenizer: MemoTokenizer, extra: int) -> np.ndarray:
    """Of each id, whether a sentence or line may end with it."""
    table = np.zeros(max(tokenizer.vocab_size, extra) + 1, bool)
    for token, k in tokenizer.tokenizer.get_vocab().items():
        table[k] = bool(re.search(r"[.!?]$|Ċ", token))  # U+010A stands for the line feed
    return table


def pack(
    docs: DataFrame,
    tokenizer: str,
    kind: str = "byte",
    capacity: int = 2048,
    end_id: int = 1,
    sentence_penalty: float = 2.0,
    hard_penalty: float = 32.0,
    window_cost: float = 1.0,
    buffer_ids: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(MemoTokenizer(tokenizer, kind))
    key_kind = to_arrow_type(docs.schema[id_col].dataType)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        end = np.array([end_id], tok.dtype)
        packer = Packer(sentence_ends(tok, end_id), capacity, sentence_penalty, hard_penalty, window_cost, TaskContext.get().partitionId() << 36)

        def table(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        for keys, texts in batches(rows, 2_000_000):
            for key, ids in zip(keys, tok.encode_batch(texts), strict=True):
                packer.add(key, np.concatenate((ids, end)))
            if packer.held >= buffer_ids:
                yield from table(packer.flush(False))
        yield from table(packer.flush(True))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {PIECES}")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from muster.llm.tables import load

    return pack(load(spark, sf_dir, "documents"), read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
