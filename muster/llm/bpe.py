"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one is a minimal perfect hash over the vocabulary's byte strings: it resolves a whole pre-token in one
probe, and the probed entry's bytes are compared, so a string outside the vocabulary is never mistaken for one.
Tier two takes the misses: a heap of (rank, position) over bytes linked in both directions merges the lowest
rank first, the leftmost on ties.

In front of both stands a bounded memo of space-delimited pieces (`memo_size` entries, cleared when full). It
changes no result: a pre-token holds white space only at its start or is white space throughout, so a text may
be cut before any space that follows another kind of character.

Nulls and empty texts have no ids. Texts are encoded whole whatever their length; special tokens are not
recognised. Repeated rows are encoded like any other; extra columns are left out of the result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MUL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Rank files are read on the driver and sent to the executors; a larger one is refused.
MAX_RANK_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def hash_strings(strings: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string: a polynomial over its bytes and its length, then mixed."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place], out=sums[1:])
    return mix(sums[starts + lengths] - sums[starts] + lengths.astype(np.uint64) * np.uint64(_MUL))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash by hash and displace: buckets, the fullest first, each take the first
    displacement that puts all their keys on free slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = hash_strings(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a 64-bit hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        self.shift = np.zeros(self.buckets, np.uint32)
        self.keys: list[bytes] = [b""] * n
        free = np.ones(n, bool)
        step = np.arange(256, dtype=np.uint64)
        for own in sorted((m for m in members if len(m)), key=len, reverse=True):
            first = 0
            while True:
                slots = self._slot(hashes[own][None, :], step[:, None] + np.uint64(first))
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    at = int(good.argmax())
                    break
                first += len(step)
            self.shift[bucket[own[0]]] = first + at
            free[slots[at]] = False
            for k, slot in zip(own, slots[at], strict=True):
                self.keys[slot] = keys[k]

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + (shift + np.uint64(1)) * np.uint64(_MUL)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, strings: list[bytes]) -> np.ndarray:
        """The one slot at which each string would be, if it is a key."""
        h = hash_strings(strings)
        return self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)].astype(np.uint64))


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = 400_000):
        self.ranks, self.pattern, self.memo_size = ranks, pattern, memo_size
        self.tier1 = PerfectHash(list(ranks))
        self.slot_rank = [ranks[k] for k in self.tier1.keys]
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo", "tokens")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Tier two: the ids of a byte string by lowest-rank-first merging."""
        n, get = len(word), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two parts has since been merged
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(word[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return tuple(out)

    def _resolve(self, tokens: list[str]) -> None:
        """Both tiers for pre-tokens that the memo lacks."""
        words = [t.encode() for t in tokens]
        keys, rank = self.tier1.keys, self.slot_rank
        for token, word, slot in zip(tokens, words, self.tier1.slots(words).tolist(), strict=True):
            self.tokens[token] = (rank[slot],) if keys[slot] == word else self.merge(word)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of all pieces into the memo."""
        if len(self.memo) + len(pieces) > self.memo_size:
            self.memo.clear()
        new = [p for p in pieces if p not in self.memo]
        if not new:
            return
        split = list(map(self.find, new))
        if len(self.tokens) > self.memo_size:
            self.tokens.clear()
        if missing := list({t for s in split for t in s if t not in self.tokens}):
            self._resolve(missing)
        of = self.tokens.__getitem__
        for piece, s in zip(new, split, strict=True):
            self.memo[piece] = of(s[0]) if len(s) == 1 else tuple(chain.from_iterable(map(of, s)))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [pieces(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        of = self.memo.__getitem__
        return [list(chain.from_iterable(map(of, c))) for c in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_RUN = regex.compile(r"\s ")
_UNIT = regex.compile(r"\s*\S+|\s+")


def pieces(text: str) -> list[str]:
    """A text cut before single spaces, or before runs of white space where runs occur: no pre-token of the
    pattern crosses such a cut."""
    if _RUN.search(text):
        return _UNIT.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [f" {x}" for x in rest]


def batches(columns: Iterator[pa.RecordBatch], chars: int = 2_000_000) -> Iterator[tuple[list, list]]:
    """Row keys and texts, so many that a batch holds about `chars` characters, or a single longer text."""
    for batch in columns:
        keys, texts, held = [], [], 0
        for key, text in ((k.as_py(), t.as_py()) for k, t in zip(batch.column(0), batch.column(1), strict=True)):
            keys.append(key)
            texts.append(text)
            held += len(text or "")
            if held >= chars:
                yield keys, texts
                keys, texts, held = [], [], 0
        if keys:
            yield keys, texts


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: the key, n_tokens, ids_sha256 over the decimal ids joined
    by commas, decoded_sha256 over the decoded bytes. One pass over the table, without a shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ByteBpe(ranks, pattern))
    key_type = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for keys, texts in batches(parts):
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_batch(texts):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_kind), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    key_kind = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from muster.llm.tables import load

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
