"""Ids of whole texts by a tokenizer of the `tokenizers` library, with a bounded memo of the parts of texts.

Both kinds of tokenizer that are supported cut a text at white space before they look up anything, so the ids of
a text are those of its parts in turn:

* ``byte``: byte-level BPE whose pre-tokens take at most one leading space. A part is a word with the white space
  before it. Texts with white space outside ASCII, which may continue such a run, go to the tokenizer whole.
* ``word``: white space is dropped and letters are lower-cased. A part is a word.

Words are runs of bytes other than space and the control characters 9 to 13. A part is cut once more where a letter
(of ASCII or of two bytes) is followed by an ASCII punctuation mark other than the apostrophe: neither normal forms nor
pre-tokens ever reach across that place, and words are met more often without their marks. The memo is an
open-addressing table from a part's bytes, up to 15 of them and their number in two 64-bit numbers, to a stretch of a
pool of ids, so that a whole batch is looked up by a few array operations and bytes are always compared; longer parts, to
`LONG` bytes, are held in a dictionary. The library encodes the parts that the memo lacks, and the memo is cleared when it
holds `memo_size` parts. Null and empty texts have no ids. Texts that hold a special token's string go to the library
whole, which gives that token's id, or with `special_as_text` the ids of its letters.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from muster.llm.bpe import mix
from muster.llm.shingles import _LOWER, _SPACE, eights, low_bytes

#: Tokenizer files are read on the driver and sent to the executors; a larger one is refused.
MAX_FILE_BYTES = 64 << 20

_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTER = np.array([chr(k).isascii() and chr(k).isalpha() for k in range(256)])
#: Of the characters of two bytes, those that are letters and stay one when lower-cased.
_LETTER2 = np.array([k > 127 and chr(k).isalpha() and chr(k).lower().isalpha() for k in range(2048)])
_MARK = np.array([33 <= k <= 126 and not chr(k).isalnum() and chr(k) != "'" for k in range(256)])


def _marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Places of the punctuation marks in `data` (u1) that directly follow a letter."""
    at = np.flatnonzero(_MARK[data])
    at = at[at > 0]
    last, before = data[at - 1], data[np.maximum(at - 2, 0)]
    pair = (at > 1) & (before >> 5 == 6) & (last >> 6 == 2)
    return at[_LETTER[last] | pair & _LETTER2[(before & 31).astype(np.int64) << 6 | last & 63]]


def _stretches(pool: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """`counts` entries of `pool` from each of `begin` on, in turn."""
    counts = counts.astype(np.int64)
    upto = np.cumsum(counts)
    return pool[np.repeat(begin - upto + counts, counts) + np.arange(int(upto[-1]) if len(upto) else 0)]


#: A normalizer and a pre-tokenizer that leave words of lower-case letters below U+0100 as they are and whole.
_LEAVES_WORDS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


def _word_tokenizer(tokenizer):
    """The same model with a plain cut at spaces, for the words named above; None for other steps before the model."""
    from tokenizers import Tokenizer, pre_tokenizers

    steps = tokenizer.normalizer, tokenizer.pre_tokenizer
    if [x and json.loads(x.__getstate__()) for x in steps] != _LEAVES_WORDS:
        return None
    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} characters")
    return text


#: Bytes up to which a part is held in the memo.
LONG = 64


class Memo:
    """From parts, as pairs of numbers, to stretches of ids."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.used, self.filled = 0, 0
        self.pool = np.empty(1 << 16, self.dtype)
        self.longer: dict[bytes, tuple[int, int]] = {}
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.mask = size - 1
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)  # high 0: free
        self.begin, self.count = np.zeros(size, np.uint32), np.zeros(size, np.uint32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots, -1 where a part is not in the table."""
        slot = self._slot(low, high)
        held = self.high[slot]
        free = held == 0
        open_ = np.flatnonzero(~free & ((held != high) | (self.low[slot] != low)))
        slot[free] = -1
        while len(open_):
            slot[open_] = at = (slot[open_] + 1) & self.mask
            held = self.high[at]
            free = held == 0
            slot[open_[free]] = -1
            open_ = open_[~free & ((held != high[open_]) | (self.low[at] != low[open_]))]
        return slot

    def _take(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        begin = (self.used + np.cumsum(counts) - counts).astype(np.uint32)
        self.used += len(ids)
        self.filled += len(counts)
        return begin, counts.astype(np.uint32)

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Parts that the table lacks, none twice, with how many of `ids` each has."""
        if 2 * (self.filled + len(low)) > len(self.high):
            old = self.high != 0
            rest = self.low[old], self.high[old], self.begin[old], self.count[old]
            size = len(self.high)
            while 2 * (self.filled + len(low)) > size:
                size *= 2
            self._table(size)
            self._place(*rest)
        self._place(low, high, *self._take(ids, counts))

    def add_longer(self, parts: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self.longer.update(zip(parts, zip(*(x.tolist() for x in self._take(ids, counts)), strict=True), strict=True))

    def _place(self, low: np.ndarray, high: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        slot = self._slot(low, high)
        left = np.arange(len(low))
        while len(left):
            free = self.high[slot[left]] == 0
            _, first = np.unique(slot[left[free]], return_index=True)
            now = left[free][first]
            at = slot[now]
            self.low[at], self.high[at], self.begin[at], self.count[at] = low[now], high[now], begin[now], count[now]
            left = left[(self.high[slot[left]] != high[left]) | (self.low[slot[left]] != low[left])]
            slot[left] = (slot[left] + 1) & self.mask


_FIELDS = ("source", "kind", "memo_size", "special_as_text")


class MemoTokenizer:
    def __init__(self, source: str, kind: str, memo_size: int = 2_000_000, special_as_text: bool = False):
        if kind not in ("byte", "word"):
            raise ValueError(f"no such kind of tokenizer: {kind}")
        self.source, self.kind, self.memo_size, self.special_as_text = source, kind, memo_size, special_as_text

    def __getattr__(self, name: str):
        """The tokenizer and the memo are made where they are first used: on an executor, not on the driver."""
        if name.startswith("__") or name in _FIELDS:
            raise AttributeError(name)
        self._ready()
        if name not in self.__dict__:
            raise AttributeError(name)
        return self.__dict__[name]

    def _ready(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.source)
        self.tokenizer.encode_special_tokens = self.special_as_text
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if self.special_as_text else special
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self.marks = np.zeros(self.vocab_size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.marks[k] = token.startswith("Ġ") if self.kind == "byte" else token.endswith("</w>")
        self.words = (_word_tokenizer(self.tokenizer) if self.kind == "word" else None) or self.tokenizer
        self.memo = Memo(self.dtype)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in _FIELDS}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state

    def _one(self, string: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([string], add_special_tokens=False)[0].ids, self.dtype)

    def _library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in turn, and how many each has. Words of letters alone are given to the tokenizer many at a
        time, and the ids cut where a word begins or ends: only a word's first id has the mark of the space before it,
        only its last the mark of a word's end."""
        lead = " " if self.kind == "byte" else ""
        plain, words, rest = [], [], []
        for k, x in enumerate(strings):
            if x[: len(lead)] != lead or not x[len(lead) :].isalpha():
                rest.append(k)
            elif self.words is not self.tokenizer and max(x) <= "\xff" and x.islower():
                plain.append(k)
            else:
                words.append(k)
        places, parts, counts = [], [], []
        for tokenizer, which in ((self.words, plain), (self.tokenizer, words)):
            for k in range(0, len(which), 512):
                some = which[k : k + 512]
                text = ("" if lead else " ").join([strings[w] for w in some])
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                marked = np.flatnonzero(self.marks[ids])
                bounds = np.append(marked, len(ids)) if lead else np.concatenate(([0], marked + 1))
                if len(bounds) != len(some) + 1 or bounds[0] or bounds[-1] != len(ids):
                    rest += some  # not so for this vocabulary: one by one
                    continue
                places.append(some)
                parts.append(ids)
                counts.append(np.diff(bounds))
        if rest:
            made = [x.ids for x in self.tokenizer.encode_batch_fast([strings[k] for k in rest], add_special_tokens=False)]
            places.append(rest)
            parts.append(np.array([i for x in made for i in x], self.dtype))
            counts.append(np.array([len(x) for x in made], np.int64))
        if not places:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(places))
        n = np.concatenate(counts)
        return _stretches(np.concatenate(parts), (np.cumsum(n) - n)[order], n[order]), n[order]

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the memo's pool the ids of parts of `data` begin, and how many they are; the memo takes up those that
        it lacked."""
        n = ends - starts
        begin, count = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        short = np.flatnonzero(n <= 15)
        ahead, a, m = eights(data), starts[short], n[short]
        low = ahead[a] & low_bytes(np.minimum(m, 8))
        high = np.where(m > 8, ahead[np.minimum(a + 8, len(data))] & low_bytes(np.maximum(m - 8, 0)), np.uint64(0)) | m.astype(np.uint64) << np.uint64(56)
        slots = self.memo.find(low, high)
        lacking = np.flatnonzero(slots < 0)
        raw, longer = None, np.flatnonzero(n > 15).tolist()
        if len(lacking) or longer:
            raw = data.tobytes()
        if len(lacking):
            by = lacking[np.lexsort((low[lacking], high[lacking]))]
            first = by[np.concatenate(([True], (low[by[1:]] != low[by[:-1]]) | (high[by[1:]] != high[by[:-1]])))]
        else:
            first = lacking
        own = [raw[x:y] for x, y in zip(starts[longer].tolist(), ends[longer].tolist(), strict=True)] if longer else []
        new = {p for p in own if p not in self.memo.longer}
        if self.memo.filled and self.memo.filled + len(first) + len(new) > self.memo_size:
            self.memo.clear()
            return self._find(data, starts, ends)
        once: dict[bytes, tuple[int, int]] = {}
        if len(first) or new:
            held = sorted(new, key=lambda p: len(p) > LONG)
            parts = [raw[x:y] for x, y in zip(starts[short[first]].tolist(), ends[short[first]].tolist(), strict=True)] + held
            made, counts = self._library([p.decode("utf-8", "surrogatepass") for p in parts])
            upto = np.concatenate(([0], np.cumsum(counts)))
            k, end = len(first), len(first) + sum(len(p) <= LONG for p in held)
            if k:
                size = self.memo.mask
                self.memo.add(low[first], high[first], made[: upto[k]], counts[:k])
                again = lacking if self.memo.mask == size else slice(None)  # a larger table has all parts elsewhere
                slots[again] = self.memo.find(low[again], high[again])
            if end > k:
                self.memo.add_longer(parts[k:end], made[upto[k] : upto[end]], counts[k:end])
            if end < len(parts):  # of this batch alone: in the pool, but not in the memo
                at, many = self.memo._take(made[upto[end] :], counts[end:])
                once = dict(zip(parts[end:], zip(at.tolist(), many.tolist(), strict=True), strict=True))
        begin[short], count[short] = self.memo.begin[slots], self.memo.count[slots]
        if longer:
            begin[longer], count[longer] = zip(*(self.memo.longer.get(p) or once[p] for p in own), strict=True)
        return begin, count

    def _special_in(self, text: str) -> bool:
        """Whether a text holds a special token's string, or would once its letters are lower-cased."""
        return any(s in text or self.kind == "word" and (s[0].isalpha() or s[0] in text) and s.lower() in text.lower() for s in self.special)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        self.memo  # made by now, and with it the list of special tokens
        whole = {k for k, t in enumerate(texts) if t and (self.kind == "byte" and _WIDE_SPACE.search(t) or self._special_in(t))}
        raw = [(t or "").encode("utf-8", "surrogatepass") if k not in whole else b"" for k, t in enumerate(texts)]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        first = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
        last = first + np.array([len(r) for r in raw], np.int64)
        edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if self.kind == "byte":
            # white space before a word belongs to it; what follows a text's last word is a part of its own
            begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            doc = np.searchsorted(first, starts, side="right") - 1
            begin = np.maximum(begin, first[doc])
            at = np.searchsorted(starts, last)
            tail = np.maximum(first, np.where(at > 0, ends[np.maximum(at - 1, 0)] if len(ends) else 0, 0))
            some = tail < last
            order = np.argsort(np.concatenate((begin, tail[some])), kind="stable")
            starts, ends = np.concatenate((begin, tail[some]))[order], np.concatenate((ends, last[some]))[order]
        cut = _marks_after_letters(data)
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        if not len(starts):
            out = [np.zeros(0, self.dtype) for _ in texts]
        else:
            begin, counts = self._find(_LOWER[data] if self.kind == "word" else data, starts, ends)
            ids = _stretches(self.memo.pool, begin, counts)
            bounds = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, np.append(first, len(data) + 1))]
            out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in whole:
            out[k] = self._one(texts[k])
        return out
