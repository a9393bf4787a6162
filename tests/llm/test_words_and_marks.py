"""The library is asked for each word once, whatever marks follow it, and its ids stay as they are."""

from __future__ import annotations

import random

import public_tokenizers as tokenizers_files
import pytest
from tokenizers import Tokenizer

from muster.llm import hf_tokens

KINDS = [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")]
PIECES = ["a", "B", "ab", "é", "É", "ß", "ю", "Ж", "İ", "ŉ", "ʹ", "µ", "×", "ª", "́", "̸", "ͅ", "Σ", "日", "1", "²", "'", "'s", "’", "=", "<", ".", "###", "&", "_", "|", "(", " ", "\n", "\x00", "\x7f", "א", "y" * 70]


@pytest.fixture(params=KINDS, ids=[k for _, k in KINDS])
def both(request):
    file, kind = request.param
    path = tokenizers_files.path(file)
    return (lambda **more: hf_tokens.MemoTokenizer(hf_tokens.read_tokenizer(path), kind, **more)), Tokenizer.from_file(path)


def same(own, ref, texts):
    for s, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == ref.encode(s, add_special_tokens=False).ids, repr(s)


def test_a_word_with_marks_is_asked_for_once(both, monkeypatch):
    make, ref = both
    asked, library = [], hf_tokens.MemoTokenizer._library
    monkeypatch.setattr(hf_tokens.MemoTokenizer, "_library", lambda self, strings: asked.extend(strings) or library(self, strings))
    same(make(), ref, [" seeasosa### seeasosa&&& seeasosa elciónsé%%% elciónsé, elciónsé"])
    assert sorted(x.strip() for x in asked) == ["###", "%%%", "&&&", ",", "elciónsé", "seeasosa"]


def test_marks_after_letters_of_all_kinds(both):
    make, ref = both
    own, draw = make(memo_size=500), random.Random(5)
    for _ in range(12):
        same(own, ref, ["".join(draw.choices(PIECES, k=draw.randint(0, 20))) for _ in range(250)])


def test_a_memo_that_grows_keeps_what_it_held(both):
    make, ref = both
    own, draw = make(), random.Random(6)
    words = ["".join(draw.choices("abcdeé", k=9)) for _ in range(40_000)]
    same(own, ref, [" ".join(words[:300])])
    size = len(own.memo.high)
    same(own, ref, [" ".join(words[k : k + 200]) for k in range(0, len(words), 200)])
    assert len(own.memo.high) > size


def test_other_steps_before_the_model_are_kept():
    ref = Tokenizer.from_file(tokenizers_files.path("word_bpe_49k.json"))
    assert hf_tokens._word_tokenizer(ref) is not None
    ref.normalizer = None
    assert hf_tokens._word_tokenizer(ref) is None
