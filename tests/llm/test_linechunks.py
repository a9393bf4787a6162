"""Line dedup by content-defined chunks against a plain loop that shares no code with it."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from muster.llm import linechunks
from muster.llm.tables import load
from tests.llm.test_llm import none, odd  # noqa: F401

WORDS, LINES, ALL = 25, 32, (1 << 64) - 1


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & ALL
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & ALL
    return h ^ h >> 33


def boundary(one, two):
    """Whether a boundary lies after a pair of lines."""
    one, two = (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in (one, two))
    return (mixed((one * 0x9E3779B97F4A7C15 + two) & ALL) >> 32) % 2 == 0


def spans(lines):
    count = [len(x.split()) for x in lines]
    out = set()
    for k in range(len(lines)):
        for end in range(k + 2, len(lines) + 1):
            if boundary(lines[end - 2], lines[end - 1]) or sum(count[k:end]) >= WORDS or end - k >= LINES:
                out.add((k, end))
                break
        for start in range(k - 1, -1, -1):
            if boundary(lines[start], lines[start + 1]) or sum(count[start : k + 1]) >= WORDS or k + 1 - start >= LINES:
                out.add((start, k + 1))
                break
    return {(a, b) for a, b in out if sum(count[a:b])}


def brute(rows):
    """Text by key; keys are distinct."""
    first, out = {}, {}
    for key, text in sorted(rows):
        lines = (text or "").split("\n")
        for a, b in sorted(spans(lines)):
            first.setdefault(tuple(lines[a:b]), (key, a))
    for key, text in rows:
        lines, covered = (text or "").split("\n"), {}
        for a, b in spans(lines):
            doc, at = first[tuple(lines[a:b])]
            if doc != key or a - at >= b - a:
                covered.setdefault((doc, a - at), set()).update((k, k + 1) for k in range(a, b - 1))
        runs = []
        for place, steps in covered.items():
            inside = sorted({k for s in steps for k in s})
            a = inside[0]
            for k, after in zip(inside, [*inside[1:], None], strict=True):
                if after != k + 1:
                    runs.append((a - k - 1, a, k + 1, place))
                    a = after
        gone = set()
        for _, a, b, _ in sorted(runs):
            left = [k for k in range(a, b) if k not in gone]
            for k in left:
                amid = any(j in gone for j in range(a, k)) and any(j in gone for j in range(k + 1, b))
                if k - 1 in left or k + 1 in left or amid:
                    gone.add(k)
        out[key] = text if not gone else "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def texts_of(seed, n, vocabulary=40):
    """Texts of lines and passages from small stocks, so that chunks repeat, overlap and meet in every way."""
    draw = random.Random(seed)
    stock = ["", " ", *(" ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.choice([1, 3, 9, 20]))) for _ in range(vocabulary))]
    passages = [[draw.choice(stock) for _ in range(draw.randint(2, 9))] for _ in range(12)]
    rows = []
    for key in range(n):
        lines = []
        for _ in range(draw.randint(0, 5)):
            lines += draw.choice(passages) if draw.random() < 0.5 else [f"own {key} {draw.random()}" if draw.random() < 0.6 else draw.choice(stock)]
        rows.append((key, rows[draw.randrange(key)][1] if key and draw.random() < 0.15 else "\n".join(lines)))
    return rows


def cut(spark, rows, **how):
    return {r.doc_id: r for r in linechunks.dedup_chunks(spark.createDataFrame(rows, "doc_id bigint, text string"), **how).collect()}


def test_chunks_are_those_of_the_rule():
    for _, text in texts_of(1, 200):
        lines = text.split("\n")
        first, end = linechunks.chunks(lines, linechunks.line_hashes(lines))
        assert set(zip(first.tolist(), end.tolist(), strict=True)) == spans(lines)


def test_random_texts_equal_a_plain_loop(spark):
    rows = [row for seed in range(6) for row in ((1000 * seed + k, t) for k, t in texts_of(seed, 60))]
    got = cut(spark, rows)
    assert {k: r.text for k, r in got.items()} == brute(rows)
    assert sum(r.removed_lines for r in got.values()) > 200
    assert {x for r in got.values() for x in r.text.split("\n")} >= {x for _, t in rows for x in t.split("\n") if x.strip()}


def test_given_documents_equal_a_plain_loop(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    got = {r.doc_id: r.text for r in linechunks.dedup_chunks(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == brute(rows) and got != dict(rows)


def test_runs_that_stand_nowhere_as_a_whole_stay_in_part(spark):
    """A, B stands in one text and B, C in another: at most one of the two goes from A, B, C."""
    lines = {c: f"{c} " + " ".join(f"{c}{k}" for k in range(20)) for c in "ABCDEx"}
    text = lambda names: "\n".join(lines[c] for c in names)
    got = {k: r.text for k, r in cut(spark, [(1, text("AB")), (2, text("BC")), (3, text("ABC")), (4, text("ABCx")), (5, text("xABCx"))]).items()}
    assert got[1] == text("AB") and got[2] == text("BC") and got[3] == text("C")
    assert got[4] == text("Cx") and lines["x"] in got[5]


@pytest.mark.parametrize("n_words", [13, 4])
def test_passages_go_whole_whatever_surrounds_them(spark, n_words):
    """Passages that hold a chunk go to their first and last line; those of 25 words always hold one."""
    draw = random.Random(9)
    rows, trials = [], 210
    lines = lambda n: [" ".join(f"w{draw.randint(0, 10**9)}" for _ in range(n_words)) for _ in range(n)]
    around, size, whole = {}, {}, 0
    for trial in range(trials):
        key = 10 * trial
        passage, before, after = lines(2 + trial % 7), lines(draw.randint(0, 6)), lines(draw.randint(0, 6))
        rows += [(key, "\n".join([*lines(draw.randint(0, 6)), *passage, *lines(draw.randint(0, 6))])), (key + 1, "\n".join([*before, *passage, *after]))]
        around[key + 1], size[key + 1] = "\n".join([*before, *after]), len(passage)
    got = cut(spark, rows)
    for key, rest in around.items():
        assert got[key - 1].removed_lines == 0
        assert got[key].removed_lines in (0, size[key])
        assert got[key].removed_lines == 0 or got[key].text == rest and got[key].removed_chunks == 1
        whole += got[key].removed_lines > 0
    assert whole == trials if n_words == 13 else whole > 0.8 * trials


def test_colliding_hashes_remove_nothing_that_stands_nowhere_else(spark):
    """Six bits a line: different lines and chunks share hashes; only lines that stand earlier may go."""
    rows = texts_of(3, 80)
    exact = brute(rows)
    got = cut(spark, rows, bits=6)
    earlier = set()
    for key, text in rows:
        left = got[key].text.split("\n") if got[key].text else []
        it = iter(text.split("\n"))
        assert all(line in it for line in left)
        assert {x for x in text.split("\n") if x.strip()} - set(left) <= earlier
        earlier |= set(text.split("\n"))
    assert exact != {k: r.text for k, r in got.items()}


def test_rows_of_every_odd_kind(spark, odd, none):  # noqa: F811
    out = linechunks.dedup_chunks(odd)
    assert out.columns == [*odd.columns, "n_lines", "removed_chunks", "removed_lines"] and out.count() == odd.count()
    assert linechunks.dedup_chunks(none).count() == 0
    shared, unique = ("\n".join(f"{kind} line {k}" for k in range(8)) for kind in ("shared", "unique"))
    rows = [(1, shared), (2, shared), (2, unique), (None, shared), (None, shared), (3, None), (4, ""), (5, "a\n\n\nb"), (6, "c\n\n\nd")]
    got = sorted((r.doc_id or 0, r.text or "", r.n_lines) for r in linechunks.dedup_chunks(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(0, shared, 8), (0, shared, 8), (1, shared, 8), (2, "", 8), (2, unique, 8), (3, "", 0), (4, "", 1), (5, "a\n\n\nb", 4), (6, "c\n\n\nd", 4)])
    rows = [(1, "\n".join(f"{k} " + "word " * 13 for k in range(5)))] * 2
    assert [r.removed_lines for r in linechunks.dedup_chunks(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [0, 0]


def test_a_long_text_is_cut_whole(spark):
    lines = [f"line {k} of a long text" for k in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["one", *lines, "two"]))]
    got = cut(spark, rows)
    assert got[1].removed_lines == 0 and got[2].text == "one\ntwo"


def test_digests_follow_the_order_of_lines():
    hashes = np.array([1, 2, 2, 1, 1, 2], np.uint64)
    d = linechunks.digests(hashes, np.array([0, 2, 4]), np.array([2, 4, 6]))
    assert d[0] == d[2] != d[1]
