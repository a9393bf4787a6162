"""Near-duplicates where keys repeat with other texts, against brute force over all pairs of rows."""

from __future__ import annotations

import random

import pytest

from muster.llm import neardup
from tests.llm.test_llm import brute_components


def altered(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randint(0, 10**6)}"
    return " ".join(words)


def groups(spark, rows, **how):
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85, **how).collect()
    assert len(out) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in out)
    return {(r.doc_id, r.component_id) for r in out}


def test_a_key_with_two_texts_joins_what_is_near_either(spark):
    draw = random.Random(4)
    a, b, c = ([f"{x}{draw.randint(0, 10**6)}" for _ in range(120)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, altered(draw, a, 1)), (3, altered(draw, b, 1))]
    assert groups(spark, rows) == {(k, 1) for k in (1, 2, 3)}
    # keys that are not the smallest of their class
    rows = [(4, " ".join(c)), (5, " ".join(c)), (5, " ".join(a)), (6, altered(draw, a, 1)), (7, " ".join(b)), (7, " ".join(b)), (8, "x y"), (8, None), (9, "x y")]
    assert groups(spark, rows) == {(4, 4), (5, 4), (6, 4), (7, 7), (8, 8), (9, 8)}


@pytest.mark.parametrize("block", [8, 256])
def test_random_repeated_keys_equal_brute_force(spark, block):
    draw = random.Random(block)
    bases = [[f"t{draw.randint(0, 10**6)}" for _ in range(120)] for _ in range(12)]
    rows = [(draw.randint(0, 400), altered(draw, draw.choice(bases), draw.randint(0, 4))) for _ in range(120)]
    rows += [(draw.randint(0, 400), altered(draw, [f"u{k}_{draw.random()}" for k in range(20)], 1)) for _ in range(60)]
    want = {(k, c) for k, (c, _) in brute_components(rows, 85).items()}
    assert len({k for k, _ in rows}) < len(rows) and groups(spark, rows, block=block) == want


def test_sketches_of_changed_texts_are_found(spark):
    """Recall: pairs with a similarity of 0.89 to 0.92, all of which must be linked."""
    draw = random.Random(12)
    rows, linked = [], set()
    for k in range(0, 1200, 2):
        words = [f"p{k}_{j}" for j in range(120)]
        other = list(words)
        for at in draw.sample(range(10, 110), 1):
            other[at] = "changed"
        cut = draw.randint(0, 3)
        rows += [(k, " ".join(words)), (k + 1, " ".join(other[cut:]))]
        x, y = ({tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in (rows[-2][1], rows[-1][1]))
        linked |= {(k + 1, k)} if 100 * len(x & y) >= 85 * len(x | y) else {(k + 1, k + 1)}
    got = groups(spark, rows)
    assert linked <= got and len(linked) == 600
