"""Hard negatives, Merkle manifests and chat windows against plain restatements, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers as tokenizers_files
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import chats, merkle, negatives
from muster.llm.hf_tokens import read_tokenizer
from muster.llm.places import placed
from muster.llm.registry import QUERIES


# places


def test_places_and_sums_of_a_group_that_holds_most_rows(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, "a", "a", "a", "b"]), draw.choice([None, *range(40)]), draw.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    got = placed(df, ["g"], ["k"], ["v"]).collect()
    for g in (None, "a", "b"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        assert sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None) == sorted((r.k, r.v) for r in mine if r.k is not None)
        keys = [-1 if r.k is None else r.k for r in mine]
        assert keys == sorted(keys)
        total = 0
        for r in mine:
            assert r.v_before == total
            total += r.v
    assert placed(df.where("false"), ["g"], ["k"], ["v"]).count() == 0


# hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives_=10, low=30, high=90):
    whole = {}
    for key, label, v in sorted((r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: r):
        if sum(x * x for x in v) < 2.0**39 and len(v):
            whole.setdefault((key, len(v)), (label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for (a, n), (label, v) in whole.items():
        if not is_anchor(a):
            continue
        others = [(-sum(x * y for x, y in zip(v, w, strict=True)), k, lab) for (k, m), (lab, w) in whole.items() if m == n and k != a]
        for p, pk, _ in sorted(o for o in others if o[2] == label)[:positives]:
            fits = sorted(o for o in others if o[2] != label and low * -p <= 100 * -o[0] <= high * -p)[:negatives_]
            out += [(a, pk, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(fits)]
    return sorted(out)


def test_negatives_equal_brute_force_with_ties_copies_and_odd_rows(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(9, 8))
    rows = [(k, int(draw.integers(4)), [float(x) for x in np.round(centres[draw.integers(9)] + draw.normal(size=8) * 0.3, 1)]) for k in range(400)]
    rows += [(k, 1, rows[7][2]) for k in range(400, 500)] + [(k, 2, rows[7][2]) for k in range(500, 600)]  # one vector, many keys
    rows += [(600, None, rows[0][2]), (601, 1, None), (None, 1, rows[0][2]), (602, 1, [None] + rows[0][2][1:]), (603, 1, [float("nan")] * 8), (604, 1, [float("inf")] * 8)]
    rows += [(605, 1, [0.0] * 8), (610, 2, [1e6] * 8), (611, 1, [1e5] * 8), (612, 1, [9e4] * 8), (613, 0, [5e4] * 8), (620, 1, [1.0, 2.0]), (621, 1, [1.0, 1.0]), (622, 2, [0.5, 0.5]), (630, 1, []), (640, 1, [1e-3] * 8)]
    rows += [rows[10], (20, 0, rows[30][2]), (20, 3, rows[31][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("part", F.lit(1))
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), part_rows=128, block_anchors=16, leaf=8)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda k: k % 10 == 0)
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.lit(False), F.col("label")).count() == 0


def test_trees_leave_out_nodes_whose_bounds_do_not_fit():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 16))
    x = np.floor(256 * (centres[draw.integers(60, size=6000)] + 0.05 * draw.normal(size=(6000, 16)))).astype(np.int16)
    labels, keys = draw.integers(5, size=6000), np.arange(6000)
    tree = negatives.BallTree(x, labels, keys, 32)
    a = np.arange(0, 6000, 50)
    none = np.full(len(a), negatives.NONE)
    score, found = tree.search(x[a], labels[a], a, np.arange(len(a)), none, -none, 5, True)
    assert tree.computed < 0.2 * len(a) * 6000
    for n, k in enumerate(a):
        s = x.astype(np.int64) @ x[k].astype(np.int64)
        mine = np.flatnonzero((labels == labels[k]) & (keys != k))
        assert found[n].tolist() == mine[np.lexsort((mine, -s[mine]))][:5].tolist()
    tree.search(x[a], labels[a], a, np.arange(len(a)), 30 * score[:, 0] // 100, 60 * score[:, 0] // 100, 10, False)
    assert tree.computed < 0.5 * len(a) * 6000


# Merkle manifest


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    """Of (doc_id, source, lang, n_chars, text) the eight values of the contract, by lists and loops."""

    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        """The top, and of each node its siblings' digests and sides level by level."""
        paths, at, who = [[] for _ in nodes], list(nodes), [[k] for k in range(len(nodes))]
        while len(at) > 1:
            runs = [range(k, min(k + 2, len(at))) for k in range(0, len(at), 2)]
            for run in runs:
                for k in run:
                    for w in who[k]:
                        paths[w].append(([at[j] for j in run if j < k], [at[j] for j in run if j > k]))
            at, who = [H(*(at[k] for k in run)) for run in runs], [[w for k in run for w in who[k]] for run in runs]
        return at[0], paths

    order = lambda v: (v is not None, v)
    by_lang = lambda r: (r[2] is not None, (r[2] or "").encode())
    langs = [sorted(g, key=lambda r: (order(r[0]), leaf(r))) for _, g in groupby(sorted(rows, key=by_lang), key=by_lang)]
    trees = [climb([leaf(r) for r in g]) for g in langs]
    root, upper = climb([t[0] for t in trees])
    out = []
    for g, (sub, paths), above in zip(langs, trees, upper, strict=True):
        for r, path in zip(g, paths, strict=True):
            path, h = path + above, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = leaf((*r[:3], r[3] + 1, r[4]))
            for left, right in path:
                h = H(*left, h, *right)
            out.append((r[0], leaf(r), sub, root, H(*(s for left, right in path for s in left + right)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "b": 2, "é": 3}, {"a": 65, "b": 64, None: 130}, {"a": 4500, "b": 1, "": 7}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_equals_brute_force(spark, sizes):
    draw, rows = random.Random(3), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = draw.choice([None, "", "x", "日本 é😀\n", "0:", "-", "a" * 50])
            rows.append((len(rows), draw.choice([None, "s", ""]), lang, draw.choice([None, 0, -3, 2**63 - 1]), text))
    rows += [(None, None, rows[0][2], None, None), rows[0], rows[0], (0, "t", rows[0][2], 1, "other")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5).withColumns({"place": F.lit("x"), "digest": F.lit(1), "block": F.lit(2)})
    got = merkle.manifest(df, *merkle.tampering()).drop("path")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_merkle(rows)


def test_manifest_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(df, *merkle.tampering()).count() == 0


# chats


@given(st.text(alphabet="#\\<>/turn: \n\rAé😀", max_size=40), st.text(alphabet="#\\</turn>: \n", max_size=12))
@settings(max_examples=300, deadline=None)
def test_what_is_escaped_reads_back(text, role):
    import re

    escaped = re.sub(r"\\|(?<=#)#|(?<=<)/turn>", r"\\\g<0>", text)
    in_role = re.sub(r"\\|(?<=#)#|(?<=<)/turn>|(?<=:) ", r"\\\g<0>", role)
    assert "##" not in escaped and "</turn>" not in escaped
    piece = f"### {in_role}: {escaped}{chats.END}"
    assert list(chats.parse(piece * 2)) == [(role, text)] * 2


def conversations(draw: random.Random) -> list[tuple]:
    rows = []
    for conv in (*range(25), None, -7):
        n = draw.choice([1, 2, 3, 60, 400])
        for turn in range(n):
            role = "system" if turn == 0 and draw.random() < 0.5 else draw.choice(["user", "assistant", "assistant", None, "a: b", "system"])
            text = draw.choice([None, "", r"\### Assistant: </turn> ok", "one two three " * draw.randint(1, 40), "日本 😀\n</turn>\n### user: x", "<|endoftext|>", "####"])
            rows.append((conv, turn if draw.random() < 0.95 else draw.choice([None, 0]), role, text))
    rows += [(1, 500, "assistant", "long " * 5000), (1, 501, "assistant", "after"), (3, -1, "system", "rule " * 3000), rows[0], rows[0]]
    return rows


def test_windows_of_chats_equal_a_plain_reading(spark):
    draw = random.Random(7)
    rows = conversations(draw)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6).withColumns({"place": F.lit(1), "tokens": F.lit("x"), "segment": F.lit("y")})
    path = tokenizers_files.path("byte_bpe_50k.json")
    budget, history, segment = 300, 60, 2000
    got = chats.windows(df, read_tokenizer(path), budget, history, segment).collect()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    count = lambda piece: len(library.encode(piece, add_special_tokens=False).ids)
    wanted = {}
    for conv in {r[0] for r in rows}:
        mine = [("" if r[2] is None else r[2], "" if r[3] is None else r[3], r[1]) for r in rows if r[0] == conv]
        wanted[conv] = sorted(mine, key=lambda r: (r[2] is not None, r[2] or 0))
        windows = sorted((w for w in got if w.conv_id == conv), key=lambda w: w.first_turn)
        read, targets, starts = [], [], []
        for w in windows:
            turns = list(chats.parse(w.text))
            pieces = [p + chats.END for p in w.text.split(chats.END)[:-1]]
            assert w.tokens == sum(map(count, pieces))
            new = turns[w.repeated :]
            assert new and w.first_turn == len(read)
            # over the budget only where a single new turn or the system turn leaves no choice
            assert w.tokens <= budget or len(new) == 1
            repeated = turns[: w.repeated]
            if repeated and wanted_system(read) and repeated[0] == read[0] and w.first_turn > 0 and count(pieces[0]) * 2 <= budget:
                repeated = repeated[1:]
                assert sum(map(count, pieces[1 : w.repeated])) <= history
            assert read[len(read) - len(repeated) :] == repeated
            read += new
            targets += [chats.unescape(w.text[s.first : s.last]) for s in w.loss]
            starts.append(w.first_turn)
        assert sorted(read) == sorted((r, t) for r, t, _ in wanted[conv])
        assert targets == [t for r, t in read if r == "assistant"]
    back = {r.conv_id: r for r in chats.read_back(spark.createDataFrame(got, chats.WINDOWS)).collect()}
    assert set(back) == set(wanted)
    for conv, r in back.items():
        assert r.n_turns == len(wanted[conv]) and r.loss_chars == sum(len(t) for role, t, _ in wanted[conv] if role == "assistant")
        assert r.formatted_chars == sum(len(w.text) for w in got if w.conv_id == conv)
    assert chats.windows(df.where("false"), read_tokenizer(path)).count() == 0


def wanted_system(turns: list[tuple[str, str]]) -> bool:
    return bool(turns) and turns[0][0] == "system"


def test_contract_of_the_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in QUERIES["op13_chat_format"](spark, sf_dir).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in mine)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), H(turns), len(loss), H(loss))
        assert r.formatted_chars > len(loss)
