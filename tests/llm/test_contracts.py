"""Cases in which rows were once lost, changed or decided by chance, and brute force for what has no SQL."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers as tokenizers_files
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import hf_tokens, licenses, linededup, neardup, quality, shingles, toxicity, urlfilter, vptree
from muster.llm.components import components
from tests.llm.test_llm import brute_components, brute_nearest


def thue_morse(n: int) -> tuple[str, str]:
    """Two words whose hashes by any polynomial modulo a power of two with an odd base are equal, if n is large."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


# hashes and ids


def test_words_that_mirror_each_other_differ():
    for n in (8, 64, 65, 1024, 4096):
        a, b = thue_morse(n)
        x, y = shingles.shingle_sets([a, b], 5)
        assert len(x) == len(y) == 1 and x[0] != y[0]


def test_hashes_depend_on_bytes_alone():
    draw = random.Random(3)
    words = sorted({"".join(draw.choices("abcé日😀", k=draw.randint(1, 90))) for _ in range(3000)})
    alone = {int(shingles.shingle_sets([w], 1)[0][0]) for w in words}
    assert len(alone) == len(words)
    assert {int(h) for h in shingles.shingle_sets(["\t".join(words)], 1)[0]} == alone


@pytest.mark.parametrize(("file", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_of_mirrored_words_and_special_tokens_are_the_library_s(file, kind):
    own = hf_tokens.MemoTokenizer(hf_tokens.read_tokenizer(tokenizers_files.path(file)), kind, memo_size=100)
    ref = Tokenizer.from_file(tokenizers_files.path(file))
    texts = [*thue_morse(1024), *thue_morse(16), *thue_morse(15), "hello <|endoftext|> x", "<|startoftext|>a <|EndOfText|>", "x" * 64, "y" * 65, "a\x00b", "a\x00", "a", " \x00\x00"]
    for _ in range(2):
        for s, ids in zip(texts, own.encode_batch(texts), strict=True):
            assert ids.tolist() == ref.encode(s, add_special_tokens=False).ids, repr(s)
    plain = hf_tokens.MemoTokenizer(hf_tokens.read_tokenizer(tokenizers_files.path(file)), kind, special_as_text=True)
    ref.encode_special_tokens = True
    assert plain.encode_batch(["hello <|endoftext|> x"])[0].tolist() == ref.encode("hello <|endoftext|> x", add_special_tokens=False).ids


# near-duplicates


def test_a_family_whose_smallest_text_is_linked_to_nobody(spark):
    draw = random.Random(11)
    base = [f"z{draw.randint(0, 10**6)}" for _ in range(60)]
    first = list(base)
    for k in (5, 15, 25, 35, 45):
        first[k] = f"o{k}"
    rows = [(0, " ".join(first))]
    for k in range(1, 300):
        words = list(base)
        words[draw.randrange(60)] = f"e{draw.randint(0, 10**6)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows, 85)
    for block in (16, 512):
        assert {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(df, 85, block=block).collect()} == want


def test_pairs_of_blocks_give_no_more_links_than_roots():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate((base[20:], draw.integers(0, 1 << 60, 5).astype(np.uint64)))) for _ in range(200)]
    short = [(neardup.mix(neardup.signature(s)) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
    table = pa.table({
        "family": pa.array([0] * 200, pa.int64()), "bi": pa.array([0] * 200, pa.int64()), "bj": pa.array([1] * 200, pa.int64()), "side": pa.array([k % 2 for k in range(200)], pa.int32()),
        "root": pa.array([k % 10 for k in range(200)], pa.int64()), "short": pa.array(short, pa.binary()), "set": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    links = list(neardup._join_pairs(85)(iter(table.to_batches())))
    assert sum(b.num_rows for b in links) == 9


def test_components_in_rounds_equal_those_of_one_task(spark):
    draw = random.Random(1)
    links = [(draw.randint(0, 2000), draw.randint(0, 2000)) for _ in range(1000)]
    root: dict[int, int] = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {k: find(k) for k in root}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    for task_links in (5, 16_384):
        assert {r.node: r.component for r in components(df, task_links=task_links).collect()} == want
    assert components(df.limit(0)).count() == 0


# line dedup


def test_other_texts_of_a_key_stay_whole(spark):
    shared = "\n".join(f"shared line {k}" for k in range(8))
    unique = "\n".join(f"unique line {k}" for k in range(8))
    rows = [(1, shared), (2, shared), (2, unique), (None, shared), (None, shared)]
    got = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([(0, shared), (0, shared), (1, shared), (2, ""), (2, unique)])


# nearest neighbours


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_ties_go_to_the_smallest_keys(spark, shard_rows):
    """Different vectors with one and the same product, at the last place and far beyond it."""
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, *[0.0] * 7])]
    for k in range(1, 400):
        rest = rng.integers(-8, 9, 7)
        rows.append((k if k % 20 else 10_000 + k + 1, [1.0, *map(float, rest)]))
    draw = random.Random(5)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute_nearest(rows, 20)
    got = defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]] == sorted(i for i, _ in rows if i)[:20]
    assert got == want


def test_many_ties_are_cut_on_the_way(spark, monkeypatch):
    points = np.eye(64)[np.arange(3000) % 64] * 1.0
    tree = vptree.VpTree(points, leaf=64)
    monkeypatch.setattr(vptree, "MAX_PAIRS", 500)
    sizes = []

    def least(who, rows):
        sizes.append(len(who))
        by = np.lexsort((rows, who))
        return by[np.arange(len(by)) - np.searchsorted(who[by], np.arange(2))[who[by]] < 5]

    who, rows = tree.search(np.zeros((2, 64)), 5, 1.0, least)
    assert sorted(rows[who == 0].tolist()) == sorted(rows[who == 1].tolist()) == [0, 1, 2, 3, 4]
    assert max(sizes) <= 500 + 2 * 64 + 10


# quality


def brute_estimate(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The smallest determinant over many concentrations from random starts, with the operator's floors and shares."""
    rng, best = np.random.default_rng(0), (np.inf, None, None)
    h = int(np.ceil(quality.KEEP * len(x)))

    def factor(cov):
        p, lower = len(cov), np.zeros_like(cov)
        for i in range(p):
            for j in range(i + 1):
                rest = cov[j, i] - lower[i, :j] @ lower[j, :j]
                lower[i, j] = np.sqrt(max(rest, quality.FLOOR[i] ** 2)) if i == j else rest / lower[j, j]
        return lower

    for trial in range(60):
        some = rng.choice(len(x), 12 if trial else len(x), replace=False)
        mean, lower = x[some].mean(axis=0), factor(np.cov(x[some].T, bias=True) * quality.CONSISTENCY)
        for _ in range(30):
            z = np.linalg.solve(lower, (x - mean).T)
            inner = np.argsort((z**2).sum(axis=0), kind="stable")[:h]
            mean, lower = x[inner].mean(axis=0), factor(np.cov(x[inner].T, bias=True) * quality.CONSISTENCY)
        det = float(np.log(np.diag(lower)).sum())
        if det < best[0]:
            best = det, mean, lower
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_estimate_comes_near_the_smallest_determinant(spark, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(5, 5)) * 2
    x = rng.normal(size=(500, 5)) @ mix + 3
    x[:90] = rng.normal(size=(90, 5)) * 0.5 + np.array([14.0, -9, 12, 7, -11])
    x = np.round(x, 3)
    rows = [("g", 500, *np.round(r * 1000).astype(int).tolist()) for r in x]
    factors = quality.estimates(spark.createDataFrame(rows, "g string, size bigint, q0 bigint, q1 bigint, q2 bigint, q3 bigint, q4 bigint")).first()
    lower = np.zeros((5, 5))
    for i in range(5):
        for j in range(i + 1):
            lower[i, j] = factors[f"l{i}{j}"]
    det, mean, _ = brute_estimate(x)
    assert float(np.log(np.diag(lower)).sum()) <= det + 0.15  # the share kept ends with a whole bin
    z = np.linalg.solve(lower, (x - np.array([factors[f"m{i}"] for i in range(5)])).T)
    d2 = (z**2).sum(axis=0)
    assert d2[:90].min() > 45 > d2[90:].max() or d2[:90].min() > 2 * d2[90:].max()
    assert np.abs(np.array([factors[f"m{i}"] for i in range(5)]) - mean).max() < 0.5


# toxicity


def test_scores_follow_from_the_model_s_weights(spark):
    """Counts, ratios and scores made again n-gram by n-gram, by the buckets that single n-grams have."""
    draw = random.Random(9)
    rows = [(k, " ".join(draw.choice(["Snot", "waffle", "kind", "words", "plain"]) for _ in range(30)) + (" snotwaffle" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    known: dict[str, int] = {}

    def own(text: str) -> set[int]:
        low = text.lower()
        grams = {low[k : k + n] for n in toxicity.SIZES for k in range(len(low) - n + 1)}
        for g in grams - set(known):
            # of an n-gram's buckets the one that its shorter ones do not have
            parts = {g[k : k + n] for n in toxicity.SIZES if n < len(g) for k in range(len(g) - n + 1)}
            known[g] = next(iter(set(toxicity.buckets([g])[1].tolist()) - {known.get(p) or own_bucket(p) for p in parts}), -1)
        return {known[g] for g in grams} - {-1}

    def own_bucket(g: str) -> int:
        parts = {g[k : k + n] for n in toxicity.SIZES if n < len(g) for k in range(len(g) - n + 1)}
        known[g] = next(iter(set(toxicity.buckets([g])[1].tolist()) - {known.get(p) or own_bucket(p) for p in parts}), -1)
        return known[g]

    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    buckets = {k: own(t) for k, t, _ in rows}
    for k, _, _ in rows:
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(weight.get(b, 0.0) for b in buckets[k])))))
    toxic = {k for k, _, y in rows if y}
    ratio = lambda b: np.log((sum(b in buckets[k] for k in toxic) + 0.5) / (len(toxic) + 1) / ((sum(b in buckets[k] for k in set(buckets) - toxic) + 0.5) / (len(rows) - len(toxic) + 1)))
    assert all((weight[b] > 0) == (ratio(b) > 0) for b in weight if abs(ratio(b)) > 2)


def test_regression_is_that_of_plain_gradient_descent():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(50, rng.integers(0, 9), replace=False)) for _ in range(200)]
    y, values = rng.integers(0, 2, 200).astype(float), rng.normal(size=50)
    x = np.zeros((200, 50))
    for k, r in enumerate(rows):
        x[k, r] = values[r]
    rate = 1 / (0.25 * (1 + (x**2).sum() / 200) + 0.01)
    w, b, vw, vb = np.zeros(50), 0.0, np.zeros(50), 0.0
    for _ in range(300):
        e = (1 / (1 + np.exp(-(b + x @ w))) - y) / 200
        vw, vb = 0.9 * vw - rate * (x.T @ e + 0.01 * w / 200), 0.9 * vb - rate * e.sum()
        w, b = w + vw, b + vb
    bias, got = toxicity.fit_logistic(rows, y, values)
    assert bias == pytest.approx(b) and got == pytest.approx(w)


def test_regression_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(50, rng.integers(0, 9), replace=False)) for _ in range(200)] + [np.zeros(0, int)] * 3
    y, values = rng.integers(0, 2, 203).astype(float), rng.normal(size=50)
    whole = toxicity.fit_logistic(rows, y, values)
    monkeypatch.setattr(toxicity, "FIT_FEATURES", 17)
    bias, w = toxicity.fit_logistic(rows, y, values)
    assert bias == pytest.approx(whole[0]) and w == pytest.approx(whole[1])
    assert toxicity.fit_logistic([np.zeros(0, int)] * 3, np.array([0.0, 1, 1]), np.zeros(0))[0] > 0


def test_rejection_of_long_texts_by_slices(spark):
    df = spark.createDataFrame([(k, None if k == 3 else "" if k == 4 else "word " * (20_000 if k % 3 else 2)) for k in range(12)], "doc_id bigint, text string")
    nobody = toxicity.Model(-1.0, np.zeros(0, np.int64), np.zeros(0))
    assert toxicity.reject(df, nobody, 0.5, chars=150_000).count() == 12
    everybody = toxicity.Model(1.0, np.zeros(0, np.int64), np.zeros(0))
    assert toxicity.reject(df, everybody, 0.5, chars=10).count() == 0


# URLs and licenses


def test_url_filter_on_an_empty_table(spark):
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_licenses_at_exactly_the_threshold_at_all_offsets(spark):
    """Changed words so that exactly the least share of shingles is left, at every offset within two steps."""
    rows, want = [], set()
    for name, text in licenses.TEMPLATES:
        words = licenses.words_of(text)
        n = len(words) - 4
        if n < 20:
            continue
        may_lack = n - -(-80 * n // 100)
        changed, lacking, at = list(words), 0, 2
        while lacking + 5 <= may_lack and at + 6 < len(words) - 5:
            changed[at + 2] = "changed"
            lacking, at = lacking + 5, at + 6
        for offset in range(2 * (len(words) // 8) + 1):
            want.add((len(rows), name))
            rows.append((len(rows), " ".join([f"q{k}" for k in range(offset)] + changed + [f"r{k}" for k in range(30)])))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert want <= {(r.doc_id, r.license) for r in found}


def test_ties_between_windows_go_to_the_first(spark):
    notice = licenses.TEMPLATES[3][1]
    rows = [(1, f"{notice} and again {notice}"), (1, f"{notice} and again {notice}"), (None, notice), (2, f"x {notice}")]
    got = {(r.doc_id, r.license, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    name = licenses.TEMPLATES[3][0]
    assert got == {(1, name, 0), (None, name, 0), (2, name, 1)}


# pipeline


def test_pipeline_run_equals_its_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(3)
    texts = [" ".join(f"word{draw.randint(0, 500)}" for _ in range(80)) + f"\nline {k}\nend {k}" for k in range(40)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, texts[0], texts[1]])] + [(100, "short", "en", "s", 5), (101, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
    run = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect()
    assert sorted(run) == sorted(docs.select("doc_id", "doc_tokens").distinct().collect())
    kept = {r.doc_id for r in run}
    assert 100 not in kept and 101 not in kept and not {40, 41} & kept and {0, 1} <= kept
