"""Quality rules, and robust multivariate outliers among what the rules let pass.

Words are runs of characters other than space and the control characters 9 to 13. A text fails the base rules with
fewer than 50 words, or if more than half of its words lie in three-word windows that occur twice or more in it.

The others are judged by how far their statistics lie from those of their language and source. The vector of a text:
words a line and characters a word, symbols a word, and the shares of repeated lines and of repeated words, each by a
transformation that evens out its tail. Per group, the minimum-covariance-determinant estimate of location and
scatter is found by concentration: from each of three deterministic starts, the mean and covariance of the `KEEP` share
of texts with the smallest Mahalanobis distances, again and again until nothing changes (`STEPS` times at most); of the
results the one whose scatter has the smallest determinant. Texts farther than `CUTOFF` (squared) are rejected. Scatter
is floored in each statistic by `FLOOR`, since most texts of a clean group have no symbols at all and an
exact zero would make the first symbol an outlier.

Distances are sorted by counting: their logarithms fall into bins a 32nd wide, and each step is one map-side
combined aggregation of counts, sums and products a bin, then a running count over a group's few bins; the share kept is
rounded up to a whole bin. So a group of any size is never in one task. Statistics are whole thousandths and sums whole
numbers, so the outcome depends on no order. Groups with fewer than `min_group` texts are
pooled over their sources, languages with fewer over all such languages; where that pool has fewer too, its texts are
judged by the estimate of all texts, however few there are.

Everything is DataFrame functions. Null texts have no words, null languages and sources are groups like any other,
ties share a bin and so a verdict, repeated rows have equal verdicts, extra columns do not matter, and an empty table
gives no rows. Texts are measured whole; repeats are found by sorting a text's windows, not by comparing pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.tables import keep, load

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
KEEP, STEPS, BINS, SCALE = 0.75, 12, 32, 1000.0
STATS = ("x0", "x1", "x2", "x3", "x4")
#: The least standard deviation of each statistic.
FLOOR = (0.6, 0.25, 0.05, 0.15, 0.15)
#: Squared distance beyond which a text is rejected; that of a normal vector exceeds it about once in 10**8.
CUTOFF = 45.0


def measure(text: str | Column) -> dict[str, Column]:
    """Word-level measures that need no array, by name."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    without = F.translate(t, " \t\n\x0b\x0c\r", "")
    return {
        "word_chars": F.length(without).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
    }


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with `words`: how many words lie in three-word windows that occur twice or more.

    Window hashes are sorted with their places; equal neighbours are repeats; a repeated window covers its three
    words less those that the repeated window before it covers. Each array is a column of its own, so that no
    lambda evaluates another array anew for every element.
    """
    n = F.size("words")
    hashes = F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    hashed = rows.withColumn("hashes", hashes)
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs)).drop("hashes")
    same = lambda x, k: x["h"] == F.get("ordered", k)["h"]
    at = F.transform("ordered", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    placed = ordered.withColumn("placed", F.array_sort(F.filter(at, lambda x: x.isNotNull()))).drop("ordered")
    covered = F.aggregate(
        "placed",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("placed")


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = base.select("*", F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = with_repeated_words(cut).select(
        "doc", "lang", "source", F.size("words").cast("bigint").alias("n_words"), *(c.alias(k) for k, c in measure("text").items()),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n = F.greatest("n_words", F.lit(1))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(b, F.lit(1)))))
    values = (F.log(n / F.greatest("n_lines", F.lit(1))), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(F.col("n_symbols") / n), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return counted.select("doc", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *(v.alias(x) for v, x in zip(values, STATS, strict=True)))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]


def _factors(params: DataFrame, *others: str) -> DataFrame:
    """Of each group (and `others`): m0.. and the entries of the Cholesky factor, so that rows only multiply."""
    p = len(STATS)
    state = params
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            state = state.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return state.select("g", *others, *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def _far(joined: DataFrame) -> DataFrame:
    """Adds d2 to rows that hold the statistics and their group's factors."""
    p = len(STATS)
    state = joined
    for i in range(p):
        rest = F.col(STATS[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        state = state.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = F.col("z0") * F.col("z0")
    for i in range(1, p):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return state.withColumn("d2", total)


#: Groups (pairs of language and source) up to which their parameters are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 10_000


def _sums(values: list[Column]) -> list[Column]:
    """Sums and sums of products of whole numbers: they do not depend on the order of adding."""
    return [F.sum(v).alias(f"t{i}") for i, v in enumerate(values)] + [F.sum(values[i] * values[j]).alias(f"t{i}{j}") for i, j in _pairs()]


def _moments(scale: float, factor: float) -> list[Column]:
    """Means and covariances, times `factor`, from such sums of values times `scale`."""
    mean = [F.col(f"t{i}") / F.col("n") for i in range(len(STATS))]
    cov = {(i, j): (F.col(f"t{i}{j}") / F.col("n") - mean[i] * mean[j]) for i, j in _pairs()}
    return [(m / scale).alias(f"m{i}") for i, m in enumerate(mean)] + [(factor * c / scale**2).alias(f"s{i}{j}") for (i, j), c in cov.items()]


#: Groups up to which tables of a few rows a group and bin are one partition, once they have been added up in all tasks,
#: and so what is done to them one task.
TASK_GROUPS = 200


def _starts(rows: DataFrame, hint: Callable[[DataFrame], DataFrame], small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three estimates of each group (g, start, m0.., s00..) to begin with, all around the medians and with the median
    absolute deviations as scales: uncorrelated; with the correlations of the hyperbolic tangents of the standardised
    values; and with those of their directions."""
    n = len(STATS)
    medians = rows.groupBy("g").agg(*(F.percentile(F.round(F.col(f"q{i}") / SCALE, 2), F.lit(0.5)).alias(f"c{i}") for i in range(n)))
    spread = rows.join(hint(medians), "g").groupBy("g").agg(*(F.percentile(F.round(F.abs(F.col(f"q{i}") / SCALE - F.col(f"c{i}")), 2), F.lit(0.5)).alias(f"a{i}") for i in range(n)))
    centre = keep(small(medians.join(spread, "g").select("g", *(f"c{i}" for i in range(n)), *(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOOR[i])).alias(f"a{i}") for i in range(n)))))
    z = rows.join(hint(centre), "g").select("g", *((F.col(f"q{i}") / SCALE - F.col(f"c{i}")).alias(f"z{i}") for i in range(n)), *(F.col(f"a{i}") for i in range(n)))
    z = z.select("g", *((F.col(f"z{i}") / F.col(f"a{i}")).alias(f"z{i}") for i in range(n)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, n)), F.col("z0") * F.col("z0")))
    whole = lambda c: F.round(c * SCALE).cast("bigint")
    bent = F.struct(F.lit(1).alias("start"), *(whole(F.tanh(f"z{i}")).alias(f"u{i}") for i in range(n)))
    turned = F.struct(F.lit(2).alias("start"), *(F.when(length > 0, whole(F.col(f"z{i}") / length)).otherwise(F.lit(0).cast("bigint")).alias(f"u{i}") for i in range(n)))
    u = z.select("g", F.explode(F.array(bent, turned)).alias("u")).select("g", "u.*")
    shape = u.groupBy("g", "start").agg(F.count("*").alias("n"), *_sums([F.col(f"u{i}") for i in range(n)])).select("g", "start", *_moments(SCALE, 1.0)).join(hint(centre), "g")
    both = lambda i, j: F.sqrt(F.greatest(F.col(f"s{i}{i}") * F.col(f"s{j}{j}"), F.lit(0.0)))
    corr = lambda i, j: F.coalesce(F.col(f"s{i}{j}") / F.nullif(both(i, j), F.lit(0.0)), F.lit(0.0))
    scaled = [((F.lit(1.0) if i == j else corr(i, j)) * F.col(f"a{i}") * F.col(f"a{j}")).alias(f"s{i}{j}") for i, j in _pairs()]
    shaped = shape.select("g", "start", *(F.col(f"c{i}").alias(f"m{i}") for i in range(n)), *scaled)
    plain = centre.select("g", F.lit(0).alias("start"), *(F.col(f"c{i}").alias(f"m{i}") for i in range(n)), *((F.col(f"a{i}") * F.col(f"a{i}") if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in _pairs()))
    return plain.unionByName(shaped)


def estimates(rows: DataFrame, n_groups: int = 1) -> DataFrame:
    """Of each group of rows (g, size, q0..: whole thousandths of the statistics) the factors (m0.., l00..) of the
    minimum-covariance-determinant estimate: of all starts, each concentrated until nothing changes (at most `STEPS`
    times), the one with the smallest determinant; the first on ties. By the number of groups their tables are broadcast
    and worked on in one task, or joined and dealt out."""
    hint = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df)
    small = (lambda df: df.repartition(1)) if n_groups <= TASK_GROUPS else (lambda df: df)
    n = len(STATS)
    factors = _factors(keep(small(_starts(rows, hint, small))), "start")
    values = rows.select("g", "size", *(F.col(f"q{i}") for i in range(n)), *((F.col(f"q{i}") / SCALE).alias(x) for i, x in enumerate(STATS)))
    names = ["n", *(f"t{i}" for i in range(n)), *(f"t{i}{j}" for i, j in _pairs())]
    before = None
    for _ in range(STEPS):
        far = _far(values.join(hint(factors), "g"))
        binned = far.withColumn("bin", F.floor(F.log(F.greatest("d2", F.lit(1e-6))) * BINS))
        bins = small(binned.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), F.max("size").alias("size"), *_sums([F.col(f"q{i}") for i in range(n)])))
        inner = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        kept = bins.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).where(F.col("before") < F.ceil(KEEP * F.col("size")))
        total = keep(kept.groupBy("g", "start").agg(*(F.sum(c).alias(c) for c in names)))
        # the innermost share of a normal sample has a smaller scatter than the whole, by a known factor
        factors = _factors(total.select("g", "start", *_moments(SCALE, CONSISTENCY)), "start")
        now = total.agg(F.bit_xor(F.xxhash64("g", "start", *names))).first()[0]  # one number that tells whether any sum changed
        if now == before:
            break
        before = now
    determinant = sum((F.log(f"l{i}{i}") for i in range(1, n)), F.log("l00"))
    rest = [c for c in factors.columns if c != "g"]
    best = factors.groupBy("g").agg(F.min_by(F.struct(*rest), F.struct(determinant, "start")).alias("b"))
    return keep(small(best.select("g", "b.*").drop("start")))


def outliers(measured: DataFrame, min_group: int) -> DataFrame:
    """`measured` with d2, the squared robust distance; null where the base rules fail a group whole."""
    able = measured.where("not base_failed")
    sizes = able.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pooled = F.sum(F.when(F.col("n") < min_group, F.col("n"))).over(Window.partitionBy("lang"))
    label = F.when(F.col("n") >= min_group, F.to_json(F.array("lang", "source"))).when(pooled >= min_group, F.to_json(F.array("lang"))).otherwise("[]")
    groups = keep(sizes.select("lang", "source", "n", label.alias("g")))
    n_groups = groups.count()
    small = (lambda df: df.repartition(1)) if n_groups <= TASK_GROUPS else (lambda df: df)
    left = groups.where("g = '[]'").agg(F.sum("n")).first()[0] or 0
    # leftovers too few for an estimate of their own are judged by that of all texts
    others = groups.where("g <> '[]'").unionByName(groups.withColumn("g", F.lit("[]")))
    fed = others if 0 < left < min_group else groups
    usable = keep(small(fed).groupBy("g").agg(F.sum("n").alias("size")))
    hint = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df)
    fed = fed.join(usable, "g").select(F.col("lang").alias("l"), F.col("source").alias("s"), "g", "size")
    groups = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g")
    whole = [F.round(F.col(x) * SCALE).cast("bigint").alias(f"q{i}") for i, x in enumerate(STATS)]
    rows = able.join(hint(fed), able["lang"].eqNullSafe(F.col("l")) & able["source"].eqNullSafe(F.col("s"))).select("g", "size", *whole)
    factors = estimates(rows, n_groups)
    keyed = measured.join(hint(groups), measured["lang"].eqNullSafe(F.col("l")) & measured["source"].eqNullSafe(F.col("s")), "left").drop("l", "s")
    exact = keyed.withColumns({x: F.round(F.col(x) * SCALE) / SCALE for x in STATS})
    return _far(exact.join(hint(factors), "g", "left"))


#: For a normal vector of 5 statistics and the innermost 75 %: 0.75 / P(chi2 with 7 degrees <= the 75 % point with 5).
CONSISTENCY = 1.412


def judge(docs: DataFrame, min_group: int = 60, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: the key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    measured = keep(statistics(docs, id_col, text_col, lang_col, source_col))
    seen = outliers(measured, min_group)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)
    return seen.select(F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.sqrt("d2").alias("distance"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"))
