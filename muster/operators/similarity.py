"""Joins of keys by edit distance whose cost follows the number of near pairs.

Of two keys of a and b characters, a <= b, that are d edits apart, cut the shorter one into d + 1 segments: at least one
of these stands unchanged in the other, and where it can stand is bounded by its number and by b - a. So every key is
dealt out twice, as the shorter one by its segments and as the longer one by the stretches that could be such segments,
and both meet in an equi-join. The edits allowed follow from the longer key's length, so both sides know them.

What all keys of a group begin with is left out first: it changes no distance, and it makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.names import proximity, similarity
from muster.operators.kept import kept, unsent


def deletions(key: Column) -> Column:
    """A key and all keys with one character less: two keys at a distance of 1 or less share one of these."""
    one_less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda k: F.concat(F.substring(key, 1, k - 1), F.substring(key, k + 1, F.length(key))))
    return F.array_distinct(F.concat(F.array(key), one_less))


def _upto(first: Column, last: Column) -> Column:
    """first .. last, empty where last comes before first."""
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _edits(longer: Column, least: float) -> Column:
    """Edits that keys as similar as `least` can be apart, the longer one having this length."""
    return F.floor(longer * (1 - least) + 1e-9).cast("int")


def _cut(length: Column, edits: Column, number: Column) -> tuple[Column, Column]:
    """Where a segment begins, from 0, and how long it is, of edits + 1 segments of a key; the last ones are longer."""
    n = edits + 1
    base = F.floor(length / n).cast("int")
    short = n - F.pmod(length, n)
    return number * base + F.greatest(F.lit(0), number - short), base + F.when(number >= short, 1).otherwise(0)


def _numbers(length: Column, edits: Column) -> Column:
    """The numbers of a key's segments; a key of fewer characters has empty ones, of which the first will do."""
    return _upto(F.lit(0), F.when(length > edits, edits).otherwise(0))


def _segments(least: float) -> Column:
    """Of a key of a length taken as the shorter one: (shorter, longer, number, first, size) of its segments, for each length
    that the longer one can have. Lengths are those of whole keys; `skip` characters at the beginning are left out."""
    n, skip = F.col("length"), F.col("skip")

    def of(longer: Column) -> Column:
        edits = _edits(longer, least)

        def one(k: Column) -> Column:
            at, size = _cut(n - skip, edits, k)
            return F.struct(n.alias("shorter"), longer.alias("longer"), k.alias("number"), (skip + at + 1).alias("first"), size.alias("size"))

        return F.transform(_numbers(n - skip, edits), one)

    return F.flatten(F.transform(_upto(n, F.floor(n / least + 1e-9)), of))


def _stretches(least: float) -> Column:
    """Of a key of a length taken as the longer one: the same of the stretches that can be a segment of the shorter one, for
    each length that this can have and each place where the segment can stand."""
    n, skip = F.col("length"), F.col("skip")
    edits = _edits(n, least)

    def of(shorter: Column) -> Column:
        more = n - shorter

        def one(k: Column) -> Column:
            at, size = _cut(shorter - skip, edits, k)
            first = F.greatest(F.lit(0), at - k, at + more - (edits - k))
            last = F.least(n - skip - size, at + k, at + more + (edits - k))
            return F.transform(_upto(first, last), lambda p: F.struct(shorter.alias("shorter"), n.alias("longer"), k.alias("number"), (skip + p + 1).alias("first"), size.alias("size")))

        return F.flatten(F.transform(_numbers(shorter - skip, edits), one))

    return F.flatten(F.transform(_upto(F.greatest(F.lit(5), F.ceil(n * least - 1e-9)), n), of))


def _common(keys: DataFrame, on: list[str]) -> DataFrame:
    """The length of what all keys of a group begin with: the least and the greatest key tell."""
    ends = keys.groupBy(*on).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.length("a")), lambda k: F.substring("a", 1, k) == F.substring("b", 1, k))
    return ends.select(*on, F.array_max(same).alias("skip"))


def compared(left: DataFrame, right: DataFrame | None, on: list[str], least: float) -> DataFrame:
    """Pairs (on, l_id, r_id) of rows (on, id, key) that share a segment, some of them repeatedly, of keys of five or more
    characters: all pairs as similar as `least` are among them. Without `right` the rows of one table are paired, the
    shorter key first, equally long ones both ways."""
    # a row a group and a row a length: worked out once, else their expressions are worked out again for rows and filters
    skips = kept(_common(left.select(*on, "key") if right is None else left.select(*on, "key").unionByName(right.select(*on, "key")), on))
    part = F.xxhash64("p.shorter", "p.longer", "p.number", F.substring("key", F.col("p.first"), F.col("p.size"))).alias("__part")

    def parts(df: DataFrame, of: Column, name: str, shorter: bool = False) -> DataFrame:
        rows = df.where(F.length("key") >= 5).withColumn("length", F.length("key")).join(skips, on)
        # where segments lie depends on lengths alone, of which there are few
        layouts = rows.select("length", "skip").distinct().withColumn("layout", F.filter(of, lambda p: p["shorter"] < p["longer"]) if shorter else of)
        return rows.join(kept(layouts), ["length", "skip"]).select(*on, F.col("id").alias(name), "key", F.explode("layout").alias("p")).select(*on, name, part)

    one = parts(left, _segments(least), "l_id").join(unsent(parts(left if right is None else right, _stretches(least), "r_id")), [*on, "__part"])
    if right is not None:
        one = one.unionByName(parts(left, _stretches(least), "l_id", True).join(unsent(parts(right, _segments(least), "r_id", True)), [*on, "__part"]))
    return one.where("l_id <> r_id").select(*on, "l_id", "r_id")


def similar(left: DataFrame, right: DataFrame, on: list[str], least: float = 0.6) -> DataFrame:
    """Pairs (on, l_key, r_key, proximity, similarity) of distinct keys of the same `on` whose proximity isn't none and whose
    similarity is `least` or more, 0.6 at least. Tables have `on` and `key`; nulls never match.

    Equal keys meet in an equi-join, keys of fewer than five characters by deletion neighbourhoods, all others by segments.
    """
    a, b = (df.select(*on, "key").where("key is not null").distinct() for df in (left, right))
    # a distance taken out of an array is worked out once a pair: what is asked of it later isn't asked of the expression
    distance = F.explode(F.array(F.levenshtein("l_key", "r_key"))).alias("distance")
    exact = a.join(unsent(b), [*on, "key"]).select(*on, F.col("key").alias("l_key"), F.col("key").alias("r_key"), F.lit(0).alias("distance"))
    near = lambda df, name: df.where(F.length("key") <= 5).select(*on, F.col("key").alias(name), F.explode(deletions(F.col("key"))).alias("near"))
    short = near(a, "l_key").join(unsent(near(b, "r_key")), [*on, "near"]).where((F.least(F.length("l_key"), F.length("r_key")) < 5) & (F.col("l_key") != F.col("r_key"))).select(*on, "l_key", "r_key", distance)
    edits = _edits(F.greatest(F.length("l_key"), F.length("r_key")), least)
    ids = lambda df: df.select(*on, F.col("key").alias("id"), "key")
    long_ = compared(ids(a), ids(b), on, least).withColumnsRenamed({"l_id": "l_key", "r_id": "r_key"}).select(*on, "l_key", "r_key", distance).where(F.col("distance") <= edits)
    x, y, d = F.col("l_key"), F.col("r_key"), F.col("distance")
    pairs = exact.unionByName(short.where("distance <= 1").distinct()).unionByName(long_.distinct())
    found = pairs.select(*on, "l_key", "r_key", proximity(x, y, d).alias("proximity"), similarity(x, y, d).alias("similarity"))
    return found.where((F.col("proximity") != "none") & (F.col("similarity") >= least))
