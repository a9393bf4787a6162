"""Which screen a capture shows, by its header's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.accuracy import ratio

#: Titles and their event codes, in the order in which they are tried.
TITLES = (
    ("polar invasion", "polar_invasion"),
    ("invasion polaire", "polar_invasion"),
    ("elite wars", "elite_wars"),
    ("wasteland showdown", "wasteland_showdown"),
    ("battle frenzy", "battle_frenzy"),
    ("void war", "void_war"),
    ("ironblood battlefield", "ironblood_battlefield"),
    ("lronblood battlefield", "ironblood_battlefield"),
)
FUZZY_ABOVE, SHORTEST, EXTRA = 0.82, 6, 6
#: Title tables are alias lists; a longer one is refused, since it travels with every task.
MAX_TITLES = 10_000


def titles(spark: SparkSession, event_types: DataFrame | None = None) -> list[tuple[str, str]]:
    """(title, code) pairs of a table (code, title_aliases), in lower case; the fixed list if it has none."""
    if event_types is not None:
        rows = event_types.select(F.posexplode("title_aliases").alias("n", "title"), "code").select(F.lower("title"), "code", "n").orderBy("code", "n").limit(MAX_TITLES + 1).collect()
        if len(rows) > MAX_TITLES:
            raise ValueError(f"more than {MAX_TITLES} titles")
        if rows:
            return [(r[0], r[1]) for r in rows]
    return list(TITLES)


def _runs(words: Column, longest: int) -> Column:
    """All runs of neighbouring words of `longest` characters at most."""
    n = F.size(words)
    run = lambda i, j: F.array_join(F.slice(words, i + 1, j), " ")
    # a run of n words has 2 n - 1 characters at least
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i, F.lit((longest + 1) // 2))), lambda j: run(i, j)))
    return F.array_distinct(F.filter(F.flatten(some), lambda r: F.length(r) <= longest))


def near_titles(headers: DataFrame, known: list[tuple[str, str]], above: float = FUZZY_ABOVE) -> DataFrame:
    """(header, code) of the title that comes closest to some run of a header's words, if it comes close enough; on ties
    the title tried first. A run is compared with titles at most EXTRA characters shorter, of SHORTEST characters or more,
    and only where their lengths allow such a ratio."""
    able = [(k, t, c) for k, (t, c) in enumerate(known) if len(t) >= SHORTEST]
    if not able:
        return headers.select("header", F.lit(None).cast("string").alias("code")).limit(0)
    words = F.filter(F.split("header", r"\s+"), lambda w: w != "")
    runs = headers.select("header").distinct().where(F.size(words) > 0)
    runs = runs.select("header", F.explode(_runs(words, max(len(t) for _, t, _ in able) + EXTRA)).alias("run"))
    titles_ = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(t).alias("title"), F.lit(c).alias("code")) for k, t, c in able))
    a, b = F.length("run"), lambda t: F.length(t["title"])
    fits = F.filter(titles_, lambda t: (a <= b(t) + EXTRA) & (2 * F.least(a, b(t)) > above * (a + b(t))))
    pairs = runs.select("header", "run", F.explode(fits).alias("t")).withColumn("score", ratio(F.col("t.title"), F.col("run")))
    best = pairs.where(F.col("score") > above).groupBy("header").agg(F.max(F.struct("score", (-F.col("t.n")).alias("first"), F.col("t.code").alias("code"))).alias("b"))
    return best.select("header", F.col("b.code").alias("code"))


def route(captures: DataFrame, known: list[tuple[str, str]], header: str = "header") -> DataFrame:
    """Adds kind and code: a title that the header contains, in order; donations and stat posts by their words; a
    title that comes close; else unknown_event. Only headers that nothing else decides are compared with titles."""
    text = F.lower(F.coalesce(F.col(header), F.lit("")))
    titles_ = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(c).alias("code")) for t, c in known))
    code = F.get(F.filter(titles_, lambda t: F.contains(text, t["title"])), F.lit(0))["code"]
    both = lambda a, b: F.contains(text, F.lit(a)) & F.contains(text, F.lit(b))
    kind = F.when(code.isNotNull(), "event").when(both("contribution", "ranking"), "donation").when(both("city", "stat"), "player_stats")
    out = captures.withColumn("__text", text).withColumn("__code", code).withColumn("__kind", kind)
    near = near_titles(out.where("__kind is null").select(F.col("__text").alias("header")), known).select(F.col("header").alias("__text"), F.col("code").alias("__near"))
    out = out.join(near, "__text", "left").withColumn("__near", F.when(F.col("__kind").isNull(), F.col("__near")))
    own = F.when(F.col("__kind") == "donation", "contribution_ranking").when(F.col("__kind") == "player_stats", "player_stats_chat").otherwise(F.coalesce("__code", "__near"))
    named = F.coalesce("__kind", F.when(F.col("__near").isNotNull(), "event"), F.lit("unknown_event"))
    return out.withColumn("kind", named).withColumn("code", own).select(*captures.columns, "kind", "code")
