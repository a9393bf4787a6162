"""Validation and repair of rows as read from captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.names import looks_misread, normalize_name


def swap_repair(rows: DataFrame) -> DataFrame:
    """Power and points read from each other's column: 0 < power < 10 000 and points of a million or more."""
    swapped = F.coalesce((F.col("power") > 0) & (F.col("power") < 10_000) & (F.col("points") >= 1_000_000), F.lit(False))
    return rows.withColumns({"power": F.when(swapped, F.col("points")).otherwise(F.col("power")), "points": F.when(swapped, F.col("power")).otherwise(F.col("points"))})


def valid_event_row() -> Column:
    """For rows after `swap_repair`."""
    return F.coalesce((F.trim("player_name") != "") & (F.col("power") >= 1_000_000) & (F.col("points").isNull() | (F.col("points") >= 0)) & F.col("rank").rlike("^R[1-5]$"), F.lit(False))


def valid_donation_row() -> Column:
    return F.coalesce((F.trim("player_name") != "") & (F.col("honor") >= 0), F.lit(False))


def truncation(captures: DataFrame) -> DataFrame:
    """Adds possible_truncation, and rejected where less than half of the expected rows were read."""
    short = F.coalesce(F.col("n_rows") < F.col("expected_rows"), F.lit(False))
    return captures.withColumn("possible_truncation", short).withColumn("rejected", short & (F.col("expected_rows") > 0) & (F.col("n_rows") / F.greatest("expected_rows", F.lit(1)) < 0.5))


def strictly_increasing(rows: DataFrame, key: str, order: str, value: str) -> Column:
    """The value where it exceeds every earlier one, else null (a rejected value never exceeds the last kept)."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(before.isNull() | (F.col(value) > before), F.col(value))


#: The smallest plausible share of the honor above, and the confidences of repaired and unrepaired rows.
DROP_RATIO_OF, FIXED_CONFIDENCE, UNFIXED_CONFIDENCE = 5, 0.40, 0.0


def repair_honor(rows: DataFrame) -> DataFrame:
    """Rows of a capture (key `capture_id`, place `row_index`) with honor, candidates (array) and confidence.

    Down a ranking honor must not rise, and must not fall below a fifth of the row above, if that one was not suspect
    itself. A suspect row has a window: from the next row's honor as read (0 for the last; after a fall at least a fifth
    of the row above, plus one) to the honor above. The first candidate in the window replaces the value, at a
    confidence of 0.40 at most; without one the value stays at a confidence of 0; a row without a list of candidates
    (null) could not be read again and stays as it is. The row above counts with its repaired value.

    Returns capture_id, row_index, honor, confidence, suspect and the window (lower, upper). One fold over a capture's
    rows, of which there are a dozen: a capture is one screen.
    """
    kept = F.expr("CAST(array() AS array<struct<row_index:bigint,honor:bigint,confidence:double,suspect:boolean,lower:bigint,upper:bigint>>)")
    typed = F.struct(F.col("row_index").cast("bigint").alias("row_index"), F.col("honor").cast("bigint").alias("honor"), "candidates", F.col("confidence").cast("double").alias("confidence"))
    screens = rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(typed)).alias("rows"))
    screens = screens.withColumn("rows", F.transform("rows", lambda r, i: r.withField("next", F.coalesce(F.get("rows", i + 1)["honor"], F.lit(0).cast("bigint")))))

    def step(state: Column, r: Column) -> Column:
        above, honor = state["honor"], r["honor"]
        fell = F.coalesce(~state["suspect"] & (honor > 0) & (honor * DROP_RATIO_OF < above), F.lit(False))
        suspect = F.coalesce(honor > above, F.lit(False)) | fell
        lower = F.when(suspect, F.when(fell, F.greatest(r["next"], F.floor(above / DROP_RATIO_OF) + 1)).otherwise(r["next"]))
        found = F.get(F.filter(r["candidates"], lambda c: (c >= lower) & (c <= above)), F.lit(0))
        value = F.when(suspect, F.coalesce(found, honor)).otherwise(honor)
        confidence = F.when(~suspect | r["candidates"].isNull(), r["confidence"]).when(found.isNotNull(), F.least(r["confidence"], F.lit(FIXED_CONFIDENCE))).otherwise(F.lit(UNFIXED_CONFIDENCE))
        row = F.struct(r["row_index"].alias("row_index"), value.alias("honor"), confidence.alias("confidence"), suspect.alias("suspect"), lower.cast("bigint").alias("lower"), F.when(suspect, above).alias("upper"))
        return F.struct(value.alias("honor"), suspect.alias("suspect"), F.concat(state["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(None).cast("bigint").alias("honor"), F.lit(False).alias("suspect"), kept.alias("out"))
    out = screens.select("capture_id", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("r"))
    return out.select("capture_id", "r.*")


def repair_positions(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Positions as a constant offset from the physical row (key `capture_id`, `row_index`, `position`).

    A reading supports an offset if it is the position that the offset gives, or the last digits of it (the first ones
    were not read). The offset with the most support, the smallest on ties, rewrites all rows that have a place, read or
    not, if at least `share` of the readings support it; otherwise readings stay that exceed every earlier one.
    Offsets are tried within a capture, which is one screen of a dozen rows.
    """
    read = rows.where("position is not null and row_index is not null").select("capture_id", "row_index", "position")
    offsets = read.select("capture_id", (F.col("position") - F.col("row_index")).alias("offset")).distinct()
    expected = F.col("offset") + F.col("row_index")
    supports = (expected == F.col("position")) | ((expected >= 0) & F.endswith(expected.cast("string"), F.col("position").cast("string")))
    votes = offsets.join(read, "capture_id").groupBy("capture_id", "offset").agg(F.count_if(supports).alias("support"), F.count("*").alias("readings"))
    best = votes.groupBy("capture_id").agg(F.max(F.struct("support", (-F.col("offset")).alias("minus"), "readings")).alias("b"))
    joined = rows.join(best, "capture_id", "left")
    joined = joined.withColumn("kept", strictly_increasing(joined, "capture_id", "row_index", "position"))
    sure = F.col("b.support") >= share * F.col("b.readings")
    fixed = F.when(F.col("row_index").isNull(), F.col("position")).when(sure, F.col("row_index") - F.col("b.minus")).otherwise(F.col("kept"))
    return joined.select("capture_id", "row_index", fixed.cast("bigint").alias("position"))


#: The confidences below which a row is asked about again, and what accepted and replaced readings get.
ASK_BELOW, ASK_STATS_BELOW, ACCEPTED, REPLACED = 0.35, 0.75, -1.0, 0.45


def asked_again(rows: DataFrame, name: str = "player_name", forced: bool = False) -> DataFrame:
    """Adds `ask`: whether a row goes to the second reader, and `reason`: forced, suspect_honor, misread_name,
    low_confidence (the first that holds) or null. `suspect` is false where rows have no such column."""
    suspect = F.coalesce("suspect", F.lit(False)) if "suspect" in rows.columns else F.lit(False)
    reason = F.when(F.lit(forced), "forced").when(suspect, "suspect_honor").when(looks_misread(F.col(name)), "misread_name").when(F.col("confidence") < ASK_BELOW, "low_confidence")
    return rows.withColumn("reason", reason).withColumn("ask", F.col("reason").isNotNull())


def answered_until(rows: DataFrame, order: str, failed: str, most: int = 2) -> DataFrame:
    """Adds `answered`: whether a row that was asked about (`ask`) got an answer before the reader was given up, which
    happens within a capture (key `capture_id`) after `most` failures in a row among the rows asked about."""
    asked = Window.partitionBy("capture_id", "ask").orderBy(order)
    good = F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(asked)
    runs_ = rows.withColumn("__run", good)
    streak = F.sum(F.when(F.col(failed), 1).otherwise(0)).over(Window.partitionBy("capture_id", "ask", "__run").orderBy(order))
    ended = runs_.withColumn("__streak", streak)
    over = F.max(F.when(F.col("__streak") >= most, 1).otherwise(0)).over(asked.rowsBetween(Window.unboundedPreceding, -1))
    return ended.withColumn("answered", F.col("ask") & ~F.col(failed) & (F.coalesce(over, F.lit(0)) == 0)).drop("__run", "__streak")


def cross_check(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Donation rows against a second reader's answers by name: inside the window the answer replaces honor (0.45),
    outside confidence is 0; without a window an equal score accepts the name (-1), another sets 0; rows without an
    answer stay."""
    last = answers.groupBy("capture_id", "player_name").agg(F.max_by("score", "ordinal").alias("score"), F.lit(True).alias("answered"))
    j = rows.join(last, ["capture_id", "player_name"], "left")
    window = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    inside = F.coalesce((F.col("score") >= F.col("lower")) & (F.col("score") <= F.col("upper")), F.lit(False))
    equal = F.coalesce(F.col("score") == F.col("honor"), F.lit(False))
    confidence = F.when(F.col("answered").isNull(), F.col("confidence")).when(window, F.when(inside, F.lit(REPLACED)).otherwise(F.lit(0.0))).otherwise(F.when(equal, F.lit(ACCEPTED)).otherwise(F.lit(0.0)))
    return j.withColumn("confidence", confidence).withColumn("honor", F.when(F.col("answered") & window & inside, F.col("score")).otherwise(F.col("honor"))).drop("score", "answered")


def merge_donation_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Donation rows (capture_id, row_index, player_name, honor, confidence, lower, upper) against answers for the same
    place (name, score). With a window: a score within it replaces honor and the name, if there is one, at 0.45; any other
    sets confidence 0. Without one: no name leaves the row; a score equal to honor takes the name at -1; another sets 0."""
    j = rows.join(answers.select("capture_id", "row_index", F.col("name").alias("__name"), F.col("score").alias("__score"), F.lit(True).alias("__has")), ["capture_id", "row_index"], "left")
    has, window = F.col("__has").isNotNull(), F.col("upper").isNotNull()
    named = F.coalesce(F.col("__name") != "", F.lit(False))
    inside = F.coalesce(F.col("__score").between(F.col("lower"), F.col("upper")), F.lit(False))
    takes = has & F.when(window, inside).otherwise(named & F.coalesce(F.col("__score") == F.col("honor"), F.lit(False)))
    refused = has & ~takes & (window | named)
    name = F.when(takes & named, normalize_name(F.col("__name"))).otherwise(F.col("player_name"))
    confidence = F.when(takes, F.when(window, F.lit(REPLACED)).otherwise(F.lit(ACCEPTED))).when(refused, F.lit(0.0)).otherwise(F.col("confidence"))
    honor = F.when(takes & window, F.col("__score")).otherwise(F.col("honor"))
    return j.withColumns({"player_name": name, "confidence": confidence, "honor": honor}).drop("__name", "__score", "__has")


def merge_event_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Event rows against answers for the same place (capture_id, row_index, name): an answer sets confidence -1, also
    where it changes nothing; a name in it replaces the row's."""
    j = rows.join(answers.select("capture_id", "row_index", F.col("name").alias("__name"), F.lit(True).alias("__has")), ["capture_id", "row_index"], "left")
    name = F.when(F.coalesce(F.col("__name") != "", F.lit(False)), normalize_name(F.col("__name"))).otherwise(F.col("player_name"))
    return j.withColumns({"player_name": name, "confidence": F.when(F.col("__has"), F.lit(ACCEPTED)).otherwise(F.col("confidence"))}).drop("__name", "__has")


STATS = ("attack_pct", "hp_pct", "defense_pct")


def merge_stat_answers(rows: DataFrame, answers: DataFrame, forced: bool = False) -> DataFrame:
    """Stat rows (capture_id, player_name, the three stats, confidence) of less than 0.75 (all, if forced) against answers
    by normalised name, the last of a name: stats that the answer has replace the row's, confidence is -1."""
    named = answers.where("name is not null and name <> ''").withColumn("player_name", normalize_name(F.col("name")))
    last = named.groupBy("capture_id", "player_name").agg(F.max_by(F.struct(*STATS), "ordinal").alias("__a"))
    j = rows.join(last, ["capture_id", "player_name"], "left")
    takes = F.col("__a").isNotNull() & (F.lit(forced) | (F.col("confidence") < ASK_STATS_BELOW))
    values = {c: F.when(takes, F.coalesce(F.col(f"__a.{c}"), F.col(c))).otherwise(F.col(c)) for c in STATS}
    return j.withColumns(values | {"confidence": F.when(takes, F.lit(ACCEPTED)).otherwise(F.col("confidence"))}).drop("__a")


#: Events whose header shows a rank beside participants and points, and those whose header shows none.
RANKED_HEADERS = ("polar_invasion", "elite_wars", "ironblood_battlefield")
PLAIN_HEADERS = ("wasteland_showdown", "battle_frenzy", "void_war")


def header_fields(captures: DataFrame) -> DataFrame:
    """alliance_rank, total_battlers and total_points by the layout of the event's header, from numbers as read in three
    columns (`battlers3`, `rank3`, `points3`) and in two (`battlers2`, `points2`). An unknown code takes the three columns
    if the rank lies in 1 to 9999 and no more than 999 took part, as far as that was read."""
    plausible = F.coalesce(F.col("rank3").between(1, 9999), F.lit(False)) & F.coalesce(F.col("battlers3") <= 999, F.lit(True))
    three = F.when(F.col("event_type").isin(*RANKED_HEADERS), F.lit(True)).when(F.col("event_type").isin(*PLAIN_HEADERS), F.lit(False)).otherwise(plausible)
    pick = lambda a, b: F.when(three, F.col(a)).otherwise(b)
    return captures.withColumns({"alliance_rank": pick("rank3", F.lit(None)), "total_battlers": pick("battlers3", F.col("battlers2")), "total_points": pick("points3", F.col("points2"))})


def joined_words(words: Column, least: int = 20, sep: str = "") -> Column:
    """Words (array of struct<text, conf, x>) with a confidence of `least` or more, from left to right, as one string."""
    kept = F.filter(words, lambda w: (F.trim(w["text"]) != "") & (w["conf"] >= least))
    return F.array_join(F.transform(F.array_sort(F.transform(kept, lambda w, i: F.struct(w["x"].alias("x"), i.alias("i"), F.trim(w["text"]).alias("t")))), lambda w: w["t"]), sep)


def word_confidence(words: Column, least: int = 10) -> Column:
    """Mean confidence, 0 to 1, of the words that `joined_words` takes; 0 without any."""
    kept = F.filter(words, lambda w: (F.trim(w["text"]) != "") & (w["conf"] >= least))
    total = F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, w: a + w["conf"])
    return F.coalesce(F.when(F.size(kept) > 0, total / (F.size(kept) * 100)), F.lit(0.0))


def ordered_vote(readings: Column) -> Column:
    """A rank from readings in the order in which they were made: the first of R1 to R5 that is read twice; else the first
    read once; else the lone digit read most often, the earliest on ties; else R1."""
    strong = F.filter(F.transform(readings, lambda t: F.nullif(F.regexp_extract(t, "R([1-5])", 1), F.lit(""))), lambda d: d.isNotNull())
    weak = F.filter(F.transform(readings, lambda t: F.when(~t.rlike("R[1-5]"), F.nullif(F.regexp_extract(t, "([1-5])", 1), F.lit("")))), lambda d: d.isNotNull())
    seen = lambda all_, d, i: F.size(F.filter(F.slice(all_, 1, i), lambda x: x == d))
    twice = F.get(F.filter(F.transform(strong, lambda d, i: F.when(seen(strong, d, i) == 1, d)), lambda d: d.isNotNull()), F.lit(0))
    votes = F.transform(weak, lambda d, i: F.struct(F.size(F.filter(weak, lambda x: x == d)).alias("n"), (-i).alias("early"), d.alias("d")))
    return F.concat(F.lit("R"), F.coalesce(twice, F.get(strong, F.lit(0)), F.array_max(votes)["d"], F.lit("1")))


def expected_rows(height: Column, top: Column, row_height: Column, offset: int = 0, most: int = 12) -> Column:
    """Rows that a screen of a height has room for below its list's top: at most `most`, at least 0."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor((height - top - offset) / row_height) + 1)).cast("int")


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: tuple[float, float, float]) -> DataFrame:
    """Rows of each of four half-open bands, and least and most value, per group."""
    a, b, c = bounds
    v = F.col(value)
    bands = {"low": v < a, "mid": (v >= a) & (v < b), "high": (v >= b) & (v < c), "top": v >= c}
    return rows.groupBy(*keys).agg(*(F.count_if(x).alias(k) for k, x in bands.items()), F.min(v).alias("least"), F.max(v).alias("most"))


def vote(rows: DataFrame, keys: list[str], value: str, share: float = 0.7) -> DataFrame:
    """The most frequent value of each cell if at least `share` of its readings agree, else null."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.max(F.struct("n", value)).alias("b"))
    return best.select(*keys, F.when(F.col("b.n") >= share * F.col("total"), F.col(f"b.{value}")).alias(value), "total")


def tab_outlier(values: Column, least: float = 15.0) -> Column:
    """Which of three brightness values lies farthest from their median, if at least `least` away: 0, 1, 2, else null."""
    median = F.get(F.array_sort(values), F.lit(1))
    away = F.transform(values, lambda x: F.abs(x - median))
    return F.when(F.array_max(away) >= least, F.array_position(away, F.array_max(away)) - 1)


def runs(rows: DataFrame, key: str, place: str, on: str, shortest: int, longest: int) -> DataFrame:
    """Runs of set cells of a mask: first and last place, whether a run touches the mask's ends."""
    w = Window.partitionBy(key)
    marked = rows.withColumn("low", F.min(place).over(w)).withColumn("high", F.max(place).over(w)).where(F.col(on))
    island = marked.withColumn("island", F.col(place) - F.row_number().over(w.orderBy(place)))
    g = island.groupBy(key, "island").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("length"), F.min("low").alias("low"), F.max("high").alias("high"))
    return g.where(F.col("length").between(shortest, longest)).select(key, "first", "last", "length", ((F.col("first") == F.col("low")) | (F.col("last") == F.col("high"))).alias("clipped"))
