"""The write path: a batch of captures into events, donations, stats, players, memberships, aliases and audit rows.

A batch is a table of captures with an ordinal, their order of arrival. Every step is a join or an aggregate over the
whole batch: captures get an outcome, their members are resolved to players, and each table gets its keyed write. A batch
comes to what its captures come to one after the other: names are resolved in order of arrival, also against players and
aliases that earlier captures of the batch made, and where several captures write one row, the last one to arrive stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.times import paris_week_start
from muster.operators.duplicates import nearest_in_roster, roster_collisions
from muster.operators.kept import kept, unsent
from muster.operators.resolution import Resolved, resolve_in_order
from muster.operators.upsert import best_by, first_wins, highest_confidence, latest_wins, membership_sync, reversal_audit
from muster.sources.domain import needs_review

#: The share of expected rows under which a capture is refused, the shortest key that is matched fuzzily,
#: and the confidence under which a stat post counts as low.
LEAST_SHARE, SHORTEST_KEY, LOW_STATS = 0.5, 5, 2 / 3
AUTO = "auto:name-resolve"


def outcomes(captures: DataFrame, uploads: DataFrame, event_types: DataFrame) -> DataFrame:
    """Adds `status` and `outcome` to captures (ordinal, alliance_id, file_hash, kind, error, event_type, event_datetime,
    period_type, possible_truncation, expected_rows, members).

    A file that was processed before for the alliance, or earlier in the batch, is a duplicate; any other earlier state
    of it does not block. Then, by kind: an event needs a time (asked for first of all) and a known type; a donation
    must be weekly and have members; a stat post must have members. Captures flagged as truncated that hold less than half
    of the rows expected are refused. `outcome` is success, duplicate, unknown_event or failed.
    """
    n, expected = F.size(F.coalesce("members", F.array().cast(captures.schema["members"].dataType))), F.col("expected_rows")
    kind = F.coalesce("kind", F.lit("event"))
    short = F.coalesce(F.col("possible_truncation"), F.lit(False)) & (F.coalesce(expected, F.lit(0)) > 0) & (n / F.greatest(expected, F.lit(1)) < LEAST_SHARE)
    known = event_types.select(F.col("code").alias("event_type"), F.lit(True).alias("__known")).distinct()
    c = captures.join(known, "event_type", "left").withColumn("kind", kind)
    # what a capture comes to if its file is new; what is asked before the file comes first
    early = F.when(F.col("error") == "unknown_event", "unknown_event").when(F.col("error").isNotNull(), "failed").when((F.col("kind") == "event") & F.col("event_datetime").isNull(), "missing_datetime")
    late = (
        F.when((F.col("kind") == "donation") & ~F.col("period_type").eqNullSafe("weekly"), "unsupported_period_type")
        .when(F.col("kind").isin("donation", "player_stats") & (n == 0), "no_members")
        .when(F.col("kind").isin("event", "donation") & short, "possible_truncation_rejected")
        .when((F.col("kind") == "event") & F.col("__known").isNull(), "unknown_event")
        .otherwise("processed")
    )
    c = c.withColumn("__early", early).withColumn("__late", late)
    key = ["alliance_id", "file_hash"]
    done = uploads.where("status = 'processed'").select(*key, F.lit(-1).cast("bigint").alias("ordinal"))
    done = done.unionByName(c.where("__early is null and __late = 'processed'").select(*key, F.col("ordinal").cast("bigint").alias("ordinal")))
    first = done.groupBy(*key).agg(F.min("ordinal").alias("__done"))
    status = F.coalesce("__early", F.when(F.col("__done") < F.col("ordinal"), "duplicate"), "__late")
    outcome = F.when(F.col("status") == "processed", "success").when(F.col("status").isin("duplicate", "unknown_event"), F.col("status")).otherwise("failed")
    return c.join(first, key, "left").withColumn("status", status).withColumn("outcome", outcome).drop("__early", "__late", "__done", "__known")


def next_uploads(uploads: DataFrame, decided: DataFrame) -> DataFrame:
    """Upload records (alliance_id, file_hash, status) after a batch. Captures that were read wrong, of an unknown type or
    processed leave their state, unless the file has been processed; refused ones leave none."""
    kept = decided.where("status in ('processed', 'unknown_event', 'failed')").select("alliance_id", "file_hash", "status", "ordinal")
    rank = lambda c: F.when(c == "processed", 1).otherwise(0)
    both = uploads.select("alliance_id", "file_hash", "status", F.lit(-1).cast("bigint").alias("ordinal")).unionByName(kept.withColumn("ordinal", F.col("ordinal").cast("bigint")))
    return best_by(both, ["alliance_id", "file_hash"], F.struct(rank(F.col("status")), "ordinal")).drop("ordinal")


def tallies(decided: DataFrame) -> DataFrame:
    """Captures of each outcome, all four in one row."""
    return decided.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "duplicate", "unknown_event", "failed")))


def in_order(decided: DataFrame) -> DataFrame:
    """Outcomes in the order in which captures arrived, whatever tasks they were worked on in."""
    return decided.select("ordinal", "kind", "status", "outcome").orderBy("ordinal")


def unique_members(decided: DataFrame, kind: str) -> DataFrame:
    """Members of processed captures of a kind, one a capture and name: the one read with the highest confidence. `raw` is
    the whole reading as JSON."""
    own = decided.where((F.col("kind") == kind) & (F.col("status") == "processed"))
    columns = ["alliance_id", "message_at", "event_type", "event_datetime"]
    rows = own.select(F.col("ordinal").alias("capture"), *columns, F.posexplode("members").alias("ordinal", "m"))
    rows = rows.select("capture", *columns, "ordinal", "m.*", F.to_json("m", {"ignoreNullFields": "false"}).alias("raw"))
    return highest_confidence(rows.where("trim(name) <> ''"), ["capture", "name"])


def warnings_of(found: Resolved, roster: DataFrame) -> DataFrame:
    """(raw_name, player_id, other_id, warning) of the names of a batch, each as of its first capture and against the players
    that were there by then: `collision` where a credited name resembles another player too, `near_duplicate` where a new
    name resembles one, `ambiguous` where several are one edit away."""
    timed = roster.select("alliance_id", "player_id", "player_name", F.lit(None).cast("bigint").alias("since"))
    timed = timed.unionByName(found.created.select("alliance_id", "player_id", F.col("raw_name").alias("player_name"), F.col("capture").cast("bigint").alias("since")))
    timed = timed.withColumn("since", F.coalesce("since", F.lit(-(1 << 62))))
    first = found.rows.groupBy("alliance_id", "raw_name").agg(F.min_by(F.struct("resolution", "player_id"), "capture").alias("r"), F.min("capture").cast("bigint").alias("since")).select("alliance_id", "raw_name", "since", "r.*")
    credited = first.where("resolution in ('exact', 'fuzzy')").select("alliance_id", "raw_name", "player_id", "since")
    columns, none = ["alliance_id", "raw_name", "player_id", "other_id"], F.lit(None).cast(roster.schema["player_id"].dataType)
    out = roster_collisions(credited, timed).select(*columns, F.lit("collision").alias("warning"))
    near = nearest_in_roster(first.where("resolution = 'new'").select("alliance_id", "raw_name", "since"), timed)
    out = out.unionByName(near.select("alliance_id", "raw_name", none.alias("player_id"), F.col("player_id").alias("other_id"), F.lit("near_duplicate").alias("warning")))
    return out.unionByName(first.where("resolution = 'ambiguous'").select("alliance_id", "raw_name", none.alias("player_id"), none.alias("other_id"), F.lit("ambiguous").alias("warning")))


def _one_a_player(rows: DataFrame) -> DataFrame:
    """Of a capture's members that are one player the one read under the player's own name, else the first."""
    return best_by(rows, ["capture", "player_id"], F.struct(F.col("resolution").isin("exact", "new", "ambiguous"), -F.col("ordinal")))


def _players(roster: DataFrame, created: DataFrame, parts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """The roster with the players that the batch makes, and columns of all players seen as of the last capture that shows
    them: `parts` are rows and the columns that they set. Within a capture the highest confidence counts."""
    null = {c: F.lit(None).cast(roster.schema[c].dataType) for c in roster.columns}
    made = created.select(*((F.col("raw_name") if c == "player_name" else F.col(c) if c in ("alliance_id", "player_id") else null[c]).alias(c) for c in roster.columns))
    out = roster.unionByName(made)
    for rows, columns in parts:
        best = best_by(rows.select("alliance_id", "player_id", "capture", "confidence", "ordinal", *columns), ["capture", "player_id"], F.struct("confidence", -F.col("ordinal")))
        batch = best.select("alliance_id", "player_id", *columns, F.col("capture").alias("ordinal"))
        # an alias may name a player that is gone: nothing brings one back
        batch = batch.join(out.select("alliance_id", "player_id"), ["alliance_id", "player_id"], "left_semi")
        out = latest_wins(out, batch, ["alliance_id", "player_id"], columns)
    return out


def _joined(memberships: DataFrame, rows: DataFrame) -> DataFrame:
    new = membership_sync(memberships, rows.select("alliance_id", "player_id", "at", F.col("capture").alias("ordinal")))
    left = F.lit(None).cast(memberships.schema["left_at"].dataType).alias("left_at")
    return memberships.unionByName(new.select("alliance_id", "player_id", "joined_at", left))


def _held_ids(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with the row_id that their key has in the table, or a hash of the key."""
    held = table.select(*key, F.col("row_id").alias("__row"))
    return rows.join(unsent(held), key, "left").withColumn("row_id", F.coalesce("__row", F.xxhash64(*key))).drop("__row")


def _messages(captures: DataFrame) -> list[Column]:
    return [F.col("message_id").alias("source_message_id")] if "message_id" in captures.columns else []


def _write_events(state: dict[str, DataFrame], decided: DataFrame, rows: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    own = decided.where("kind = 'event' and status = 'processed'")
    message = _messages(own)
    event_id = F.concat_ws("-", F.col("alliance_id").cast("string"), "event_type", F.date_format("event_datetime", "yyyy-MM-dd HH:mm"))
    key = ["alliance_id", "event_type", "event_datetime"]
    batch = own.select(*key, "alliance_rank", "total_battlers", "total_points", *message, event_id.alias("event_id"), "ordinal")
    present = state["events"].select(*key, F.col("event_id").alias("__held"))
    events = latest_wins(state["events"], batch.join(present, key, "left").withColumn("event_id", F.coalesce("__held", "event_id")).drop("__held"), key)
    one = _one_a_player(rows).where("points is not null").join(events.select(*key, "event_id"), key)
    batch = one.select(
        "event_id", "player_id", F.col("rank").alias("player_rank"), "points", "power", "confidence", needs_review(F.col("confidence")).alias("needs_review"), F.parse_json("raw").alias("raw_ocr"), F.col("capture").alias("ordinal")
    )
    part = state["participations"]
    audit = reversal_audit(part, batch, state["corrections"], ["event_id", "player_id"], {"points": False, "power": True})
    made = _held_ids(batch, part, ["event_id", "player_id"])
    return {"events": events, "participations": latest_wins(part, made, ["event_id", "player_id"])}, {"audit": audit}


def _write_donations(state: dict[str, DataFrame], decided: DataFrame, rows: DataFrame, now: Column) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    rows = rows.withColumn("period_start", paris_week_start(F.col("message_at")))
    own = decided.where("kind = 'donation' and status = 'processed'")
    periods = own.select("alliance_id", paris_week_start(F.col("message_at")).alias("period_start"), "ordinal")
    key = ["alliance_id", "period_start", "player_id"]
    message = _messages(own)
    sources = own.select(F.col("ordinal").alias("capture"), *message)
    batch = _one_a_player(rows).join(sources, "capture").select(
        *key, F.col("rank").alias("player_rank"), F.col("alliance_honor").alias("honor"), "alliance_tag", "leaderboard_position", "confidence",
        needs_review(F.col("confidence")).alias("needs_review"), F.parse_json("raw").alias("raw_ocr"), now.alias("updated_at"), *(["source_message_id"] if message else []), F.col("capture").alias("ordinal"),
    )
    don = state["donations"]
    audit = reversal_audit(don, batch, state["corrections"], key, {"honor": False})
    made = _held_ids(batch, don, key)
    read = F.filter(F.transform("members", lambda m: m["leaderboard_position"]), lambda p: p.isNotNull())
    falls = F.exists(F.transform(read, lambda p, i: F.coalesce(p <= F.get(read, i - 1), F.lit(False))), lambda x: x)
    written = {"periods": first_wins(state["periods"], periods, ["alliance_id", "period_start"]), "donations": latest_wins(don, made, key)}
    return written, {"audit": audit, "positions": own.where(falls).select("ordinal")}


def _write_stats(state: dict[str, DataFrame], members: DataFrame, rows: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    known = _one_a_player(rows.where("resolution in ('alias', 'exact', 'fuzzy')"))
    stats = ["attack_pct", "hp_pct", "defense_pct"]
    values = [F.col(c).cast("decimal(8,2)").alias(c) for c in stats]
    batch = known.select("alliance_id", "player_id", F.to_date("message_at").alias("recorded_date"), *values, "attack_kind", "confidence", F.col("raw_lines").alias("raw_text"), F.col("capture").alias("ordinal"))
    rejected = rows.where("resolution in ('new', 'ambiguous')").select("capture", "name", F.col("raw_lines").alias("raw_text"))
    low = members.groupBy("capture").agg(F.count_if(F.col("confidence") < LOW_STATS).alias("low"))
    return {"stats": latest_wins(state["stats"], batch, ["alliance_id", "player_id", "recorded_date"])}, {"rejected": rejected, "low": low}


KINDS = ("event", "donation", "player_stats")


def upsert_batch(state: dict[str, DataFrame], decided: DataFrame, kinds: tuple[str, ...] = KINDS, now: Column | None = None, warn: bool = True) -> tuple[dict[str, DataFrame], dict[str, dict[str, DataFrame]]]:
    """The tables after a batch's captures of all `kinds`, in any mixture, and side outputs by kind.

    `state`: roster (with last_power, last_rank and last_seen_at), aliases, memberships and corrections, and by kind
    events (event_id, alliance_id, event_type, event_datetime, header), participations (row_id, event_id, player_id, points,
    power, confidence, needs_review); periods (alliance_id, period_start), donations (row_id, alliance_id, period_start,
    player_id, honor, alliance_tag, leaderboard_position, confidence, needs_review); stats (alliance_id, player_id,
    recorded_date, the three stats, attack_kind, confidence, raw_text). Where they have them, events also get
    source_message_id, participations player_rank and raw_ocr (the whole reading, a variant), donations all
    of these and updated_at, which is `now`; messages come from the captures' message_id.
    Without `warn` no warnings are worked out.
    """
    decided = kept(decided)
    members = {k: kept(unique_members(decided, k)) for k in kinds}
    seen = None
    for k, m in members.items():
        part = m.select("alliance_id", F.col("name").alias("raw_name"), "capture", F.lit(k != "player_stats").alias("creates"))
        seen = part if seen is None else seen.unionByName(part)
    found = resolve_in_order(seen, state["roster"], state["aliases"], SHORTEST_KEY)
    rows = {k: m.join(unsent(found.rows.withColumnRenamed("raw_name", "name")), ["alliance_id", "name", "capture"]) for k, m in members.items()}
    new_aliases = found.aliases.select("alliance_id", "raw_name", "player_id", F.lit(AUTO).alias("created_by"), F.col("capture").alias("ordinal"))
    out, side = dict(state), {}
    out["aliases"] = first_wins(state["aliases"], new_aliases, ["alliance_id", "raw_name"])
    ranks, shown, powers = [], [], []
    if "event" in kinds:
        e = rows["event"]
        written, side["event"] = _write_events(state, decided, e)
        out |= written
        ranks.append(e)
        powers.append((e.select("*", F.col("power").alias("last_power"), F.col("event_datetime").alias("last_seen_at")), ["last_power", "last_seen_at"]))
        shown.append(_one_a_player(e).withColumn("at", F.col("event_datetime")))
    if "donation" in kinds:
        written, side["donation"] = _write_donations(state, decided, rows["donation"], F.current_timestamp() if now is None else now)
        out |= written
        ranks.append(rows["donation"])
        shown.append(_one_a_player(rows["donation"]).withColumn("at", F.col("message_at")))
    if "player_stats" in kinds:
        written, side["player_stats"] = _write_stats(state, members["player_stats"], rows["player_stats"])
        out |= written
    if ranks:
        both = ranks[0] if len(ranks) == 1 else ranks[0].unionByName(ranks[1])
        out["roster"] = _players(state["roster"], found.created, [*powers, (both.withColumn("last_rank", F.col("rank")), ["last_rank"])])
        out["memberships"] = _joined(state["memberships"], shown[0] if len(shown) == 1 else shown[0].unionByName(shown[1]))
        for k in side if warn else ():
            side[k]["warnings"] = warnings_of(found, state["roster"])
    return out, side


def upsert_events(state: dict[str, DataFrame], decided: DataFrame, warn: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after a batch's event captures, and side outputs: audit, warnings. Every player seen is refreshed, also
    those who did not take part (null points) and also by an older capture; only those who did have participations."""
    out, side = upsert_batch(state, decided, ("event",), warn=warn)
    return out, side["event"]


def upsert_donations(state: dict[str, DataFrame], decided: DataFrame, now: Column | None = None, warn: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after a batch's weekly donation captures, and side outputs: audit, warnings, positions (captures whose
    positions on the screen do not rise throughout). The period is the week, in Paris, of the message. Donations refresh a
    player's rank alone."""
    out, side = upsert_batch(state, decided, ("donation",), now, warn)
    return out, side["donation"]


def upsert_stats(state: dict[str, DataFrame], decided: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables after a batch's stat posts, and side outputs: rejected (members that are nobody's, with their text) and
    low (how many members of each capture were read with a confidence under two thirds). Only known players have stats: none
    are created, and nobody joins. A row is recorded on the UTC day of the message."""
    out, side = upsert_batch(state, decided, ("player_stats",))
    return out, side["player_stats"]
