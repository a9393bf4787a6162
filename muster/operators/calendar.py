"""Recurring calendar events and their iCalendar text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An event is expanded at most so many steps from its first date; later repetitions do not appear.
MAX_STEPS = 500
#: Days or months of a step.
BY_DAYS, BY_MONTHS = {"daily": 1, "weekly": 7, "4weekly": 28}, {"monthly": 1, "yearly": 12}


def _size(steps: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv)), F.col("recurrence"))


def expand(events: DataFrame, start: str, end: str) -> DataFrame:
    """One row an occurrence within [start, end]: event_id, title, occurs_on.

    daily, weekly, 4weekly, monthly and yearly repeat until `recurrence_end` (inclusive, null: for ever), months and
    years on the first date's day or the month's last; none, null and unknown codes occur once, those without a
    recurrence whatever `recurrence_end` says. Only steps that fall into the range are made.
    """
    first, low, high = F.col("date"), F.lit(start).cast("date"), F.lit(end).cast("date")
    once = F.coalesce(F.col("recurrence") == "none", F.lit(True))
    last = F.when(once, high).otherwise(F.least(high, F.col("recurrence_end")))
    days, months = _size(BY_DAYS), _size(BY_MONTHS)
    apart = lambda to: F.months_between(F.trunc(to, "month"), F.trunc(first, "month")).cast("int")
    # the first and last step that may lie in the range; months that end early are decided by the dates themselves
    from_ = F.when(days.isNotNull(), F.ceil(F.date_diff(low, first) / days)).when(months.isNotNull(), F.floor(apart(low) / months)).otherwise(F.lit(0))
    upto = F.when(days.isNotNull(), F.floor(F.date_diff(last, first) / days)).when(months.isNotNull(), F.floor(apart(last) / months)).otherwise(F.lit(0))
    a, b = F.greatest(from_.cast("int"), F.lit(0)), F.least(upto.cast("int"), F.lit(MAX_STEPS - 1))
    k = F.explode(F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))).alias("k")
    out = events.select("*", k)
    on = F.when(days.isNotNull(), F.date_add(first, F.col("k") * days)).when(months.isNotNull(), F.add_months(first, F.col("k") * months)).otherwise(first)
    out = out.withColumn("occurs_on", on)
    return out.where((F.col("occurs_on") >= low) & (F.col("occurs_on") <= last)).select("event_id", "title", "time", "type", "occurs_on")


def month_grid(events: DataFrame, year: int, month: int) -> DataFrame:
    """A month's occurrences with their cell, from 0, of a grid whose weeks begin on Monday."""
    begin = f"{year:04d}-{month:02d}-01"
    end = str((pd.Timestamp(begin) + pd.offsets.MonthEnd(0)).date())
    lead = (F.dayofweek(F.lit(begin).cast("date")) + 5) % 7
    return expand(events, begin, end).withColumn("cell", (lead + F.dayofmonth("occurs_on") - 1).cast("int"))


def week_grid(events: DataFrame, day: str) -> DataFrame:
    """The occurrences of the week, from its Monday in UTC, that holds a day, with their weekday from 0."""
    at = pd.Timestamp(day)
    monday = at - pd.Timedelta(days=at.weekday())
    out = expand(events, str(monday.date()), str((monday + pd.Timedelta(days=6)).date()))
    return out.withColumn("weekday", F.date_diff("occurs_on", F.lit(str(monday.date())).cast("date")))


def instant(rows: DataFrame) -> Column:
    """An occurrence's beginning; without a time it is midnight."""
    clock = F.left(F.coalesce("time", F.lit("00:00")), F.lit(5))
    return F.try_to_timestamp(F.concat_ws(" ", F.col("occurs_on").cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))


def upcoming_at(events: DataFrame, now: str, n: int = 30) -> DataFrame:
    """The next `n` occurrences from an instant (yyyy-MM-dd HH:mm) on, within a year."""
    soon = expand(events, now[:10], str((pd.Timestamp(now[:10]) + pd.DateOffset(years=1)).date()))
    at = soon.withColumn("at", instant(soon)).where(F.col("at") >= F.lit(now).cast("timestamp"))
    return at.orderBy("at", "event_id").limit(n)


def next_of_type(events: DataFrame, now: str, kind: str = "raid") -> DataFrame:
    """The next occurrence of a type among the next 30 of all types; no row without one."""
    return upcoming_at(events, now).where(F.col("type") == kind).orderBy("at", "event_id").limit(1)


def countdown(at: Column, now: Column) -> Column:
    """Days, hours, minutes and seconds from now to an instant, or NOW once it has come."""
    s = F.unix_timestamp(at) - F.unix_timestamp(now)
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    days = F.floor(s / 86400)
    text = F.concat(F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""), two(F.floor(s % 86400 / 3600)), F.lit("h "), two(F.floor(s % 3600 / 60)), F.lit("m "), two(s % 60), F.lit("s"))
    return F.when(s <= 0, "NOW").otherwise(text)


def widget(events: DataFrame, today: str) -> DataFrame:
    """Up to 6 occurrences of today; if there are none, the next 5 within 30 days. `kind` says which."""
    rows = expand(events, today, str((pd.Timestamp(today) + pd.Timedelta(days=30)).date()))
    kind = F.when(F.col("occurs_on") == F.lit(today).cast("date"), "today").otherwise("upcoming")
    top = rows.withColumn("kind", kind).orderBy("occurs_on", F.coalesce("time", F.lit("00:00")), "event_id").limit(6)  # six rows
    place = Window.orderBy("occurs_on", F.coalesce("time", F.lit("00:00")), "event_id")
    n_today = F.count_if(F.col("kind") == "today").over(Window.partitionBy(F.lit(0)))
    placed = top.withColumn("place", F.row_number().over(place)).withColumn("n_today", n_today)
    return placed.where(F.when(F.col("n_today") > 0, F.col("kind") == "today").otherwise(F.col("place") <= 5)).drop("place", "n_today")


def type_counts(events: DataFrame) -> DataFrame:
    """Events of each type, before any repetition."""
    return events.groupBy("type").agg(F.count("*").alias("events"))


def upcoming(events: DataFrame, today: str, n: int = 30) -> DataFrame:
    """The next `n` occurrences within a year from a day on."""
    horizon = str((pd.Timestamp(today) + pd.DateOffset(years=1)).date())
    return expand(events, today, horizon).orderBy("occurs_on", "time", "event_id").limit(n)


def escape(text: Column) -> Column:
    """RFC 5545 text: backslash first, then semicolon, comma and line feed."""
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def recurrence_rule(events: DataFrame) -> Column:
    """FREQ and what belongs to it; null for an event that does not recur."""
    freq = F.when(F.col("recurrence") == "daily", "DAILY").when(F.col("recurrence") == "weekly", "WEEKLY").when(F.col("recurrence") == "4weekly", "WEEKLY;INTERVAL=4").when(F.col("recurrence") == "monthly", "MONTHLY").when(F.col("recurrence") == "yearly", "YEARLY")
    until = F.coalesce(F.concat(F.lit(";UNTIL="), F.date_format("recurrence_end", "yyyyMMdd"), F.lit("T235959Z")), F.lit(""))
    return F.concat(F.lit("FREQ="), freq, until)


def vevent(events: DataFrame, dtstamp: str, domain: str = "muster.example", with_rule: bool = True, key: Column | None = None) -> DataFrame:
    """One VEVENT of an hour a row, lines ended by CR LF; lines without content are left out. `key`: what
    the name of an event is made of, by default its id."""
    at = F.try_to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.left("time", F.lit(5))), F.lit("yyyy-MM-dd HH:mm"))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    named = lambda name, value: F.concat(F.lit(name), value)
    lines = [
        F.lit("BEGIN:VEVENT"), named("UID:", F.concat_ws("-", (F.col("event_id") if key is None else key).cast("string"), F.concat(F.col("date").cast("string"), F.lit(f"@{domain}")))), F.lit(f"DTSTAMP:{dtstamp}"),
        named("DTSTART:", stamp(at)), named("DTEND:", stamp(at + F.expr("INTERVAL 1 HOUR"))), named("SUMMARY:", escape(F.col("title"))),
        F.when(F.col("description") != "", named("DESCRIPTION:", escape(F.col("description")))), named("ORGANIZER:CN=", escape(F.col("author"))),
        named("RRULE:", recurrence_rule(events)) if with_rule else F.lit(None), F.lit("END:VEVENT"),
    ]
    return events.select("event_id", F.concat_ws("\r\n", *lines).alias("ics"))


#: What a calendar document begins with, but for its maker, and ends with.
HEAD, FOOT = ("BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//{maker}//EN", "CALSCALE:GREGORIAN"), "END:VCALENDAR"
EOL = "\r\n"


def vcalendar(events: DataFrame, dtstamp: str, first: str | None = None, last: str | None = None, maker: str = "Muster//Alliance Events") -> DataFrame:
    """A calendar document as rows (part, occurs_on, event_id, text) in that order: head, blocks, foot. With a range of days
    each occurrence in it is a block of its own without a rule (a month, a week); without one each event is a block with
    its rule (a single event). Without events there are only head and foot."""
    if first is None:
        blocks = vevent(events, dtstamp).join(events.select("event_id", F.col("date").alias("occurs_on")), "event_id")
    else:
        at = expand(events, first, last).select("event_id", "occurs_on")
        dated = events.join(at, "event_id").withColumn("date", F.col("occurs_on"))
        own = F.struct("event_id", "occurs_on")
        blocks = vevent(dated.withColumn("event_id", own), dtstamp, with_rule=False, key=F.col("event_id.event_id")).select("event_id.occurs_on", "event_id.event_id", "ics")
    spark = events.sparkSession
    ends = spark.createDataFrame([(0, EOL.join(HEAD).format(maker=maker)), (2, FOOT)], "part int, text string")
    null = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in ("occurs_on", "event_id")}
    return blocks.select(F.lit(1).alias("part"), "occurs_on", "event_id", F.col("ics").alias("text")).unionByName(ends.select("part", *(v.alias(c) for c, v in null.items()), "text"))


def write_document(rows: DataFrame, path: str) -> None:
    """Writes a document as text files that, one after the other, are the document, every line ended by CR LF. Rows are
    dealt out by ranges of their order, so no task has more than its part."""
    order = ["part", "occurs_on", "event_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.option("lineSep", EOL).text(path)


def encoded(text: Column) -> Column:
    """Percent-encoding of a part of an address: letters, digits and - _ . ! ~ * ' ( ) stand for themselves."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in "!~'()":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def google_url(events: DataFrame) -> Column:
    """The address that adds an event of an hour to a calendar, with its repetition if it has one."""
    at = F.try_to_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.left("time", F.lit(5))), F.lit("yyyy-MM-dd HH:mm"))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    rule = F.coalesce(F.concat(F.lit("&recur="), encoded(F.concat(F.lit("RRULE:"), recurrence_rule(events)))), F.lit(""))
    return F.concat(
        F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), encoded(F.col("title")), F.lit("&dates="), stamp(at), F.lit("/"), stamp(at + F.expr("INTERVAL 1 HOUR")),
        F.lit("&details="), encoded(F.coalesce("description", F.lit(""))), rule,
    )
