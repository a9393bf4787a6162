"""URL filters: rules for hosts and paths, and for all other URLs a logistic regression on hashed character n-grams.

A URL's host is what follows its first `://` up to `/`, `?`, `#` or the end, lower-cased in A-Z; its path goes on up
to `?`, `#` or the end. A null URL or one without `://` has an empty host and path. A rule fits its host and all
subdomains where the URL's path starts with the rule's; the longest rule that fits decides.

The regression's features are the n-grams of 3 and 4 characters of `^host$path$`, hashed to 4096 buckets by the first
three hexadecimal digits of their MD5; a URL's value is the mean weight of its n-grams plus a bias. Weights are
rounded to whole numbers of 1 / SCALE, so that sums are exact and the verdict is the same in any engine. Training is
gradient descent over a labelled table of at most MAX_LABELLED rows; scoring is DataFrame functions alone, one pass
without a shuffle. Empty hosts and paths have the two n-grams of `^$$`. Repeated rows have equal verdicts, extra
columns are left out, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.tables import load

SIZES, BUCKETS, SCALE, MAX_LABELLED = (3, 4), 4096, 10_000, 5_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: A small labelled table: made-up URLs, 1 for those to block.
LABELLED = (
    ("https://casino-royale.example/free-spins/bonus", 1), ("http://best-casino.example/slots/jackpot", 1), ("http://poker-bonus.example/play-now", 1),
    ("https://win-jackpot.example/casino/register", 1), ("http://slots-online.example/free-casino-chips", 1), ("http://bet-365-tips.example/betting/odds", 1),
    ("http://cheap-pills.example/buy-viagra", 1), ("https://pharma-discount.example/order/pills/no-prescription", 1), ("http://viagra-online.example/cheap/buy", 1),
    ("http://replica-watches.example/cheap-rolex", 1), ("https://buy-replica-bags.example/discount/sale", 1), ("http://weight-loss-pills.example/miracle", 1),
    ("http://xxx-videos.example/porn/free", 1), ("https://adult-cams.example/sex-chat/live", 1), ("http://free-porn-tube.example/xxx/watch", 1),
    ("http://hot-singles.example/sex-dating/tonight", 1), ("https://payday-loan.example/fast-cash/apply-now", 1), ("http://quick-loans.example/no-credit-check/cash", 1),
    ("http://crypto-doubler.example/free-bitcoin/giveaway", 1), ("https://bitcoin-profit.example/get-rich/invest-now", 1), ("http://account-verify-login.example/secure/update/paypal", 1),
    ("http://paypal-secure-login.example/verify/account", 1), ("https://appleid-unlock.example/signin/confirm", 1), ("http://free-gift-card.example/claim-prize/winner", 1),
    ("http://download-crack.example/keygen/serial", 1), ("https://warez-torrent.example/crack/full-version", 1), ("http://cheap-cialis.example/pills/order", 1),
    ("http://live-casino-bonus.example/roulette", 1), ("http://escort-girls.example/sex/book", 1), ("http://hack-password.example/free-download/crack", 1),
    ("https://www.library.example.org/en/catalogue/1204", 0), ("https://news.example.com/en/2024/05/12/weather", 0), ("https://blog.gardening.example.net/posts/tomatoes", 0),
    ("https://docs.example.org/de/handbuch/123.html", 0), ("https://m.museum.example.net/fr/visite/44", 0), ("https://www.university.example/research/papers/789", 0),
    ("https://en.encyclopedia.example.org/wiki/Mathematics", 0), ("https://recipes.example.com/es/sopas/56", 0), ("https://forum.example.net/t/python-question/9912", 0),
    ("https://www.city-council.example/minutes/2023", 0), ("https://code.example.org/project/issues/17", 0), ("https://maps.example.com/en/routes/3310", 0),
    ("https://school.example/de/stundenplan/5", 0), ("https://www.weather.example.net/fr/semaine/12", 0), ("https://blog.travel.example.com/en/20542", 0),
    ("https://www.theatre.example.org/programme/index.html", 0), ("https://history.example.net/en/archive/6747/", 0), ("https://www.science-journal.example/article/41053#top", 0),
    ("https://health.example.org/en/nutrition/vitamins", 0), ("https://m.sport.example.com/de/469?page=2", 0), ("https://books.example.org/es/31929", 0),
    ("https://music.example.net/albums/2210.html", 0), ("https://www.example.net/de/12804/", 0), ("https://www.example.org/fr/6524/", 0),
    ("https://art.example.com/en/gallery/18362?ref=x", 0), ("https://www.railway.example/timetable/north", 0), ("https://blog.astronomy.example.net/fr/11293", 0),
    ("https://support.example.com/en/faq/16974", 0), ("https://parliament.example.org/debates/1999/03", 0), ("https://www.bakery.example/contact", 0),
)


def parts(url: str | None) -> tuple[str, str]:
    found = re.match(URL, url) if url else None
    fold = {k: k + 32 for k in range(65, 91)}
    return (found[1].translate(fold), found[2]) if found else ("", "")


def gram_buckets(host: str, path: str) -> list[int]:
    s = f"^{host}${path}$"
    return [int(hashlib.md5(s[k : k + n].encode()).hexdigest()[:3], 16) for n in SIZES for k in range(len(s) - n + 1)]


@lru_cache(maxsize=8)
def train(labelled: tuple[tuple[str, int], ...] = LABELLED, steps: int = 400, rate: float = 20.0, penalty: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Bias and weights of the buckets, in units of 1 / SCALE."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    rows = []
    for url, y in labelled:
        grams = gram_buckets(*parts(url))
        counts: dict[int, float] = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1 / len(grams)
        rows.append((list(counts.items()), y))
    w, b = [0.0] * BUCKETS, 0.0
    for _ in range(steps):
        slope, slope_b = dict.fromkeys((g for counts, _ in rows for g, _ in counts), 0.0), 0.0
        for counts, y in rows:
            z = b + sum(w[g] * c for g, c in counts)
            error = (1 / (1 + math.exp(-z)) - y) / len(rows)
            slope_b += error
            for g, c in counts:
                slope[g] += error * c
        for g, s in slope.items():
            w[g] -= rate * (s + penalty * w[g])
        b -= slope_b
    return round(b * SCALE), tuple(round(x * SCALE) for x in w)


def split_url(url: Column) -> tuple[Column, Column]:
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.coalesce(url, F.lit(""))
    return fold(F.regexp_extract(text, URL, 1)), F.regexp_extract(text, URL, 2)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: the key, host, path, the rule that fits (host and path, null if none does), verdict."""
    bias, weights = train(labelled)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    decided = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the last that fits is the longest
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        decided = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(decided)
    rows = rows.withColumn("decided", decided).withColumn("s", F.concat(F.lit("^"), "host", F.lit("$"), "path", F.lit("$")))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - (n - 1), F.lit(1))), lambda k: F.substring("s", k, F.lit(n)))
    grams = F.concat(*map(cut, SIZES))
    rows = rows.withColumn("grams", F.when(F.col("decided").isNull(), F.filter(grams, lambda g: F.length(g) >= min(SIZES))))
    table = F.lit(list(weights)).cast("array<bigint>")
    weight = lambda g: F.get(table, F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int"))
    total = F.aggregate("grams", F.lit(0).cast("bigint"), lambda a, g: a + weight(g))
    scored = F.when(total + F.lit(bias).cast("bigint") * F.size("grams") >= 0, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", scored).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))


def oracle() -> str:
    bias, weights = train(LABELLED)
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    )
    grams = " || ".join(f"CASE WHEN length(s) >= {n} THEN list_transform(range(1, length(s) - {n} + 2), lambda k: substring(s, k, {n})) ELSE [] END" for n in SIZES)
    bucket = "CAST('0x' || substring(md5(g), 1, 3) AS INTEGER) + 1"
    return f"""
    WITH cut AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages
    ), ruled AS (
      SELECT *, CASE {fits} END AS decided, '^' || host || '$' || path || '$' AS s FROM cut
    ), cut_up AS (SELECT *, {grams} AS grams FROM ruled),
    weights AS (SELECT {list(weights)} AS w)
    SELECT page_id, host, path, decided.rule AS rule,
           coalesce(decided.verdict, CASE WHEN list_sum(list_transform(grams, lambda g: w[{bucket}])) + {bias} * len(grams) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
    FROM cut_up, weights
    """
