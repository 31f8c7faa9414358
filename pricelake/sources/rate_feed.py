"""Exchange-rate feeds: XML documents as rows of rates. Both shapes are read by Spark's XML functions."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import feed_date

_ITEM = "array<struct<title: string, pubDate: string, description: string, quant: string>>"


def rates(feeds: DataFrame) -> DataFrame:
    """feeds: ``feed_id, xml``. (feed_id, as_of, code, raw, quant, per_unit): items without a readable value are skipped;
    a missing or senseless quant counts 1; the date is the first item's, else the feed's."""
    bare = F.regexp_replace("xml", r"^\s*<\?[^>]*\?>", "")
    parsed = feeds.select("feed_id", F.from_xml(bare, f"date string, item {_ITEM}, channel struct<date: string, item: {_ITEM}>", {"mode": "PERMISSIVE"}).alias("x"))
    items = parsed.select("feed_id", F.coalesce("x.date", "x.channel.date").alias("feed_date"), F.posexplode(F.coalesce("x.item", "x.channel.item")).alias("place", "i"))
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    value = number(F.col("i.description"))
    given = number(F.col("i.quant"))
    quant = F.when(given > 0, given).otherwise(1.0)
    rows = items.select(
        "feed_id",
        "place",
        F.coalesce(F.nullif(F.trim("i.pubDate"), F.lit("")), "feed_date").alias("day"),
        F.upper(F.trim("i.title")).alias("code"),
        value.alias("raw"),
        F.bround(quant).cast("int").alias("quant"),
    ).where("raw is not null and code <> ''")
    day = rows.groupBy("feed_id").agg(F.min_by("day", F.when(F.col("day").isNotNull(), F.col("place"))).alias("as_of_text"))
    last = rows.groupBy("feed_id", "code").agg(F.max_by(F.struct("raw", "quant"), "place").alias("r"))
    per_unit = F.bround(F.col("r.raw") / F.greatest(F.lit(1), F.col("r.quant")), 6)
    return last.join(day, "feed_id").select("feed_id", feed_date(F.col("as_of_text")).alias("as_of"), "code", "r.raw", "r.quant", per_unit.alias("per_unit"))


class FeedCache:
    """Feeds that were fetched: one of a given day never changes, the latest is fetched anew once it is ``ttl`` seconds
    old, or when asked. ``fetch`` takes the day, or None for the latest; what it raises is not kept."""

    def __init__(self, fetch: Callable[[date | None], str], ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.ttl, self.clock = fetch, ttl, clock
        self.kept: dict[date | None, tuple[float, str]] = {}

    def get(self, day: date | None = None, refresh: bool = False) -> str:
        at, feed = self.kept.get(day, (0.0, ""))
        if day in self.kept and not refresh and (day is not None or self.clock() - at < self.ttl):
            return feed
        feed = self.fetch(day)
        self.kept[day] = self.clock(), feed
        return feed
