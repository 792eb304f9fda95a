"""Mail feeds as a sign of life: is there a recent mail from the right sender?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import millis, shift


def matches(sender: str, title_regex: str = ".*") -> Column:
    """Sender equal to the trimmed setting and the whole title matching."""
    return (F.col("email") == F.lit(sender.strip())) & F.regexp_like(
        "title", F.lit(f"^(?:{title_regex})$")
    )


def recent(now: Column, threshold_ms: int) -> Column:
    return F.col("issued") > shift(now, -threshold_ms)


def mail_counts(
    entries: DataFrame,
    now: Column,
    sender: str,
    title_regex: str = ".*",
    threshold_ms: int = 2 * 3_600_000,
    by: list[str] | None = None,
) -> DataFrame:
    """Total, matching and recent mails, the newest matching one or null; ok = any recent."""
    match = F.coalesce(matches(sender, title_regex), F.lit(False))
    fresh = F.count_if(match & recent(now, threshold_ms))
    return entries.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_mails"),
        F.count_if(match).alias("matching_mails"),
        fresh.alias("recent_mails"),
        F.max(F.when(match, millis("issued"))).alias("newest_matching_ms"),
        (fresh > 0).alias("ok"),
    )


def mail_predicate(
    responses: DataFrame, entries: DataFrame, keys: list[str], now: Column, sender: str, title_regex: str = ".*",
    threshold_ms: int = 2 * 3_600_000,
) -> DataFrame:
    """The verdict on responses of mail feeds (`keys`, status_code) with the mails read from their bodies:
    good if the answer was 200 and some matching mail is recent. Adds the counts, ok and `data`, the counts
    as a string map; a feed without mails has counts of 0."""
    counts = mail_counts(entries, now, sender, title_regex, threshold_ms, keys).drop("ok")
    found = responses.join(counts, keys, "left")
    names = ("total_mails", "matching_mails", "recent_mails")
    found = found.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})
    ok, data = counted()
    return found.withColumns({"ok": ok, "data": data})


def counted(**definition) -> tuple[Column, Column]:
    """(ok, data) columns over status_code and the mail counts of a response: the builder of predicates of
    type gmailRss, whose definition says which mails were counted."""
    names = ("total_mails", "matching_mails", "recent_mails", "newest_matching_ms")
    shown = [x for n in names for x in (F.lit(n), F.coalesce(F.col(n).cast("string"), F.lit("null")))]
    fresh = F.coalesce(F.col("recent_mails") > 0, F.lit(False))
    return F.coalesce(F.col("status_code") == 200, F.lit(False)) & fresh, F.create_map(*shown)
