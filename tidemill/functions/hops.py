"""Discovery paths, statuses, costs, precedences and waits as Column expressions.

A path has one letter for each hop from a seed: L link, E embed, X speculative, R redirect, P prerequisite,
I inferred.  Only the last 50 are kept; ``12+`` before them counts what was cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_HOPS = 50
#: Labels of fetch statuses that aren't HTTP's.
STATUS_LABELS = {
    1: "DNS success", 0: "not attempted", -1: "DNS failure", -2: "connect failure", -3: "connection lost", -4: "timeout", -5: "runtime failure", -6: "prerequisite failure", -7: "URI unfetchable", -8: "too many retries",
    -50: "deferred", -60: "no queue", -61: "robots unknown", -62: "prerequisite unknown", -63: "unknown", -404: "empty response", -3000: "severe failure", -4000: "chaff", -4001: "too many link hops", -4002: "too many embed hops",
    -5000: "out of scope", -5001: "blocked by user", -5002: "blocked by processor", -5003: "blocked by quota", -5004: "blocked by runtime limit", -6000: "deleted by user", -7000: "thread killed", -9998: "robots excluded",
}
DISREGARDED = (-9998, -5003, -5002, -5001, -5000, -5004, -6000)


def hop_count(hops: Column) -> Column:
    cut = F.regexp_extract(hops, r"^(\d+)\+", 1).try_cast("int")
    return F.coalesce(cut, F.lit(0)) + F.length(F.regexp_replace(F.coalesce(hops, F.lit("")), r"^\d+\+", ""))


def extend(hops: Column, hop: Column) -> Column:
    """The path one hop further; beyond the most, the oldest letter is counted instead of kept."""
    cut = F.coalesce(F.regexp_extract(hops, r"^(\d+)\+", 1).try_cast("int"), F.lit(0))
    letters = F.concat(F.regexp_replace(F.coalesce(hops, F.lit("")), r"^\d+\+", ""), hop)
    over = F.length(letters) > MOST_HOPS
    return F.when(over, F.concat((cut + 1).cast("string"), F.lit("+"), F.right(letters, F.lit(MOST_HOPS)))).otherwise(F.when(cut > 0, F.concat(cut.cast("string"), F.lit("+"), letters)).otherwise(letters))


def tail(hops: Column) -> Column:
    """The letters since the last link."""
    return F.regexp_extract(F.coalesce(hops, F.lit("")), "[^L]*$", 0)


def count_letter(hops: Column, letter: str) -> Column:
    return F.length(hops) - F.length(F.replace(hops, F.lit(letter), F.lit("")))


def embed_hops(hops: Column) -> Column:
    return F.length(tail(hops))


def link_hops(hops: Column) -> Column:
    return count_letter(F.coalesce(hops, F.lit("")), "L")


def is_redirect(hops: Column) -> Column:
    return F.coalesce(hops.endswith("R"), F.lit(False))


def transcluded(hops: Column, most: int = 2, most_speculative: int = 1) -> Column:
    """Whether the path ends in a few hops that no link follows: part of a page rather than a page."""
    end = tail(hops)
    return (F.length(end) > 0) & (count_letter(end, "X") <= most_speculative) & (F.length(end) - count_letter(end, "R") <= most)


def transcluded_by_kind(hops: Column, speculative: int = 1, referral: int = -1, embed: int = -1, most: int = 2) -> Column:
    """The older test with a limit for each letter; -1 sets none."""
    end = tail(hops)
    limits = [F.lit(True) if n < 0 else count_letter(end, c) <= n for c, n in (("X", speculative), ("R", referral), ("E", embed))]
    return (F.length(end) > 0) & reduce(lambda a, b: a & b, limits) & (F.length(end) <= most)


# ---- status


def status_label(status: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, status), F.concat(F.lit("HTTP "), status.cast("string")))


def is_success(status: Column) -> Column:
    """Anything that a server said, error pages included."""
    return status > 0


def is_disregarded(status: Column) -> Column:
    return status.isin(*DISREGARDED)


def needs_retry(status: Column, attempts: Column, most: int = 30) -> Column:
    return (attempts < most) & status.isin(-50, -1, -2, -3, 0)


def outcome(status: Column, attempts: Column, most: int = 30) -> Column:
    return F.when(needs_retry(status, attempts, most), "retry").when(is_success(status), "success").when(is_disregarded(status), "disregard").otherwise("failure")


# ---- scheduling


def scheduling(hops: Column, depth: int = -1, embeds: int = 1) -> Column:
    """0 at once, 1 high, 2 medium, 3 normal: redirects, shallow links and near embeds come first."""
    n = embed_hops(hops)
    redirect = F.when(link_hops(hops) == 0, 1).otherwise(2)
    return F.when(is_redirect(hops), redirect).when((F.lit(depth) >= 0) & (link_hops(hops) <= depth), 1).when((n > 0) & (n <= embeds), 2).otherwise(3)


def cost_by_query(uri: Column, via: Column) -> Column:
    """1, one more for a query, one more if the page that led here has the same address before it."""
    before = F.regexp_extract(uri, r"^([^?]*)", 1)
    asked = uri.contains("?")
    return 1 + asked.cast("int") + (asked & F.coalesce(via, F.lit("")).startswith(before)).cast("int")


CALENDAR_WORDS = "calendar|calendrier|event|year|month|day|date|jour|viewcal|yr="


def cost_by_calendar(uri: Column) -> Column:
    """1, one more for addresses that look like calendar pages."""
    return 1 + F.regexp_like(uri, F.lit(rf"(?i){CALENDAR_WORDS}|\D(?:19|20)\d\d\D")).cast("int")


def precedence_by_hops(hops: Column, base: int = 1, links_only: bool = True) -> Column:
    return F.lit(base) + (link_hops(hops) if links_only else hop_count(hops))


def precedence_by_success(successes: Column, base: int = 3, increments: tuple[int, ...] = (100, 1000)) -> Column:
    """A queue falls one level for each increment of successes; the last increment repeats."""
    level, at = F.lit(base), 0
    for step in increments[:-1]:
        at += step
        level = level + (successes >= at).cast("int")
    rest = F.greatest(successes - at, F.lit(0))
    return (level + F.floor(rest / increments[-1])).cast("int")


def politeness_delay(duration: Column, crawl_delay_s: Column | None = None, factor: float = 5.0, least: int = 3000, most: int = 30000, respect_s: int = 300) -> Column:
    """Milliseconds to wait after a fetch: a multiple of its duration within bounds, but what robots.txt asks for if more."""
    delay = F.least(F.greatest((duration * factor).cast("long"), F.lit(least).cast("long")), F.lit(most).cast("long"))
    if crawl_delay_s is None:
        return delay
    asked = (F.least(crawl_delay_s, F.lit(float(respect_s))) * 1000).cast("long")
    return F.greatest(delay, F.coalesce(asked, F.lit(0).cast("long")))


def retry_delay(status: Column, seconds: int = 900) -> Column:
    return F.when(status.isin(-1, -2, -3), seconds).otherwise(0)
