"""Scope decisions: rules that ACCEPT, REJECT or say nothing (null), and sequences in which the last word wins.

A rule is a nullable string Column.  Rules that look a set up (prefixes, hosts, countries) are joins that
add a boolean column; see ``tidemill.operators.joins``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import hops as hops_
from tidemill.functions import uris

ACCEPT, REJECT = "ACCEPT", "REJECT"

#: Endings of files by kind.
SUFFIXES = {
    "images": ("bmp", "gif", "jpg", "jpeg", "png", "svg", "tif", "tiff"),
    "audio": ("mp2", "mp3", "mid", "wav", "wma", "ogg", "flac", "ram", "rm"),
    "video": ("avi", "mpg", "mpeg", "mp4", "mov", "wmv", "m4v", "rmvb", "swf", "webm"),
    "misc": ("pdf", "doc", "xls", "ppt", "css", "js", "smil", "zip", "gz", "tgz", "rar", "exe"),
}


def full(column: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole value; false for null."""
    return F.coalesce(F.regexp_like(column, F.lit(rf"^(?:{pattern})\z")), F.lit(False))


def rule(predicate: Column, decision: str = ACCEPT, enabled: bool = True) -> Column:
    return F.when(predicate & F.lit(enabled), F.lit(decision))


def accept() -> Column:
    return F.lit(ACCEPT)


def reject() -> Column:
    return F.lit(REJECT)


def invert(decision: Column) -> Column:
    return F.when(decision == ACCEPT, REJECT).when(decision == REJECT, ACCEPT)


def last_word(rules: Sequence[Column]) -> Column:
    """The decision of the last rule that says something."""
    return F.coalesce(*reversed(list(rules))) if rules else F.lit(None).cast("string")


def decisive(rules: Sequence[Column]) -> Column:
    """Number (from 0) of the first rule since which the decision stands: later ones that agree change nothing."""
    standing, at = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, r in enumerate(rules):
        changes = r.isNotNull() & ~standing.eqNullSafe(r)
        at = F.when(changes, k).otherwise(at)
        standing = F.coalesce(r, standing)
    return at


# ---- predicates


def matches_list(column: Column, patterns: Sequence[str], any_of: bool = True) -> Column:
    """Whether any or all patterns match the whole value; false for no patterns."""
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b if any_of else a & b, (full(column, p) for p in patterns))


def has_suffix(uri: Column, *kinds: str) -> Column:
    """Whether a file of these kinds (all, if none is named) is asked for."""
    endings = [s for k in kinds or SUFFIXES for s in SUFFIXES[k]]
    return F.regexp_like(uri, F.lit(rf"(?i)\.(?:{'|'.join(endings)})$"))


def repeats_segment(uri: Column, most: int = 2) -> Column:
    """Whether a path segment follows itself more than ``most`` times: a trap's mark.  0 switches it off."""
    return F.regexp_like(uri, F.lit(rf"/([^/]+/)\1{{{most},}}")) if most else F.lit(False)


def too_many_segments(uri: Column, most: int = 20) -> Column:
    """Slashes in the whole URI, those after the scheme included."""
    return F.length(uri) - F.length(F.replace(uri, F.lit("/"), F.lit(""))) > most


def too_many_hops(hops: Column, most: int = 20) -> Column:
    return hops_.hop_count(hops) > most


def scheme_not_in(uri: Column, schemes: Sequence[str] = ("dns", "ftp", "http", "https", "whois")) -> Column:
    return ~uris.scheme(uri).isin(*schemes)


def longer_than(length: Column, most: int = -1) -> Column:
    return F.coalesce(length > most, F.lit(False))


def not_longer_than(length: Column, most: int) -> Column:
    return F.coalesce(length < most, F.lit(False))


def content_length(length: Column, most: int) -> Column:
    """The rule that always decides: shorter content is accepted."""
    return F.when(F.coalesce(length < most, F.lit(False)), ACCEPT).otherwise(REJECT)


def leaves_domain(uri: Column, via: Column) -> Column:
    """Whether a link leads to another registered domain."""
    return F.coalesce(uris.assigned_domain(uri) != uris.assigned_domain(via), F.lit(False))


def moved_site(uri: Column, via: Column, hops: Column) -> Column:
    """Whether a site's root redirects to the same host but for www: the target counts as a seed."""
    same = uris.host_basename(uri) == uris.host_basename(via)
    return F.coalesce(same & hops_.is_redirect(hops) & uris.path(via).isin("", "/"), F.lit(False))


def expects_html(uri: Column) -> Column:
    """Whether a page may be expected behind an address, by its ending."""
    return ~has_suffix(uri)


def unchanged(now_modified: Column, before_modified: Column, now_etag: Column, before_etag: Column) -> Column:
    """Whether the server's marks say a page is the same; null if it gives none to compare."""
    modified, etag = now_modified == before_modified, now_etag == before_etag
    return F.when(modified.isNotNull() & etag.isNotNull(), modified & etag).otherwise(F.coalesce(modified, etag))


def preselect(uri: Column, block_all: bool = False, allow: str = "", block: str = "", recheck: Column | None = None) -> Column:
    """The status with which a candidate is stopped before it is fetched; null if it goes on."""
    status = F.lit(None).cast("int")
    if recheck is not None:
        status = F.when(~F.coalesce(recheck == ACCEPT, F.lit(False)), -5000).otherwise(status)
    if block:
        status = F.when(full(uri, block), -5001).otherwise(status)
    if allow:
        status = F.when(~full(uri, allow), -5001).otherwise(status)
    return F.lit(-5001) if block_all else status


def gate(frame: DataFrame, applies: Column, columns: dict[str, Column]) -> DataFrame:
    """Columns computed where a processor applies, unchanged elsewhere."""
    return frame.withColumns({k: F.when(applies, v).otherwise(F.col(k) if k in frame.columns else F.lit(None)) for k, v in columns.items()})


def limit_per_key(frame: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def scope(seed: Column, focus: Column, exclude: Column, hops: Column, most_links: int = 25, most_trans: int = 5) -> Column:
    """The older algebra: (seed or focus or transcluded) and neither excluded nor too far away."""
    trans = (hops_.embed_hops(hops) > 0) & (hops_.embed_hops(hops) <= most_trans)
    return (seed | focus | trans) & ~(exclude | (hops_.link_hops(hops) > most_links))
