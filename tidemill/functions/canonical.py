"""URI canonicalisation: each rule is a Column expression, a policy applies rules in order.

Nulls stay null; a rule that doesn't apply returns its input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]


def lowercase(url: Column) -> Column:
    return F.lower(url)


def strip_userinfo(url: Column) -> Column:
    """Drop the name and password before the host of http, https, ftp and ftps URIs."""
    return F.regexp_replace(url, r"(?i)^((?:http|ftp)s?://)[^/]+@", "$1")


def strip_www(url: Column) -> Column:
    """Drop ``www.``, where a path of at least one character follows the first slash."""
    return F.regexp_replace(url, r"(?i)^(https?://)www\.(?=[^/]*/.)", "$1")


def strip_numbered_www(url: Column) -> Column:
    """Drop ``www``, any digits and a dot, where a path of at least one character follows the first slash."""
    return F.regexp_replace(url, r"(?i)^(https?://)www\d*\.(?=[^/]*/.)", "$1")


def _strip_last(url: Column, parameter: str) -> Column:
    """Drop the last occurrence of a parameter that ends the URL or is followed by another one."""
    return F.regexp_replace(url, f"(?i)^(.+){parameter}(?:&|$)", "$1")


def strip_session_ids(url: Column) -> Column:
    """Drop the session ids of Java, PHP and ASP servers: three passes, one id each."""
    url = _strip_last(url, "(?:jsession|phpsess)id=[0-9a-z]{32}")
    url = _strip_last(url, "sid=[0-9a-z]{32}")
    return _strip_last(url, "aspsessionid[a-z]{8}=[a-z]{24}")


def strip_coldfusion_ids(url: Column) -> Column:
    return _strip_last(url, "cfid=[^&]+&cftoken=[^&]+")


def strip_extra_slashes(url: Column) -> Column:
    """One slash for each run of slashes after the scheme of http and https URIs."""
    rest = F.regexp_replace(F.regexp_extract(url, r"^https?://(.*)", 1), "/{2,}", "/")
    return F.when(F.regexp_like(url, F.lit("^https?://")), F.concat(F.regexp_extract(url, "^(https?://)", 1), rest)).otherwise(url)


def fixup_query(url: Column) -> Column:
    """One repair after the last ``?``: an empty query, ``&`` at its begin or ``&`` at its end goes."""
    head, query = F.regexp_extract(url, r"(?s)^(.+)\?[^?]*$", 1), F.regexp_extract(url, r"(?s)\?([^?]*)$", 1)
    fixed = (
        F.when(query.isin("", "&"), head)
        .when(query.startswith("&"), F.concat(head, F.lit("?"), F.substr(query, F.lit(2))))
        .when(query.endswith("&"), F.concat(head, F.lit("?"), F.regexp_replace(query, "&$", "")))
        .otherwise(url)
    )
    return F.when(F.regexp_like(url, F.lit(r"(?s)^.+\?[^?]*$")), fixed).otherwise(url)


def rewrite(pattern: str, replacement: str) -> Rule:
    """A rule that replaces URLs which a pattern matches as a whole."""
    return lambda url: F.regexp_replace(url, rf"^(?:{pattern})$", replacement)


DEFAULT: tuple[Rule, ...] = (lowercase, strip_userinfo, strip_numbered_www, strip_session_ids, strip_coldfusion_ids, fixup_query)


def canonical(url: Column, rules: Sequence[Rule] = DEFAULT) -> Column:
    return reduce(lambda column, rule: rule(column), rules, url)


def forced_refetch(url: Column, via: Column, hops: Column, rules: Sequence[Rule] = DEFAULT) -> Column:
    """Whether a redirect leads to the canonical form it came from, so that it must be fetched despite being seen."""
    return F.coalesce(hops.endswith("R") & (canonical(url, rules) == canonical(via, rules)), F.lit(False))
