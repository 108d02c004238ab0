"""URI parts, normalisation and sort-friendly keys as Column expressions.

The sort key of ``http://user@www.example.com:80/a`` is ``http://(com,example,www,:80@user)/a``.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_CHARS = 2083
_QUAD = r"^(?:\d{1,3}\.){3}\d{1,3}$"
_COMMON_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "co.za", "com.cn")


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_port(uri: Column) -> Column:
    """The authority without user information."""
    return F.regexp_replace(authority(uri), "^.*@", "")


def host(uri: Column) -> Column:
    return F.lower(F.regexp_replace(host_port(uri), r":\d*$", ""))


def port(uri: Column) -> Column:
    return F.regexp_extract(host_port(uri), r":(\d+)$", 1).try_cast("int")


def path(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)


def parts(uri: Column) -> Column:
    """struct(scheme, authority, host, port, path, query); the fragment is dropped."""
    return F.struct(*(f(uri).alias(f.__name__) for f in (scheme, authority, host, port, path, query)))


def filename(uri: Column) -> Column:
    return F.element_at(F.split(path(uri), "/"), -1)


def host_basename(uri: Column) -> Column:
    """The host without a leading ``www``, digits and a dot."""
    return F.regexp_replace(host(uri), r"^www\d*\.", "")


def referenced_host(uri: Column) -> Column:
    """The host, also of ``dns:`` URIs."""
    return F.when(scheme(uri) == "dns", F.regexp_extract(uri, "^dns:/*([^/?]*)", 1)).otherwise(host(uri))


def server_key(uri: Column) -> Column:
    """host:port of the server; https without a port is told apart by ``:443``."""
    key = F.lower(host_port(uri))
    return F.when((scheme(uri) == "https") & ~F.regexp_like(key, F.lit(r":\d+$")), F.concat(key, F.lit(":443"))).otherwise(key)


def is_quad(name: Column) -> Column:
    return F.regexp_like(name, F.lit(_QUAD))


def add_http(text: Column) -> Column:
    """``http://`` before text that has no scheme."""
    return F.when(F.regexp_like(text, F.lit(r"^[A-Za-z][\w+-]+:")), text).otherwise(F.concat(F.lit("http://"), text))


#: Characters that a path or query keeps as they are; percent signs always stay.
_PATH_SAFE, _QUERY_SAFE = r"A-Za-z0-9\-_.!~*'():@&=+$,;/|%", r"A-Za-z0-9\-_.!~*'():@&=+$,;/|%?{}\[\]^\\"


def escape(text: Column, safe: str) -> Column:
    """Other characters than the safe ones as percent signs and the hexadecimal digits of their bytes."""
    bad = F.lit(f"[^{safe}]")
    each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c == " ", "%20").when(F.regexp_like(c, bad), F.url_encode(c)).otherwise(c))
    return F.when(F.regexp_like(text, bad), F.array_join(each, "")).otherwise(text)


def without_dots(path_: Column) -> Column:
    """A path without the segments . and .., each .. with the one before it; at the root .. goes alone."""
    segments = F.split(F.regexp_replace(path_, r"(/\.{1,2})$", "$1/"), "/")
    none = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    out = F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(segments, 2, F.size(segments)), none, step), "/"))
    return F.when(F.regexp_like(path_, F.lit(r"/\.{1,2}(?:/|$)")), out).otherwise(path_)


def normalise(uri: Column) -> Column:
    """A tidy absolute URI, or null: trimmed, without breaks, fragment and dot segments, slashes and default ports repaired,
    characters escaped that URIs may not hold.

    Null where the port is no number up to 65535, labels of the host are empty, or the whole is too long.
    Internationalised names are left to ``resolve``.
    """
    text = F.trim(F.translate(uri, "\u00a0", " "))
    text = F.regexp_replace(text, r"[\n\r\t]+", "")
    text = F.regexp_replace(text, "#.*$", "")
    return _let(text, lambda t: _let(_slashes(t), _normal))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _slashes(text: Column) -> Column:
    """Slashes for backslashes before a query; two behind the scheme."""
    before, after = F.regexp_extract(text, r"^([^?]*)", 1), F.regexp_extract(text, r"^[^?]*(\?.*)$", 1)
    return F.regexp_replace(F.concat(F.translate(before, "\\", "/"), after), r"(?i)^(https?:)/{2,}", "$1//")


def _normal(text: Column) -> Column:
    name = F.lower(F.regexp_replace(host_port(text), r"^\.+|\.+(?=$|:)|(?:%20)+$", ""))
    name = F.regexp_replace(name, ":0*(?=[0-9])", ":")
    name = _let(name, lambda n: F.when(scheme(text) == "http", F.regexp_replace(n, ":(80)?$", "")).when(scheme(text) == "https", F.regexp_replace(n, ":(443)?$", "")).otherwise(n))
    user = F.regexp_extract(authority(text), "^(.*@)", 1)
    after = F.regexp_extract(text, r"^[^?]*(\?.*)$", 1)
    way = lambda: _let(_let(path(text), without_dots), lambda w: _let(F.when(w == "", F.lit("/")).otherwise(w), lambda x: escape(x, _PATH_SAFE)))
    whole = lambda n: F.concat(scheme(text), F.lit("://"), user, n, way(), _let(after, lambda q: escape(q, _QUERY_SAFE)))
    number = lambda n: F.regexp_extract(n, r":(.*)$", 1)
    named = lambda n: (scheme(text) != "") & (n != "") & ~n.contains("..")
    ported = lambda n: (number(n) == "") | (F.regexp_like(number(n), F.lit(r"^\d{1,9}$")) & F.coalesce(number(n).try_cast("int") <= 65535, F.lit(False)))
    short = lambda w: F.when(F.length(w) <= MOST_CHARS, w)
    return _let(name, lambda n: F.when(named(n) & ported(n), _let(whole(n), short)))


def joined(base: str | None, reference: str | None) -> str | None:
    """A reference joined with its base URI, the host name in ASCII; null where that fails."""
    if reference is None:
        return None
    try:
        whole = urljoin(base or "", reference.strip())
        head, sep, rest = whole.partition("://")
        name, slash, tail = rest.partition("/")
        if not name.isascii():
            name = name.encode("idna").decode()
        return head + sep + name + slash + tail
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(StringType())
def _joined(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([joined(b, r) for b, r in zip(base, reference)], dtype=object)


def resolve(base: str | Column, reference: str | Column) -> Column:
    """References resolved against base URIs and normalised; null where that fails or gives no absolute URI of a host."""
    return normalise(_joined(base, reference))


# ---- sort-friendly keys


def surt(uri: Column, preserve_case: bool = False) -> Column:
    """The key that sorts by domain: host labels reversed, port and user information behind them."""
    shape = r"^(\w+://)(?:([^/@\s]+)@)?([^/:@\s]+)(:\d+)?(/\S*)?$"
    part = [F.regexp_extract(uri, shape, k) for k in range(6)]
    name = F.when(is_quad(part[3]), part[3]).otherwise(F.concat(F.array_join(F.reverse(F.split(part[3], r"\.")), ","), F.lit(",")))
    user = F.when(part[2] != "", F.concat(F.lit("@"), part[2])).otherwise("")
    key = F.concat(part[1], F.lit("("), name, part[4], user, F.lit(")"), part[5])
    key = key if preserve_case else F.lower(key)
    return F.when(F.regexp_like(uri, F.lit(shape)), key).otherwise(uri)


def http_for_https(uri: Column) -> Column:
    """https as http, for comparisons."""
    return F.regexp_replace(uri, "^https://", "http://")


def as_prefix(key: Column) -> Column:
    """What a key implies as a prefix: up to the last slash; of a bare host also its subdomains."""
    cut = F.regexp_replace(key, r"^([^/]*//[^/]*/.*/|[^/]*//[^/]*/)[^/]*$", "$1")
    return F.when(F.regexp_like(cut, F.lit("/$")), cut).otherwise(F.regexp_replace(cut, r"\)[^/]*$", ""))


def surt_prefix(text: Column) -> Column:
    """The prefix that a URI or bare host of a seed list implies."""
    return as_prefix(surt(http_for_https(add_http(text))))


def host_prefix(prefix: Column) -> Column:
    """A prefix truncated to exactly its host."""
    return F.concat(F.regexp_extract(prefix, r"^(\w+://\([^)]*?),?(?:\).*)?$", 1), F.lit(",)"))


def domain_prefix(prefix: Column) -> Column:
    """A prefix truncated to its domain and all below it."""
    return F.regexp_replace(F.regexp_replace(prefix, r"\).*$", ""), "www,$", "")


def class_key(uri: Column) -> Column:
    """The queue that a URI belongs to: the authority of its sort key, with # for the port's colon."""
    key = F.translate(F.regexp_extract(surt(uri), r"^\w+://\(([^)]*)\)", 1), ":", "#")
    return F.when(key != "", key)


def assigned_domain(uri: Column, suffixes: tuple[str, ...] = _COMMON_SUFFIXES) -> Column:
    """The registered domain: a public suffix and one label before it; hosts that are numbers stay."""
    name = host(uri)
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    found = F.when(F.size(labels) < 2, name).when(two.isin(*suffixes) & (F.size(labels) > 2), three).otherwise(two)
    return F.when(is_quad(name), name).otherwise(found)


def is_tld(label: Column, known: tuple[str, ...] = ("ac", "ad", "ae", "af", "ag", "ai", "al", "am", "ar", "at", "au", "be", "bg", "biz", "br", "ca", "ch", "cl", "cn", "co", "com", "cz", "de", "dk", "edu", "ee", "es", "eu", "example", "fi", "fr", "gov", "gr", "hk", "hr", "hu", "id", "ie", "il", "in", "info", "int", "io", "ir", "is", "it", "jp", "kr", "lt", "lu", "lv", "me", "mil", "mx", "my", "name", "net", "nl", "no", "nz", "org", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk", "th", "tr", "tv", "tw", "ua", "uk", "us", "uy", "vn", "za")) -> Column:
    """Whether a label is one of the top-level domains known."""
    return F.lower(label).isin(*known)


def policy_basis(uri: Column, via: Column, hops: Column) -> Column:
    """The URI whose policies count: a prerequisite's are those of the page that needs it."""
    return F.when(F.coalesce(hops.endswith("P"), F.lit(False)), F.coalesce(via, uri)).otherwise(uri)


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash by 31 of a string of the basic plane, as a long."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def ip_class_key(host_: Column, ip: Column) -> Column:
    """The queue by address; by host name where no address is known."""
    return F.coalesce(ip, host_)


def bucket_class_key(host_: Column, ip: Column, queues: int = 1021, mask: int = 1023) -> Column:
    """One of a fixed number of queues by the address, of others by the host where no address is known."""
    number = lambda x: F.abs(java_hash(x))
    return F.when(host_.isNull(), "NO-HOST").when(ip.isNull(), F.concat(F.lit("NO-IP-"), number(host_).bitwiseAND(F.lit(mask)).cast("string"))).otherwise((number(ip) % queues).cast("string"))


def path_bucket(uri: Column, parallel: int) -> Column:
    """Number of a parallel sub-queue by the first path segment."""
    return F.pmod(F.xxhash64(F.regexp_extract(path(uri), "^/([^/]*)", 1)), F.lit(parallel)).cast("int")
