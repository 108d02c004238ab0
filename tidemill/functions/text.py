"""Strings, digests, dates and formats of logs and reports as Column expressions."""

from __future__ import annotations

import base64
import html as html_
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def mime(content_type: Column) -> Column:
    """The media type without parameters; ``no-type`` where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(content_type, r"^([^\s;,]+)", 1), F.lit("")), F.lit("no-type"))


def digits_date(ts: Column, digits: int = 14) -> Column:
    """12, 14 or 17 digits of a timestamp in the session's zone."""
    return F.date_format(ts, {12: "yyyyMMddHHmm", 14: "yyyyMMddHHmmss", 17: "yyyyMMddHHmmssSSS"}[digits])


def iso_date(ts: Column, millis: bool = False) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T"), F.date_format(ts, "HH:mm:ss.SSS" if millis else "HH:mm:ss"), F.lit("Z"))


def parse_digits_date(digits: Column) -> Column:
    """A timestamp from 4 to 17 digits; what is missing is the first month, day or moment; null if it is no date."""
    least = F.lit("00000101000000000")
    whole = F.concat(digits, F.substr(least, F.length(digits) + 1))
    return F.when(F.regexp_like(digits, F.lit(r"^\d{4,17}$")), F.try_to_timestamp(F.substr(whole, F.lit(1), F.lit(14)), F.lit("yyyyMMddHHmmss")))


def display_bytes(n: Column) -> Column:
    """Bytes in the largest unit they fill, with one decimal below ten; halves go to the even digit."""
    size, unit = n.cast("double"), F.lit("B")
    out = F.concat(n.cast("string"), F.lit(" "), unit)
    for k, name in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        x = size / 1024.0**k
        out = F.when(x >= 1, F.concat(F.when(x < 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.0f", F.bround(x, 0))), F.lit(f" {name}"))).otherwise(out)
    return out


def display_duration(ms: Column, days: bool = True) -> Column:
    """1d2h3m4s5ms, without the units that are nought; without days, hours go on counting."""
    out, rest = [], ms
    for name, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1))[not days :]:
        n = F.floor(rest / size)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(""))
        rest = rest - n * size
    return F.when(ms == 0, F.lit("0ms")).otherwise(F.concat(*out))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(html_.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def base32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: base64.b32encode(b).decode().rstrip("="), na_action="ignore")


@F.pandas_udf(BinaryType())
def from_base32(text: pd.Series) -> pd.Series:
    """Bytes of base 32, in either case and with or without padding; null where it is none."""

    def one(t: str) -> bytes | None:
        t = t.rstrip("=").upper()
        try:
            return base64.b32decode(t + "=" * (-len(t) % 8))
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def decode_loosely(text: pd.Series) -> pd.Series:
    """Percent escapes and plus signs decoded; escapes that are none stay as they are."""
    return text.map(lambda t: unquote_plus(t, errors="replace"), na_action="ignore")


def decimal(number: Column, most: int) -> Column:
    """A number with at most so many fraction digits, without noughts at the end."""
    fixed = F.format_string(f"%.{most}f", number.cast("double"))
    return F.regexp_replace(fixed, r"\.?0+$", "") if most else fixed


def long_bytes(number: Column) -> Column:
    """Eight bytes of a long, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def bytes_long(data: Column) -> Column:
    return F.conv(F.hex(data), 16, -10).cast("long")


def http_date(text: Column) -> Column:
    """The time of a header such as Sun, 06 Nov 1994 08:49:37 GMT, in UTC; years from 2090 on are meant a century before."""
    shape = r"^\s*(?:\w{3,9},\s*)?(\d{1,2})[ -](\w{3})[ -](\d{4})\s+(\d{2}:\d{2}:\d{2})"
    part = [F.regexp_extract(text, shape, k) for k in range(5)]
    year = F.regexp_replace(part[3], "^209", "199")
    return F.try_to_timestamp(F.concat_ws(" ", F.lpad(part[1], 2, "0"), F.initcap(part[2]), year, part[4]), F.lit("dd MMM yyyy HH:mm:ss"))


def digest(content: Column) -> Column:
    """``sha1:`` and the digest in base 32."""
    return F.concat(F.lit("sha1:"), base32(F.unhex(F.sha1(content))))


def text_digest(content: Column, strip: str = "", most: int = 1 << 20) -> Column:
    """A digest of text up to a size, with what a pattern matches replaced by a blank: blind to such changes."""
    stripped = F.regexp_replace(content, strip, " ") if strip else content
    return F.when(F.length(content) <= most, F.sha1(stripped))


def declared_charset(page: Column) -> Column:
    """The character set that a page declares in a meta element or XML declaration; null if none."""
    meta = F.regexp_extract(page, r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([\w.:-]+)""", 1)
    xml = F.regexp_extract(page, r"""(?is)^\s*<\?xml\s[^>]*?encoding\s*=\s*["']([\w.:-]+)["']""", 1)
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(xml, F.lit("")))


def dash_if_none(column: Column) -> Column:
    """``-`` for null and empty fields of logs."""
    return F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("-"))


def pad(column: Column, width: int, fill: str = " ") -> Column:
    """Left-padded to a width; longer text stays whole."""
    text = column.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def map_keep_first(first: Column, second: Column) -> Column:
    """Both maps together; of equal keys the first map's value stays."""
    return F.map_concat(F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k)), first)
