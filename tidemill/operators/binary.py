"""Links in documents that aren't text: PDF, Word, Flash, and anything else that holds addresses.

Bytes are read as Latin-1, so that patterns run over them in the JVM; only compressed Flash needs Python.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MOST_BYTES = 8 << 20


def _latin(body: Column) -> Column:
    return F.decode(F.when(F.length(body) <= MOST_BYTES, body), "ISO-8859-1")


def address_runs(body: Column) -> Column:
    """Runs of bytes that look like absolute addresses, in any kind of file up to a size."""
    return F.array_distinct(F.regexp_extract_all(_latin(body), F.lit(r"((?:https?|ftp)://[A-Za-z0-9][A-Za-z0-9.-]{2,}(?::\d+)?(?:/[A-Za-z0-9._~%/?#\[\]@!$&'*+,;=:-]*)?)"), F.lit(1)))


def pdf_links(body: Column) -> Column:
    """URI actions of a PDF's plain objects, with escaped characters restored."""
    found = F.regexp_extract_all(_latin(body), F.lit(r"/URI\s*\(((?:\\.|[^\\()]){1,2083})\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"\\(.)", "$1")))


def word_links(body: Column) -> Column:
    """Targets of HYPERLINK fields, in one- or two-byte text."""
    return F.array_distinct(F.regexp_extract_all(F.replace(_latin(body), F.lit("\0"), F.lit("")), F.lit(r'HYPERLINK\s[^"\x13-\x15]{0,64}"([^"]{1,2083})"'), F.lit(1)))


@F.pandas_udf(BinaryType())
def flash_body(body: pd.Series) -> pd.Series:
    """The uncompressed content of Flash files; others and damaged ones as they are."""

    def one(data: bytes) -> bytes:
        if data[:3] != b"CWS":
            return data
        unzip = zlib.decompressobj()
        try:
            return data[:8] + unzip.decompress(data[8:], MOST_BYTES)
        except zlib.error:
            return data

    return body.map(one, na_action="ignore")


def flash_links(body: Column) -> Column:
    """Strings of a Flash file that end at a zero byte and are addresses or paths to files."""
    text = _latin(flash_body(body))
    absolute = F.regexp_extract_all(text, F.lit(r"((?:https?|ftp)://[\x21-\x7E]{3,2083})"), F.lit(1))
    files = F.regexp_extract_all(text, F.lit(r"(?i)(?<=[\x00-\x1F])([\w/.~-]{1,255}\.(?:html?|swf|jpe?g|png|gif|xml|mp3|flv|css|js|php|aspx?|jsp))(?=\x00)"), F.lit(1))
    return F.array_distinct(F.concat(absolute, files))
