"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash range, so sketches of very
unequal documents compare by containment, and the union of two sketches is the sketch of both texts
together.  A short text has few hashes there, so a sketch also keeps its ``FLOOR`` least hashes: a text of
that many shingles or fewer is kept whole.  Each sketch is complete below its own limit (the fixed fraction,
or just above the largest hash kept, or the whole range for a text kept whole); two sketches are compared
below the lower limit of both, and merged with it.

A fingerprint is text: the limit in hexadecimal, a colon, the sorted hashes in base64.

Words are the runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than five
words has one shingle.  Defined results: a null text is empty; texts without words have an empty sketch, like
(1) one another and unlike (0) all others; documents come in order of doc_id, null first, then of text; the
last one is followed by the first, a single one by itself; repeated rows follow one another; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, chunks, map_texts, shingle_hashes, stage_table, utf8, word_hashes

FRACTION, FLOOR, SIZE = 1 / 4, 32, 5
WHOLE = (1 << 64) - 1


class Sketch:
    """Sorted hashes, all that the text has up to ``limit``."""

    __slots__ = ("hashes", "limit")

    def __init__(self, hashes: np.ndarray, limit: int) -> None:
        self.hashes, self.limit = hashes, limit

    @classmethod
    def of(cls, distinct: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> Sketch:
        """Of the sorted distinct shingle hashes of a text."""
        if len(distinct) <= floor:
            return cls(distinct, WHOLE)
        limit = max(int(fraction * (WHOLE + 1)) - 1, int(distinct[floor - 1]))
        return cls(distinct[: np.searchsorted(distinct, np.uint64(limit), "right")], limit)

    @classmethod
    def parse(cls, text: str) -> Sketch:
        limit, hashes = text.split(":")
        return cls(np.frombuffer(base64.b64decode(hashes), "<u8"), int(limit, 16))

    def __str__(self) -> str:
        return f"{self.limit:x}:{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    def below(self, limit: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(limit), "right")]

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts together."""
        limit = min(self.limit, other.limit)
        return Sketch(np.union1d(self.below(limit), other.below(limit)), limit)

    def _meet(self, other: Sketch) -> tuple[int, int, int]:
        limit = min(self.limit, other.limit)
        a, b = self.below(limit), other.below(limit)
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        return len(a), len(b), int((both[1:] == both[:-1]).sum())

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity."""
        a, b, both = self._meet(other)
        return both / (a + b - both) if a + b else float(len(self.hashes) == len(other.hashes))

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has."""
        a, _, both = self._meet(other)
        return both / a if a else float(not len(self.hashes))


def sketches(texts: list[bytes | None], fraction: float = FRACTION, floor: int = FLOOR, size: int = SIZE) -> list[Sketch]:
    hashes, offsets = shingle_hashes(*word_hashes(texts), size)
    return [Sketch.of(np.unique(hashes[i:j]), fraction, floor) for i, j in zip(offsets[:-1], offsets[1:])]


def fingerprints(docs: DataFrame, keep: list, fraction: float = FRACTION, floor: int = FLOOR, size: int = SIZE) -> DataFrame:
    """The kept columns and fingerprint."""

    def make():
        return lambda texts: [[str(s) for s in sketches(texts, fraction, floor, size)]]

    return map_texts(docs, keep, "fingerprint string", make)


def _edit(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame) -> list[int]:
    """doc_ids that begin the ranges in which documents are compared with the next one: at most 10,000."""
    spark = docs.sparkSession
    n = min(10_000, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()
    # these are doc_ids of rows, so each range's first document is known
    return sorted({cuts[0], *cuts[1]}) if cuts[0] is not None else []


def compare_with_next(docs: DataFrame, fraction: float = FRACTION, floor: int = FLOOR, size: int = SIZE) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points replaced by the first ones of the next document.
    Documents are parted into ranges of doc_id; the first document of each range is also sent to the range
    before it, as that one's last next document.  So texts are shuffled once and ranges don't depend on each
    other.  Within a range rows are streamed in order and two texts are held at a time.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    begins = _ranges(rows)
    first_null = not rows.filter("doc_id is null").isEmpty()
    last = len(begins) - 1
    home = _range_of(begins) if begins else F.lit(0)
    rows = rows.withColumn("home", home)
    is_first = F.col("doc_id").isNull() if first_null else F.col("doc_id") == (begins[0] if begins else None)
    before = F.when(is_first, F.lit(max(last, 0)))
    if begins:
        before = before.when(F.col("doc_id").isin(begins[1:]), F.col("home") - 1)
    home = F.col("home")
    rows = rows.withColumn("at", F.filter(F.array(F.struct(home.alias("range"), F.lit(False).alias("borrowed")), F.struct(before.alias("range"), F.lit(True).alias("borrowed"))), lambda x: x["range"].isNotNull()))
    rows = rows.select("doc_id", "text", F.explode("at").alias("at")).select("at.range", "at.borrowed", "doc_id", "text")
    ordered = rows.repartition("range").sortWithinPartitions("range", "borrowed", F.asc_nulls_first("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, bytes]] = []

        def flush(rows: list) -> pa.RecordBatch:
            """Results of the rows that have a next row in the list."""
            texts = [r[3] for r in rows]
            todo = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            plain = [t.decode("utf-8", "replace") for t in texts]
            edited = [_edit(plain[k], plain[k + 1]).encode() for k in todo]
            own, changed = sketches(texts, fraction, floor, size), sketches(edited, fraction, floor, size) if edited else []
            columns: list[list] = [[] for _ in names]
            for k, e, s in zip(todo, edited, changed):
                same_edit, same_next = e == texts[k], texts[k] == texts[k + 1]
                values = (rows[k][2], len(plain[k]), hashlib.sha256(e).hexdigest(), str(own[k]), str(s), 1.0 if same_edit else own[k].likeness(s), 1.0 if same_next else own[k].likeness(own[k + 1]))
                for column, value in zip(columns, values):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            ranges, borrowed, ids, texts = (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)))
            for i, j in chunks(texts):
                rows = held + list(zip(ranges[i:j], borrowed[i:j], ids[i:j], texts[i:j]))
                yield flush(rows)
                held = rows[-1:]

    return ordered.mapInArrow(run, schema)


def _range_of(begins: list[int], step: int = 100) -> F.Column:
    """Index of the range that holds doc_id (0 for null), found in two steps: among every 100th begin, then between."""
    typed = lambda values: F.array(*map(F.lit, values)).cast("array<long>")
    reached = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    coarse = F.greatest(reached(typed(begins[::step])) - 1, F.lit(0)) * step
    return F.greatest(coarse + reached(F.slice(typed(begins), coarse + 1, step)) - 1, F.lit(0)).cast("int")
