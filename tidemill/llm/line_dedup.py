"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus equals it or, for lines of ``fuzzy_chars`` or more, is
within one edit of it; earlier is by doc_id, then line number.  Two lines are within one edit exactly
if they share a variant: both with the same position deleted (a substitution), or one with a position
deleted and the other as it is (an insertion).  All variants are named by hashes and joined, and each
pair found is verified by its edit distance.

A corpus has far too many variants to shuffle them all, so they are emitted in three levels, each for
the lines that met another one on the level before; no level can part two lines within one edit:
halves (an edit leaves the first or the last half alone), sixteenths (it leaves all of the line alone
but one of 16 pieces), single characters of that piece.  Lines whose level-one key is met are fetched
through a bitmap of bounded size, so texts of other lines aren't shuffled.

Equal lines are counted by 128-bit hashes with map-side aggregation; the decision is joined back to
the occurrences with salted keys, so a line that is a third of all lines loads no single task.

Defined results: a null text stays null, without lines; lines are parted by line feeds; blank lines
are layout, never compared and never removed; rows that repeat a doc_id count as one place, so each
keeps the line; null doc_ids come last in order, as one place; of lines that tie, the earliest place stays;
a text's lines are removed in one pass, however many there are; an empty table gives an empty result; other
columns are passed on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, likely_in, mix, powers, salted_left_join, stage_table

FUZZY_CHARS = 20
PIECES = 16
LAST = (1 << 63) - 1


def _place(doc_id: str) -> F.Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def _text_key(text: str) -> F.Column:
    """Tells apart the texts of one doc_id, so that what is removed from each is a group of its own."""
    return F.hash(text)


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(_place("doc_id").alias("o"), _text_key("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.filter(F.length(F.trim("line")) > 0)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(77), "line")})


def _halves(line: str) -> F.Column:
    """Level one: the first and the last half, for the line as the shorter and as the longer one of a pair."""
    n = F.length(line)
    keys = []
    for longer in (0, 1):
        half = F.floor((n - longer) / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), n - longer, F.substr(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), n - longer, F.substr(line, n - half + 1, half)))
    return F.array(*keys)


def _met(keyed: DataFrame) -> DataFrame:
    """(key, id) of the keys that two or more rows have, from sorted rows in one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id, written = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            key, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = np.concatenate(([last_key is not None and key[0] == last_key], key[1:] == key[:-1]))
            out = same.copy()
            out[:-1] |= same[1:]
            keys, ids = key[out], id_[out]
            if same[0] and not written:
                keys, ids = np.append(keys, last_key), np.append(ids, last_id)
            last_key, last_id, written = key[-1], id_[-1], bool(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])

    arrow_limits(keyed.sparkSession)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long")


class _Prefix:
    """Hashes of parts of a line from prefix sums over its code points."""

    def __init__(self, line: str) -> None:
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = n = len(codes)
        self.power, self.inverse = powers(n + 2)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes) * self.power[:n], out=self.total[1:])

    def first(self, k: np.ndarray) -> np.ndarray:
        return self.total[k]

    def last(self, k: np.ndarray) -> np.ndarray:
        """Of the last k code points, wherever the line begins."""
        return (self.total[self.n] - self.total[self.n - k]) * self.inverse[self.n - k]

    def without(self, i: np.ndarray) -> np.ndarray:
        """Of the line without position i."""
        return mix(self.total[i] + (self.total[self.n] - self.total[i + 1]) * self.inverse[1]) + np.uint64(self.n - 1)

    def whole(self) -> np.uint64:
        return mix(self.total[self.n :])[0] + np.uint64(self.n)


def _piece_keys(line: str, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Level two: for both lengths of the shorter line and each piece, what is left and right of it."""
    p = _Prefix(line)
    keys, which = [], []
    j = np.arange(pieces)
    for longer in (0, 1):
        m = p.n - longer
        left, right = j * m // pieces, m - (j + 1) * m // pieces
        keys.append(mix(p.first(left) * np.uint64(3) + mix(p.last(right) + np.uint64(m)) + j.astype(np.uint64)))
        which.append(j + pieces * longer)
    return np.concatenate(keys).view(np.int64), np.concatenate(which)


def _second_level(found: DataFrame, pieces: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(i, 256).to_numpy()
                keys = [_piece_keys(x, pieces)[0] for x in batch.column(1).slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, 2 * pieces))], names=["key", "id"])

    arrow_limits(found.sparkSession)
    return found.select("id", "line").mapInArrow(run, "key long, id long")


def _variants(met: DataFrame, pieces: int) -> DataFrame:
    """Level three, from (id, line, keys met): each line as it is (position -1) and with one position of a met piece deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out: tuple[list, list, list] = ([], [], [])
                for id_, line, keys in zip(*(c.slice(i, 64).to_pylist() for c in batch.columns)):
                    p = _Prefix(line)
                    own, which = _piece_keys(line, pieces)
                    at = []
                    for w in which[np.isin(own, np.array(keys, np.int64))]:
                        m, j = p.n - (w >= pieces), w % pieces
                        # a longer line may have its extra character at either end of the piece
                        at.append(np.arange(j * m // pieces, min((j + 1) * m // pieces + 1, p.n)))
                    at = np.unique(np.concatenate(at))
                    out[0].append(np.concatenate((np.array([p.whole()], np.uint64), p.without(at))).view(np.int64))
                    out[1].append(np.concatenate(([-1], at)))
                    out[2].append(np.full(len(at) + 1, id_))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, ("i8", "i4", "i8"))], names=["v", "at", "id"])

    return met.select("id", "line", "keys").mapInArrow(run, "v long, at int, id long")


def _near(docs: DataFrame, distinct: DataFrame, fuzzy_chars: int, pieces: int) -> DataFrame:
    """(h1, h2) of the lines that an earlier line is within one edit of, but not equal to."""
    keyed = distinct.filter(F.col("halves").isNotNull()).select(F.explode("halves").alias("key"), F.col("h1").alias("id")).distinct()
    ids = stage_table(_met(keyed).select("id").distinct(), "met")
    lines = _lines(docs).filter(F.length("line") >= fuzzy_chars).withColumn("id", F.col("h1"))
    lines = likely_in(lines, "id", ids, ids.count())  # lines that come through by chance meet no other one below
    found = lines.groupBy("id", "h2").agg(F.min(F.struct("o", "n")).alias("place"), F.first("line").alias("line"))
    found = stage_table(found.select("id", "h2", "place", "line"), "lines")
    met = _met(_second_level(found, pieces).distinct()).groupBy("id").agg(F.collect_set("key").alias("keys"))
    rows = stage_table(_variants(found.join(met, "id"), pieces).join(found.select("id", "place"), "id"), "variants")
    member = F.struct("place", "id")
    deleted, whole = rows.filter("at >= 0"), rows.filter("at < 0")
    same_place = deleted.groupBy("v", "at").agg(F.min(member).alias("other"))
    shorter = whole.select("v", member.alias("other"))
    longer = deleted.groupBy("v").agg(F.min(member).alias("other"))
    pairs = deleted.join(same_place, ["v", "at"]).select("id", "place", "other")
    pairs = pairs.union(deleted.join(shorter, "v").select("id", "place", "other")).union(whole.join(longer, "v").select("id", "place", "other"))
    pairs = pairs.filter("other.place < place").select("id", F.col("other.id").alias("other")).distinct()
    one = found.select("id", "h2", "line")
    two = found.select(F.col("id").alias("other"), F.col("line").alias("other_line"))
    near = F.levenshtein("line", "other_line", 1)
    return pairs.join(one, "id").join(two, "other").filter(near.between(0, 1)).select(F.col("id").alias("h1"), "h2").distinct()


def repeated_lines(docs: DataFrame, fuzzy_chars: int = FUZZY_CHARS, pieces: int = PIECES) -> DataFrame:
    """(o, t, gone): for each doc_id (the largest long for null) and text the sorted (line number, line hash) to remove."""
    lines = _lines(docs)
    halves = F.when(F.length("line") >= fuzzy_chars, _halves("line"))
    distinct = lines.withColumn("halves", halves).groupBy("h1", "h2").agg(F.min(F.struct("o", "n")).alias("first"), F.count("*").alias("count"), F.first("halves").alias("halves"))
    distinct = stage_table(distinct, "distinct")
    near = _near(docs, distinct, fuzzy_chars, pieces).withColumn("near", F.lit(True))
    decided = distinct.select("h1", "h2", "first", "count").join(near, ["h1", "h2"], "left").filter("count > 1 or near")
    decided = decided.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    at = salted_left_join(lines.select("o", "t", "n", "h1", "h2"), decided, ["h1", "h2"], "o")
    at = at.filter(F.col("first").isNotNull() & (F.col("near") | (F.struct("o", "n") != F.col("first"))))
    return at.groupBy("o", "t").agg(F.sort_array(F.collect_set(F.struct("n", "h1"))).alias("gone"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines removed from text; two columns follow the others: n_lines, n_removed (long)."""
    gone = repeated_lines(docs, **options)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    joined = docs.select(row, _place("doc_id").alias("o"), _text_key("text").alias("t")).join(gone, ["o", "t"], "left")
    # lines and what goes are bound to variables, so that no filter above parts the text anew for each line
    bound = F.array(F.struct(F.split("row.text", "\n").alias("ls"), F.col("gone").alias("gone")))
    # texts whose keys collide share a group: what isn't this text's line is passed over
    own = F.transform(bound, lambda s: F.struct(s["ls"].alias("ls"), F.filter(s["gone"], lambda g: F.coalesce(F.xxhash64(F.get(s["ls"], g["n"])) == g["h1"], F.lit(False))).alias("gone")))
    begin = lambda s, k: F.when(k == 0, 0).otherwise(F.get(s["gone"], k - 1)["n"] + 1)
    between = lambda s: F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda k: F.slice(s["ls"], begin(s, k) + 1, F.coalesce(F.get(s["gone"], k)["n"], F.size(s["ls"])) - begin(s, k)))
    kept = F.get(F.transform(own, lambda s: F.when(F.size(s["gone"]) > 0, F.flatten(between(s)))), F.lit(0))
    joined = joined.select("row", F.size(F.split("row.text", "\n")).alias("lines"), F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.col("lines"))
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*columns, n.cast("long").alias("n_lines"), F.coalesce(n - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"))


#: Variants are compared by 64-bit hashes here too; positions tell substitutions from other pairs of edits.
SQL = r"""
with line as (
    select doc_id, n, string_split(text, chr(10))[n] as l from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(n)
), distinct_line as (
    select l, min((doc_id, n)) as place from line where trim(l) <> '' group by l
), variant as (
    select l, place, p, hash(left(l, p - 1) || substr(l, p + 1)) as v, length(l) - 1 as m from distinct_line, unnest(range(1, length(l) + 1)) as u(p) where length(l) >= 20
), self as (
    select l, place, hash(l) as v, length(l) as m from distinct_line where length(l) >= 20
), same_place as (
    select v, m, p, min(place) as earliest from variant group by v, m, p
), longer as (
    select v, m, min(place) as earliest from variant group by v, m
), near as (
    select l from variant join same_place using (v, m, p) where earliest < place
    union select a.l from variant a join self b on a.v = b.v and a.m = b.m where b.place < a.place
    union select b.l from self b join longer a on a.v = b.v and a.m = b.m where a.earliest < b.place
), judged as (
    select line.doc_id, line.n, line.l, trim(line.l) <> '' and ((line.doc_id, line.n) <> d.place or near.l is not null) as gone
    from line left join distinct_line d on d.l = line.l left join near on near.l = line.l
)
select doc_id, coalesce(string_agg(l, chr(10) order by n) filter (not coalesce(gone, false)), '') as text,
    count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_removed
from judged group by doc_id
"""
