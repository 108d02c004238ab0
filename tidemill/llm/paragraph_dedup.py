"""Substring dedup: paragraph MinHash banding, and repeated passages inside paragraphs.

Paragraphs are the lines that aren't blank, however short.  Those with equal sets of 5-word shingles are one class
(a line of fewer words has one shingle, all its words).  The sets are MinHashed, with bands tuned for recall; colliding
paragraphs are verified by exact Jaccard similarity on the full sets, and the components of the links are the clusters.
A pair at the threshold is missed about once in 1,100: by the bands (``PARAGRAPHS``) 0.4 and by the sketches' estimate
0.5 times in 1,000.  A set so small that one more shingle takes it below the threshold can only equal another, so it
needs no bands.

A passage that documents share may lie within longer paragraphs that are unlike as wholes.  So of the windows of
``GRAM`` words of each text those are taken whose hash is the least among ``REACH`` windows in a row (winnowing): equal
passages of ``GRAM + REACH - 1`` = 50 words or more hold one such window in common for certain, wherever they lie and
however lines are broken.  A window that an earlier document has, or an earlier place of its text, is a seed; seeds with
the same earlier document at the same distance that touch are one passage, which then grows word by word to both ends,
as far as the words before and behind it are those of the earlier place (up to where another seed would be due).
Shorter passages of ``GRAM`` words or more are found too where a seed happens to lie in them.  So every word of a passage
of 50 words that an earlier place has is found, but for words at its ends in which only a later one of several earlier
places agrees.

Of what repeats, the earliest occurrence (by doc_id, then place) stays, and all others, within its document or in others,
are to be removed: their rows have kept false.  Rows with kept true name the earliest occurrence, for paragraphs always,
for passages where another document repeats it.

Defined results: null and empty texts have no paragraphs; rows with a null doc_id are left out; rows that repeat
doc_id and text are one document, rows of one doc_id with other texts are parts of it that are numbered alike; very
long texts are parted into windows at once, with memory in proportion; ties of windows go to the first; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, likely_in, map_texts, mix, powers, release_shuffles, stage_table, word_hashes
from .odd_minhash import Tuning, distinct_shingles, near_duplicates, text_keys

GRAM, REACH = 32, 19
PARAGRAPHS = Tuning(share=(80, 100), bands=15, rows=4, bits=128)
#: Shingles whose samples are held at once.
BLOCK_SHINGLES = 4096


def _line_signer(tuning: Tuning):
    """Signatures as of ``near_duplicates``, of all lines of a chunk at once: most lines are short."""
    bands, rows, samples = tuning.bands, tuning.rows, tuning.samples
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 31, (samples, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, (samples, 1), dtype=np.uint32)
    factors = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sample_keys = mix(np.arange(samples, dtype=np.uint64))

    def samples_of(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(line, sample) of the lines that begin at these places of x."""
        out = np.full((len(begin), samples), 0xFFFFFFFF, np.uint32)
        ends = np.append(begin[1:], len(x))
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(ends, begin[i] + BLOCK_SHINGLES, "right")))
            for k in range(begin[i], ends[j - 1], BLOCK_SHINGLES):  # more than once for a long line alone
                block = a * x[k : min(k + BLOCK_SHINGLES, ends[j - 1])] + b
                least = np.minimum.reduceat(block, begin[i:j] - begin[i] if j > i + 1 else [0], axis=1)
                np.minimum(out[i:j], least.T, out=out[i:j])
            i = j
        return out

    def sign(texts: list[bytes | None]) -> list[list]:
        hashes, counts = distinct_shingles(texts, tuning.size)
        out: list[list] = [counts, *text_keys(hashes, counts), *([None] * len(texts) for _ in range(2))]
        links = tuning.share[1] * counts >= tuning.share[0] * (counts + 1)
        wide = np.flatnonzero(links & (counts > 0))
        if not len(wide):
            return out
        x = (hashes[np.repeat(links, counts)] >> np.uint64(32)).astype(np.uint32)
        least = samples_of(x, np.cumsum(counts[wide]) - counts[wide]).astype(np.uint64)
        banded = mix((least.reshape(-1, bands, rows) * factors).sum(axis=2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
        spots = (mix(least ^ sample_keys) % np.uint64(tuning.bits)).astype(np.int64) + tuning.bits * np.arange(len(wide))[:, None]
        bits = np.bincount(spots.ravel(), minlength=tuning.bits * len(wide)).reshape(len(wide), -1) & 1
        for k, keys_, odd in zip(wide.tolist(), banded, np.packbits(bits.astype(np.uint8), axis=1)):
            out[3][k], out[4][k] = keys_, odd.tobytes()
        return out

    return sign


def repeated_paragraphs(docs: DataFrame, tuning: Tuning = PARAGRAPHS) -> DataFrame:
    """(doc_id, at, cluster_id, first_doc_id, first_at, kept) of the paragraphs that are like others; at is the line's number."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    place = F.struct("doc_id", F.col("at").cast("long").alias("at"))
    items = lines.filter(F.col("text").rlike(r"[^\x09-\x0D\x20]")).select(place.alias("doc_id"), "text")
    found = near_duplicates(items, tuning, _line_signer).filter("grouped")
    found = found.select("doc_id.doc_id", "doc_id.at", F.xxhash64("component_id").alias("cluster_id"), F.col("component_id.doc_id").alias("first_doc_id"), F.col("component_id.at").alias("first_at"), "kept").distinct()
    # a paragraph like itself alone is that of a row that repeats
    return found


def seeds(words: np.ndarray, offsets: np.ndarray, gram: int = GRAM, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, hash) of the windows of ``gram`` words that have the least hash of ``reach`` in a row, by winnowing."""
    n = len(words) - gram + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if n < 1:
        return none
    power, inverse = powers(len(words))
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * power)))
    hashes = mix((total[gram:] - total[:-gram]) * inverse[:n])
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    within = np.arange(n) + gram <= offsets[text + 1]  # other windows cross from one text to the next
    at = np.flatnonzero(within)
    if not len(at):
        return none
    hashes, text = hashes[at], text[at]
    # the least of each row of windows, the first of equal ones; a text of fewer windows is one row
    begin = np.searchsorted(text, text)
    size = np.searchsorted(text, text, "right") - begin
    place = np.arange(len(at))
    starts = place[(place - begin) <= np.maximum(size - reach, 0)]
    best = starts.copy()
    end = begin[starts] + size[starts] - 1
    for k in range(1, reach):
        other = np.minimum(starts + k, end[: len(starts)])
        best = np.where(hashes[other] < hashes[best], other, best)
    chosen = np.unique(best)
    return text[chosen], at[chosen] - offsets[text[chosen]], hashes[chosen]


def _agreeing(words: np.ndarray, one: np.ndarray, other: np.ndarray, step: int, most: np.ndarray, reach: int) -> np.ndarray:
    """How many words agree from two places on in one direction, at most ``most`` of each and ``reach``."""
    k = np.arange(reach)
    inside = k < most[:, None]
    last = len(words) - 1
    same = words[np.clip(one[:, None] + step * k, 0, last)] == words[np.clip(other[:, None] + step * k, 0, last)]
    return np.logical_and.accumulate(same & inside, axis=1).sum(axis=1)


def own_repeats(words: np.ndarray, offsets: np.ndarray, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which seeds are the first of their text, and (text, at, n, first_at) of the passages that repeat words of their own text.

    A seed is compared with the last equal one that it doesn't overlap, so words that go round and round are one passage.
    """
    order = np.lexsort((at, hashes, text))
    t, a, h = text[order], at[order], hashes[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    spot = (group << 32) + a
    source = np.searchsorted(spot, spot - gram, "right") - 1
    again = np.flatnonzero((source >= 0) & (group[source] == group))
    firsts = np.sort(order[new])
    t, a, s = t[again], a[again], a[source[again]]
    order = np.lexsort((a, a - s, t))
    t, a, s = t[order], a[order], s[order]
    joined = (t[1:] == t[:-1]) & (a[1:] - s[1:] == a[:-1] - s[:-1]) & (a[1:] <= a[:-1] + gram)
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(t), 1), bool), ~joined)))
    end = np.append(begin[1:], len(t))[: len(begin)] - 1
    t, n, a, s = t[begin], a[end] + gram - a[begin], a[begin], s[begin]
    base = offsets[t]
    behind = _agreeing(words, base + a + n, base + s + n, 1, offsets[t + 1] - base - a - n, reach - 1)
    before = _agreeing(words, base + a - 1, base + s - 1, -1, s, reach - 1)
    return firsts, (t, a - before, n + before + behind, s - before)


def _windows(docs: DataFrame, gram: int, reach: int) -> DataFrame:
    """(doc_id, t, w, own): the first seeds of each text by hash, and its passages that repeat words of its own."""

    def make():
        def f(texts: list[bytes | None]) -> list[list]:
            words, offsets = word_hashes(texts)
            text, at, hashes = seeds(words, offsets, gram, reach)
            firsts, (own, *columns) = own_repeats(words, offsets, text, at, hashes, gram, reach)
            text, at, hashes = text[firsts], at[firsts], hashes[firsts].view(np.int64)
            cuts, own_cuts = (np.searchsorted(x, np.arange(len(texts) + 1)) for x in (text, own))
            spans = list(zip(*(c.tolist() for c in columns)))
            return [
                [{"key": hashes[i:j], "at": at[i:j]} for i, j in zip(cuts[:-1], cuts[1:])],
                [[{"at": a, "n": n, "first_at": s} for a, n, s in spans[i:j]] for i, j in zip(own_cuts[:-1], own_cuts[1:])],
            ]

        return f

    return map_texts(docs, ["doc_id", "t"], "w struct<key:array<long>,at:array<int>>, own array<struct<at:int,n:int,first_at:int>>", make)


def _repeats(windows: DataFrame) -> DataFrame:
    """(doc_id, t, at, first_doc_id, first_t, first_at) of windows that an earlier text has, from sorted rows in one stream.

    The state is the bucket's first row, however many rows a bucket has.
    """
    names = ["doc_id", "t", "at", "first_doc_id", "first_t", "first_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, document, text and place of the bucket's first row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, t, at = columns = [batch.column(k).to_numpy() for k in range(4)]
            opens = np.concatenate(([held is None or key[0] != held[0]], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(key)), -1))
            first_doc, first_t, first_at = (np.where(begin >= 0, x[begin], h) for x, h in zip(columns[1:], (held or (0,) * 4)[1:]))
            again = (doc != first_doc) | (t != first_t)
            held = (key[-1], first_doc[-1], first_t[-1], first_at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (doc, t, at, first_doc, first_t, first_at)], names=names)

    ordered = windows.repartition("key").sortWithinPartitions("key", "doc_id", "t", "at")
    return ordered.mapInArrow(run, "doc_id long, t int, at int, first_doc_id long, first_t int, first_at int")


def _passages(repeats: DataFrame, gram: int) -> DataFrame:
    """(doc_id, t, at, n, first_doc_id, first_t, first_at): seeds of a text on one diagonal that touch are one passage."""
    schema = "doc_id long, t int, at int, n int, first_doc_id long, first_t int, first_at int"

    def merge(table: pa.Table) -> pa.Table:
        at, first, first_t, first_at = (table.column(c).to_numpy() for c in ("at", "first_doc_id", "first_t", "first_at"))
        order = np.lexsort((at, at - first_at, first_t, first))
        at, first, first_t, first_at = at[order], first[order], first_t[order], first_at[order]
        same = (at[1:] <= at[:-1] + gram) & (np.diff(at - first_at) == 0) & (first[1:] == first[:-1]) & (first_t[1:] == first_t[:-1])
        begin = np.flatnonzero(np.concatenate(([True], ~same)))
        end = np.append(begin[1:], len(at)) - 1
        own = [np.full(len(begin), table.column(c)[0].as_py(), t) for c, t in (("doc_id", np.int64), ("t", np.int32))]
        columns = [*own, at[begin], at[end] + gram - at[begin], first[begin], first_t[begin], first_at[begin]]
        return pa.table(dict(zip(("doc_id", "t", "at", "n", "first_doc_id", "first_t", "first_at"), columns)))

    return repeats.groupBy("doc_id", "t").applyInArrow(merge, schema)


def _grown(passages: DataFrame, docs: DataFrame, reach: int) -> DataFrame:
    """passages with the words before and behind them that are those of the earlier place, at most reach - 1 either side.

    Only texts that hold a passage or its first occurrence are read again.  What stands beside a place (32 bits of each
    word's hash) is worked out once for each place of a text, so a text that many others repeat has no more rows than words.
    """
    sides = F.array(*(F.struct(F.lit(side).alias("side"), (F.col("at") + end).alias("at"), (F.col("first_at") + end).alias("first_at")) for side, end in ((False, F.lit(0)), (True, F.col("n")))))
    ends = passages.select("p", "doc_id", "t", "first_doc_id", "first_t", F.explode(sides).alias("s")).select("p", "doc_id", "t", "first_doc_id", "first_t", "s.*")
    places = ends.select("doc_id", "t", "at", "side").union(ends.select("first_doc_id", "first_t", "first_at", "side")).distinct()
    asked = stage_table(places.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("at", "side"))).alias("places")), "places")
    ids = asked.select(F.struct("doc_id", "t").alias("id"))
    texts = likely_in(docs.withColumn("id", F.struct("doc_id", "t")), "id", ids, ids.count())
    texts = texts.select("doc_id", "t", "text").join(asked, ["doc_id", "t"])

    def make():
        def f(texts: list[bytes | None]) -> list[list]:
            words, offsets = word_hashes(texts)
            words = words.astype(np.uint32).view(np.int32)
            return [[words[i:j] for i, j in zip(offsets[:-1], offsets[1:])]]

        return f

    # the words nearest to the place come first
    beside = lambda p: F.when(p["side"], F.slice("words", p["at"] + 1, F.lit(reach - 1))).otherwise(F.reverse(F.slice("words", F.greatest(p["at"] - reach + 2, F.lit(1)), F.least(p["at"], F.lit(reach - 1)))))
    worded = map_texts(texts, ["doc_id", "t", "places"], "words array<int>", make)
    known = worded.select("doc_id", "t", F.explode(F.transform("places", lambda p: F.struct(p["at"], p["side"], beside(p).alias("beside")))).alias("p"))
    known = stage_table(known.select("doc_id", "t", "p.*").dropDuplicates(["doc_id", "t", "at", "side"]), "beside")
    own = ends.join(known.withColumnRenamed("beside", "own"), ["doc_id", "t", "at", "side"])
    first = known.toDF("first_doc_id", "first_t", "first_at", "side", "other")
    # a place that a third of all passages repeats is a skewed key of this join: adaptive execution splits it
    both = own.join(first, ["first_doc_id", "first_t", "first_at", "side"])
    agree = F.zip_with("own", "other", lambda a, b: F.coalesce(a == b, F.lit(False)))
    # the first pair that differs; of none, all agree
    differs = F.array_position(agree, F.lit(False)).cast("int")
    more = F.when(differs > 0, differs - 1).otherwise(F.size(agree))
    grown = both.select("p", "side", more.alias("more")).groupBy("p").agg(*(F.max(F.when(F.col("side") == side, F.col("more"))).alias(name) for side, name in ((False, "before"), (True, "behind"))))
    out = passages.join(grown, "p")
    return out.select("doc_id", "t", (F.col("at") - F.col("before")).alias("at"), (F.col("n") + F.col("before") + F.col("behind")).alias("n"), "first_doc_id", "first_t", (F.col("first_at") - F.col("before")).alias("first_at"))


def repeated_passages(docs: DataFrame, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """(doc_id, at, n_words, cluster_id, first_doc_id, first_at, kept) of verbatim passages that occurred before, and of their first occurrences in other documents.

    at is a word's number; a passage and the first occurrence that it repeats have the same cluster_id.
    """
    docs = docs.filter("doc_id is not null").withColumn("t", F.hash("text"))
    windows = stage_table(_windows(docs, gram, reach), "windows")
    keys = windows.select("doc_id", "t", F.explode(F.arrays_zip("w.key", "w.at")).alias("w")).select("w.key", "doc_id", "t", "w.at")
    passages = stage_table(_passages(_repeats(keys), gram).withColumn("p", F.monotonically_increasing_id()), "passages")
    grown = _grown(passages, docs, reach)
    own = windows.select("doc_id", "t", F.explode("own").alias("o")).select("doc_id", "t", "o.at", "o.n", F.col("doc_id").alias("first_doc_id"), F.col("t").alias("first_t"), "o.first_at")
    grown = stage_table(grown.union(own), "grown")
    drop_tables(docs.sparkSession, windows, passages)
    del keys, windows, passages, own
    release_shuffles(docs.sparkSession)
    cluster = F.xxhash64("first_doc_id", "first_t", "first_at", "n").alias("cluster_id")
    n = F.col("n").cast("long").alias("n_words")
    place = lambda c: F.col(c).cast("long")
    again = grown.select("doc_id", place("at").alias("at"), n, cluster, "first_doc_id", place("first_at").alias("first_at"), F.lit(False).alias("kept"))
    others = grown.filter("doc_id <> first_doc_id or t <> first_t")
    first = others.select(F.col("first_doc_id").alias("doc_id"), place("first_at").alias("at"), n, cluster, "first_doc_id", place("first_at").alias("first_at"), F.lit(True).alias("kept"))
    return again.union(first).distinct()


def repeated_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, at, n_words, cluster_id, first_doc_id, first_at, kept): one row for each paragraph or passage that repeats.

    For kind ``paragraph`` at is the line's number and n_words is null; for ``passage`` at is a word's number.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passages = repeated_passages(docs)
    paragraphs = repeated_paragraphs(docs)
    columns = ("cluster_id", "first_doc_id", "first_at", "kept")
    one = paragraphs.select("doc_id", F.lit("paragraph").alias("kind"), "at", F.lit(None).cast("long").alias("n_words"), *columns)
    return one.union(passages.select("doc_id", F.lit("passage").alias("kind"), "at", "n_words", *columns))
