"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A sequence is filled greedily with the longest piece that still fits; then its smallest piece is
replaced with two unpacked pieces that fit the gap so expanded more tightly, where there are such.

Packing looks at lengths alone, so the plan is made over the counts of pieces by length (at most
``capacity`` numbers, aggregated on the executors): the same bin is repeated as often as the counts
allow, which gives what packing bin by bin would.  The pieces then find their places by their rank
among the pieces of their length, from counts by (length, salt).  A length has a salt for each
``SALT_PIECES`` of its pieces, so a window sorts about that many however large the corpus is, and at most
``capacity + pieces / SALT_PIECES`` rows of counts reach the driver.

Tokens: the tokenizer's ids as it gives them with add_special_tokens=False, then ``end_id``.  The tokenizer
parts a text at white space before it merges, so ids are looked up by the strings between, in a table of
bounded size; texts in which normalisation might matter, or that spell one of its added tokens, go through
the tokenizer as a whole.

Defined results: a null text is empty and has the end id alone; only documents of more than ``capacity``
ids are cut, into full pieces and a rest; repeated rows are packed each, in an order that is arbitrary among
equal ones; a null doc_id comes first in that order; very long texts are tokenised one at a time; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_texts, stage_table

CAPACITY, END_ID = 4096, 1
#: Pieces of one length that a task ranks.
SALT_PIECES = 500_000
#: Strings between white space whose ids a task keeps: about 140 MB.
WORDS = 700_000

# What the tokenizer's own pre-tokenizer takes as words, for texts of the plain kind below.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Latin text without combining marks, control or format characters: normalisation only lower-cases it.
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_PLAIN = frozenset(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x17F), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]))


def _bytes_as_letters() -> dict[int, str]:
    """Characters of plain texts as the letters by which byte-level vocabularies write their bytes."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printed)}
    return {p: "".join(letter[b] for b in chr(p).encode()) for p in [*range(0xA0, 0x250), *range(0x2000, 0x2100)]}


class WordIds:
    """ids of whole texts, as little-endian 32-bit numbers, by a table of what white space parts.

    Words that aren't in the table are merged by the vocabulary's model alone, many in one call.
    """

    def __init__(self, path: str, limit: int = WORDS) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        #: What a text must not spell, in any case, to be looked up by its words.
        self.added = tuple(t["content"].lower() for t in parts["added_tokens"])
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
        self.merger = Tokenizer.from_str(json.dumps(parts))
        self.letters = _bytes_as_letters()
        # a word's last token, and no other one, ends in the mark of a word's end
        self.ends = np.zeros(self.merger.get_vocab_size(), bool)
        self.ends[[k for token, k in self.merger.get_vocab().items() if token.endswith("</w>")]] = True
        self.limit = limit
        self.table: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        if len(self.table) + len(new) > self.limit:  # the first strings met are the frequent ones
            self.table = dict(itertools.islice(self.table.items(), self.limit // 4))
        table = self.table
        # most new strings are a word, or a word and a mark that is one of its own
        marked = [w for w in new if w[-1] in ".," and w[:-1].isalpha()]
        words = {w[:-1] for w in marked}.difference(table)
        words.update(w for w in new if w.isalpha())
        self._merge([*words], None)
        ends = {c: table.get(c) or self._whole([c])[0] for c in ".,"}
        table.update([(w, table[w[:-1]] + ends[w[-1]]) for w in marked])
        rest = [w for w in new if w not in table]
        self._merge(rest, [*map(_WORDS.findall, rest)])

    def _merge(self, new: list[str], words: list[list[str]] | None) -> None:
        """Put the ids of strings into the table; words: those that each consists of, if not of itself alone."""
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            if words is None:
                joined, ends = " ".join(some), np.arange(1, len(some) + 1)
            else:
                parts = words[k : k + 1024]
                joined, ends = " ".join(itertools.chain.from_iterable(parts)), np.cumsum([*map(len, parts)])
            [found] = self.merger.encode_batch_fast([joined if joined.isascii() else joined.translate(self.letters)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            after = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
            cuts = [0, *(4 * after[ends]).tolist()]
            ids = ids.tobytes()
            self.table.update(zip(some, [ids[i:j] for i, j in zip(cuts, cuts[1:])]))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        plain = [not b.translate(None, _ASCII) if b.isascii() else _PLAIN.issuperset(set(t)) for b, t in zip(texts, decoded)]
        lower = [t.lower() if ok else "" for t, ok in zip(decoded, plain)]
        split = [t.split() if ok and not any(a in t for a in self.added) else None for t, ok in zip(lower, plain)]
        new = set().union(*filter(None, split)).difference(self.table)
        if new:
            self._learn([*new])
        whole = iter(self._whole([t for t, ws in zip(decoded, split) if ws is None]))
        get = self.table.__getitem__
        try:
            return [next(whole) if ws is None else b"".join(map(get, ws)) for ws in split]
        except KeyError:  # the table was cut back while these texts' strings were learned
            return [next(iter(self([t]))) if len(texts) > 1 else self._whole([t.decode("utf-8", "replace")])[0] for t in texts]


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table for all tasks that a worker process runs."""
    return WordIds(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document."""

    def make():
        ids_of = word_ids(path)
        end = np.array([end_id], "<u4").tobytes()

        def f(texts: list[bytes | None]) -> list[list]:
            gc.disable()  # millions of strings that are in no cycle
            try:
                return cut(texts)
            finally:
                gc.enable()

        def cut(texts: list[bytes | None]) -> list[list]:
            out = []
            for ids in ids_of([t or b"" for t in texts]):
                ids += end
                step = 4 * capacity
                cuts = range(0, len(ids), step)
                out.append([{"piece": k // step, "start": k // 4, "length": len(ids[k : k + step]) // 4, "ids_crc32": zlib.crc32(ids[k : k + step])} for k in cuts])
            return [out]

        return f

    pieces = map_texts(docs, ["doc_id"], "p array<struct<piece:int,start:long,length:long,ids_crc32:long>>", make)
    return pieces.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), from the number of pieces of each length (index 0 to capacity)."""
    left = counts.astype(np.int64).copy()
    bins = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return bins
        taken: dict[int, int] = {}
        gap = capacity
        lengths: list[int] = []
        while gap:
            k = int(np.searchsorted(have, gap, "right")) - 1
            while k >= 0 and left[have[k]] <= taken.get(int(have[k]), 0):
                k -= 1
            if k < 0:
                break
            x = int(have[k])
            times = min(gap // x, int(left[x]) - taken.get(x, 0))
            taken[x] = taken.get(x, 0) + times
            lengths += [x] * times
            gap -= x * times
        if gap and len(lengths) > 1:
            small = lengths[-1]
            free = left.copy()
            for x, n in taken.items():
                free[x] -= n
            # the pair a <= b of the largest sum in (small, small + gap]
            room = small + gap
            have_free = np.flatnonzero(free[: room + 1])
            if len(have_free):
                at = np.searchsorted(have_free, room - have_free, "right") - 1
                ok = at >= 0
                a, b = have_free[ok], have_free[at[ok]]
                # a length can only pair with itself if two such pieces are free: else take the next smaller
                alone = (a == b) & (free[b] < 2)
                below = at[ok] - 1
                a, b = a[~alone | (below >= 0)], np.where(alone, have_free[np.maximum(below, 0)], b)[~alone | (below >= 0)]
                if len(a) and (sums := a + b).max() > small:
                    k = int(sums.argmax())
                    lengths[-1:] = [int(b[k]), int(a[k])]
        use: dict[int, int] = {}
        for x in lengths:
            use[x] = use.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * times
        bins.append((lengths, times))


def plan(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: runs of ranks (length, rank, runs), each a slot of one kind of bin.

    The piece of rank r in a run goes to sequence first + r - rank, at offset.
    """
    rows, used, first = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), first, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "first", "offset"]).sort_values(["length", "rank"])


def place(pieces: DataFrame, capacity: int = CAPACITY, salt_pieces: int = SALT_PIECES) -> DataFrame:
    """pieces with sequence_id and offset.  pieces are read several times: give a table."""
    spark = pieces.sparkSession
    lengths = pieces.groupBy("length").count().toPandas()  # at most capacity rows
    lengths["salts"] = -(-lengths["count"] // salt_pieces)
    hot = spark.createDataFrame(lengths.loc[lengths["salts"] > 1, ["length", "salts"]].astype("int64").values.tolist(), "length long, salts long")
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    salted = pieces.join(F.broadcast(hot), "length", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts).cast("int"))
    counts = salted.groupBy("length", "salt").count().toPandas().sort_values(["length", "salt"])  # at most capacity + pieces / salt_pieces rows
    by_length = np.zeros(capacity + 1, np.int64)
    by_length[lengths["length"].to_numpy()] = lengths["count"].to_numpy()
    runs = plan(best_two_fit(by_length, capacity))
    before = {(r.length, r.salt): int(b) for r, b in zip(counts.itertuples(), counts.groupby("length")["count"].cumsum() - counts["count"])}
    of = {length: tuple(part[c].to_numpy() for c in ("rank", "first", "offset")) for length, part in runs.groupby("length")}
    shared = spark.sparkContext.broadcast((before, of))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(order) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, salt: pd.Series, k: pd.Series) -> pd.DataFrame:
        before, of = shared.value
        sequence, offset = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for (x, s), rows in k.groupby([length, salt]).indices.items():
            rank, first, at = of[x]
            r = before[(x, s)] + k.to_numpy()[rows]
            run = np.searchsorted(rank, r, "right") - 1
            sequence[rows] = first[run] + r - rank[run]
            offset[rows] = at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("p", locate("length", "salt", "k"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stage_table(tokenize(docs, path, capacity, end_id), "pieces"), capacity)
