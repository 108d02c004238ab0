"""Benchmark decontamination with suffix arrays of the training text.

Each shard (``SHARD_BYTES`` of documents) gets a suffix array over its words.  Every suffix of the test items is
binary-searched in it by its first ``window`` words: the range found holds all its matches of that length, and
matches that follow one another along a diagonal are one longest match, with its places in item and document.
Suffixes that begin alike are searched once, and those whose first two words never follow one another in the
shard not at all.  Of the training text only suffixes that can start a match are indexed: those whose next words
all occur in the test set.  That is exact, and small when most training words don't.

The test set is the query set: it is compiled on the driver in blocks of ``block_words`` words, each
broadcast to the tasks; a larger test set takes more passes, whose results are added to the rows.

Words: A-Z lower-cased, then runs of ``[0-9a-z]`` and non-ASCII characters.  A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined results: a null or empty text has no words and no hits; a null item text, or one without
words, is never found; items that repeat are each reported; a null item_id is ignored; repeated
documents are each returned; a null doc_id is kept as it is; of longest matches that tie the first in the
document is named; a very long text is a shard of its own; an empty test set finds nothing; empty documents
give an empty result; other columns never clash, as only doc_id and text are read (``remove_contaminated`` passes all on).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, stage_table

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 8 << 20

#: A-Z to a-z; other bytes that aren't of words to the blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class TestBlock:
    """Part of the test set: its vocabulary, its distinct windows by length and where they occur in items."""

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.item_ids = [i for i, _ in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.shortest = min((min(len(ws), window) for _, ws in items), default=0)
        self.longest = max((len(ws) for _, ws in items), default=0)
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, (_, ws) in enumerate(items):
            ids = tuple(self.vocabulary[w] for w in ws)
            for k in range(max(1, len(ids) - window + 1)):
                places.setdefault(ids[k : k + window], []).append((i, k))
        self.windows = []  # (length, matrix of word ids, places of each row)
        for length in sorted({len(w) for w in places}):
            rows = sorted(w for w in places if len(w) == length)
            self.windows.append((length, np.array(rows, np.int32), [places[w] for w in rows]))


def blocks(items: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """The test set in blocks; rows come to the driver one partition at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        ws = words(row[1].encode() if row[1] else None)
        if row[0] is None or not ws:
            continue
        block.append((row[0], ws))
        size += len(ws)
        if size >= block_words:
            yield TestBlock(block, window)
            block, size = [], 0
    if block:
        yield TestBlock(block, window)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ids in order of their first ``depth`` words, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth and rank.max(initial=0) < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + follow, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def search(ids: np.ndarray, order: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of words, the range of the suffix array whose suffixes start with it."""
    n, length = len(order), rows.shape[1]
    padded = np.concatenate((ids, np.zeros(length, ids.dtype)))

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        for _ in range(int(n).bit_length() + 1):
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) >> 1
            at = order[middle]
            sign = np.zeros(len(open_), np.int8)
            todo = np.arange(len(open_))
            for k in range(length):
                a, b = padded[at[todo] + k], rows[open_[todo], k]
                sign[todo] = np.where(a < b, -1, np.where(a > b, 1, 0))
                todo = todo[a == b]
                if not len(todo):
                    break
            right = (sign <= 0) if upper else (sign < 0)
            lo[open_] = np.where(right, middle + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], middle)
        return lo

    return bound(False), bound(True)


def scan(block: TestBlock, texts: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[list[tuple[int, int, int]]]]:
    """For each text: number of words, which words are hit, (item, item word, text word) of each window found."""
    get = block.vocabulary.get
    n_words, pieces, owners, froms, hit = [], [], [], [], []
    for t, text in enumerate(texts):
        ids = np.array([get(w, 0) for w in words(text)], np.int32)
        n_words.append(len(ids))
        hit.append(np.zeros(0, bool))
        if len(ids) < block.shortest:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).view(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= block.shortest:
                pieces += [ids[a:b], np.zeros(1, np.int32)]
                owners.append(t)
                froms.append(a)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if pieces:
        ids = np.concatenate(pieces)
        begins = np.cumsum([0, *(len(p) for p in pieces)])[:-1:2]
        order = suffix_array(ids, block.longest)
        first = np.zeros(len(block.vocabulary) + 1, bool)
        first[ids] = True
        pair = lambda a, b: a.astype(np.int64) * len(first) + b
        pairs = np.unique(pair(ids[:-1], ids[1:]))
        for length, rows, places in block.windows:
            likely = first[rows[:, 0]]
            if length > 1:
                likely &= np.isin(pair(rows[:, 0], rows[:, 1]), pairs)
            likely = np.flatnonzero(likely)
            lo, hi = search(ids, order, rows[likely])
            for n in np.flatnonzero(lo < hi):
                r = likely[n]
                at = order[lo[n] : hi[n]]
                piece = np.searchsorted(begins, at, "right") - 1
                for p, position in zip(piece, at - begins[piece]):
                    t, position = owners[p], int(froms[p] + position)
                    if not len(hit[t]):
                        hit[t] = np.zeros(n_words[t], bool)
                    hit[t][position : position + length] = True
                    found[t] += [(i, k, position) for i, k in places[r]]
    return n_words, hit, found


def longest(found: list[tuple[int, int, int]], lengths: Callable[[int], int], window: int) -> list[tuple[int, int, int, int]]:
    """(item, item word, text word, words) of the longest matches: windows that follow one another, joined."""
    out: list[tuple[int, int, int, int]] = []
    for i, k, position in sorted(found, key=lambda x: (x[0], x[2] - x[1], x[2])):
        n = min(window, lengths(i))
        if out and out[-1][0] == i and out[-1][2] - out[-1][1] == position - k and out[-1][2] + out[-1][3] - n + 1 == position:
            out[-1] = (*out[-1][:3], out[-1][3] + 1)
        else:
            out.append((i, k, position, n))
    return out


_FIELDS = "n_words long, hits array<struct<a:int,b:int>>, items array<string>, best struct<n:long,at:long>"


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8))).tolist()
    return list(zip(edge[::2], edge[1::2]))


def find_contamination(docs: DataFrame, items: DataFrame, keep: list, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns and n_words, hits (ranges of hit words), items (item_ids found, as strings, sorted), best.

    best: the words of the longest verbatim match and where it begins; null where there is none.
    """
    spark = docs.sparkSession
    names = docs.select(*keep).columns
    todo = blocks(items, window, block_words)
    block, following = next(todo, None), next(todo, None)
    if block is None:

        def count():
            return lambda texts: [[len(words(t)) for t in texts], [[] for _ in texts], [[] for _ in texts], [None] * len(texts)]

        return map_texts(docs, keep, _FIELDS, count)
    # the text is passed on only while there are blocks to come
    text = [F.col("text").cast("string").alias("_t")] if following else []
    state = map_texts(docs, [*keep, *text], _FIELDS, _finder(spark, block, window), limit=SHARD_BYTES)
    while following:
        state = stage_table(state, "passes")  # one pass ends before the next one's block is sent
        before = [F.col(c).alias(f"_{c}") for c in ("hits", "items", "best")]
        more = map_texts(state, [*names, "_t", *before], _FIELDS, _finder(spark, following, window), text="_t", limit=SHARD_BYTES)
        following = next(todo, None)
        better = F.col("_best").isNull() | (F.col("best.n") > F.col("_best.n")) | ((F.col("best.n") == F.col("_best.n")) & (F.col("best.at") < F.col("_best.at")))
        best = F.when(F.col("best").isNotNull() & better, F.col("best")).otherwise(F.col("_best"))
        text = ["_t"] if following else []
        state = more.select(*names, *text, "n_words", F.concat("_hits", "hits").alias("hits"), F.array_sort(F.array_union("_items", "items")).alias("items"), best.alias("best"))
    return state


def _sizes(block: TestBlock) -> dict[int, int]:
    """Words of each item."""
    sizes: dict[int, int] = {}
    for length, _, places in block.windows:
        for row in places:
            for i, k in row:
                sizes[i] = max(sizes.get(i, 0), k + length)
    return sizes


def _finder(spark: SparkSession, block: TestBlock, window: int) -> Callable:
    shared = spark.sparkContext.broadcast(block)

    def make():
        block = shared.value
        sizes = _sizes(block)

        def f(texts: list[bytes | None]) -> list[list]:
            n_words, hit, found = scan(block, texts)
            ids = [sorted({block.item_ids[i] for i, _, _ in x}) for x in found]
            best = [max(((n, -p) for _, _, p, n in longest(x, sizes.__getitem__, window)), default=None) for x in found]
            return [n_words, [[{"a": a, "b": b} for a, b in _ranges(h)] for h in hit], ids, [x and {"n": x[0], "at": -x[1]} for x in best]]

        return f

    return make


def _covered(hits: str) -> F.Column:
    """Words within the union of ranges that may overlap: a fold over the ranges in order."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def step(state, x):
        new = F.greatest(x["b"] - F.greatest(x["a"], state["to"]), F.lit(0))
        return F.struct(F.greatest(state["to"], x["b"]).alias("to"), (state["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_longest, longest_at, items, hits."""
    found = find_contamination(docs, items, [F.col("doc_id")], **options)
    n_hit = _covered("hits")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("best.n", F.lit(0).cast("long")).alias("n_longest"),
        F.col("best.at").alias("longest_at"),
        "items",
        "hits",
    )


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_word, doc_word, n_words): the longest verbatim matches and their places."""
    spark = docs.sparkSession
    out = None
    for block in blocks(items, window, block_words):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared):
            block = shared.value
            sizes = _sizes(block)

            def f(texts: list[bytes | None]) -> list[list]:
                _, _, found = scan(block, texts)
                return [[[dict(zip(("item_id", "item_word", "doc_word", "n_words"), (block.item_ids[i], k, p, n))) for i, k, p, n in longest(x, sizes.__getitem__, window)] for x in found]]

            return f

        one = map_texts(docs, ["doc_id"], "found array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>", make, limit=SHARD_BYTES)
        one = one.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id string, item_word int, doc_word int, n_words int")
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold a window of an item; all columns are passed on."""
    found = find_contamination(docs, items, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")], **options)
    return found.filter(F.size("hits") == 0).select("_row.*")


SQL = r"""
with recursive item as (
    select row_number() over () as i, item_id::varchar as item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
    from benchmark where text is not null and item_id is not null
), win as (
    select distinct i, item_id, k as j, least(10, len(ws)) as n, array_to_string(ws[k:k + 9], ' ') as w
    from item, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as u(k) where len(ws) > 0
), doc as (
    select doc_id, row_number() over () as r,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws
    from documents
), spot as (
    select r, k, n, array_to_string(ws[k:k + n - 1], ' ') as w
    from doc, (select distinct n from win) l, unnest(range(1, len(ws) - n + 2)) as u(k) where len(ws) >= n
), found as (
    select spot.r, spot.k, spot.n, win.item_id, win.i, win.j from spot join win on win.n = spot.n and win.w = spot.w
), hit as (
    select r, count(distinct u.at_word) as n_hit from found, unnest(range(k, k + n)) as u(at_word) group by r
), run as (
    select r, n, k, k - row_number() over (partition by r, i, k - j order by k) as g, i, k - j as d from found
), longest as (
    select r, max(words) as n_longest, min(begin_at) filter (words = most) as longest_at
    from (select *, max(words) over (partition by r) as most from (select r, n + count(*) - 1 as words, min(k) - 1 as begin_at from run group by r, i, d, g, n)) group by r
), ids as (
    select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from found) group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_longest, 0)::bigint as n_longest, longest_at::bigint as longest_at
from doc left join hit using (r) left join ids using (r) left join longest using (r)
"""
