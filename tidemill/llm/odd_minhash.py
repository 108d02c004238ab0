"""MinHash near-duplicates with odd sketches.

Each document's set of 5-word shingles is MinHashed; bands of the samples name candidate pairs, odd
sketches (parity bitmaps of the samples; the population count of a XOR estimates a high similarity
precisely) drop unlikely candidates, the full sets confirm the rest, and components of the confirmed
links make the groups.

Documents with equal sets form one class, of which the first one's text is compared.  In a band's
bucket every member is first compared with the bucket's least class; then, in the buckets that
still hold several components, members of different components are compared in blocks by their
sketches.  So a bucket of many copies costs a comparison a member, yet no candidate pair that could
change the components goes unexamined.

A bucket of many unlike members (pages with one boilerplate) would need too many comparisons.  Beyond
``MOST_COMPARISONS`` its members are joined exactly by their rare shingles instead: of sets alike enough one of the
first n - ceil(share * n) + 1 shingles is common, in any order of all shingles; rare ones come first, so
that pairs which share but boilerplate never meet.

A link at the threshold is missed if no band names it or its sketches estimate less than ``Tuning.least``:
together about 2 in 100,000 for documents, nearly all of it by the estimate.

Defined results: null, empty and blank texts have no set and link with nothing; a text of fewer than
five words has one shingle, its whole sequence; rows with a null doc_id aren't linked (component_id
null, kept true); repeated rows are copies of one another and each is returned; rows of one doc_id with other
texts are each judged by their own text; very long texts are MinHashed in blocks and hold one set in memory; an
empty table gives an empty result; other columns are ignored (``near_duplicates``) or passed on
(``keep_one``, which returns one of rows that repeat both doc_id and text).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, drop_tables, likely_in, map_texts, mix, release_shuffles, salted_left_join, shingle_hashes, stage_table, word_hashes
from .components import connected_components



@dataclasses.dataclass(frozen=True)
class Tuning:
    """share: least intersection and union of a link; size: words of a shingle; bands of rows samples; bits of a sketch."""

    share: tuple[int, int] = (85, 100)
    size: int = 5
    bands: int = 40
    rows: int = 6
    bits: int = 512

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        """Candidates of a lower estimate are dropped: 4.5 standard deviations below the threshold, and what folding adds."""
        j = self.share[0] / self.share[1]
        return j - 4.5 * (j * (1 - j) / self.samples) ** 0.5 - 0.02

    def missed(self, similarity: float) -> float:
        """The probability that no band names a pair of this similarity."""
        return (1 - similarity**self.rows) ** self.bands


DOCUMENTS = Tuning()
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Shingles of the sets in a block that a task verifies against another: 2 MB.
ROOM_SHINGLES = 250_000
#: Comparisons within a bucket beyond which its members are joined by rare shingles.
MOST_COMPARISONS = 1 << 25
#: Tells the second half of a set's key from the first.
_OTHER_HALF = np.uint64(0x5851F42D4C957F2D)


def set_keys(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set of distinct hashes, by where it begins: equal sets have equal ones, whatever their order."""
    return [np.add.reduceat(mix(mix(hashes ^ x)), begin).view(np.int64) for x in (np.uint64(0), _OTHER_HALF)]


def distinct_shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and how many each has."""
    hashes, offsets = shingle_hashes(*word_hashes(texts), size)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def text_keys(hashes: np.ndarray, counts: np.ndarray) -> list[list]:
    """The two halves of the key of each text's set, of what ``distinct_shingles`` gives; none of an empty set."""
    out: list[list] = [[None] * len(counts), [None] * len(counts)]
    some = np.flatnonzero(counts)
    if len(some):
        begin = np.cumsum(counts[some]) - counts[some]
        for column, keys in zip(out, set_keys(hashes, begin)):
            for k, key in zip(some.tolist(), keys.tolist()):
                column[k] = key
    return out


def _keyer(tuning: Tuning):
    """n_shingles, k1 and k2 as the signers give them, without signatures."""

    def keyed(texts: list[bytes | None]) -> list[list]:
        hashes, counts = distinct_shingles(texts, tuning.size)
        return [counts, *text_keys(hashes, counts)]

    return keyed


def _signer(tuning: Tuning):
    bands, rows, samples = tuning.bands, tuning.rows, tuning.samples
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
    factors = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sample_keys = mix(np.arange(samples, dtype=np.uint64))

    def sign(texts: list[bytes | None]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        hashes, offsets = shingle_hashes(*word_hashes(texts), tuning.size)
        for i, j in zip(offsets[:-1], offsets[1:]):
            distinct = np.unique(hashes[i:j])
            out[0].append(len(distinct))
            if not len(distinct):
                for column in out[1:]:
                    column.append(None)
                continue
            key = [int(k[0]) for k in set_keys(distinct, np.zeros(1, np.int64))]
            x = (distinct >> np.uint64(32)).astype(np.uint32)
            least = np.full(samples, 0xFFFFFFFF, np.uint32)
            for k in range(0, len(x), 256):
                block = x[k : k + 256, None] * a
                block += b
                np.minimum(least, block.min(axis=0), out=least)
            wide = least.astype(np.uint64)
            banded = mix((wide.reshape(bands, rows) * factors).sum(axis=1) + np.arange(bands, dtype=np.uint64))
            bits = np.bincount((mix(wide ^ sample_keys) % np.uint64(tuning.bits)).astype(np.int64), minlength=tuning.bits) & 1
            for column, value in zip(out[1:], (*key, banded.view(np.int64), np.packbits(bits.astype(np.uint8)).tobytes())):
                column.append(value)
        return out

    return sign


def estimate(different_bits: np.ndarray, tuning: Tuning) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * different_bits / tuning.bits, 1 - 1e-9)
    return 1 + tuning.bits / (4 * tuning.samples) * np.log1p(-share)


def different_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _sketches(column: pa.Array, tuning: Tuning) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, tuning.bits // 64)


def _buckets(banded: DataFrame) -> DataFrame:
    """(key, rep, center) of the buckets of two or more, from (key, rep).

    Sorted rows are streamed, with one row of state: however many documents a bucket has, none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_rep, last_shared = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            rep = batch.column(1).to_numpy()
            first = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            center = np.where(begin >= 0, rep[begin], last_rep if last_rep is not None else 0)
            shared = ~first  # a bucket's first row is written when its second one comes
            extra_key, extra_rep = [], []
            if shared[0] and not last_shared:
                extra_key.append(last_key)
                extra_rep.append(last_rep)
            opens = np.flatnonzero(first[:-1] & ~first[1:])
            keys = np.concatenate((np.array(extra_key, np.int64), key[opens], key[shared]))
            reps = np.concatenate((np.array(extra_rep, np.int64), rep[opens], rep[shared]))
            centers = np.concatenate((np.array(extra_rep, np.int64), rep[opens], center[shared]))
            last_shared = bool(shared[-1])
            last_key, last_rep = key[-1], center[-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps), pa.array(centers)], names=["key", "rep", "center"])

    ordered = banded.repartition("key").sortWithinPartitions("key", "rep")
    return ordered.mapInArrow(run, "key long, rep long, center long")


def _grouped_classes(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """The classes that may be in a group: of several copies, or in a bucket with another (and a few more, by the bitmap).

    The others meet nothing, so no later join need ship them.
    """
    members = shared.select("rep").distinct()
    single = likely_in(classes.filter("copies = 1"), "rep", members, members.count(), "rep")
    return single.union(classes.filter("copies > 1"))


def _likely(pairs: DataFrame, reps: DataFrame, tuning: Tuning) -> DataFrame:
    """The pairs (a, b) whose odd sketches don't rule a link out."""
    one = reps.select(F.col("rep").alias("a"), F.col("odd").alias("odd_a"))
    other = reps.select(F.col("rep").alias("b"), F.col("odd").alias("odd_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = estimate(different_bits(_sketches(batch.column(2), tuning), _sketches(batch.column(3), tuning)), tuning) >= tuning.least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(close))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def _full_sets(named: DataFrame, reps: DataFrame, docs: DataFrame, tuning: Tuning) -> DataFrame:
    """(rep, full) of the named classes: the sorted distinct shingle hashes, from the text of each one's first document."""
    size = tuning.size

    def make():
        def full(texts: list[bytes | None]) -> list[list]:
            hashes, offsets = shingle_hashes(*word_hashes(texts), size)
            sets = [np.unique(hashes[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            keys = [[int(k[0]) for k in set_keys(s, np.zeros(1, np.int64))] if len(s) else [None, None] for s in sets]
            return [[k[0] for k in keys], [k[1] for k in keys], [s.tobytes() for s in sets]]

        return full

    first = stage_table(reps.join(named.distinct(), "rep").select("rep", "first", "k1", "k2"), "named")
    likely = likely_in(docs, "id", first, first.count(), "first")
    sets = map_texts(likely, ["id"], "k1 long, k2 long, full binary", make)
    # rows of one id may have several texts: the one that is meant has the class's key
    return sets.join(first.withColumnRenamed("first", "id"), ["id", "k1", "k2"]).select("rep", "full")


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, tuning: Tuning) -> DataFrame:
    """The pairs whose full sets have share[1] * intersection >= share[0] * union.

    Pairs that hang together make a room, parted into blocks of about ``ROOM_SHINGLES``; a task gets the
    pairs of two blocks and the sets they name.  So a set is shipped once for each block that its document
    is compared with, not for each pair, and a task's memory is bounded however large a room is.
    """
    arrow_limits(docs.sparkSession)
    share = tuning.share
    room = connected_components(pairs).join(reps.select(F.col("rep").alias("vertex"), "n_shingles"), "vertex")
    blocks = room.groupBy("component").agg(F.ceil(F.sum("n_shingles") / ROOM_SHINGLES).cast("int").alias("blocks"))
    place = room.join(blocks, "component").select("vertex", F.col("component").alias("room"), F.pmod(F.xxhash64("vertex"), "blocks").cast("int").alias("block"))
    placed = pairs.join(place.select(F.col("vertex").alias("a"), "room", F.col("block").alias("i")), "a").join(place.select(F.col("vertex").alias("b"), F.col("block").alias("j")), "b")
    placed = placed.select("room", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a", "b")
    placed = stage_table(placed, "pairs")
    needed = placed.select("room", "i", "j", F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = _full_sets(needed.select("rep"), reps, docs, tuning).join(needed, "rep")
    none = F.lit(None)
    rows = sets.select("room", "i", "j", F.col("rep").alias("a"), none.cast("long").alias("b"), "full")
    rows = rows.union(placed.select("room", "i", "j", "a", "b", none.cast("binary")))

    def verify(table: pa.Table) -> pa.Table:
        pair = table.column("full").is_null()
        one = table.filter(pc.invert(pair))
        full = {k: np.frombuffer(v, np.uint64) for k, v in zip(one.column("a").to_pylist(), one.column("full").to_pylist())}
        todo = table.filter(pair).select(["a", "b"])
        linked = []
        for a, b in zip(todo.column(0).to_pylist(), todo.column(1).to_pylist()):
            x, y = full[a], full[b]
            if share[1] * min(len(x), len(y)) < share[0] * max(len(x), len(y)):
                linked.append(False)
                continue
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            linked.append(share[1] * common >= share[0] * (len(both) - common))
        return todo.filter(pa.array(linked, pa.bool_()))

    return rows.groupBy("room", "i", "j").applyInArrow(verify, "a long, b long")


def _by_rare_shingles(members: DataFrame, reps: DataFrame, docs: DataFrame, tuning: Tuning) -> DataFrame:
    """(key, rep): buckets of the members such that any two sets alike enough share one, by the prefixes of the sets.

    The order of shingles is by the number of members that have them, then by hash; those of one member alone
    take their places in the prefix but make no bucket.
    """
    arrow_limits(docs.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(full, np.int64)
                for k in range(0, len(h), 10_000):
                    part = h[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rep)), pa.array(part)], names=["rep", "h"])

    rows = stage_table(_full_sets(members, reps, docs, tuning).mapInArrow(explode, "rep long, h long"), "shingles")
    counts = rows.groupBy("h").count().filter("count > 1")
    ranked = rows.join(counts, "h", "left").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("c"), "h"))).alias("hs"))
    n = F.size("hs")
    needed = n - F.ceil(n * tuning.share[0] / tuning.share[1] - 1e-9).cast("int") + 1
    prefix = F.filter(F.slice("hs", 1, needed), lambda x: x["c"] > 1)
    return ranked.select("rep", F.explode(prefix).alias("x")).select(F.col("x.h").alias("key"), "rep")


def _across(shared: DataFrame, reps: DataFrame, found: DataFrame, tuning: Tuning, docs: DataFrame | None = None, most: int = MOST_COMPARISONS, smallest: int = 3) -> DataFrame:
    """Likely pairs of different components within buckets that hold several, compared in blocks.

    A bucket's members are those of its least component (most of them, as a rule) and the rest.  Blocks of the
    rest meet one another and all blocks of the others; members of one component never meet for nothing, so a
    bucket of a million copies and one stranger costs a million comparisons.  With ``docs``, members of buckets
    that would need more than ``most`` are joined by their rare shingles.
    """
    member = shared.select("key", "rep").join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
    member = member.select("key", "rep", F.coalesce("component", "rep").alias("component"))
    least = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    # band buckets of two were compared in whole already
    member = member.join(least.filter((F.col("n") >= smallest) & (F.col("lo") != F.col("hi"))), "key").withColumn("rest", F.col("component") != F.col("lo"))
    if docs is not None:
        sizes = member.groupBy("key").agg(F.count_if("rest").alias("rests"), F.count("*").alias("n"))
        hot = stage_table(sizes.filter(F.col("rests").cast("double") * F.col("n") > most).select("key"), "hot")
        if not hot.isEmpty():
            cool = _across(shared.join(hot, "key", "left_anti"), reps, found, tuning)
            rare = stage_table(_by_rare_shingles(member.join(hot, "key", "left_semi").select("rep").distinct(), reps, docs, tuning), "rare")
            return cool.union(_across(rare, reps, found, tuning, smallest=2)).distinct()
    blocks = member.groupBy("key").agg(*(F.ceil(F.greatest(F.count_if(F.col("rest") == r), F.lit(1)) / BLOCK).cast("int").alias(f"blocks_{r}") for r in (True, False)))
    rows = member.join(blocks.toDF("key", "rests", "others"), "key").join(reps.select("rep", "odd"), "rep")
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("others"))).cast("int")
    unit = lambda rest, i, j: F.struct(F.lit(rest).alias("among_rest"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("block", block)
    own = F.concat(F.transform(upto("rests"), lambda k: unit(True, F.least("block", k), F.greatest("block", k))), F.transform(upto("others"), lambda k: unit(False, F.col("block"), k)))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("rest"), own).otherwise(F.transform(upto("rests"), lambda k: unit(False, k, F.col("block"))))))
    rows = rows.select("key", "unit.*", "rest", "block", "rep", "component", "odd")

    def compare(batch: pa.Table) -> pa.Table:
        sketch = _sketches(batch.column("odd"), tuning)
        rest, block, rep, component = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "block", "rep", "component"))
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        among = batch.column("among_rest")[0].as_py()
        left = np.flatnonzero(rest & (block == i))
        right = np.flatnonzero(rest & (block == j)) if among else np.flatnonzero(~rest)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in left:
            fit = right[(component[right] != component[k]) & ((rep[right] > rep[k]) | (not among) | (i != j))]
            fit = fit[estimate(different_bits(sketch[fit], sketch[k]), tuning) >= tuning.least]
            a.append(np.minimum(rep[fit], rep[k]))
            b.append(np.maximum(rep[fit], rep[k]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("key", "among_rest", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, tuning: Tuning = DOCUMENTS, signer: Callable = _signer, most: int = MOST_COMPARISONS) -> DataFrame:
    """(doc_id, n_shingles, component_id, grouped, kept): groups of documents linked by similar shingle sets.

    doc_id may be of any type that has an order, such as a struct; component_id is the least one of the group.
    signer: ``signer(tuning)`` gives the function of texts for ``map_texts``.

    Bands are most of what is signed, so only one copy of them is on disk besides the shuffle that is made or read:
    rows aren't written with them (the keys of sets are worked out again for the result), and they are deleted once
    the buckets are known.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    fields = "n_shingles long, k1 long, k2 long"
    signed = map_texts(docs, ["id"], f"{fields}, bands array<long>, odd binary", lambda: signer(tuning))
    usable = signed.filter("n_shingles > 0 and id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n_shingles"))
    # a class's number is given once, when it is written
    classes = stage_table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    release_shuffles(spark)
    shared = stage_table(_buckets(classes.select(F.explode("bands").alias("key"), "rep")), "buckets")
    release_shuffles(spark)
    reps = stage_table(_grouped_classes(classes.drop("bands"), shared), "reps")
    drop_tables(spark, classes)
    pairs = shared.filter("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    likely = stage_table(_likely(pairs, reps, tuning), "likely")
    links = stage_table(_confirm(likely, reps, docs, tuning), "links")
    found = stage_table(connected_components(links), "components")
    more = stage_table(_across(shared, reps, found, tuning, docs, most).join(likely, ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        links = stage_table(links.union(_confirm(more, reps, docs, tuning)), "links")
        found = stage_table(connected_components(links), "components")
    drop_tables(spark, shared, likely, more, links)
    labels = found.join(reps.select(F.col("rep").alias("vertex"), "first"), "vertex").groupBy("component").agg(F.min("first").alias("label"))
    found = found.join(labels, "component").select(F.col("vertex").alias("rep"), "label")
    classes = reps.select("k1", "k2", "rep", "first", "copies").join(found, "rep", "left")
    classes = classes.filter("copies > 1 or label is not null").select("k1", "k2", F.coalesce("label", "first").alias("class_component"))
    out = salted_left_join(map_texts(docs, ["id"], fields, lambda: _keyer(tuning)), classes, ["k1", "k2"], "id")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("class_component").isNotNull().alias("grouped"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, tuning: Tuning = DOCUMENTS) -> DataFrame:
    """docs with one document of each group: the least doc_id.  All columns are passed on."""
    place = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t")))
    gone = near_duplicates(docs.select(place.alias("doc_id"), "text"), tuning).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), place.alias("_place"))
    kept = marked.join(gone, F.col("_place") == F.col("_gone"), "left_anti")
    # of rows that repeat both id and text one stays; there are few, as a rule none
    again = stage_table(docs.select(place.alias("_again")).dropna().groupBy("_again").count().filter("count > 1").select("_again"), "again")
    if not again.isEmpty():
        repeated = F.col("_place") == F.col("_again")
        kept = kept.join(again, repeated, "left_anti").union(kept.join(again, repeated, "left_semi").dropDuplicates(["_place"]))
    return kept.select("_row.*")


SQL = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') as ws
    from documents
), shingle as (
    select distinct doc_id, array_to_string(ws[k:k + 4], ' ') as s
    from words, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as u(k) where len(ws) > 0
), size as (
    select doc_id, count(*) as n from shingle group by doc_id
), link as (
    select a.doc_id as a, b.doc_id as b from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id
    join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), edge as (
    select a, b from link union all select b, a from link
), reach as (
    select doc_id as a, doc_id as b from documents union select reach.a, edge.b from reach join edge on edge.a = reach.b
), component as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from documents left join size using (doc_id) join component using (doc_id)
"""
