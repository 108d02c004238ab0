"""Helpers that the operators share: scratch tables, Arrow batches, vectorised word hashes.

Words of the near-duplicate operators: A-Z lower-cased, then the runs of bytes that are not
ASCII white space.  Hashes are 64 bits, the same in every process.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text processed at once; bounds the memory of the vectorised steps.
CHUNK_BYTES = 1 << 20


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts: by rows and by bytes.

    The session's limits are only ever lowered: they count when a result is read, so they can't be put back here.
    """
    for name, most in (("maxRecordsPerBatch", 10_000), ("maxBytesPerBatch", CHUNK_BYTES)):
        digits, unit = re.match(r"(-?\d+)([kmg]?)", spark.conf.get(f"spark.sql.execution.arrow.{name}").lower()).groups()
        if not 0 < int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


# ---- scratch tables

#: Temporary folders of local sessions, by application.
_local: dict[str, str] = {}
#: Tables written and not deleted yet, in order.
_staged: list[str] = []


def _remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the context's checkpoint folder.

    A local session without either gets a temporary one of its own; on a cluster that is an error, as executors
    would write to disks of their own.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(_remove, _local[context.applicationId])
    return f"file://{_local[context.applicationId]}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemill-scratch/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/tidemill-scratch/" in folder:
                _delete(spark, folder)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: Spark's cleaner goes by collected objects."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch_until_written(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged within the block, which must have written its results elsewhere."""
    before = len(_staged)
    yield
    for folder in _staged[before:]:
        _delete(spark, folder)
    del _staged[before:]


def release_scratch(spark: SparkSession) -> None:
    """Delete all staged tables of this application; call it when results have been written."""
    for folder in _staged:
        _delete(spark, folder)
    _staged.clear()


# ---- Arrow batches


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


# ---- hashes

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE = [_U(int(x) | 1) for x in _rng.integers(0, 1 << 64, 8, dtype=np.uint64)]
_powers: list[np.ndarray] = []

#: A-Z to a-z, other ASCII white space to the blank.
FOLD_SPACE = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _hash_words(folded: bytes, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words (or of their first bytes) of blank-separated bytes: differences of a prefix sum."""
    buf = np.frombuffer(folded, np.uint8)
    word = buf != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    power, inverse = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes | None], fold: bytes = FOLD_SPACE, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the offsets of each text's words in them."""
    folded = b" ".join(t or b"" for t in texts).translate(fold) + b" "
    begins = np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
    starts, hashes, at = [], [], 0
    while at < len(folded):  # a long text goes in pieces that end at a blank
        to = len(folded)
        if to - at > 2 * CHUNK_BYTES:
            cut = folded.find(b" ", at + CHUNK_BYTES)
            to = cut + 1 if cut >= 0 else to
        s, h = _hash_words(folded[at:to], prefix)
        starts.append(s + at)
        hashes.append(h)
        at = to
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words and each text's offsets in them.

    A text of fewer words, but not none, has one shingle: its whole sequence.
    """
    n = np.diff(offsets)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], counts)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    left = np.repeat(offsets[1:], counts) - at  # words from here to the text's end
    out = np.minimum(left, size).astype(np.uint64)
    for k in range(size):
        out += np.where(left > k, padded[at + k], _U(0)) * _SHINGLE[k]
    return mix(out), out_offsets


def unique_per_text(hashes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text."""
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield np.unique(hashes[a:b])


# ---- DataFrame helpers


def map_texts(df: DataFrame, keep: list, fields: str, make: Callable, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Run a vectorised function over whole texts and append its columns to the kept ones.

    ``make()`` is called once a task and returns ``f(texts) -> list of columns`` for ``fields`` (DDL);
    texts are UTF-8 bytes or None, at most ``limit`` bytes a call unless one text is longer.  A call gets what several
    Arrow batches hold if the limit has room for them.
    """
    arrow_limits(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("string").alias("_text"))
    added = StructType.fromDDL(fields)
    schema = StructType(source.schema.fields[:-1] + added.fields)
    types = list(to_arrow_schema(added).types)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()

        def called(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            texts = utf8(batch.column(batch.num_columns - 1))
            for i, j in chunks(texts, limit):
                kept = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                new = [pa.array(c, t) for c, t in zip(function(texts[i:j]), types)]
                yield pa.RecordBatch.from_arrays(kept + new, names=names)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            n = batch.column(batch.num_columns - 1).nbytes
            if held and size + n > limit:
                yield from called(held)
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += n
        if held:
            yield from called(held)

    return source.mapInArrow(run, schema)


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Left join for hot keys: rows of a key go to ``salts`` tasks by column ``by``; small is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


#: Most bits of a bitmap: 2 million rows of 16 bytes are broadcast at most.
MOST_BITS = 1 << 27


def likely_in(rows: DataFrame, key: str, ids: DataFrame, n_ids: int, ids_key: str = "id") -> DataFrame:
    """rows whose key may be among the ids, by a broadcast bitmap of hashed ids: all that are, and few others.

    So the others' texts never enter a shuffle.  The bitmap has about 16 bits an id, ``MOST_BITS`` at most: beyond
    that more rows come through, and the exact join that must follow still gives the same result.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(n_ids, 1) - 1).bit_length()))
    spot = F.xxhash64(ids_key).bitwiseAND(bits - 1).alias("s")
    words = ids.select(spot).groupBy(F.expr("shiftright(s, 6)").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("_bits"))
    spotted = rows.withColumn("_spot", F.xxhash64(key).bitwiseAND(bits - 1)).withColumn("_word", F.expr("shiftright(_spot, 6)"))
    found = spotted.join(F.broadcast(words), "_word").filter(F.expr("(_bits & shiftleft(1L, cast(_spot & 63 as int))) <> 0"))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns))
