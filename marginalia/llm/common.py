"""What the operators share: scratch tables, Arrow text buffers and vectorised 64-bit hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import importable

U64 = np.uint64


def _return_memory() -> None:
    """Large arrays are mapped each for itself and go back to the system when they are freed, in the long-lived Python
    workers too; Arrow's buffers come from the same allocator."""
    try:
        ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD of the C library, where it has one
    except (AttributeError, OSError):
        return
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; without one (tests, one machine) a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_table(spark: SparkSession, name: str) -> str:
    """A new table's place in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"


#: Row groups of tables whose rows are megabytes each; the writer else looks at its size after 100 rows only.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once and outlives executors. With large_rows
    a task that writes or reads it holds a row group of about 16 MB, however many rows fall to it."""
    spark, path = df.sparkSession, new_table(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def single_rows(spark: SparkSession) -> Iterator[None]:
    """For what runs inside, Python is sent rows of megabytes one by one, not all of a partition's in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession, rows: int, per: int) -> int:
    """Buckets for so many rows with at most about `per` in each."""
    return max(1, -(-rows // per))


def crc_mod(doc_id: int | None, mod: int) -> int:
    """crc32 of the id as text, modulo mod; a null id counts as 0."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string array; null counts as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes, or a single text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


# A-Z to lower case; white space (20, 09-0D) to a space. Bytes of longer UTF-8 sequences stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def word_spans(norm: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without spaces; a text's end also ends a word."""
    if not len(norm):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = norm != 32
    edge = np.zeros(len(norm) + 1, bool)
    edge[off] = True
    before = np.empty(len(norm), bool)
    before[0] = False
    before[1:] = full[:-1]
    before[edge[:-1]] = False
    after = np.empty(len(norm), bool)
    after[-1] = False
    after[:-1] = full[1:]
    after[edge[1:]] = False
    return np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes (sorted, apart), from prefix sums of a polynomial; a few MB at a time."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + STEP_BYTES, "right")))
        own = data[low : int(end[j - 1])]
        up, down = _power_tables(len(own))
        sums = np.zeros(len(own) + 1, U64)
        np.cumsum((own.astype(U64) + U64(1)) * up[: len(own)], out=sums[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


#: Bits of a bitmap for each of its members, and the most that one has: 128 MB, reached with some 10 ** 8 members. Beyond
#: that it fills up and rules out less, and what it doesn't rule out is still joined exactly.
MAP_SHARE, MAP_MOST = 8, 30
_PIECE = 19  # bits of 64 KB, made by one task


def bitmap(nodes: DataFrame) -> bytes:
    """Bit of every 64-bit hash in the first column, in a bitmap of a size that follows the number of rows. Pieces are
    made on the executors, each from the hashes that fall to it. A hash without its bit is not a member."""
    column = F.col(nodes.columns[0])
    bits = min(MAP_MOST, max(_PIECE, (MAP_SHARE * max(nodes.count(), 1) - 1).bit_length()))

    def mark(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << _PIECE, bool)
        own[(table["h"].to_numpy().view(U64) >> U64(64 - bits)) & U64((1 << _PIECE) - 1)] = True
        return pa.table([table["k"][:1].cast(pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["k", "bits"])

    piece = F.shiftrightunsigned(column, 64 - (bits - _PIECE)).cast("int") if bits > _PIECE else F.lit(0)
    out = bytearray(1 << (bits - 3))
    for r in nodes.filter(column.isNotNull()).select(piece.alias("k"), column.alias("h")).groupBy("k").applyInArrow(mark, "k int, bits binary").collect():
        out[r["k"] << (_PIECE - 3) : (r["k"] + 1) << (_PIECE - 3)] = r["bits"]
    return bytes(out)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit."""
    place = hashes.view(U64) >> U64(64 - (8 * len(bits)).bit_length() + 1)
    return ((bits[(place >> U64(3)).astype(np.int64)] >> (U64(7) - (place & U64(7))).astype(np.uint8)) & 1).astype(bool)


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit hash of a row's id and text; a null text counts as empty."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that don't go. gone: (doc_id, key, stays), each key once, with key as
    from row_key(); of the rows of a key none is left, or where it stays one.

    Helper columns have names of their own that no table has. A bitmap of the keys is broadcast, so texts of rows that
    certainly stay aren't shuffled.
    """
    mark = uuid.uuid4().hex
    key, key_, id_, stays = (f"{x}_{mark}" for x in ("key", "of", "id", "stays"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("stays").alias(stays))
    members = docs.sparkSession.sparkContext.broadcast(bitmap(gone.select(key_)))

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(np.frombuffer(members.value, np.uint8), hashes.to_numpy()))

    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    some = keyed.filter(may(key)).join(gone, (F.col(key) == F.col(key_)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    once = some.filter(F.col(stays)).dropDuplicates([key, id_])
    return keyed.filter(~may(key)).select(*_names(docs)).unionByName(some.filter(F.col(stays).isNull()).select(*_names(docs))).unionByName(once.select(*_names(docs)))


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
