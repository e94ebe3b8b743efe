"""Exact deduplication over a cuckoo-filter index of live digests.

Every row gives a SHA-256 digest. Rows with equal digests are first combined within each Arrow batch, so a copied text
sends one row per batch, and then meet in the bucket that their digest names. A bucket holds a cuckoo filter: a digest
that the filter doesn't know is new; a hit is verified against the full digests kept in the filter's buckets. A live
entry is deleted and inserted again when a copy with a larger id arrives. A full filter doubles and is refilled from the
stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import partitions, row_key, stored, without

SLOTS, MAX_KICKS = 4, 200


class CuckooIndex:
    """Filter of 16-bit fingerprints with two candidate buckets each, beside the full keys by bucket pair."""

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._reset(max(2, 1 << (buckets - 1).bit_length()))

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]
        self.content: dict[int, list[list]] = {}

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & self.mask
        return print_, one, self._other(one, print_)

    def _other(self, place: int, print_: int) -> int:
        return place ^ ((print_ * 0x5BD1E995) & self.mask)

    def maybe(self, key: bytes) -> bool:
        """Whether the filter knows the fingerprint; false positives occur, false negatives don't."""
        print_, one, two = self._places(key)
        return print_ in self.slots[one] or print_ in self.slots[two]

    def find(self, key: bytes) -> list | None:
        """The live entry [key, value], verified in full."""
        if not self.maybe(key):
            return None
        _, one, two = self._places(key)
        return next((e for e in self.content.get(min(one, two), ()) if e[0] == key), None)

    def insert(self, key: bytes, value: object) -> None:
        """Adds a key that isn't live; a full filter grows first."""
        while not self._place(key):
            self._grow()
        _, one, two = self._places(key)
        self.content.setdefault(min(one, two), []).append([key, value])
        self.size += 1

    def _place(self, key: bytes) -> bool:
        print_, place, two = self._places(key)
        if len(self.slots[place]) >= SLOTS:
            place = two
        trail = []
        for kick in range(MAX_KICKS):
            slots = self.slots[place]
            if len(slots) < SLOTS:
                slots.append(print_)
                return True
            at = kick % SLOTS
            trail.append((place, at, slots[at]))
            slots[at], print_ = print_, slots[at]
            place = self._other(place, print_)
        for place, at, old in reversed(trail):  # nothing is lost when no place is found
            self.slots[place][at] = old
        return False

    def delete(self, key: bytes) -> bool:
        """Takes a live key out; whether there was one."""
        entry = self.find(key)
        if entry is None:
            return False
        print_, one, two = self._places(key)
        (self.slots[one] if print_ in self.slots[one] else self.slots[two]).remove(print_)
        home = self.content[min(one, two)]
        home.remove(entry)
        if not home:
            del self.content[min(one, two)]
        self.size -= 1
        return True

    def _grow(self) -> None:
        live = list(self.entries())
        buckets = (self.mask + 1) * 2
        while True:
            self._reset(buckets)
            if all(self._place(key) for key, _ in live):
                break
            buckets *= 2
        for entry in live:
            _, one, two = self._places(entry[0])
            self.content.setdefault(min(one, two), []).append(entry)

    def entries(self) -> Iterator[list]:
        for home in self.content.values():
            yield from home


INDEX_SCHEMA = "digest binary, doc_id long, uid long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("group_size", pa.int64())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch: its largest (doc_id, uid), null ids lowest, and the number of rows."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).sort_by([("digest", "ascending"), ("doc_id", "ascending"), ("uid", "ascending")])
        digests, ids, uids = t["digest"].to_pylist(), t["doc_id"].to_pylist(), t["uid"].to_pylist()
        best: dict[bytes, list] = {}
        for d, i, u in zip(digests, ids, uids, strict=True):
            e = best.setdefault(d, [None, -1, 0])
            e[2] += 1
            if _above(i, u, e[0], e[1]):
                e[0], e[1] = i, u
        yield _batch((d, *e) for d, e in best.items())


def _above(i: int | None, u: int, j: int | None, v: int) -> bool:
    return (i is not None, i or 0, u) > (j is not None, j or 0, v)


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    live = CuckooIndex()
    for batch in batches:
        for d, i, u, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = live.find(d)
            if old is None:
                live.insert(d, (i, u, n))
                continue
            j, v, m = old[1]
            best = (i, u) if _above(i, u, j, v) else (j, v)
            live.delete(d)
            live.insert(d, (*best, n + m))
    rows = []
    for key, value in live.entries():
        rows.append((key, *value))
        if len(rows) == 10_000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, key, uid) of every row; uid tells repeated rows apart and is fixed in the stored table."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "digests")


def index(rows: DataFrame, per_bucket: int = 200_000) -> DataFrame:
    """One row per distinct digest: the row that stays (largest doc_id) and the size of the group."""
    n = partitions(rows.sparkSession, rows.count(), per_bucket)
    parts = rows.select("digest", "doc_id", "uid").mapInArrow(_combine, INDEX_SCHEMA)
    n = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.repartition(n, "digest").mapInArrow(_index, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without any change; null counts as empty. The row with the largest doc_id of a group
    stays; a null doc_id is below every other; of rows that repeat id and text one stays. An empty table gives no rows.
    Other columns aren't read, whatever their names.
    """
    return _grouped(docs, text, doc_id).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    rows = digests(docs, text, doc_id)
    copies = index(rows).filter("group_size > 1").select(F.col("digest").alias("of"), F.col("doc_id").alias("best"), F.col("uid").alias("best_uid"), "group_size")
    return rows.join(copies, F.col("digest") == F.col("of"), "left").select(
        "doc_id",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("of").isNull() | (F.col("uid") == F.col("best_uid"))).alias("kept"),
        "digest", "key",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names: of equal texts one row, that of the
    largest doc_id, null ids lowest; null counts as empty. Rows that repeat an id with another text are other documents.
    An empty table gives no rows."""
    gone = _grouped(docs).filter("group_size > 1").groupBy("doc_id", "key").agg(F.count_if(~F.col("kept")).alias("less"), F.bool_or("kept").alias("stays")).filter("less > 0")
    return without(docs, stored(gone.select("doc_id", "key", "stays"), "gone"))
