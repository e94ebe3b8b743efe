"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to partitions and packed there by best-fit
decreasing. Dual-feasible functions give a lower bound on each partition's number of bins: a partition that meets its
bound, and whose bound is its volume's, is certified and done. In any other the bins that are filled to the last token
stay; the pieces of the other bins meet those of other partitions with gaps in fewer, larger partitions and are packed
again, until the bins left over meet the bound of all their pieces together, or no exchange saves one any more; what no
bound certifies is marked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import encoder, vocabulary
from marginalia.llm.common import partitions, steps, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece of every whole text: (doc_id, piece, start, length, ids_crc32)."""

    words = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(words.value, pattern)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for i, j in steps(_offsets(batch.column(1)), 8 << 20):
                ids, at = enc.encode(batch.column(1).slice(i, j - i))
                rows = [[], [], [], [], []]
                for k, doc in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]].astype("<u4"), end])
                    for p, (s, n) in enumerate(cut(len(own), capacity)):
                        for column, x in zip(rows, (doc, p, s, n, zlib.crc32(own[s : s + n].tobytes())), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


def _offsets(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing of so many pieces of each length needs: the largest value over two families of
    dual-feasible functions."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    many, total = np.cumsum(count), np.cumsum(count * size)
    half = capacity // 2
    for a in range(1, half + 1):  # items over capacity - a stand alone; those below a are left out
        alone = many[-1] - many[capacity - a]
        big = many[capacity - a] - many[half]
        room = big * capacity - (total[capacity - a] - total[half])
        rest = total[half] - total[a - 1]
        best = max(best, int(alone + big + max(0, -(-(rest - room) // capacity))))
    for k in range(1, 25):  # u_k: x where (k + 1) x is whole, else floor((k + 1) x) / k
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. A piece goes to the fullest bin that takes it; pieces come by
    their length, or by the key where there is one."""
    order = np.argsort(-lengths if key is None else -key, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0  # open_: bit r is set when a bin has r tokens free
    for i in order.tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        place[i], offset[i] = b, capacity - room
        if room > n:
            free[room - n].append(b)
            open_ |= 1 << (room - n)
    return place, offset, bins


PACKED = PIECES + ", round int, part long, bin long, offset long, settled boolean"
_PACKED = pa.schema([*_PIECES, ("round", pa.int32()), ("part", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("settled", pa.bool_())])


def packed_best(lengths: np.ndarray, capacity: int, tries: int = 8) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Best-fit decreasing, and where it misses the lower bound the best of some runs with the order of like lengths
    changed a little: bin, offset, number of bins, and whether the bound certifies that none can be saved."""
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    best = best_fit_decreasing(lengths, capacity)
    rng = np.random.default_rng(len(lengths))
    for k in range(tries):
        if best[2] <= bound:
            break
        shift = rng.integers(0, 2 + (k << 4), len(lengths))
        best = min(best, best_fit_decreasing(lengths, capacity, lengths + shift), key=lambda x: x[2])
    return (*best, best[2] <= bound)


def _pack_round(todo: DataFrame, number: int, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_numpy()
        place, offset, bins, least = packed_best(lengths, capacity)
        filled = np.bincount(place, weights=lengths, minlength=bins)
        done = least and bins <= -(-int(lengths.sum()) // capacity)
        settled = np.full(len(lengths), True) if done else filled[place] == capacity
        n = len(lengths)
        new = [pa.array(np.full(n, number, np.int32)), table["part"].cast(pa.int64()), pa.array(place), pa.array(offset), pa.array(settled)]
        return pa.Table.from_arrays([*(table[f.name].cast(f.type) for f in _PIECES), *new], schema=_PACKED)

    return todo.groupBy("part").applyInArrow(run, PACKED)


def pack(items: DataFrame, capacity: int = 1024, per_partition: int = 60_000, most: int = 960_000) -> DataFrame:
    """Pieces with sequence_id, offset and `certified`; items as from pieces(). per_partition is what one task packs at
    first; it doubles with each exchange, up to `most`, which a task's memory bounds. Exchanges go on until the bins left
    over are certified, a single partition holds them, or, with full tasks, an exchange has saved no bin. Pieces of bins
    that no bound certifies have certified = false, so a gap shows in the result."""
    items = stored(items, "pieces")
    total, todo, done, number, before = items.count(), items, [], 0, None
    while True:
        per = min(most, per_partition << number)
        n = partitions(items.sparkSession, total, per)
        keyed = todo.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", F.lit(number)), F.lit(n)).cast("int"))
        out = stored(_pack_round(keyed, number, capacity), f"packed{number}")
        done.append(out.filter("settled").withColumn("certified", F.lit(True)))
        gaps = out.filter("not settled")
        count = np.zeros(capacity + 1, np.int64)
        for r in gaps.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
            count[r["length"]] = r["n"]
        total, bins = int(count.sum()), gaps.select("part", "bin").distinct().count()
        certified = bins <= lower_bound(count, capacity)
        stuck = n == 1 or per == most and before is not None and bins >= before
        if certified or stuck:
            done.append(gaps.withColumn("certified", F.lit(certified)))  # certified together: no exchange can save a bin
            break
        todo, before, number = gaps.select(*_PIECES.names), bins, number + 1
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    sequence = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft(F.col("part"), 32) + F.col("bin")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", "certified")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs whole documents; see pieces() and pack().

    A null or empty text is a document of the end id alone. Rows that repeat an id are packed each for itself; pieces of
    equal length are alike, and their ids and starts order them. A text of any length is encoded whole and cut after. An
    empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    return pack(pieces(docs, ranks_path, pattern, capacity, end_id), capacity)
