"""Line dedup by deletion neighbourhoods.

A line goes when an earlier line (by doc_id and line number) is equal to it, or is within one edit of it and both have at
least `min_chars` characters. Equal lines meet by hash. For the rest, two lines within one edit are equal after one
character is deleted from the longer, or the same place from both, so hashes of all such variants, joined with the place
for the second kind, bring them together. A variant's lines only meet the earliest of them, so a variant that many lines
share costs as much as it has lines; the earliest neighbour is verified by its edit distance.

Variants are only emitted where they can match. Each distinct line first sends hashes of its halves: lines within one
edit share the first half or the last. Lines that do then send, for each of 16 segments, the hash of all that surrounds
it; an edit lies in one segment. Only in segments whose surroundings another line shares are characters deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import U64, bitmap, in_bitmap, mix, stored

SEGMENTS = 16
_B = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_B), -1, 1 << 64))


class Rolling:
    """Polynomial hashes of a line's characters."""

    def __init__(self, line: str):
        chars = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(U64) + U64(1)
        self.n = len(chars)
        up = np.full(self.n + 1, _B)
        up[0] = 1
        self.up = np.cumprod(up)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(chars * self.up[:-1])])
        down = np.full(self.n + 1, _INVERSE)
        down[0] = 1
        self.down = np.cumprod(down)

    def without(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the line without its characters a to b."""
        return self.sums[a] + (self.sums[self.n] - self.sums[b]) * self.down[b - a]


def half_keys(line: str) -> list[Column]:
    """Hashes of the halves of the named column's line, taken as the longer of two lines and as the shorter."""
    out = []
    for more in (0, 1):
        longer = f"(length({line}) + {more})"
        out += [F.expr(f"xxhash64(substring({line}, 1, {longer} div 2), {longer}, 0)"), F.expr(f"xxhash64(right({line}, {longer} - {longer} div 2), {longer}, 1)")]
    return out


def segment_keys(line: str) -> list[tuple[int, int, int, int]]:
    """(key, longer, from, to): the surroundings of each segment of a line of `longer` characters. In the shorter line
    the segment has one character less."""
    r, out = Rolling(line), []
    for longer in (r.n, r.n + 1):
        cuts = np.unique(np.linspace(0, longer, SEGMENTS + 1).astype(np.int64))
        a, b = cuts[:-1], cuts[1:]
        keys = mix(r.without(a, b - (longer - r.n)) + mix(a.astype(U64) * _B + U64(longer)))
        out += zip(keys.view(np.int64).tolist(), [longer] * len(a), a.tolist(), b.tolist(), strict=True)
    return out


def variants(line: str, spans: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(key, kind) of the line itself (kind 0) and of its deletions (1) in the spans, and of deletions with their place
    (2)."""
    r = Rolling(line)
    whole = mix(r.sums[[r.n]])
    out = {(int(whole.view(np.int64)[0]), 0)} if any(longer == r.n + 1 for longer, _, _ in spans) else set()
    for longer, a, b in spans:
        if longer == r.n:
            at = np.arange(a, b)
            h = r.without(at, at + 1)
            out |= {(x, 1) for x in mix(h).view(np.int64).tolist()}
            out |= {(x, 2) for x in mix(h + mix(at.astype(U64) * _B + U64(r.n))).view(np.int64).tolist()}
    return out


def _batches(fn, names: list[str]):
    """mapInArrow of fn: row values to rows (key columns), with the row's id columns h, g carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, g, *x) for h, g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in fn(*row)]
            for i in range(0, max(len(rows), 1), 200_000):
                columns = list(zip(*rows[i : i + 200_000], strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _shared(keys: DataFrame) -> DataFrame:
    """Rows whose key another row has as well."""
    often = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return keys.join(often, "key", "left_semi")


def repeated_lines(lines: DataFrame, min_chars: int) -> DataFrame:
    """lines: doc_id, line_no, line (not null). The (doc_id, line_no, h, g) that go, h and g a hash of 128 bits."""
    hashed = lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64("line", F.lit("g")))
    place = F.struct("doc_id", "line_no")
    long = F.length("line") >= min_chars
    halves = [F.min(F.when(long, key)).alias(f"half{k}") for k, key in enumerate(half_keys("line"))]
    firsts = stored(hashed.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), *halves), "lines")

    # The first occurrence of every distinct line that shares a half with another one.
    keys = firsts.filter("half0 is not null").select("h", "g", "first", F.explode(F.array(*(f"half{k}" for k in range(len(halves))))).alias("key"))
    often = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "halves")
    near = stored(keys.join(often, "key", "left_semi").groupBy("h", "g").agg(F.min("first").alias("first")), "near")
    # A bitmap of fixed size keeps most other lines' texts out of the join's shuffle.
    members = hashed.sparkSession.sparkContext.broadcast(bitmap(near.select("h")))

    def marked_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(members.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits, batch.column("h").to_numpy())))

    asked = hashed.filter(long).select("doc_id", "line_no", "line", "h", "g")
    asked = asked.mapInArrow(marked_only, asked.schema)
    some = stored(asked.join(near, ["h", "g"]).filter(F.col("first") == place).select("h", "g", "line").dropDuplicates(["h", "g"]), "texts")
    segments = some.mapInArrow(_batches(segment_keys, ["h", "g", "key", "longer", "a", "b"]), "h long, g long, key long, longer long, a long, b long")
    spans = _shared(segments).groupBy("h", "g").agg(F.collect_list(F.struct("longer", "a", "b")).alias("spans"))
    left = stored(some.join(spans, ["h", "g"]).join(near, ["h", "g"]), "segments")
    own = left.select("h", "g", "line", "spans")
    emitted = stored(own.mapInArrow(_batches(lambda line, s: variants(line, [(x["longer"], x["a"], x["b"]) for x in s]), ["h", "g", "key", "kind"]), "h long, g long, key long, kind long").join(near, ["h", "g"]), "variants")
    least = emitted.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.struct("first", "h", "g"))).alias("whole"), F.min(F.when(F.col("kind") == 1, F.struct("first", "h", "g"))).alias("cut"), F.min(F.when(F.col("kind") == 2, F.struct("first", "h", "g"))).alias("both"), F.count("*").alias("n"),
    ).filter("n > 1")
    partner = F.when(F.col("kind") == 0, F.col("cut")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("both"))
    found = emitted.join(least, "key").withColumn("by", partner).filter("by.first < first").groupBy("h", "g").agg(F.min("by").alias("by"))
    one = left.select("h", "g", F.col("line").alias("one"))
    two = left.select(F.col("h").alias("by_h"), F.col("g").alias("by_g"), F.col("line").alias("two"))
    pairs = found.select("h", "g", F.col("by.h").alias("by_h"), F.col("by.g").alias("by_g")).join(one, ["h", "g"]).join(two, ["by_h", "by_g"])
    near_copies = pairs.filter(F.levenshtein("one", "two", 1) >= 0).select("h", "g").withColumn("all_go", F.lit(True))

    marked = firsts.join(near_copies, ["h", "g"], "left").filter("n > 1 or all_go").select("h", "g", "first", F.coalesce("all_go", F.lit(False)).alias("all_go"))
    return hashed.join(marked, ["h", "g"]).filter(F.col("all_go") | (place != F.col("first"))).select("doc_id", "line_no", F.col("all_go").alias("near"))


def split_lines(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id, line_no, line) of every line that isn't blank; lines are compared without white space at their ends."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.col("text") if text is None else text, "\n")).alias("line_no", "line"))
    return parts.withColumn("line", F.btrim("line", F.lit(" \t\x0b\f\r"))).filter("line != ''")


def line_dedup(docs: DataFrame, min_chars: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_exact, n_near (lines that go, as copies and as near copies) and text,
    without the lines that go.

    The earliest of equal lines stays; a row's doc_id and the line number say which is earliest, null ids first. Blank
    lines always stay. Lines under min_chars characters go only as exact copies. A null text stays null, with no lines.
    Of rows that repeat a doc_id the lines are taken as being in the same document: a line that goes in one goes in the
    other at the same place. An empty table gives no rows. Other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated_lines(split_lines(docs), min_chars).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"), F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"))
    gone = gone.withColumnRenamed("doc_id", "_id")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i)), "\n")
    return joined.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
