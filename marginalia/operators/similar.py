"""Nearest texts by token-sorted similarity, found in blocks with an exact bound.

Both sides are cut into blocks of bounded size and each pair of blocks is a task's work. Counts of characters bound the
longest common subsequence, and so the similarity, of one text with a whole block at once; pairs are compared in the order
of their bounds until none can enter the k best or reach the least score. Only the k best leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.similarity import ratio, sorted_tokens

LEFT_IN_BLOCK, RIGHT_IN_BLOCK, CLASSES = 1024, 4096, 64


@dataclass(frozen=True)
class Rule:
    """score = share * first + (1 - share) * second, each 0 to 100; pairs count whose first reaches `floor` and whose score
    reaches `least`."""

    share: float = 1.0
    floor: float = 0.0
    least: float = 0.0


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters by class of code points, and lengths."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for i, t in enumerate(texts):
        if t:
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
    return out, out.sum(1)


def _bound(counts: np.ndarray, sizes: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
    total = sizes + size
    return np.where(total > 0, 200.0 * np.minimum(counts, own).sum(1) / np.maximum(total, 1), 100.0)


def best_of(left: tuple[str, str], one: tuple, two: tuple, rights: list[tuple[str, str]], order: np.ndarray, k: int, rule: Rule) -> list[tuple[float, int, float, float]]:
    """(score, place, first, second) of the k best of rights; order: their rank among equals. one, two: the sides' counts."""
    (c1, n1, a), (c2, n2, b) = one, two
    first = _bound(c1, n1, a, len(left[0]))
    reach = rule.share * first + ((1 - rule.share) * _bound(c2, n2, b, len(left[1])) if rule.share < 1 else 0.0)
    reach = np.where(first >= rule.floor - 1e-9, reach, -1.0)
    found: list[tuple[float, int, float, float]] = []
    least = rule.least
    for i in np.argsort(-reach, kind="stable").tolist():
        if reach[i] < least - 1e-6:
            break
        x = ratio(left[0], rights[i][0])
        if x < rule.floor:
            continue
        y = ratio(left[1], rights[i][1]) if rule.share < 1 else 0.0
        score = round(rule.share * x + (1 - rule.share) * y, 6)
        if score < rule.least:
            continue
        found.append((score, i, x, y))
        if len(found) >= k:
            found = sorted(found, key=lambda f: (-f[0], order[f[1]]))[:k]
            least = max(least, found[-1][0])
    return sorted(found, key=lambda f: (-f[0], order[f[1]]))[:k]


_FOUND = "left_id long, right_id long, score double, first double, second double"


def _compare(k: int, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rights = [(r["one"], r["two"]) for r in row["rights"]]
                order = np.array([r["id"] for r in row["rights"]])
                (c1, n1), (c2, n2) = _counts([r[0] for r in rights]), _counts([r[1] for r in rights])
                out = []
                for x in row["lefts"]:
                    own = (x["one"], x["two"])
                    a, b = _counts([own[0]])[0][0], _counts([own[1]])[0][0]
                    out += [(x["id"], int(order[i]), s, p, q) for s, i, p, q in best_of(own, (c1, n1, a), (c2, n2, b), rights, order, k, rule)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def nearest(left: DataFrame, right: DataFrame, k: int = 1, rule: Rule = Rule()) -> DataFrame:
    """(left_id, right_id, rank, score, first, second): the k nearest of right for every row of left; both (id long, one,
    two), with null as ''. Of equal scores the smallest right id is first."""

    def blocks(df: DataFrame, name: str, per: int, other: int) -> DataFrame:
        n = counts[name]
        entry = F.struct(F.col("id").cast("long").alias("id"), *(sorted_tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("one", "two")))
        packed = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"{name}_block"), entry.alias("e")).groupBy(f"{name}_block").agg(F.collect_list("e").alias(f"{name}s"))
        return packed.withColumn("right_block" if name == "left" else "left_block", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    counts = {"left": max(1, -(-left.count() // LEFT_IN_BLOCK)), "right": max(1, -(-right.count() // RIGHT_IN_BLOCK))}
    pairs = blocks(left, "left", LEFT_IN_BLOCK, counts["right"]).join(blocks(right, "right", RIGHT_IN_BLOCK, counts["left"]), ["left_block", "right_block"])
    found = pairs.select("lefts", "rights").mapInArrow(_compare(k, rule), _FOUND)
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def single(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """A side of nearest() with one text."""
    return df.select(id_.cast("long").alias("id"), text.alias("one"), F.lit("").alias("two"))
