"""Join of documents by the Jaccard similarity of their word n-grams, with count vectors in an R-tree.

A document's distinct shingles are 64-bit hashes; documents with equal sets are one node. Sets of sizes up to M that link
differ in at most D = 15 / 185 * 2M shingles (for 85 %). Shingles are hashed into more than D groups, so at least one
group of two linked sets is equal: every node sends the hash of each of its groups, and nodes with an equal group meet.
Sizes are cut into levels with their own number of groups, and a node takes part in each level that a partner's size can
reach. A node with too few groups that hold anything also sends the shingles of least hash, as a prefix filter does.

The meeting nodes form runs. A run's nodes are points in R-trees, with the numbers of shingles by hash group as
coordinates; the overlap of two is bounded by the sum of coordinate minima, and that of a point and all points of a tree's
node by their coordinate maxima. First each node of a run is verified, on the whole sets, with the one of its tree that
has the highest bound, and components follow. Only runs that still span several components are searched once more, for
every pair of different components whose bound reaches the threshold; survivors are verified. So no link between
components is lost, and copies are never expanded into all pairs. A large run is dealt to several trees, a task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import FOLD, U64, bitmap, buffers, in_bitmap, mix, row_key, span_hashes, steps, stored, without, word_spans
from marginalia.llm.graph import components

GROUPS = 256  # coordinates of a count vector
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and each text's offsets."""
    data, off = buffers(texts)
    norm = FOLD[data]
    start, end = word_spans(norm, off)
    words = span_hashes(norm, start, end)
    docs = len(off) - 1
    count = np.bincount(np.searchsorted(off, start, "right") - 1, minlength=docs)[:docs] if len(start) else np.zeros(docs, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(grams)])
    begin = np.repeat(first[:-1] - at[:-1], grams) + np.arange(at[-1])
    long = np.repeat(count >= width, grams)
    out = np.empty(at[-1], U64)
    if long.any():
        h = np.zeros(int(long.sum()), U64)
        for k in range(width):
            h = mix(h + words[begin[long] + k] * _ODD[k % len(_ODD)] + U64(k))
        out[long] = h
    for d in np.flatnonzero((count > 0) & (count < width)).tolist():
        h = np.zeros(1, U64)
        for k in range(count[d]):
            h = mix(h + words[first[d] + k : first[d] + k + 1] * _ODD[k % len(_ODD)] + U64(k))
        out[at[d]] = mix(h + U64(0x5851F42D4C957F2D))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][grams > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[at]


def node_ids(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, 0 for an empty one."""
    out = np.zeros(len(off) - 1, U64)
    some = np.diff(off) > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(sets ^ _ODD[5]), off[:-1][some]) + np.diff(off)[some].astype(U64)) | U64(1)
    return out.view(np.int64)


class Levels:
    """Size classes for the threshold percent / 100, and what each node sends."""

    def __init__(self, percent: int, ratio: float = 1.5, spare: float = 1.1):
        self.percent, self.top = percent, [6]
        self.spare, self.ratio = spare, ratio

    def differ(self, total: int) -> int:
        """Most shingles by which two linked sets with `total` in sum differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(level, largest size) of the levels in which a set of n shingles may meet a partner."""
        reach = n * 100 // self.percent
        while self.top[-1] < reach:
            self.top.append(int(self.top[-1] * self.ratio) + 1)
        return [(j, m) for j, m in enumerate(self.top) if m >= n and (j == 0 or self.top[j - 1] < reach) and self.differ(2 * m)]

    def signatures(self, own: np.ndarray) -> np.ndarray:
        n, out = len(own), []
        for level, most in self.of(n):
            groups = int((self.differ(2 * most) + 1) * self.spare) + 1
            group = ((own >> U64(32)) * U64(groups)) >> U64(32)
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            tag = group[cut] * U64(0x100000001B3) + U64(level + 1)
            out.append(mix(np.add.reduceat(mix(own ^ _ODD[6]), cut) + mix(tag)))
            if len(cut) <= self.differ(n + min(most, n * 100 // self.percent)):
                prefix = n - -(-self.percent * n // 100) + 1
                out.append(mix(own[:prefix] + _ODD[7]))
        return np.concatenate(out) if out else np.empty(0, U64)


def vector(own: np.ndarray) -> bytes:
    """Counts of the shingles by group; two bytes each while every count fits."""
    counts = np.bincount((own & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype("<u2" if len(own) < 1 << 16 else "<u4").tobytes()


def counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * GROUPS else "<u4").astype(np.int64)


def _sets(width: int):
    names = ["doc_id", "key", "n", "node", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = buffers(batch.column(2))[1]
            for i, j in steps(off):
                sets, at = shingle_sets(batch.column(2).slice(i, j - i), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(node_ids(sets, at)), pa.array([vector(sets[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], names)

    return run


def _send(width: int, percent: int, parts: int, flush: int = 2_000_000):
    """Rows (part, blob): signatures that fall to a part, six bytes each, with the nodes that sent them."""

    def blob(sig: np.ndarray, node: np.ndarray) -> bytes:
        nodes, index = np.unique(node, return_inverse=True)
        index = index.astype("<u2" if len(nodes) < 65536 else "<u4")
        head = np.array([len(sig), len(nodes)], "<u4").tobytes()
        return head + (sig & U64(0xFFFFFFFF)).astype("<u4").tobytes() + (sig >> U64(32)).astype("<u2").tobytes() + nodes.astype("<i8").tobytes() + index.tobytes()

    def out(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        part = (sig >> U64(48)) * U64(parts) >> U64(16)
        order = np.argsort(part, kind="stable")
        sig, node, part = sig[order] & U64((1 << 48) - 1), node[order], part[order].astype(np.int32)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() + [len(part)] if len(part) else [0]
        rows = [(int(part[a]), blob(sig[a:b], node[a:b])) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sigs, nodes, size = Levels(percent), [], [], 0
        for batch in batches:
            off = buffers(batch.column(0))[1]
            seen: set[int] = set()
            for i, j in steps(off):
                sets, at = shingle_sets(batch.column(0).slice(i, j - i), width)
                for k, node in enumerate(node_ids(sets, at).tolist()):
                    if node and node not in seen:  # of equal sets in a batch, one sends
                        seen.add(node)
                        own = levels.signatures(sets[at[k] : at[k + 1]])
                        sigs.append(own)
                        nodes.append(np.full(len(own), node, np.int64))
                        size += len(own)
                if size >= flush:
                    yield out(sigs, nodes)
                    sigs, nodes, size = [], [], 0
        if size:
            yield out(sigs, nodes)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Runs of nodes with an equal signature: (run, node) for every node of a run of two or more; equal runs of a
    part once."""
    sigs, nodes = [], []
    for raw in table["blob"].to_pylist():
        n, m = np.frombuffer(raw, "<u4", 2).tolist()
        low, high = np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u2", n, 8 + 4 * n)
        ids = np.frombuffer(raw, "<i8", m, 8 + 6 * n)
        sigs.append(low.astype(U64) | high.astype(U64) << U64(32))
        nodes.append(ids[np.frombuffer(raw, "<u2" if m < 65536 else "<u4", n, 8 + 6 * n + 8 * m)])
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    # Signatures that occur once, nearly all, go before the full sort.
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    sig, node = sig[often], node[often]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    names = ["run", "node"]
    if not len(sig):
        return pa.table([pa.array([], pa.int64())] * 2, names)
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([cut, [len(sig)]]))
    name = mix(np.add.reduceat(mix(node.view(U64) ^ _ODD[4]), cut) + size.astype(U64)).view(np.int64)
    _, once = np.unique(name, return_index=True)
    take = np.zeros(len(cut), bool)
    take[once] = True
    take &= size > 1
    rows = np.repeat(take, size)
    return pa.table([np.repeat(name, size)[rows], node[rows]], names)


def _contents(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the given nodes, and of a few others that share a bit of the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes))
    names = ["node", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            off = buffers(batch.column(0))[1]
            seen: set[int] = set()
            for i, j in steps(off):
                sets, at = shingle_sets(batch.column(0).slice(i, j - i), width)
                ids = node_ids(sets, at)
                known = in_bitmap(bits, ids)
                rows = [k for k in np.flatnonzero(known & (ids != 0)).tolist() if not (ids[k] in seen or seen.add(ids[k]))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array([sets[at[k] : at[k + 1]].tobytes() for k in rows], pa.binary())], names)

    return docs.select("text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _verify(percent: int):
    """Keeps the pairs whose overlap reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = batch.columns
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                both = np.concatenate([np.frombuffer(one[k].as_buffer(), U64), np.frombuffer(two[k].as_buffer(), U64)])
                both.sort()
                keep[k] = (100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * len(both)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets. Only texts that occur in a pair are read into sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(_contents(docs, nodes, width), "contents")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two").mapInArrow(_verify(percent), "a long, b long")


def fitting(point: np.ndarray, high: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of `point` with a set below `high`, of `least` shingles or more, can reach the threshold."""
    return (100 + percent) * np.minimum(point, high).sum(1, dtype=np.int64) >= percent * (int(point.sum(dtype=np.int64)) + least)


class RTree:
    """Sort-tile-recursive R-tree over count vectors; answers which points may overlap enough."""

    def __init__(self, points: np.ndarray, fan: int = 64):
        self.points, self.sizes = points, points.sum(1, dtype=np.int64)
        order = self._tile(np.arange(len(points)), 0, fan)
        self.levels = []
        groups = [order[i : i + fan] for i in range(0, len(order), fan)]
        high = np.array([points[g].max(0) for g in groups])
        least = np.array([self.sizes[g].min() for g in groups])
        self.levels.append((groups, high, least))
        while len(groups) > fan:
            groups = [np.arange(i, min(i + fan, len(groups))) for i in range(0, len(groups), fan)]
            high, least = np.array([high[g].max(0) for g in groups]), np.array([least[g].min() for g in groups])
            self.levels.append((groups, high, least))

    def _tile(self, rows: np.ndarray, dim: int, fan: int) -> np.ndarray:
        if len(rows) <= fan or dim >= 4:
            return rows
        rows = rows[np.argsort(self.points[rows, dim], kind="stable")]
        slabs = max(2, int(np.ceil((len(rows) / fan) ** 0.25)))
        return np.concatenate([self._tile(x, dim + 1, fan) for x in np.array_split(rows, slabs) if len(x)])

    def search(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Rows of the points whose bound on the overlap with `point` reaches the threshold."""
        groups, high, least = self.levels[-1]
        now = np.flatnonzero(fitting(point, high, least, percent))
        for below in (*self.levels[-2::-1], None):
            at = np.concatenate([groups[g] for g in now]) if len(now) else np.empty(0, np.int64)
            if below is None:
                return at[fitting(point, self.points[at], self.sizes[at], percent)]
            groups, high, least = below
            now = at[fitting(point, high[at], least[at], percent)]


def _search(percent: int, nearest: bool):
    """Pairs of a probe and a point of a leaf's run in different components whose bound reaches the threshold, by an R-tree
    over the leaf's points: for each probe the point of highest bound, or all."""

    def run(table: pa.Table) -> pa.Table:
        ids, label = table["node"].to_numpy(), table["label"].to_numpy()
        vectors = np.array([counts(x) for x in table["counts"].to_pylist()])
        if vectors.max(initial=0) < 1 << 15:
            vectors = vectors.astype(np.int16)
        rows, a, b = np.flatnonzero(table["point"].to_numpy(zero_copy_only=False)), [], []
        tree = RTree(vectors[rows]) if len(rows) else None
        for k in np.flatnonzero(table["probe"].to_numpy(zero_copy_only=False)).tolist() if len(rows) else ():
            found = rows[tree.search(vectors[k], percent)]
            found = found[label[found] != label[k]]
            if nearest and len(found) > 1:
                near = np.minimum(vectors[k], vectors[found]).sum(1, dtype=np.int64) / (vectors[k].sum(dtype=np.int64) + vectors[found].sum(1, dtype=np.int64))
                found = found[[near.argmax()]]
            a.append(np.minimum(ids[found], ids[k]))
            b.append(np.maximum(ids[found], ids[k]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.empty((2, 0), np.int64)
        return pa.table([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], ["a", "b"])

    return run


def _candidates(runs: DataFrame, vectors: DataFrame, percent: int, nearest: bool, leaf_nodes: int) -> DataFrame:
    """Pairs (a, b) of the runs (run, node, label) that don't lie in one component.

    A run is dealt to leaves of about leaf_nodes nodes, a task each. Of every pair of components one isn't the run's
    largest: nodes of the largest are points only, the others also probe every leaf of the run. When only the nearest
    are asked for, all nodes probe their own leaf.
    """
    split = runs.groupBy("run").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low != high")
    placed = runs.join(split.select("run", F.ceil(F.col("n") / leaf_nodes).cast("int").alias("leaves")), "run")
    placed = placed.withColumn("leaf", F.pmod(F.xxhash64("node", F.lit(1)), F.col("leaves")).cast("int"))
    if nearest:
        dealt = placed.select("run", "leaf", "node", "label", F.lit(True).alias("point"), F.lit(True).alias("probe"))
    else:
        many = placed.groupBy("run", "label").agg(F.count("*").alias("n")).groupBy("run").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        other = placed.join(many, "run").withColumn("probe", F.col("label") != F.col("main"))
        dealt = other.select("run", "leaf", "node", "label", F.lit(True).alias("point"), "probe")
        away = other.filter(F.col("probe") & (F.col("leaves") > 1)).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1))).filter("to != leaf")
        dealt = dealt.unionByName(away.select("run", F.col("to").alias("leaf"), "node", "label", F.lit(False).alias("point"), F.lit(True).alias("probe")))
    return dealt.join(vectors, "node").groupBy("run", "leaf").applyInArrow(_search(percent, nearest), "a long, b long").distinct()


def _components(docs: DataFrame, width: int, percent: int, per_part: int, leaf_nodes: int) -> DataFrame:
    """(doc_id, key, n, label) of every row: the shingles' number and the component, a node's id; 0 for none."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    sets = stored(keyed.mapInArrow(_sets(width), "doc_id long, key long, n long, node long, counts binary"), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (3 * per_part)))
    sent = docs.select("text").mapInArrow(_send(width, percent, parts), "part int, blob binary")
    runs = stored(sent.groupBy("part").applyInArrow(_meet, "run long, node long").dropDuplicates(["run", "node"]), "runs")
    involved = runs.select("node").distinct()
    vectors = stored(sets.filter("n > 0").select("node", "counts").join(involved, "node", "left_semi").dropDuplicates(["node"]), "vectors")
    near = stored(_candidates(runs.withColumn("label", F.col("node")), vectors, percent, True, leaf_nodes), "near")
    links = stored(verified(near, docs, width, percent), "links")
    labels = components(links)
    labelled = runs.join(labels, "node", "left").select("run", "node", F.coalesce("label", "node").alias("label"))
    more = stored(_candidates(labelled, vectors, percent, False, leaf_nodes).join(near, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        extra = stored(verified(more, docs, width, percent), "links")
        if not extra.isEmpty():
            labels = components(links.unionByName(extra))
    return sets.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("doc_id", "key", "n", F.coalesce("label", "node").alias("label"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, per_part: int = 2_000_000, leaf_nodes: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z in lower case. Fewer than `width` words are one shingle; a null text or
    one without words has none, links with nothing and is its own component. Two documents link when 100 * intersection
    >= percent * union of their distinct shingles; component_id is the smallest doc_id that links lead to, the row's own
    included (null ids count for nothing). Repeated rows have equal sets and so one component. A text of any length is
    one set, made as a whole. An empty table gives no rows. Columns other than doc_id and text aren't read.
    """
    named = _components(docs, width, percent, per_part, leaf_nodes)
    least = named.filter("n > 0").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).filter("many > 1")
    return named.join(least, F.col("label") == F.col("_label"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def without_near_copies(docs: DataFrame, width: int = 4, percent: int = 85, per_part: int = 2_000_000, leaf_nodes: int = 1024) -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever their names: of each component one row, that of the
    smallest doc_id, null ids last; of rows that repeat it one. Rows are told apart by id and text, so rows that repeat
    an id in other components stay. Rows without words link with nothing and stay. An empty table gives no rows."""
    named = _components(docs, width, percent, per_part, leaf_nodes).filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    many = named.groupBy("label").agg(F.min(order).alias("first"), F.count("*").alias("many")).filter("many > 1").withColumnRenamed("label", "_label")
    grouped = named.join(many, F.col("label") == F.col("_label"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = grouped.select("doc_id", "key", stays.alias("stays")).groupBy("doc_id", "key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1")
    return without(docs, stored(gone.select("doc_id", "key", "stays"), "gone"))
