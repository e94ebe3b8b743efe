"""SentencePiece encoding and decoding in numpy, by batches of equal-length words.

A text is cut into words where no piece of the vocabulary can cross; each distinct word of a batch is encoded once, and
words of equal length advance together. Hashes of all substrings up to the longest piece probe the sorted hashes of the
pieces, and a Viterbi pass goes over the ends: vectorised maxima over the piece lengths give each end's piece and its
backpointer. For a unigram model the best sum of scores decides. A BPE model's ids follow from its merges: there a prefix
has one encoding, and a piece may end it only if merging its text and that of the piece before gives these two back. What
pairs are so is worked out once for each pair, by merges, and kept.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import U64, buffers, mix, steps

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_STEP = U64(0x9E3779B97F4A7C15)
UNIGRAM, BPE = 1, 2
LONG = 400  # characters from which a BPE word is merged with a heap: the same ids, in less memory
START, UNKNOWN = -1, -2  # what ends the empty prefix, and a character that is no piece
PAIRS = 20  # bits of the table of pairs


class PieceModel:
    """A SentencePiece model file with an identity normaliser, unigram or BPE, with byte fallback or an unknown id."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with an identity normaliser, extra white space kept and white space before words are read")
        self.kind, self.prefix = model.trainer_spec.model_type, norm.add_dummy_prefix
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.texts = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == 1]
        if any(MARK in self.texts[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds white space after other characters")
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
        scores = np.array([p.score for p in model.pieces], np.float32)
        self.longest = max(len(self.texts[i]) for i in normal)
        keys = np.array([self._hash(self.texts[i]) for i in normal], U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        self.scores = scores[self.ids]
        self.unk_score = np.float32(scores[normal].min() - 10)
        self.by_text = {self.texts[i]: (float(scores[i]), i) for i in normal}
        if self.kind == BPE:
            self._splits(normal, scores)

    @staticmethod
    def _hash(text: str) -> U64:
        h = np.zeros(1, U64)
        for c in text:
            h = mix(h * _STEP + np.array([ord(c) + 1], U64))
        return h[0]

    def spans(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of equal length, by start and length - 1: score (-inf where there's no piece) and id."""
        n, size = chars.shape
        most = min(self.longest, size)
        score, ids = np.full((n, size, most), -np.inf, np.float32), np.full((n, size, most), -1, np.int64)
        h = np.zeros((n, size), U64)
        for k in range(most):
            h = mix(h[:, : size - k] * _STEP + chars[:, k:].astype(U64) + U64(1))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            score[:, : size - k, k][hit] = self.scores[at[hit]]
            ids[:, : size - k, k][hit] = self.ids[at[hit]]
        return score, ids

    def viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Length of the piece that ends at each place of the best path, 0 elsewhere."""
        n, size = chars.shape
        score, _ = self.spans(chars)
        single = score[:, :, 0]
        single[single == -np.inf] = self.unk_score
        best, back = np.full((n, size + 1), -np.inf, np.float32), np.zeros((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            lengths = np.arange(min(score.shape[2], end), 0, -1)  # of equal sums the longest piece wins
            sums = best[:, end - lengths] + score[:, end - lengths, lengths - 1]
            pick = sums.argmax(1)
            best[:, end], back[:, end] = sums[np.arange(n), pick], lengths[pick]
        out, end, rows = np.zeros((n, size + 1), np.int64), np.full(n, size), np.arange(n)
        while len(rows):
            out[rows, end[rows]] = back[rows, end[rows]]
            end[rows] -= back[rows, end[rows]]
            rows = rows[end[rows] > 0]
        return out[:, 1:]

    def _splits(self, normal: list[int], scores: np.ndarray) -> None:
        """Of each piece the two that merge into it last, and the order of merges; a character is there from the start. A
        piece that merges of its own text don't end in is never used."""
        self.rank, self.left, self.right = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), np.int64)
        self.reachable = np.zeros(len(self.texts), bool)
        order = sorted((i for i in normal if len(self.texts[i]) > 1), key=lambda i: -scores[i])
        self.rank[order] = np.arange(1, len(order) + 1)
        by_size: dict[int, list[int]] = {}
        for i in normal:
            by_size.setdefault(len(self.texts[i]), []).append(i)
        pairs: dict[int, int] = {}
        for size, own in by_size.items():
            if size == 1:
                self.reachable[own] = True
                continue
            chars = np.frombuffer("".join(self.texts[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
            self.reachable[own] = self.merge(chars)[:, -1] == size
            ends = self.merge(chars, whole=False)
            for i, e in zip(own, ends, strict=True):
                cut = np.flatnonzero(e)
                if self.reachable[i] and len(cut) == 2:
                    one, two = self.texts[i][: cut[0] + 1], self.texts[i][cut[0] + 1 :]
                    self.left[i], self.right[i] = self.by_text[one][1], self.by_text[two][1]
                    pairs[self.left[i] << 32 | self.right[i]] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = self.rank[[pairs[k] for k in self.pair_keys.tolist()]]
        self.seen_keys, self.seen_fits = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)

    def _apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merges of the pieces' joint text end in the two. Their own merges are taken back, the later first; at no
        time may what stands at the border merge earlier than what was taken back."""
        out, rows = np.ones(len(one), bool), np.arange(len(one))
        limit = np.full(len(one), np.iinfo(np.int64).max)
        while len(rows):
            key = one << 32 | two
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit)
            out[rows[bad]] = False
            first, second = self.rank[one], self.rank[two]
            go = ~bad & ((first > 0) | (second > 0))
            one, two, limit, rows, first, second = one[go], two[go], limit[go], rows[go], first[go], second[go]
            later = first > second
            limit = np.where(later, first, second + 1)
            one, two = np.where(later, self.right[one], one), np.where(later, two, self.left[two])
        return out

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether a prefix that ends with the piece `before` may go on with `piece`."""
        out = (before < 0) | (piece < 0)
        some = np.flatnonzero(~out)
        key = before[some].astype(np.int64) << 32 | piece[some]
        slot = ((key.view(U64) * _STEP) >> U64(64 - PAIRS)).astype(np.int64)
        known, missed = self.seen_fits[slot], np.flatnonzero(self.seen_keys[slot] != key)
        if len(missed):
            known[missed] = self._apart(before[some[missed]], piece[some[missed]])
            self.seen_keys[slot[missed]], self.seen_fits[slot[missed]] = key[missed], known[missed]
        out[some] = known
        return out

    def prefixes(self, chars: np.ndarray) -> np.ndarray:
        """As viterbi(), for a BPE model: the piece that ends each prefix's encoding, found from those of shorter ones."""
        n, size = chars.shape
        _, ids = self.spans(chars)
        ids[(ids >= 0) & ~self.reachable[ids]] = -1
        single = ids[:, :, 0]
        single[single < 0] = UNKNOWN
        last, back = np.full((n, size + 1), START, np.int64), np.zeros((n, size + 1), np.int64)
        every = np.arange(n)
        for end in range(1, size + 1):
            lengths = np.arange(min(ids.shape[2], end), 0, -1)
            piece, before = ids[:, end - lengths, lengths - 1], last[:, end - lengths]
            can = piece != -1
            can[can] = self.fits(before[can], piece[can])
            pick = can.argmax(1)
            last[:, end], back[:, end] = piece[every, pick], lengths[pick]
        out, end, rows = np.zeros((n, size + 1), np.int64), np.full(n, size), every
        while len(rows):
            out[rows, end[rows]] = back[rows, end[rows]]
            end[rows] -= back[rows, end[rows]]
            rows = rows[end[rows] > 0]
        return out[:, 1:]

    def merge(self, chars: np.ndarray, whole: bool = True) -> np.ndarray:
        """As viterbi(), by merges: each step merges, in every word at once, the adjacent pair whose piece has the highest
        score, the leftmost among equals. Without `whole` the merge that would end in the whole word isn't made."""
        n, size = chars.shape
        score, _ = self.spans(chars)
        most = score.shape[2]
        if not whole and most == size:
            score[:, 0, size - 1] = -np.inf
        end = np.tile(np.arange(1, size + 1), (n, 1))  # of the symbol that begins at each place
        begin, live = np.ones((n, size + 1), bool), np.arange(n)
        while len(live):
            own, one = end[live], np.arange(size)
            two = np.take_along_axis(np.concatenate([own, np.full((len(live), 1), size)], 1), own, 1)
            long = two - one
            can = begin[live][:, :size] & (own < size) & (long <= most)
            value = np.where(can, score[live[:, None], one, np.minimum(long, most) - 1], -np.inf)
            pick = value.argmax(1)
            rows = np.arange(len(live))
            some = value[rows, pick] > -np.inf
            rows, pick, live_some = rows[some], pick[some], live[some]
            begin[live_some, own[rows, pick]] = False
            end[live_some, pick] = two[rows, pick]
            live = live_some
        out = np.zeros((n, size + 1), np.int64)
        w, at = np.nonzero(begin[:, :size])
        out[w, end[w, at]] = end[w, at] - at
        return out[:, 1:]

    def merge_long(self, word: str) -> list[str]:
        """Symbols of one long word, by a heap of adjacent pairs."""
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (p := self.by_text.get(parts[a] + parts[b])):
                heap.append((-p[0], a, len(parts[a]), len(parts[b])))

        for i in range(len(word) - 1):
            push(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, a, n, m = heapq.heappop(heap)
            b = right[a]
            if parts[a] is None or b < 0 or len(parts[a]) != n or len(parts[b]) != m:
                continue
            parts[a], parts[b] = parts[a] + parts[b], None
            right[a] = right[b]
            if right[a] >= 0:
                left[right[a]] = a
            for x, y in ((left[a], a), (a, right[a])):
                before = len(heap)
                push(x, y)
                if len(heap) > before:
                    heapq.heappush(heap, heap.pop())
        return [p for p in parts if p is not None]

    def symbol_ids(self, symbol: str) -> list[int]:
        if found := self.by_text.get(symbol):
            return [found[1]]
        raw = self.bytes[list(symbol.encode())]
        return raw.tolist() if (raw >= 0).all() else [self.unknown]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        memo: dict[str, list[int]] = {}
        for size, rows in by_size.items():
            if not size:
                continue
            if size > LONG and self.kind == BPE:
                for i in rows:
                    out[i] = [x for s in self.merge_long(words[i]) for x in self.symbol_ids(s)]
                continue
            step = max(1, (1 << 20) // (size * min(size, self.longest)))
            for k in range(0, len(rows), step):
                own = rows[k : k + step]
                chars = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
                ends = self.viterbi(chars) if self.kind == UNIGRAM else self.prefixes(chars)
                w, at = np.nonzero(ends)
                cut = ends[w, at]
                got: list[list[int]] = [[] for _ in own]
                for r, e, n in zip(w.tolist(), at.tolist(), cut.tolist(), strict=True):
                    s = words[own[r]][e + 1 - n : e + 1]
                    if s not in memo:
                        memo[s] = self.symbol_ids(s)
                    got[r] += memo[s]
                for i, x in zip(own, got, strict=True):
                    out[i] = x
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        arr = pc.fill_null(texts.cast(pa.large_string()), "")
        arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
        odd = pc.match_substring_regex(arr, f"^ |  | $|{MARK}|^$").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", arr) if odd.any() or not self.prefix else arr
        lists = pc.split_pattern(plain, " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        code, off = coded.indices.to_numpy(), lists.offsets.to_numpy()
        words = [MARK + w for w in coded.dictionary.to_pylist()]
        own: dict[int, list[str]] = {}
        for i in range(len(arr)) if not self.prefix else np.flatnonzero(odd).tolist():
            text = arr[i].as_py().replace(" ", MARK)
            own[i] = _WORD.findall(MARK * self.prefix + text) if text else []
        extra = list(dict.fromkeys(w for x in own.values() for w in x))
        table = [np.array(x, np.int32) for x in self.words(words + extra)]
        at = {w: len(words) + k for k, w in enumerate(extra)}
        lens = np.fromiter(map(len, table), np.int64, len(table))
        begin = np.concatenate([[0], np.cumsum(lens)])
        flat = np.concatenate(table) if table else np.empty(0, np.int32)
        out = []
        for i in range(len(arr)):
            c = np.array([at[w] for w in own[i]], np.int64) if i in own else code[off[i] - off[0] : off[i + 1] - off[0]]
            n = lens[c]
            total = np.concatenate([[0], np.cumsum(n)])
            out.append(flat[np.repeat(begin[c] - total[:-1], n) + np.arange(total[-1])])
        return out

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces and their offsets."""
        raw = [bytes([int(t[3:5], 16)]) if self.bytes[int(t[3:5], 16) if re.fullmatch("<0x[0-9A-F]{2}>", t) else 0] == i and re.fullmatch("<0x[0-9A-F]{2}>", t) else t.replace(MARK, " ").encode() for i, t in enumerate(self.texts)]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])

    def decode(self, ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> bytes:
        """The text's UTF-8 bytes; the space before the first word goes."""
        data, off = table
        n = off[ids + 1] - off[ids] if len(ids) else np.empty(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        out = data[np.repeat(off[ids] - total[:-1], n) + np.arange(total[-1])].tobytes() if len(ids) else b""
        return out[1:] if self.prefix and out[:1] == b" " else out


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"


_models: dict[int, PieceModel] = {}


def piece_model(proto: bytes) -> PieceModel:
    """One model for each Python worker, with the pairs that it knows."""
    key = zlib.crc32(proto)
    if key not in _models:
        _models[key] = PieceModel(proto)
    return _models[key]


def piece_ids(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and round_trip
    (whether decoding the ids gives the text back).

    A null or empty text has no ids. Repeated rows are encoded each for itself; a text of any length is encoded whole; an
    empty table gives no rows; other columns aren't read. The model file is read once on the driver and sent to the executors; its size is fixed.
    """
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto.value)
        table = model.decoder()
        for batch in batches:
            off = buffers(batch.column(1))[1]
            for i, j in steps(off, 16 << 20):
                texts = batch.column(1).slice(i, j - i)
                data, at = buffers(texts)
                ids = model.encode(texts)
                same = [model.decode(x, table) == data[at[k] : at[k + 1]].tobytes() for k, x in enumerate(ids)]
                columns = [batch.column(0).slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
