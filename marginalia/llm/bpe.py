"""Byte-level BPE of whole texts, with the work done once for each distinct chunk.

No pre-token of the public pattern crosses the place before a space, unless that space stands inside a longer run of
white space. Texts are cut at those places, equal chunks are encoded once, and the ids are put together by index.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marginalia.llm.common import buffers

#: White space, a space, white space: here a cut before each space would split a pre-token. White space beyond ASCII,
#: which the pattern knows and re2 does not, counts as such a place wherever it stands.
_INSIDE = "[ \\t\\n\\r\\f\\v] [ \\t\\n\\r\\f\\v]|[\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LEADING = r"^([ \t\n\r\f\v]|$)"


@dataclass(frozen=True)
class Vocabulary:
    """A tiktoken file's content and the added tokens: read on the driver, and sent to the executors."""

    ranks: bytes
    added: tuple[tuple[str, int], ...]


def vocabulary(ranks_path: str) -> Vocabulary:
    return Vocabulary(Path(ranks_path).read_bytes(), tuple(added_tokens(ranks_path).items()))


class ChunkEncoder:
    """Encodes with the ranks of a tiktoken file. The tokens that the .json file of the same name adds to the vocabulary are
    taken out of the texts first, as tokenizers does; without such a file there are none."""

    def __init__(self, words: Vocabulary, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, words.ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = dict(words.added)
        self.added_pattern = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        ranks |= {token.encode(): rank for token, rank in self.added.items()}
        self.token_bytes = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)

    def _whole(self, text: str) -> list[int]:
        """Ids of one text, split at the added tokens."""
        if not self.added:
            return self.encoding.encode_ordinary(text)
        out = []
        for part in re.split(f"({self.added_pattern})", text):
            out += [self.added[part]] if part in self.added else self.encoding.encode_ordinary(part)
        return out

    def _table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, each after a space, and their offsets; they are encoded as one long string."""
        if not len(chunks):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(" ", chunks.type))[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(" " + joined), np.uint32)
        sizes = np.diff(buffers(chunks)[1]) + 1
        ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
        return ids, np.concatenate([[0], ends])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids begin (len + 1 offsets); null counts as empty."""
        arr = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = pc.match_substring_regex(arr, _INSIDE)
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(arr, token))
        odd = set(np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist())
        if odd:
            mask = np.zeros(len(arr), bool)
            mask[list(odd)] = True
            plain = pc.if_else(pa.array(mask), "", arr)
        else:
            plain = arr
        lists = pc.split_pattern(plain, " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        parts = lists.flatten()
        off = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        # The first part of a text has no space before it; all others have.
        first = np.zeros(len(code), bool)
        first[off[:-1][np.diff(off) > 0]] = True
        heads, head_code = np.unique(code[first], return_inverse=True)
        code[first] = len(words) + head_code
        rows = ~pc.match_substring_regex(words, _LEADING).to_numpy(zero_copy_only=False)
        single = np.flatnonzero(~rows).tolist()
        flat, ends = self._table(words.filter(pa.array(rows)))
        begin, lens = np.zeros(len(words) + len(heads), np.int64), np.zeros(len(words) + len(heads), np.int64)
        begin[: len(words)][rows], lens[: len(words)][rows] = ends[:-1], np.diff(ends)
        rest = [(i, " " + words[i].as_py()) for i in single] + [(len(words) + k, words[h].as_py()) for k, h in enumerate(heads.tolist())]
        more, size = [flat], len(flat)
        for i, chunk in rest:
            got = np.array(self.encoding.encode_ordinary(chunk), np.uint32)
            begin[i], lens[i] = size, len(got)
            size += len(got)
            more.append(got)
        flat = np.concatenate(more)
        n = lens[code]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[code] - total[:-1], n) + np.arange(total[-1])]
        ends = total[off]
        if odd:
            out, at = [], []
            for i in range(len(arr)):
                x = np.array(self._whole(arr[i].as_py()), np.uint32) if i in odd else ids[ends[i] : ends[i + 1]]
                out.append(x)
                at.append(len(x))
            ids, ends = np.concatenate(out), np.concatenate([[0], np.cumsum(at)])
        return ids, ends


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Ids by content of the added tokens in the .json file beside a tiktoken file. Options that change what a token
    matches are not known here."""
    place = Path(ranks_path).with_suffix(".json")
    added = json.loads(place.read_text(encoding="utf-8"))["added_tokens"] if place.exists() else []
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        raise ValueError(f"added tokens with options in {place}")
    return {x["content"]: x["id"] for x in added}


_encoders: dict[tuple[int, str], ChunkEncoder] = {}


def encoder(words: Vocabulary, pattern: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    key = zlib.crc32(words.ranks), pattern
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(words, pattern)
    return _encoders[key]


def byte_offsets(enc: ChunkEncoder, ids: np.ndarray) -> np.ndarray:
    """Ends of the tokens in bytes, counted from the first; byte-level BPE keeps every byte."""
    return np.cumsum(enc.token_bytes[ids])
