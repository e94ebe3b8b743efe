"""Token counts by section, from one encoding of each whole document.

A document is encoded once. Byte-level BPE keeps every byte, so the tokens' byte lengths give their spans; sections are
spans of the same bytes. The interval join of both is a binary search of the tokens' places among the sections' starts.
A token that crosses a boundary belongs to one section by rule: "first" (that of its first byte), "last" (that of its
last byte) or "most" (that of most of its bytes, the earlier one in a tie). So sections always add up to the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import encoder, vocabulary
from marginalia.llm.common import buffers, steps

SCHEMA = "doc_id long, section int, start long, length long, n_tokens long, n_crossing long, document_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), *((x, pa.int64()) for x in ("start", "length", "n_tokens", "n_crossing", "document_tokens"))])


def attribute(starts: np.ndarray, ends: np.ndarray, token_start: np.ndarray, token_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses into another one. Sections are adjacent and sorted."""
    first = np.searchsorted(starts, token_start, "right") - 1
    last = np.searchsorted(starts, token_end - 1, "right") - 1
    cross = first != last
    if rule == "first":
        return first, cross
    if rule == "last":
        return last, cross
    if rule != "most":
        raise ValueError(f"unknown rule {rule}")
    out = first.copy()
    for t in np.flatnonzero(cross).tolist():
        own = np.arange(first[t], last[t] + 1)
        out[t] = own[(np.minimum(ends[own], token_end[t]) - np.maximum(starts[own], token_start[t])).argmax()]
    return out, cross


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first") -> DataFrame:
    """One row per section of every row of docs: doc_id, section (from 0), start and length in bytes, n_tokens,
    n_crossing (tokens of the section that reach into another one) and document_tokens.

    Sections are lines, each with the newline that ends it. A null or empty text is one empty section without tokens.
    Repeated rows are counted each for itself; a text of any length is encoded whole; an empty table gives no
    rows; other columns aren't read. The vocabulary is read on the driver and sent to the executors.
    """

    words = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(words.value, pattern)
        for batch in batches:
            off = buffers(batch.column(1))[1]
            for i, j in steps(off, 8 << 20):
                texts = batch.column(1).slice(i, j - i)
                data, at = buffers(texts)
                ids, place = enc.encode(texts)
                size = enc.token_bytes[ids]
                end = np.cumsum(size)
                newline = np.flatnonzero(data == 10) + 1
                # Every text opens a section, and so does each newline that doesn't end its text.
                newline = newline[~np.isin(newline, at)]
                some = np.flatnonzero(np.diff(at) > 0)
                starts = np.sort(np.concatenate([at[some], newline]))
                ends = np.concatenate([starts[1:], at[-1:]])[: len(starts)]
                section, cross = attribute(starts, ends, end - size, end, rule)
                doc = np.searchsorted(at, starts, "right") - 1
                empty = np.flatnonzero(np.diff(at) == 0)
                order = np.argsort(np.concatenate([doc, empty]), kind="stable")
                doc = np.concatenate([doc, empty])[order]
                pad = lambda x: np.concatenate([x, np.zeros(len(empty), np.int64)])[order]
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                columns = [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(pad(starts - at[np.searchsorted(at, starts, "right") - 1])), pa.array(pad(ends - starts)),
                    pa.array(pad(np.bincount(section, minlength=len(starts)))), pa.array(pad(np.bincount(section[cross], minlength=len(starts)))), pa.array(np.diff(place)[doc]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
