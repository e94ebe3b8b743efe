"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte n-grams (naive Bayes log-odds, hashed
trigrams of the lower-case text, everything but letters as a space) tells the languages whose bit is 1 from the others.
A text's margins, one for each bit, are compared with all codewords by a logistic loss, weighted by how far apart each
classifier keeps the languages' mean training margins; the codeword of least loss wins, and a text whose two best are
close is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, steps

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
HASH_BITS = 15
#: Least score of a text that counts as being in a language: below, no codeword holds half of the belief.
REJECT = 0.5
_PRIME = np.uint32(0x9E3779B1)

# ASCII bytes that are no letters count as a space.
_LETTERS = np.arange(256, dtype=np.uint32)
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits of -1 and 1: every split of the classes up to 6 of them, beyond that the random code of 10 log2
    classes bits that has the largest least distance among 200 draws."""
    if classes == 1:
        return np.ones((1, 1), np.int8)
    if classes <= 6:
        masks = np.arange(1, 2 ** (classes - 1))
        bits = np.array([[(m >> c) & 1 if c < classes - 1 else 0 for m in masks] for c in range(classes)])
        return (bits * 2 - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, int(np.ceil(10 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = (code[:, None] != code[None]).sum(2) + np.eye(classes, dtype=int) * 10**6
        if apart.min() > far:
            best, far = code, int(apart.min())
    return best


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, each with a space before and after it, and each text's offsets among them. Trigrams of
    three spaces count as well, they tell no language from another."""
    data, off = buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = np.diff(off)
    # A space before and after each text.
    padded = np.full(len(data) + 2 * len(n), 32, np.uint32)
    at = np.repeat(1 + 2 * np.arange(len(n)), n) + np.arange(len(data))
    padded[at] = _LETTERS[data]
    if len(padded) < 3:
        return np.empty(0, np.int64), np.zeros(len(n) + 1, np.int64)
    key = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    keep = np.ones(len(padded), bool)  # a text's last space and its border with the next text begin no trigram
    keep[off[1:] + 2 * np.arange(len(n))] = keep[off[1:] + 2 * np.arange(len(n)) + 1] = False
    return (key[keep[: len(key)]] * _PRIME >> np.uint32(32 - HASH_BITS)).astype(np.int64), off


@dataclass
class Ecoc:
    """A trained model: its size follows the number of languages, not of rows."""

    langs: list[str]
    code: np.ndarray
    odds: np.ndarray  # 2 ** HASH_BITS x bits
    bias: np.ndarray
    weight: np.ndarray
    sharpness: float = 10.0
    tight: float = 0.1

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> Ecoc:
        """counts: each language's n-gram frequencies, summed over its training texts."""
        langs = sorted(counts)
        code = codewords(len(langs))
        share = np.array([counts[x] / max(counts[x].sum(), 1e-9) for x in langs])
        smooth = 1e-7
        odds = np.zeros((share.shape[1], code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            one, other = share[code[:, b] > 0], share[code[:, b] < 0]
            if len(one) and len(other):
                odds[:, b] = np.log(one.mean(0) + smooth) - np.log(other.mean(0) + smooth)
        # The mean margin of each language's own n-grams; each bit's threshold lies midway between the nearest two.
        mean = share @ odds
        bias, gap = np.zeros(code.shape[1]), np.ones(code.shape[1])
        for b in range(code.shape[1]):
            one, other = mean[code[:, b] > 0, b], mean[code[:, b] < 0, b]
            if len(one) and len(other):
                bias[b], gap[b] = (one.min() + other.max()) / 2, max(one.min() - other.max(), 1e-3)
        weight = gap / gap.sum()
        return cls(langs, code, odds, bias, weight)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean log-odds of each text's n-grams, by bit; a few MB of text at a time."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for i, j in steps(buffers(texts)[1]):
            keys, off = grams(texts.slice(i, j - i))
            for a, b in steps(off, 1 << 20):
                own = self.odds[keys[off[a] : off[b]]]
                if len(own):
                    some = np.diff(off[a : b + 1]) > 0
                    out[i + a : i + b][some] = np.add.reduceat(own, (off[a:b] - off[a])[some], axis=0, dtype=np.float64) / np.diff(off[a : b + 1])[some, None]
        return out - self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best codeword, its share of belief, and whether the next one is close."""
        loss = np.logaddexp(0, -self.sharpness * margins[:, None, :] * self.code[None]) @ self.weight
        best = loss.argmin(1)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        belief /= belief.sum(1, keepdims=True)
        score = belief.max(1)
        second = np.sort(belief, 1)[:, -2] if loss.shape[1] > 1 else np.zeros(len(loss))
        return best, score, score - second < self.tight


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def train(docs: DataFrame, rows_per_lang: int = 2000, mod: int = 4, remainder: int = 2, tasks: int = 8) -> Ecoc | None:
    """A model from a sample of about rows_per_lang labelled rows of each language that aren't held out, chosen by a
    hash of the id; None without labelled rows."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, remainder)).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    rows = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, rows_per_lang / n)))), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j in steps(buffers(batch.column(1))[1]):
                keys, off = grams(batch.column(1).slice(i, j - i))
                for k, lang in enumerate(langs[i:j]):
                    own = np.bincount(keys[off[k] : off[k + 1]], minlength=1 << HASH_BITS).astype(np.float64)
                    if own.sum():
                        total = sums.setdefault(lang, np.zeros(1 << HASH_BITS))
                        total += own / own.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "sums"])

    counts: dict[str, np.ndarray] = {}
    for r in sample.repartition(tasks).mapInArrow(count, "lang string, sums binary").toLocalIterator():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["sums"])
    return Ecoc.fit(counts) if counts else None


def identify(docs: DataFrame, model: Ecoc | None, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row, from its whole text alone.

    lang_pred is `und`, with score 0 and ambiguous true, where the text is null or has no letter, or where there was
    nothing to learn from. Rows that repeat are judged alike; a text of any length is judged whole; of languages as good the
    first by name is told. An empty table gives no rows. lang and source are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(2)
            n = len(texts)
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            lang, score, close = [None] * n, np.zeros(n), np.ones(n, bool)
            if m is not None and n:
                best, score, close = m.decode(m.margins(texts))
                lang = [m.langs[b] for b in best.tolist()]
                score = np.where(known.to_numpy(zero_copy_only=False), score, 0.0)
                close = close | ~known.to_numpy(zero_copy_only=False)
            pred = pc.fill_null(pc.if_else(known, pa.array(lang, pa.string()), "und"), "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pred, pa.array(score), pa.array(close)], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), mod, remainder).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def identified(docs: DataFrame, model: Ecoc | None) -> DataFrame:
    """The rows of docs that are in a language: those with a letter whose best score reaches REJECT. One pass, no join."""
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            if m is not None and len(batch):  # without a model every text with a letter stays
                known = pc.and_(known, pa.array(m.decode(m.margins(texts))[1] >= REJECT))
            yield batch.filter(known)

    return docs.mapInArrow(run, schema)
