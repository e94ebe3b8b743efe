"""The ten operators against brute force, on texts with nulls, empty and repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, langid, line_dedup, ngram_jaccard, packing, pieces, ppm, queries, token_counts, topk, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, part string, h string"
OPS = ["op1_sentencepiece", "op2_line_dedup", "op3_language_id", "op4_lm_scoring", "op5_token_counts", "op6_topk_search", "op7_exact_dedup", "op8_ngram_jaccard", "op9_best_fit_packing"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def make_texts():
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice(["ta", "no", "Éa", "ri", "so"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 120))) for _ in range(30)]
    out = base[:]
    for t in base[:12]:  # near copies: a word changed here and there
        w = t.split(" ")
        for k in range(0, len(w), max(1, len(w) // rng.randint(1, 4))):
            w[k] = w[k] + "x"
        out.append(" ".join(w))
    lines = [" ".join(rng.choice(["red", "blue", "fish", "bird"]) for _ in range(7)) for _ in range(20)]
    out += ["\n".join(rng.choice(lines) + rng.choice(["", "", "s", " "]) for _ in range(6)) for _ in range(12)]
    return out + base[:5] + [None, "", " \n\t", "a", "a b", "A  B", "日本語 text\n\n x", "word " * 3000]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, "k", "n", "p", "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def test_exact_dedup(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs).collect()}
    for i, t in enumerate(texts):
        own = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(own), len(own), i == max(own), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(5, "x"), (5, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(df).collect()
    assert sum(r["kept"] for r in rows if r["keep_id"] == 5) == 1 and all(r["group_size"] == 3 for r in rows if r["keep_id"] == 5)
    assert exact_dedup.without_copies(df).count() == 2


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.size == 3000 and all(index.find(k)[1] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys)) and index.size == 1500


def test_jaccard_components(docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert len(set(label.values())) < len(texts) - 5
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_group_signatures_lose_no_link():
    rng, levels = np.random.default_rng(5), ngram_jaccard.Levels(85)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        cut = one[rng.random(len(one)) > rng.random() * 0.16]
        two = np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(one) // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(one, two))
        if len(two) and 100 * both >= 85 * (len(one) + len(two) - both) and both < max(len(one), len(two)):
            assert len(np.intersect1d(levels.signatures(one), levels.signatures(two)))


def test_rtree_finds_what_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(1.0, (900, ngram_jaccard.GROUPS))
    points[::3] = points[1::3] + (rng.random((300, ngram_jaccard.GROUPS)) < 0.05)
    tree = ngram_jaccard.RTree(points)
    for k in range(0, 900, 50):
        want = np.flatnonzero(ngram_jaccard.fitting(points[k], points, points.sum(1), 85))
        assert sorted(tree.search(points[k], 85).tolist()) == want.tolist()


def test_runs_of_several_leaves(spark):
    """Links of a run that is dealt to several R-trees, found as in brute force: chains of near copies in a hot group."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        own = base[:]
        for at in rng.sample(range(120), rng.choice([1, 1, 2, 5, 6])):
            own[at] = f"x{rng.randint(0, 40)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[k : k + 4]) for k in range(117)} for w in map(str.split, texts)]
    label = list(range(60))
    for _ in texts:
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert 2 < len(set(label)) < 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaf in (5, 1024):
        assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(df, leaf_nodes=leaf).collect()} == dict(enumerate(label))


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), 1024) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for own in by_bin.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(by_bin) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 1


def test_added_tokens_have_their_ids(spark):
    """Ids and lengths in bytes equal those of tokenizers on texts with the file's added token, in op9 and op5."""
    from tokenizers import Tokenizer

    from marginalia.llm.bpe import encoder, vocabulary

    t, end = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = [f"a {end} b", end, end + end, f"x{end}\n\n  {end}   y  ", f"a  {end}b c <|endoftext|", "a b", f"<|{end}|> 日本 {end}", None, f"word {end} " * 900]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    enc = encoder(vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    ids, at = enc.encode(pa.array(texts))
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want
    assert [int(enc.token_bytes[ids[at[k] : at[k + 1]]].sum()) for k in range(len(texts))] == [len((x or "").encode()) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for i, x in enumerate(want):
        own = np.array([*x, 2], "<u4")
        assert {(r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i} == {(s, n, zlib.crc32(own[s : s + n].tobytes())) for s, n in packing.cut(len(own), 1024)}


def test_bounds_and_exchange(spark):
    assert packing.lower_bound(np.bincount([600, 600, 600], minlength=1025), 1024) == 3 and packing.lower_bound(np.zeros(1025, np.int64), 1024) == 0
    rng = random.Random(2)
    items = spark.createDataFrame([(i, 0, 0, rng.randint(1, 1024), 0) for i in range(600)], packing.PIECES)
    rows = packing.pack(items, 1024, per_partition=100).collect()
    lengths = np.array([r["length"] for r in rows])
    assert len(rows) == 600 and len({r["sequence_id"] for r in rows}) <= packing.best_fit_decreasing(lengths, 1024)[2] + 3


def test_language_codes_and_edges(docs, spark):
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min((code[a] != code[b]).sum() for a in range(4) for b in range(a)) == 4
    assert langid.codewords(12).shape[0] == 12 and langid.codewords(1).shape == (1, 1)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    edge = next(i for i, r in got.items() if r["lang_pred"] == "und")
    assert got[edge]["score"] == 0 and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, None).collect())


def test_language_id_against_brute_force(spark):
    """Training and decoding by dictionaries and loops give the same languages and scores, on whole texts."""
    rng = random.Random(12)
    stems = {"aa": ["tado", "lume", "sira"], "bb": ["krotz", "schun", "ßelt"], "cc": ["quoi", "eaux", "tado"]}
    rows = [(i, " ".join(rng.choice(stems[g]) + rng.choice(["", "s", "e"]) for _ in range(rng.randint(1, 40))) + rng.choice(["", " 12!", "\nX"]), g) for i, g in enumerate(rng.choice("abc") * 2 for _ in range(150))]
    rows += [(900, None, "aa"), (901, "12 -", "bb"), (902, "zzz", None), (903, "Tado TADO", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def trigrams(text):
        raw = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode())
        return collections.Counter((int.from_bytes(raw[k : k + 3]) * 0x9E3779B1 & 0xFFFFFFFF) >> 17 for k in range(len(raw) - 2))

    sums = collections.defaultdict(collections.Counter)
    for i, t, g in rows:
        if t and g and zlib.crc32(str(i).encode()) % 4 != 2:
            own = trigrams(t)
            for k, n in own.items():
                sums[g][k] += n / sum(own.values())
    langs, code = sorted(sums), langid.codewords(len(sums))
    share = {g: collections.Counter({k: v / sum(sums[g].values()) for k, v in sums[g].items()}) for g in langs}
    bits = []
    for b in range(code.shape[1]):
        sides = [[g for g, c in zip(langs, code[:, b], strict=True) if c * sign > 0] for sign in (1, -1)]
        odds = lambda k, sides=sides: math.log(sum(share[g][k] for g in sides[0]) / len(sides[0]) + 1e-7) - math.log(sum(share[g][k] for g in sides[1]) / len(sides[1]) + 1e-7)
        mean = {g: sum(v * odds(k) for k, v in share[g].items()) for g in langs}
        low, high = min(mean[g] for g in sides[0]), max(mean[g] for g in sides[1])
        bits.append((odds, (low + high) / 2, max(low - high, 1e-3)))
    model = langid.train(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    for i, t, _ in rows:
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        own = trigrams(t)
        margin = [sum(n * odds(k) for k, n in own.items()) / sum(own.values()) - bias for odds, bias, _ in bits]
        loss = [sum(w * math.log1p(math.exp(-model.sharpness * m * c)) for m, c, (_, _, w) in zip(margin, word, bits, strict=True)) / sum(w for *_, w in bits) for word in code]
        belief = [math.exp(min(loss) - x) for x in loss]
        assert got[i]["lang_pred"] == langs[loss.index(min(loss))] and got[i]["score"] == pytest.approx(max(belief) / sum(belief), rel=1e-3)


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(df, langid.train(df)).filter("held_out").join(df.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_lm_base_and_probabilities(docs, texts):
    tokens = {i: [*words(t), "\0end"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = sum(count.values()), len(count)
    for r in ppm.lm_scores(docs).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), total)
        assert abs(r["base_score"] - sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)) < 1e-6 and r["score"] < 0


def running(text):
    return b"".join(w.encode() + b" " for w in words(text)) + b"\n"


def brute_ppm(train, order=5):
    """log10 probability of the byte at a place of a padded stream, by dictionaries: escapes by method C, exclusion."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        padded = b" " * order + running(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i]][padded[i]] += 1

    def length(padded, i):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            own = seen[k].get(padded[i - k : i])
            if not own:
                continue
            left = {x: c for x, c in own.items() if x not in excluded}
            weight = sum(left.values()) + len(left)
            if padded[i] in left:
                return out + math.log10(left[padded[i]] / weight)
            if weight:
                out += math.log10(len(left) / weight)
            excluded = set(own)
        return out - math.log10(256 - len(seen[0].get(b"", ())))

    return length


@pytest.mark.parametrize("adapt", [0.0, 0.1])
def test_lm_scores_against_brute_force(docs, texts, adapt):
    """Every text's score, unseen tokens among them, by dictionaries of contexts and counts."""
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in [*words(t), "\0end"])
    total, kinds = sum(count.values()), len(count)
    escape, length = kinds / (total + kinds), brute_ppm(train)
    got, unseen = {r["doc_id"]: r for r in ppm.lm_scores(docs, adapt=adapt).collect()}, 0
    for i, t in enumerate(texts):
        padded, at, score, own = b" " * 5 + running(t), 5, 0.0, words(t)
        before = collections.Counter()
        for k, w in enumerate([*own, "\0end"]):
            size = len(w.encode()) + 1 if k < len(own) else 1
            belief = sum(length(padded, at + j) for j in range(size))
            at += size
            p = (1 - escape) * count[w] / total + escape * 10**belief
            if k:
                p = (1 - adapt) * p + adapt * (before[w] / k if k < len(own) else 0.0)
            score += math.log10(p) if p else math.log10(escape) + belief + (math.log10(1 - adapt) if k else 0)
            before[w] += 1
            unseen += not count[w]
        assert got[i]["score"] == pytest.approx(score, rel=1e-5), (i, t)
    assert unseen > 5


def test_lm_keeps_its_order_on_many_distinct_tokens(spark):
    """Over 10 million contexts in several parts: scores as in one trie of order 5 over all training texts."""
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    train = letters[rng.integers(0, 36, (160_000, 44))]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    asked = [np.concatenate([train[0, :22], train[1, 22:]]), letters[rng.integers(0, 36, 44)]]
    rows = [(i, " ".join(x.tobytes().decode() for x in own)) for i, own in zip(free, np.split(train, 40), strict=True)] + [(i, x.tobytes().decode()) for i, x in zip(held, asked, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["score"] for r in ppm.lm_scores(df, block_bytes=1 << 20, part_bytes=2 << 20, adapt=0.0).collect()}
    stream, sizes = ppm.streams(pa.array([t for i, t in rows if i in free]))
    trie = ppm.trie(*ppm.summed(ppm.context_keys(stream, sizes, 5), np.ones(len(stream), np.int64)), 5)
    assert sum(map(len, trie.keys)) > 10_000_000
    total, kinds = 160_040, 160_001
    escape = kinds / (total + kinds)
    for i, t in rows[40:]:
        stream, sizes = ppm.streams(pa.array([t]))
        own = trie.key_lengths(ppm.context_keys(stream, sizes, 5))
        want = math.log10(escape) + own[:-1].sum() + math.log10((1 - escape) * 40 / total + escape * 10 ** own[-1])
        assert got[i] == pytest.approx(want, rel=1e-5)
    assert got[held[0]] - got[held[1]] > 20


def test_lm_long_unseen_token_costs_the_same_in_any_place(spark):
    """A token far below 1e-300 isn't floored: after a known token it adds what it costs as a text's first token."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    long = "".join(random.Random(4).choice("qxzjkvw0123456789") for _ in range(10_000))
    rows = [(i, "a b tano tata") for i in range(60) if i not in held] + [(held[0], long), (held[1], "tata " + long)]
    got = {r["doc_id"]: r["score"] for r in ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] < -5000 and -4 < got[held[1]] - got[held[0]] < 1


def test_trie_sums_to_one():
    stream, sizes = ppm.streams(pa.array(["tatati no", "tata ti", None]))
    assert stream.tobytes() == b"tatati no \ntata ti \n\n" and sizes.tolist() == [11, 9, 1]
    assert [(a, b) for a, b in zip(*ppm.tokens(stream), strict=True)] == [(0, 6), (7, 9), (11, 15), (16, 18)]
    trie = ppm.trie(*ppm.summed(ppm.context_keys(stream, sizes, 3), np.ones(len(stream), np.int64)), 3)
    for context in (b"   ", b"tat", b"ta ", b"zzz", b"xno", b"ti ", b"o \n"):
        key = np.array([int.from_bytes(bytes([3]) + context + bytes([b])) for b in range(256)], np.uint64)
        assert abs((10 ** trie.key_lengths(key)).sum() - 1) < 1e-9


def test_line_dedup(docs, texts):
    lines = [(i, n, x.strip(" \t\v\f\r")) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n")) if x.strip(" \t\v\f\r")]
    first = {}
    for i, n, x in sorted(lines):
        first.setdefault(x, (i, n))

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {x for x in first if len(x) >= 16 and any(len(y) >= 16 and first[y] < first[x] and abs(len(x) - len(y)) < 2 and close(x, y) for y in first)}
    want = {(i, n): x in near for i, n, x in lines if x in near or first[x] != (i, n)}
    assert near and {(r["doc_id"], r["line_no"]): r["near"] for r in line_dedup.repeated_lines(line_dedup.split_lines(docs), 16).collect()} == want
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want))


def test_sentencepiece_matches_the_library(docs, texts):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    unigram = pb.ModelProto()
    unigram.ParseFromString(proto)
    unigram.trainer_spec.model_type = 1
    for p in unigram.pieces:  # sums of scores stay exact in single precision
        p.score = max(p.score, -32000.0)
    rng = random.Random(5)
    dense = ["".join(rng.choice("abcdetohnrsi▁ .,AB日0") for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["a" * n for n in range(1, 60)] + ["the" * n for n in range(1, 20)]
    odd = [*texts, *dense, " lead", "trail ", "a   b", "x" * 900, "ab" * 300 + " c", "a\x00b"]
    for raw in (proto, unigram.SerializeToString()):
        model, library = pieces.PieceModel(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
        table, got = model.decoder(), model.encode(pa.array(odd, pa.string()))
        assert [x.tolist() for x in got] == library.encode([t or "" for t in odd])
        assert [x.tolist() for x in model.encode(pa.array(odd, pa.string()))] == [x.tolist() for x in got]
        assert [model.decode(x, table).decode() for x in got] == [(t or "").replace(pieces.MARK, " ") for t in odd]
    assert pieces.piece_ids(docs, P.path("piece_bpe_32k.model")).filter("not round_trip").isEmpty()


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_section_tokens(docs, texts, rule):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = collections.defaultdict(dict)
    for r in token_counts.section_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule).collect():
        rows[r["doc_id"]][r["section"]] = r
    for i, x in enumerate(texts):
        parts = re.findall("[^\n]*\n|[^\n]+", x or "") or [""]
        assert [rows[i][k]["length"] for k in range(len(parts))] == [len(p.encode()) for p in parts]
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert sum(r["n_tokens"] for r in rows[i].values()) == len(ids) == rows[i][0]["document_tokens"]
        section = [k for k, p in enumerate(parts) for _ in p.encode()]  # of every byte; a byte is a sign of a token's name
        tokens, crossing, at = collections.Counter(), collections.Counter(), 0
        for own in ids:
            size = len(t.id_to_token(own))
            inside = section[at : at + size]
            home = {"first": inside[0], "last": inside[-1], "most": max(sorted(set(inside)), key=inside.count)}[rule]
            tokens[home] += 1
            crossing[home] += len(set(inside)) > 1
            at += size
        assert at == len((x or "").encode()) and [(rows[i][k]["n_tokens"], rows[i][k]["n_crossing"]) for k in range(len(parts))] == [(tokens[k], crossing[k]) for k in range(len(parts))]


def test_attribution_rules():
    starts, ends = np.array([0, 4, 6]), np.array([4, 6, 10])
    token_start, token_end = np.array([0, 3, 7]), np.array([3, 7, 10])
    assert [token_counts.attribute(starts, ends, token_start, token_end, r)[0].tolist() for r in ("first", "last", "most")] == [[0, 0, 2], [0, 2, 2], [0, 1, 2]]


def test_topk(docs, texts, spark):
    tf = {i: collections.Counter(words(t)) for i, t in enumerate(texts)}
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = collections.Counter(w for c in tf.values() for w in c)
    asked = docs.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in topk.search(docs, asked, k=5, shard_bytes=4000, block_bytes=3000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 9)))
    for q in (i for i in tf if i % 7 == 0):
        score = {}
        for i, c in tf.items():
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s > 0:
                score[i] = round(s, 9)
        assert [s for _, s in got[q]] == pytest.approx(sorted(score.values(), reverse=True)[:5])
        assert all(score[i] == pytest.approx(s) for i, s in got[q])


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://net/", "http://net", "http://example.com/de/1", "http://b.example.org/fr/", "http://xorg/fr/", "http://cheap-pills.example.com/en/", "http://u.com?x=/net/", "http://adult-x.example.com/de", "ftp://q.net#/"]
    rows = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.HOST_RULES, queries.PATTERN_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("example.com", "/de/1", "example.com/de/", "block"),
        ("b.example.org", "/fr/", "org/fr/", "allow"), ("xorg", "/fr/", None, "allow"), ("cheap-pills.example.com", "/en/", None, "block"), ("u.com", "", None, "allow"), ("adult-x.example.com", "/de", None, "block"), ("q.net", "", None, "allow"),
    ]


def test_thousands_of_url_rules(spark):
    """Random rules by rarest token give what trying every rule gives; borders are ASCII, and other columns stay unread."""
    rng = random.Random(11)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rules = []
    for n in range(3000):
        a, b = rng.choice(words_), rng.choice(words_)
        pattern, literals = rng.choice([(rf"\b{a}\b.*\b{b}\b", (a, b)), (rf"://{a}\.", (a,)), (rf"/{a}(/|$)", (a,)), (rf"\b{a}-{b}\b", (a, b)), (rf"[?&]{a}=\d+", (a,))])
        rules.append(url_filter.PatternRule(str(n), pattern, literals, rng.choice(["block", "block", "allow"])))
    urls = [f"http://{rng.choice(words_)}.{rng.choice(words_)}/{'/'.join(rng.choice(words_) for _ in range(rng.randint(0, 3)))}?{rng.choice(words_)}={rng.randint(0, 9)}" for _ in range(300)]
    urls += ["http://a.com/écheap-pills", "http://a.com/cheap-pillsé", "HTTP://CHEAP-PILLS.com", None, "", "x" * 5000 + "://cheap-pills/", urls[0], urls[0]]
    rules.append(url_filter.PatternRule("pills", r"\bcheap-pills\b", ("cheap", "pills")))
    df = spark.createDataFrame([(i, u, "h", "p", "r", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string, token string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(df, (), rules).collect()}

    def brute(url):
        low = (url or "").translate(LOWER)
        return next((r.verdict for r in rules if re.search(r.pattern, low, re.ASCII)), "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)} and got[300] == "block" and len(set(got.values())) == 2


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.QUERIES["op10_url_filters"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def near_groups(rows):
    """Components of (id, text) rows by brute force, as lists of places."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    groups = collections.defaultdict(list)
    for k, g in enumerate(label):
        groups[g].append(k)
    return list(groups.values())


def test_pipeline_against_brute_force(spark, tmp_path, docs, texts):
    """Every stage on its predecessor's rows, with ids that repeat, against plain Python; language ID against its
    operator, row by row, and the letters of the texts."""
    import corpus_pipeline

    more = [(3, texts[40]), (7, "a wholly different text of several words"), (1, texts[1]), (None, texts[2]), (12, texts[2] + " tail")]
    rows = [(i, t) for i, t in enumerate(texts)] + more
    spark.createDataFrame([(i, t, "en", "s", 1, "k", "n", "p", "h") for i, t in rows], SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")

    def after(df, stage):
        out = stage(spark, df, str(tmp_path)).cache()
        return out, sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key)

    stages = dict(corpus_pipeline.STAGES)
    out, left = after(now, stages["language_id"])
    assert out.columns == now.columns and all(re.search(r"[^\W\d_]", t or "") for _, t in left) and set(left) <= set(rows)
    verdicts = langid.identify(now, langid.train(now)).filter("lang_pred <> 'und'").filter(F.col("score") >= langid.REJECT)
    assert len(left) == verdicts.count()

    out, got = after(out, stages["exact_dedup"])
    best = {}
    for r in left:
        best[r[1]] = max(best.get(r[1], r), r, key=key)
    assert out.columns == now.columns and got == sorted(best.values(), key=key)

    left, (out, got) = got, after(out, stages["ngram_jaccard"])
    want = [min((left[k] for k in g), key=lambda x: (x[0] is None, x[0] or 0)) if words(left[g[0]][1]) else left[g[0]] for g in near_groups(left)]
    assert out.columns == now.columns and len(got) == len(want) and sorted(x[0] or -1 for x in got) == sorted(x[0] or -1 for x in want)

    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sorted(r["length"] for r in run) == sorted(n for _, x in got for _, n in packing.cut(len(t.encode(x, add_special_tokens=False).ids) + 1, 1024))
    bins = collections.Counter()
    for r in run:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024


def test_near_stage_keeps_other_rows_of_an_id(spark):
    """Of (1, A), (7, near copy of A) and (7, another text) the last stays, whatever other columns are named."""
    base = [f"word{k}" for k in range(100)]
    rows = [(1, " ".join(base), 1, 2, 3, 4), (7, " ".join([*base[:99], "end"]), 1, 2, 3, 4), (7, "another text of a few words", 5, 6, 7, 8), (None, " ".join(base), 1, 1, 1, 1), (9, "", 1, 1, 1, 1), (9, None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _gone_id int, _digest int, key int")
    left = ngram_jaccard.without_near_copies(df)
    assert left.columns == df.columns and {tuple(r) for r in left.collect()} == {rows[0], rows[2], rows[4], rows[5]}


def test_exact_stage_with_clashing_columns(spark):
    rows = [(5, "x", 1, 2, 3), (5, "x", 1, 2, 3), (6, "x", 1, 2, 3), (6, "y", 1, 2, 3), (None, "", 0, 0, 0), (4, None, 9, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest int, _gone_id int, _gone_digest int")
    assert sorted(map(tuple, exact_dedup.without_copies(df).collect())) == [rows[5], rows[2], rows[3]]
    twice = spark.createDataFrame([rows[0], rows[0]], df.schema)
    assert [tuple(r) for r in exact_dedup.without_copies(twice).collect()] == [rows[0]]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("members", [0, 10, 200_000])
def test_bitmap_has_every_member(spark, members):
    from marginalia.llm.common import bitmap, in_bitmap

    hashes = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, members + 50_000)
    bits = np.frombuffer(bitmap(spark.createDataFrame([(int(x),) for x in hashes[:members]], "h long")), np.uint8)
    assert len(bits) == 1 << max(16, (members * 8 - 1).bit_length() - 3 if members else 16)
    known = in_bitmap(bits, hashes)
    assert known[:members].all() and known[members:].mean() < 0.2
