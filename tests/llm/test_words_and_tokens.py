"""Spelling variants, fingerprints and token alignment against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash

from marlspan.llm import simhash, spelling, token_align

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
SCHEMA = "doc_id long, text string, n long, word string, name string, fp long, rid long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3) for i, t in rows], SCHEMA).repartition(parts)


# ---- spelling ----


def brute_variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    others = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return {(w, forms.get(w), root(w), n, len(others[w]), words.get(forms.get(w))) for w, n in words.items()}


def variants(spark, rows):
    found = [tuple(r) for r in spelling.variants(frame(spark, rows)).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_variants(spark):
    rng = random.Random(5)
    heads = ["aaaaaaa", "naïvetés", "straßenbahn", "variant", "spellings", "ÿÿÿÿÿÿÿÿ"]
    rows = [(None, "Variant"), (1, None), (2, ""), (3, "×÷ · 123")]
    for k in range(160):
        words = []
        for _ in range(25):
            w = rng.choice(heads)
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(("", "b", "é", w[i] * 2)) + w[i + 1 :]
            words.append(rng.choice((w, w.upper(), w.capitalize())))
        rows.append((k, rng.choice((" ", ", ", "\n", "1")).join(words)))
    rows += rows[5:25]
    expected = brute_variants(rows)
    assert len(expected) > 100 and sum(x[1] is not None for x in expected) > 30
    assert variants(spark, rows) == expected


def test_long_words(spark):
    """Words of over 64 bytes, on both sides of that length, of a chain, and one of 20,000 letters."""
    base, huge = "ab" * 31 + "c", "xyz" * 7000
    rows = [(k, " ".join([base + "e"] * 130 + [base + "ed"] * 12 + [base] * 3 + [huge, huge[:50] + huge[51:]])) for k in range(3)]
    rows += [(10, " ".join([base + "edé"] * 2 + [huge] * 40))]
    assert variants(spark, rows) == brute_variants(rows)


def test_no_words(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert variants(spark, [(1, "one two"), (2, None)]) == set()


# ---- fingerprints ----


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def brute_components(fps, bits=3):
    """Least index of each one's component."""
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps) <= bits
    while True:
        least = np.where(near, label, len(fps)).min(axis=1)
        if np.array_equal(least[least], label):
            return label
        label = least[least]


def test_near_duplicates(spark, corpus):
    rows, docs = corpus
    rng = random.Random(8)
    long = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(3000)]
    more = [(5000 + k, " ".join(long[:j] + ["new"] * (k % 4) + long[j + k % 3 :])) for k, j in enumerate(rng.sample(range(3000), 40))]
    rows = rows + more + [(None, more[0][1]), (None, "alone and nameless"), (9999, None)]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((i, f"{fps[t]:016x}") for i, t in rows)
    distinct = sorted(set(fps.values()))
    label = dict(zip(distinct, brute_components(distinct)))
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[fps[t]]] = min(i, least.get(label[fps[t]], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{fps[t]:016x}", least.get(label[fps[t]])) for i, t in rows}
    assert len(set(label.values())) < len(distinct)


@pytest.mark.parametrize("params", [simhash.Params(shard=64, sample=500, chunk=50, share=90), simhash.Params(shard=100_000)])
def test_links_of_fingerprints(spark, params):
    """Random ones, near copies, and a dense ball of over a thousand around one of them."""
    rng = np.random.default_rng(4)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, len(x))).astype(np.uint64), axis=0)
    base = rng.integers(0, 1 << 64, 800, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, flip(base, 3), flip(base, 5), flip(np.repeat(base[:1], 1200), 4), np.array([0, (1 << 64) - 1], np.uint64)]))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    label = np.arange(len(fps))
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    for r in simhash.links(nodes, params).collect():
        a, b = label[at[r.a]], label[at[r.b]]
        assert int(fps[at[r.a]] ^ fps[at[r.b]]) != 0
        label[label == max(a, b)] = min(a, b)
    assert np.array_equal(label, brute_components(fps))


def test_no_fingerprints(empty):
    assert simhash.near_duplicates(empty).count() == 0


# ---- alignment ----


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_align.byte_letters()
    docs = []
    for i, t in rows:
        tokens = ([], [])
        if t:
            for k in a_side.encode(" " + t, add_special_tokens=False).ids:
                tokens[0].append((k, bytes(letters[c] for c in a_side.id_to_token(k)) if k != 50256 else b"<|endoftext|>"))
            for k in b_side.encode(t):
                piece = b_side.id_to_piece(k)
                tokens[1].append((k, bytes([int(piece[3:5], 16)]) if b_side.is_byte(k) else piece.replace("▁", " ").encode()))
            if any(b"".join(x for _, x in side) != (" " + t).encode() for side in tokens):
                tokens = ([], [])
        spans = []
        for side in tokens:
            at, out = 0, []
            for k, x in side:
                out.append((k, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = ["|".join(",".join(str(k) for k, s, e in side if low <= s and e <= high) for side in spans) for low, high in zip([0, *ends], ends)]
        links = [(a, b) for a, s, e in spans[0] for b, s2, e2 in spans[1] if s < e2 and s2 < e]
        docs.append((i, len(spans[0]), len(spans[1]), groups, links))
    held = Counter(p for *_, links in docs for p in set(links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return Counter((i, n_a, n_b, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha256(";".join(g).encode()).hexdigest() if n_a else "") for i, n_a, n_b, g, links in docs)


ODD = ["x▁y", "▁", "a\x00b", "<|endoftext|> and <s> </s> <unk> <0x41>", " lead  two   three ", "\n\n \t", " ", "tab\there don't it's", "日本語 русский \U0001f600 é", "\xa0nbsp\xa0 \x85 \x1c  x", "a" * 3000, "1 234,5 67"]


@pytest.mark.parametrize("broadcast_pairs", [token_align.BROADCAST_PAIRS, 0])
def test_alignment(spark, broadcast_pairs, monkeypatch):
    rng = random.Random(2)
    pieces = ["the", "Token", "isation", "naïve", " ", " ", "\n", ".", "über", "x", "▁", "日", "  ", "9"]
    rows = [(k, t) for k, t in enumerate([None, "", *ODD])]
    rows += [(100 + k, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 120)))) for k in range(80)]
    rows += rows[4:20] + [(None, "nameless tokens")]
    found = token_align.align(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), broadcast_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == brute_alignment(rows)


def test_alignment_of_no_texts(spark, empty):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert token_align.align(empty, *paths).count() == 0
    assert [tuple(r) for r in token_align.align(frame(spark, [(1, None)]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_encoders_as_the_libraries(corpus):
    """Runs by themselves and whole texts give the same ids."""
    rows, _ = corpus
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    side = token_align.byte_level_side(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " + t for _, t in rows if t] + [" " + t for t in ODD]
    ids, counts = side.ids(texts)
    at = np.append(0, np.cumsum(counts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
