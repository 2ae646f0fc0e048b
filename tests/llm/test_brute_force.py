"""The operators against plain implementations of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.llm import decontaminate, lattice_lm, ngram_join, pii, quality, secret_scan, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def multiset(rows):
    return Counter(map(tuple, rows))


# ---- near duplicates ----


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i)) for i, _ in rows]


@pytest.mark.parametrize("params", [ngram_join.Params(), ngram_join.Params(sketch_cells=1 << 17, chunk=2, probes=2, broadcast_rows=0), ngram_join.Params(chunk=3)])
def test_jaccard_components(corpus, params):
    rows, docs = corpus
    assert multiset(ngram_join.jaccard_components(docs, params).collect()) == multiset(brute_components(rows))


def test_jaccard_frequent_shingles(spark):
    """Many near copies of a few texts: nearly all shingles are frequent, so combinations decide."""
    rng = random.Random(3)
    rows = []
    for base in range(4):
        words = [f"b{base}_{k}" for k in range(80)]
        for k in range(60):
            near = words[:]
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                near[rng.randrange(80)] = f"n{rng.random()}"
            rows.append((base * 1000 + k, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert multiset(ngram_join.jaccard_components(docs).collect()) == multiset(brute_components(rows))


def test_signatures_of_linked_sets_meet():
    """Whatever the classes are, two sets with enough overlap share a signature."""
    import numpy as np

    rng, p = np.random.default_rng(5), ngram_join.Params()
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        change = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.concatenate([a[change:], rng.integers(0, 1 << 63, int(rng.integers(0, change + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        counts = np.full(2 * 1024, 0, np.uint32)
        counts[:] = np.tile(rng.choice([1, 500, 100_000], 1024, p=[0.2, 0.4, 0.4]).astype(np.uint32), 2)
        order = ngram_join.Order(counts, 1024)
        order.frequent, order.very_frequent = 100, 10_000
        sig, text = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), order, p)
        assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist())


@pytest.mark.parametrize("percent", [80, 45])
def test_bounds_leave_linked_sets_a_partner(percent):
    rng = np.random.default_rng(6)
    for _ in range(60):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 700))).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15, 0.6])], rng.integers(0, 1 << 63, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(8)]
        sets = [s for s in sets if len(s)]
        if len(sets) < 2:
            continue
        h, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        member, probe = np.arange(len(sets) // 2), np.arange(len(sets) // 2, len(sets))
        good_member, good_probe = ngram_join.partners(ngram_join.bit_maps(h, first).to_pylist(), np.diff(first), member, probe, percent)
        for a in member.tolist():
            for b in probe.tolist():
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    assert good_member[a] and good_probe[b]


def test_many_short_texts_that_share_a_line(spark):
    """One line in all of them, some with a partner, none of the links lost in the common combinations."""
    rng = random.Random(12)
    line = "this one common line stands in every text here"
    rows = []
    for k in range(260):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice((0, 1, 2, 3, 6, 30)))]
        rows.append((k, f"{line} {' '.join(own)}"))
        if k % 5 == 0:
            rows.append((1000 + k, f"{line} {' '.join([*own, 'more'])}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for params in (ngram_join.Params(), ngram_join.Params(chunk=16, probes=16)):
        assert multiset(ngram_join.jaccard_components(docs, params).collect()) == multiset(brute_components(rows))


def test_one_of_each_keeps_the_smallest(corpus):
    rows, docs = corpus
    kept = [r.doc_id for r in ngram_join.one_of_each(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components(rows)})


def test_null_id_takes_a_named_copy(spark):
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, text), (5, text), (None, "other words here")], "doc_id long, text string")
    got = multiset((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == Counter({(None, 6, 5): 1, (5, 6, 5): 1, (None, 1, None): 1})


# ---- quality ----


def test_quality(corpus):
    rows, docs = corpus
    want = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        found = defaultdict(list)
        for k in range(len(w) - 7):
            found[tuple(w[k : k + 8])].append(k)
        hit = {x for at in found.values() if len(at) > 1 for k in at for x in range(k, k + 8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert multiset(got) == multiset(want)


def test_lines_that_fail_go(spark):
    prose = " ".join(f"Word{k}." for k in range(40))
    text = f"home | about | contact\n{prose}\nWe use cookies here\n{prose}\na### b*** c%%%"
    row = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_text=True).first()
    assert row.clean_text == prose and row.kept and row.n_lines_removed == 4 or row.base_failed
    junk = "\n".join(f"x{k}### y{k}*** z{k}&&&" for k in range(30))
    assert not quality.quality(spark.createDataFrame([(1, junk)], "doc_id long, text string")).first().kept


def test_clean_text_is_left_alone(spark):
    prose = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) + "." for k in range(5))
    docs = spark.createDataFrame([(1, prose, "en", "s", len(prose))], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.keep_documents(docs).collect() == docs.collect()


# ---- benchmark ----


def brute_hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[key]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [8 << 20, 200])
def test_decontamination(spark, corpus, most):
    """At once, and in passes over blocks of items."""
    rows, docs = corpus
    rng = random.Random(9)
    items = [(0, None), (1, ""), (2, "one, two"), (3, "ONE"), (10, "w1 w2")]
    for k in range(12):
        w = WORD.findall(rng.choice([t for _, t in rows if t and len(t) > 100]))
        at = rng.randrange(max(1, len(w) - 20))
        items.append((20 + k, " ".join(w[at : at + rng.choice((5, 13, 14, 30))])))
    items.append((99, items[-1][1]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark, max_index_bytes=most)
    want = brute_hits(rows, items)
    assert sum(r[2] for r in want) > 100
    assert multiset(got.collect()) == multiset(want)
    bad = {r[0] for r in want if r[5]}
    kept = decontaminate.clean_documents(docs, benchmark, max_index_bytes=most)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in bad)


def test_empty_benchmark(spark, corpus):
    rows, docs = corpus
    got = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert got.where("n_hit > 0").count() == 0 and got.count() == len(rows)


# ---- repeated passages ----


def brute_dedup(rows):
    first, out = {}, []
    words = {(i, t): WORD.findall(t or "") for i, t in rows}
    for (i, _), w in words.items():
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    for i, t in rows:
        w = words[i, t]
        gone = {x for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for x in range(k, k + 20)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize("params", [substring_dedup.Params(), substring_dedup.Params(block_bytes=3000, slice_bytes=5000, cells=64)])
def test_substring_dedup(corpus, params):
    """In few large blocks, and in many with a sketch so small that most cells collide."""
    rows, docs = corpus
    want = brute_dedup(rows)
    assert sum(r[2] for r in want) > 500
    assert multiset(substring_dedup.deduplicate(docs, params).collect()) == multiset(want)


# ---- personal data and secrets ----

SPANS = [
    "mail bob.x+1@mail.example.com, c@d.e and @nope x@y", "ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5.6.7.8 v 01.002.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111",
    "call +1 (988) 555-2485 or +49 30 1234 or +123456789012345678", "iban DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00", "phone (030) 123-4567 and 12-34", "a@b.c@d.e.f a..b@c-.d-", "é" * 30 + "x@y.zz",
]


def brute_pii(t):
    t = t or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return [sum(k == x for _, x, _ in out) for k in range(4)], sha(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in out))


def random_spans(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pii(spark):
    texts = [None, "", *SPANS, *random_spans(1, "a@.b1234567890-+ ()é", 400), "x " * 50_000 + "q@r.st"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        counts, digest = brute_pii(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest), texts[r.doc_id]


def test_pii_adds_and_redacts():
    spans = [s.kind for s in pii.find(SPANS[4])]
    assert spans.count("iban") == 1
    assert [s.kind for s in pii.find("phone (030) 123-4567")] == ["national"] and pii.find("order (030) 123-4567") == []
    assert pii.redacted("to a@b.cc now", pii.find("to a@b.cc now")) == "to [EMAIL] now"


def test_secrets(spark):
    rows = [None, "", 'password="abcdefgh" token: short secret=secret: abcdefghijk API-KEY apikey=\'12345678', "AKIA" + "A" * 12 + " AKIAAKIA00", "deadbeef" * 5 + "G" + "0" * 31]
    rows += random_spans(2, ["token", "secret=", ":", "=", " ", "AKIA", "Z9", "abcdef", "0123456789", "é", "\n", "'", '"', "PassWord", "ſecret="], 300)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secret_scan.scan_secrets(docs).collect():
        t = rows[r.doc_id] or ""
        s = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in s) for k in range(3)], t
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s)))


def test_markov_ratio_tells_random_from_names(spark):
    words = ["getCustomerAccountName", "application_development_information", "src/main/resources/messages_de", "verkeitschaftlichungen-der-gesellschaft"]
    keys = ["x9Kq2LmZ8vRt4WbN7cYp1", "q7f3kz81mxp04vhw9t2bj", "Zk4tQ9xWv2Lr8NsB5mHy3Jd6"]
    docs = spark.createDataFrame([(k, f"see {w} here") for k, w in enumerate(words + keys)], "doc_id long, text string")
    got = {r.doc_id: "random" in r.spans for r in secret_scan.scan_secrets(docs).collect()}
    assert not any(got[k] for k in range(len(words))) and all(got[k] for k in range(len(words), len(got)))


# ---- the language model ----


def brute_probability(pieces, s):
    total = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(j):
            if s[i:j] in pieces.weight:
                total[j] += total[i] * math.exp(pieces.weight[s[i:j]])
        if s[j - 1] not in pieces.weight:
            total[j] += total[j - 1] * math.exp(pieces.spelled(s[j - 1]))
    return total[-1]


def test_lattice_is_the_sum_over_segmentations():
    import public_tokenizers

    pieces = lattice_lm.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    for word in ("a", "the", "therein", "naïve", "x\U0001f600y", "zzzzqq"):
        assert math.isclose(pieces.log_probability(word), math.log(brute_probability(pieces, "▁" + word)), rel_tol=1e-9)
    into = {}
    pieces.expect("therein", 3, into)
    letters = sum(n * (1 if p.startswith("<0x") else len(p)) for p, n in into.items())
    assert math.isclose(letters, 3 * len("▁therein"), rel_tol=1e-9)


def test_language_model_base(corpus):
    import public_tokenizers

    rows, docs = corpus
    words = [(i, WORD.findall(lower(t))) for i, t in rows]
    train = [(i, w) for i, w in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for _, w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = []
    for i, w in words:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((i, zlib.crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)))
    for params in (lattice_lm.Params(), lattice_lm.Params(block_bytes=2000, keep_words=10)):
        got = lattice_lm.score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), params)
        rows_ = got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        assert multiset((*r[:5], round(r[5], 6)) for r in rows_) == multiset(want)
        assert all(r.score < 0 for r in rows_)


def test_lattices_of_many_words_equal_those_of_one():
    import public_tokenizers

    pieces = lattice_lm.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinorstéçß中😀.,'") for _ in range(rng.choice((0, 1, 2, 3, 5, 5, 5, 8, 8, 12, 47, 48, 70)))) for _ in range(900)]
    times = [rng.randint(1, 9) for _ in words]
    many = lattice_lm.Lattices(pieces)
    assert all(math.isclose(a, pieces.log_probability(w), rel_tol=1e-9) for a, w in zip(many.log_probabilities(words), words))
    got, want = {}, {}
    many.expect(words, np.array(times), got)
    for w, n in zip(words, times):
        pieces.expect(w, n, want)
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())


def test_language_model_score(corpus):
    """The score of each document, from plain loops over words and segmentations."""
    import public_tokenizers

    rows, docs = corpus
    path, p = public_tokenizers.path("piece_bpe_32k.model"), lattice_lm.Params()
    words = [(i, WORD.findall(lower(t))) for i, t in rows]
    train = [w for i, w in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in train for x in w)
    first = pieces = lattice_lm.Pieces.read(path)
    prior = {n: first.weight[n] if n in first.weight else first.bytes[int(n[1:-1], 16)] for n in first.names}
    for _ in range(p.rounds):
        expected = {}
        for w, n in c.items():
            pieces.expect(w, n, expected)
        total = math.fsum(expected.values()) + p.smoothing
        pieces = lattice_lm.Pieces.of(first.names, [(expected.get(n, 0.0) + p.smoothing * math.exp(prior[n])) / total for n in first.names])
    n, ends = sum(c.values()), len(train)
    on, end = math.log10((n + 1) / (n + ends + 2)), math.log10((ends + 1) / (n + ends + 2))
    one = {x: math.log10(brute_probability(pieces, "▁" + x)) + on for _, w in words for x in w}
    want = Counter((i, round(sum(one[x] for x in w) + end, 6)) for i, w in words)
    got = lattice_lm.score_documents(docs, path, lattice_lm.Params(together=7)).select("doc_id", "score").collect()
    assert Counter((i, round(s, 6)) for i, s in got) == want


# ---- empty tables ----


def test_empty_tables(spark, empty):
    import public_tokenizers

    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    results = [
        ngram_join.jaccard_components(empty), quality.quality(empty), decontaminate.decontaminate(empty, items), substring_dedup.deduplicate(empty), pii.find_pii(empty),
        secret_scan.scan_secrets(empty), lattice_lm.score_documents(empty, public_tokenizers.path("piece_bpe_32k.model")), ngram_join.one_of_each(empty), quality.keep_documents(empty), pii.redact_documents(empty),
    ]
    assert [df.count() for df in results] == [0] * len(results)
    assert F is not None
