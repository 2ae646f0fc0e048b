"""Tokens, page text, toxicity and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from marlspan.llm import bpe, html_extract, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


def test_encoder_equals_the_library(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks), random.Random(4)
    texts = ["", " ", "  a", "a  b ", "it's 'tis don't", "\x1c\x85　x", "x" * 20_000, "\U0001f600é中" * 50, "<|endoftext|>"]
    texts += ["".join(rng.choice("aábcdeèiou 01 9''s\n\t  .,;!?中文字émojis😀ÀÉthe ing　\x1c\x85\r") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("abetinosr") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), "<u4").tolist()
        assert ids == library.encode_ordinary(t)
        assert decoder.feed(ids) + decoder.finish() == t


def test_small_tables_change_nothing(ranks, monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "MOST", 3)
    monkeypatch.setattr(bpe.Transducer, "MOST", 3)
    monkeypatch.setattr(bpe.Merges, "MOST", 3)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, text = bpe.Encoder(ranks, public_tokenizers.PATTERN), "many different unheardofwords zzyqx here and thereabouts " * 3
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_streaming_decode_in_any_pieces(ranks):
    decoder = bpe.Decoder(ranks)
    ids = [ranks[bytes([b])] for b in "a中😀é".encode()]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "a中😀é"
    assert decoder.feed([ranks[b"\xe4"]]) == "" and decoder.finish() == "�"


def test_digests(spark, corpus):
    rows, docs = corpus
    text = {i: t or "" for i, t in rows}
    for r in bpe.digests(bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def odd_spaces(seed, n):
    """Texts with white space of every kind, at ends, alone and in runs, and other characters that end in the same bytes."""
    rng = random.Random(seed)
    parts = ["word", "a", "Été", "don't", "42", "中文", "😀", "\u2019", "«", "\u1681", "\u3001", "!?", " ", " ", " ", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_through_spark_equal_the_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "<|endoftext|>", "x " * 50_000, "y" * 30_000, *odd_spaces(8, 400)]
    rows = [(k, t, 1, "z") for k, t in enumerate(texts)] + [(3, texts[3], 1, "z")] * 2 + [(None, "a b", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string").repartition(3)
    got = [tuple(r) for r in bpe.digests(bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)).collect()]
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_decode(docs.where("doc_id > 99999"), PATH, public_tokenizers.PATTERN).count() == 0


def test_batch_decoding_of_any_ids(ranks):
    """Ids that are no text: every maximal bad part gives one U+FFFD, as in the token-by-token decoder."""
    rng, decoder = random.Random(5), bpe.Decoder(ranks)
    odd = [ranks[bytes([b])] for b in (0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xC0)] + [ranks[b"a"], ranks[b" the"]]
    lists = [[rng.choice(odd) for _ in range(rng.randint(0, 12))] for _ in range(800)]
    first = np.cumsum([0, *map(len, lists)])
    got = decoder.decode_all(np.array([i for x in lists for i in x], np.int64), first).to_pylist()
    assert got == [b"".join(decoder.tokens[i] for i in x).decode("utf-8", "replace") for x in lists]


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; sell now</div>
<article><h1>The   title&nbsp;here</h1><p><b>First &lt;part&gt;
of it.<br><p>Second part &amp more &#233;t&eacute;. It goes on.</p><p></p><p>Third.</p></article>
<section class="comments"><div class="comment"><p>I do not agree with this.</p></div></section><form class="search"><p>Search this site</p></form>
<aside class="sidebar"><p>Most read today</p></aside><footer>&copy; someone</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "<p", 0), (5, "u", "<nav><a>x</a>", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    want = "The title here\nFirst <part> of it.\nSecond part & more été. It goes on.\nThird."
    assert got[1].text == want and got[1].n_chars == len(want)
    assert [got[k].text for k in (2, 3)] == ["", ""] and len(got) == 5


def test_labeller_on_unseen_layouts():
    maker = html_extract.PageMaker(12345)
    made = [maker.page() for _ in range(150)]
    good = html_extract.label([b for b, _ in made], html_extract.trained())
    assert np.mean(np.concatenate([g == (y > 0) for g, (_, y) in zip(good, made)])) > 0.97


def test_gradients_of_the_network():
    p = html_extract.Params(hidden=3, path_cells=2, word_cells=2)
    rng = np.random.default_rng(0)
    lstm = html_extract.Lstm(4, 3, rng)
    x, mask = rng.normal(size=(5, 2, 4)), np.ones((5, 2), bool)
    mask[3:, 1] = False
    lstm.wx, lstm.wh, lstm.b = lstm.wx.astype(float), lstm.wh.astype(float), lstm.b.astype(float)
    weights = rng.normal(size=(5, 2, 3)) * mask[:, :, None]
    loss = lambda: float((lstm.forward(x, mask) * weights).sum())
    keep = []
    lstm.forward(x, mask, keep)
    for w, g in zip((lstm.wx, lstm.wh, lstm.b), lstm.backward(x, keep, weights)):
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3
    assert p.hidden == 3


# ---- toxicity ----


def toxic_corpus(seed, n=1500):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(("idiot", "vequlo", "vequda", "scumm", "YOU moron")))
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(1)
    more = [(10_000, None), (10_001, ""), (10_002, "x" * 200_000)]
    frame = spark.createDataFrame(docs + more, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, marks).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)
    assert np.mean([p == t for p, t in held]) > 0.95
    # held-out labels teach nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(frame, flipped).collect()}
    assert all(again[i] == r.score for i, r in got.items())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]


# ---- the pipeline ----


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() <= docs.count()
            docs = out
    assert out.count() == docs.count() > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, out.collect()))
