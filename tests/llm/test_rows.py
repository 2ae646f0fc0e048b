"""Rows are judged each by itself: alone, among others, in any order and partitioning."""

import random

import duckdb
import numpy as np
import pyarrow as pa

from marlspan.llm import oracles, quality, toxicity
from marlspan.llm import textkit as tk

#: Ends and beginnings that would make a phrase, a run of letters or a sign between letters if rows met.
PARTS = ["cook", "ies are", "abc aa", "a b", "a", "@b", "c@", "", "x", "terms of", " use", "click here", "d aaa", "no!", "so ...", "home", "\n", "| | |", "lorem", " ipsum dolor", "Ünï", "é", "é é"]


def rows_of(seed, n=120):
    rng = random.Random(seed)
    filler = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(25)) for _ in range(8)]
    return ["".join(rng.choice((*PARTS, *filler, "\n", " ")) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def alone_and_together(texts, measure):
    together = measure(*tk.text_buffer(pa.array(texts)))
    alone = np.concatenate([measure(*tk.text_buffer(pa.array([t]))) for t in texts])
    assert np.array_equal(together, alone)


def test_quality_of_a_row_depends_on_it_alone():
    alone_and_together(rows_of(1), lambda buf, off: np.stack(list(quality.judge(buf, off, quality.Rules())[0].values()), 1))


def test_toxicity_features_of_a_row_depend_on_it_alone():
    lexicon = toxicity.Lexicon([(0, int(np.uint64(toxicity._hash_of("abc")).astype(np.int64)), 3.0)])
    alone_and_together(rows_of(2), lambda buf, off: toxicity.features(buf, off, lexicon, 5))


def test_toxicity_scores_in_any_partitioning(spark):
    words = [f"w{k}" for k in range(60)]
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words) for _ in range(25)) + (" vequlo moron" if k % 4 == 0 else "")) for k in range(700)]
    rows += [(1000 + k, t) for k, t in enumerate(rows_of(4))] + rows[:3] + [(None, None)]
    wide = [(i, t, 7, "p", 0) for i, t in rows]
    docs = spark.createDataFrame(wide, "doc_id long, text string, toxic int, part string, x int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "clash") for k in range(700)], "doc_id long, toxic int, text string")
    one = sorted(map(tuple, toxicity.score_toxicity(docs.coalesce(1), labels).collect()), key=repr)
    many = sorted(map(tuple, toxicity.score_toxicity(docs.repartition(9), labels.repartition(5)).collect()), key=repr)
    assert len(one) == len(rows) and one == many
    assert toxicity.score_toxicity(docs.where("doc_id > 99999"), labels).count() == 0


def test_lines_of_boilerplate_and_menus():
    def removed(text):
        buf, off = tk.text_buffer(pa.array([text]))
        out, lines, good, _ = quality.judge(buf, off, quality.Rules())
        return [text.encode()[s:e].decode() for s, e, _ in lines[:, ~good].T.tolist()], bool(out["kept"][0])

    prose = [" ".join(f"Plain{k}x{j}" for j in range(12)) + "." for k in range(4)]
    long = " ".join(f"word{k}" for k in range(600)) + " and a cookie at the end."
    assert removed(long) == ([], True)  # a phrase in passing
    assert removed("\n".join([*prose, "This site uses cookies, click here."]))[0] == ["This site uses cookies, click here."]
    menu = ["Home", "About us", "Our products", "Contact"]
    assert removed("\n".join([prose[0], *menu, *prose[1:]])) == (menu, True)
    assert removed("\n".join([prose[0], *menu[:2], *prose[1:], *menu[2:]])) == ([], True)
    assert removed("\n".join([*prose, "And so it goes on ...", "To be read on…"]))[0] == ["And so it goes on ...", "To be read on…"]


def quality_rows():
    """A case for each rule on lines, on both sides of its threshold."""
    prose = [" ".join(f"Plain{k}x{j}" for j in range(12)) + "." for k in range(4)]
    lines = [
        " ".join(f"word{k}" for k in range(100)) + " cookie", "This site uses cookies, click here.", "we take cookies for granted " * 5, " ".join(["cookie"] + ["w"] * 14), " ".join(["cookie"] + ["w"] * 15), "Lorem IPSUM dolor", "COOKIE javascript " + "w " * 27,
        "And so it goes on ...", "And so it goes on ..", "to be read on\u2026", "dots... in the middle", "trailing dots... \t ", "...", "\u2026", "a | b | c", "| | |", "one | bar of many many words here", "# # # a b", "# a b c", "no! no! no!", "no! no no no", "100% $5 & more <b>",
        "", " ", "\r", prose[0], prose[1], " " + prose[0], "\u0130stanbul", "caf\xe9", "Home", "About us", "Our products", "Contact", "end.", "So:", "x)", "four words in line", "Stra\xdfe", "K\u212a", "a\u0300",
    ]
    out = ["\n".join([*prose, line]) for line in lines] + ["\n".join([line, *prose, line]) for line in lines] + lines
    menu = ["Home", "About us", "Our products", "Contact"]
    for between in ([], [""], [" "], ["end."], [prose[3]], ["caf\xe9"], ["four words in line"], ["Home"]):
        out += ["\n".join([*prose[:3], *menu[:2], *between, *menu[2:], prose[3]]), "\n".join([*prose, *menu, *between, *menu[:3]]), "\n".join([*menu[:3], *between, *prose])]
    rng = random.Random(9)
    out += ["\n".join(rng.choice((*lines, *menu, *menu)) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [None, "", "\n", " ".join(prose), *out, *out[:5]]


def test_quality_as_its_sql(spark, tmp_path):
    """The query and its SQL on crafted rows: every rule decides some line, either way."""
    rows = list(enumerate(quality_rows()))
    documents = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    db = duckdb.connect()
    db.register("documents", documents)
    expected = db.sql(oracles.SQL["op3_quality_rules"]).to_arrow_table().to_pylist()
    found = quality.quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: r["doc_id"]
    for a, b in zip(sorted((r.asDict() for r in found), key=key), sorted(expected, key=key), strict=True):
        assert a == b, rows[a["doc_id"]]
    assert {r["kept"] for r in expected} == {True, False} and len({r["n_lines_removed"] for r in expected}) > 8


def test_toxicity_fetches_no_more_than_its_sample(spark):
    """An id that a thousand rows share is one labelled row, whatever their order."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(25)) + (" vequlo moron" if k % 4 == 0 else "")) for k in range(400)]
    shared = [(8, f"copy {k % 7} of one id") for k in range(1000)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    frame = lambda r, n: spark.createDataFrame(r, "doc_id long, text string").repartition(n)
    small = toxicity.learn(frame(rows, 3), labels, toxicity.Params())
    large = toxicity.learn(frame(rows[:8] + [(8, min(t for _, t in [rows[8], *shared]))] + rows[9:], 3), labels, toxicity.Params())
    again = toxicity.learn(frame([*rows, *shared], 5), labels, toxicity.Params())
    texts = tk.text_buffer(pa.array([t for _, t in rows]))
    assert np.array_equal(again.score(*texts), large.score(*texts)) and not np.array_equal(small.knots, np.zeros(0))
