"""The pipeline against a plain version of every stage, on a small corpus that has what each stage looks for."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken
from test_brute_force import WORD, brute_components, brute_hits

import corpus_pipeline
from marlspan.llm import bpe
from marlspan.llm.quality import Rules

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def corpus_of(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "naïve", "中文"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    items = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(4)]
    lines = ["Home", "About us", "Our news", "Contact", "home | about | contact | more", "We use cookies here", "BUY! NOW! WOW!", "a### b*** c%%%", "To be read on ...", "All rights reserved."]
    rows = []
    for k in range(90):
        parts = [prose(rng.choice((15, 40, 80))) for _ in range(rng.choice((1, 2, 3)))]
        if k % 4 == 0:
            parts[rng.randrange(len(parts)) : 0] = lines[: rng.choice((3, 4))] if k % 8 else [rng.choice(lines[4:])]
        if k % 5 == 0:
            parts.append(parts[0])
        if k % 6 == 0:
            parts.append(f"Write to who{k}@mail.example.org or 10.0.0.{k}, card 4111 1111 1111 1111, call +49 30 1234567.")
        if k % 9 == 0:
            parts.insert(0, "So " + items[k % 4][1] + " it is.")
        text = "\n".join(parts)
        rows.append((2 * k, text))
        if k % 7 == 0:
            rows.append((2 * k + 1, text if k % 2 else text.replace("w1 ", "w1 new ", 1)))
    rows += [(1001, None), (1003, ""), (1005, "too short"), (1007, "\n".join(f"x{k}### y{k}*** z{k}&&&" for k in range(30))), (1009, ("the same eight words come again and again " * 12))]
    return rows, [(i, t) for i, t in items]


def brute_quality(text):
    """The text without the lines that fail, or None."""
    r, text = Rules(), text or ""
    lines = text.split("\n")
    n = [len(WORD.findall(x)) for x in lines]
    with_words = [k for k in range(len(lines)) if n[k]]
    fails, seen = set(), set()
    for k in with_words:
        x = lines[k]
        fails |= {k} if x in seen else set()
        seen.add(x)
        phrases = len(re.findall("|".join(map(re.escape, r.boilerplate)), re.sub("[A-Z]", lambda m: m[0].lower(), x)))
        last = WORD.findall(x)[-1]
        if sum(c in "#*$%&|<>" for c in x) > 0.5 * n[k] or x.count("!") > 0.5 * n[k] or (x.count("|") >= 2 and x.count("|") >= 0.25 * n[k]) or 15 * phrases >= n[k] or x[: x.rindex(last) + len(last)].endswith(("...", "…")):
            fails.add(k)
    open_ = lambda k: n[k] <= r.menu_words and not re.search(r"""[.!?:;,"')\]}]$|[^\x00-\x7f]$""", WORD.findall(lines[k])[-1])
    run = []
    for k in [*with_words, None]:
        if k is not None and open_(k):
            run.append(k)
            continue
        fails |= set(run) if len(run) >= r.menu_lines else set()
        run = []
    w = WORD.findall(text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {x for ks in at.values() if len(ks) > 1 for k in ks for x in range(k, k + 8)}
    lost = sum(n[k] for k in fails)
    if len(w) < 20 or 100 * len(repeated) > 30 * len(w) or lost > 0.5 * len(w) or len(w) - lost < 20:
        return None
    return "\n".join(x for k, x in enumerate(lines) if k not in fails)


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute_redacted(text):
    """Base kinds alone: the corpus has no others."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "EMAIL": (EMAIL, lambda s: True), "IP": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "CARD": (CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), "PHONE": (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    }
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in good.items() for m in p.finditer(text) if ok(m[0]))
    out, at = "", 0
    for start, kind, end in spans:
        assert start >= at  # none overlap here
        out, at = out + text[at:start] + f"[{kind}]", end
    return out + text[at:]


def test_pipeline_equals_the_plain_one(spark, tmp_path):
    rows, items = corpus_of(21)
    sf = f"file://{tmp_path}"
    wide = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    kept = [(i, q) for i, t in rows if (q := brute_quality(t)) is not None]
    one = {i for i, _, c in brute_components(kept) if i == c}
    unique = [(i, t) for i, t in kept if i in one]
    bad = {h[0] for h in brute_hits(unique, items) if h[5]}
    private = [(i, brute_redacted(t)) for i, t in unique if i not in bad]
    assert len(rows) > len(kept) > len(unique) > len(private) > 20 and any("[CARD]" in t for _, t in private)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in private:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
