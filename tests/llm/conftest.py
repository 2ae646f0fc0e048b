import random

import pytest

#: A small vocabulary makes shared shingles, windows and passages likely.
VOCABULARY = [f"w{k}" for k in range(40)] + ["Über", "naïve", "x.y", "Ça,"]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def texts_of(seed):
    """Random texts with copies, near copies, shared passages, repeats, odd white space, nulls and a very long one."""
    rng = random.Random(seed)
    shared = passage(rng, 60)
    out = [None, "", " \n\t ", "one", "one two three four", "one two three four", "a " * 70, "\x1c\x85 odd space  words"]
    for _ in range(40):
        words = passage(rng, rng.choice((3, 5, 8, 30, 60, 120)))
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            words[at:at] = shared[: rng.choice((20, 40, 60))]
        out.append(rng.choice((" ", " ", "\n", "  ")).join(words))
        if rng.random() < 0.3:
            out.append(out[-1])
        if rng.random() < 0.5:
            near = words[:]
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = "new"
            out.append(" ".join(near))
    out.append(" ".join(passage(rng, 30_000)))
    return out


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text) rows as a list and as a DataFrame that has columns with clashing names."""
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts_of(7))]
    rows += [rows[20], rows[20]]  # repeated rows
    wide = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 5) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, sig string, __block int"
    return rows, spark.createDataFrame(wide, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
