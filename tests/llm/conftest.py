import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, text_1 string, id string, __x string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwéß") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def prose(rng, words, n):
    out = []
    for _ in range(n):
        w = rng.choice(words)
        out.append(w + rng.choice(["", "", "", "", ".", ",", "!", "\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) with copies, near copies, a shared passage, repeats, nulls, blanks and a long text."""
    rng = random.Random(4)
    words = vocabulary(rng)
    texts = [prose(rng, words, rng.randint(5, 160)) for _ in range(60)]
    passage = prose(rng, words, 60)
    base = prose(rng, words, 300)
    for i in range(45):  # a large group of near copies: more than a bucket compares in pairs
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0]] * 5
    texts += [prose(rng, words, 20) + " " + passage + " " + prose(rng, words, 20) for _ in range(4)]
    texts += [None, "", " \n\t", "one", "Two words", "a " * 100, "😀 ñandú　x", "tail.\n" * 30, prose(rng, words, 20000), "x" * 3000, "it's we'll 'tis   a  b\n\n c", "!!! ### $$$ | < > don't"]
    sources = ["a", "b", "c", "d", None]
    return [(k * 7 - 20, t, sources[0] if k % 3 == 0 else rng.choice(sources)) for k, t in enumerate(texts)]


def frame(spark, rows, schema=COLUMNS):
    """A documents table with more columns, some of whose names operators use inside."""
    return spark.createDataFrame([(k, t, "en", s, None if t is None else len(t), 1, "t", "i", "x") for k, t, s in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
