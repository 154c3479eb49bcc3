import random

import pytest
from pyspark.sql import functions as F

ODD = [None, "", " \t\n", "one", "One  two\tthree", "é" * 300, "a b c d e f g h i j k l m n o p " * 40, "x" * 5000]


def invented(n, seed=1):
    """Texts with copies, near copies, shared passages and repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages, texts = [prose(60) for _ in range(4)], list(ODD)
    base = prose(120)
    for i in range(n):
        text = prose(rng.randint(3, 150))
        if i % 3 == 0:
            text = f"{text} {rng.choice(passages)} {prose(10)}"
        if i % 5 == 0:
            w = rng.choice([t for t in texts if t]).split(" ")
            w[rng.randrange(len(w))] = "CHANGED"
            text = " ".join(w)
        if i % 7 == 0:
            w = base.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        if i % 11 == 0:
            text = rng.choice([t for t in texts if t])
        texts.append(text)
    return dict(enumerate(texts))


@pytest.fixture(scope="session")
def texts():
    return invented(160)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with columns that clash with those of the results; one row stands twice and one has no id."""
    rows = [(d, t, f"src{d % 5}" if d % 9 else None, "en" if d % 2 else None, len(t or "")) for d, t in texts.items()]
    table = spark.createDataFrame([*rows, rows[20], (None, texts[30], "src1", None, 3)], "doc_id long, text string, source string, lang string, n_chars long")
    clash = ("part", "kept", "spans", "key", "cls", "size", "copies", "slot", "score", "rest", "n_bytes", "rank", "token", "start")
    return table.withColumns({c: F.lit("extra") for c in clash}).repartition(5)
