import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, id long, items binary, bucket long"


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    """Documents with exact and near copies, shared lines and passages, and every odd text there is."""
    rng = random.Random(7)
    texts = {}
    for i in range(60):
        texts[i] = "\n".join(" ".join(words(rng, rng.randrange(3, 40))) for _ in range(rng.randrange(1, 6)))
    for i in range(60, 80):
        w = texts[i - 60].split(" ")
        for k in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts[i] = " ".join(w)
    passage = " ".join(words(rng, 70))
    for i in range(80, 90):
        texts[i] = " ".join(words(rng, 90)) + " " + passage + " " + " ".join(words(rng, 30))
    line = " ".join(words(rng, 12))
    for i in range(90, 110):
        x = line.split()
        x[i % 12] = f"y{i}" if i % 2 else x[i % 12]
        texts[i] = " ".join(words(rng, 20)) + "\n" + " ".join(x) + "\n"
    texts |= {110: "", 111: None, 112: " \n\t ", 113: "one two", 114: "one two", 115: "ONE two", 116: "é ñ ö\x00x", 117: "q " * 30000, 118: "long" * 20000, 119: "\n\n\n"}
    texts[120] = texts[5]
    return texts


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None, len(t or ""), 1, 2, b"x", 3) for i, t in texts.items()]
    rows += [(None, "no id here at all", None, "s", 1, None, None, None, None), (5, texts[5], "en", "s", 1, 1, 1, None, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    from folio.llm.scratch import Scratch

    return Scratch(spark)
