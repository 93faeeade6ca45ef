import random

import pytest

from tests.conftest import spark  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, found string, target string, list int, rank int"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict[int, str | None]:
    """Copies, near copies, shared passages, runs of one character, empty and very long texts."""
    r = random.Random(3)
    base = [sentence(r, 80) for _ in range(25)]
    passage = sentence(r, 25)
    out: dict[int, str | None] = {}
    for i in range(120):
        t = base[i % 25]
        words = t.split()
        if i % 3 == 1:
            for _ in range(i % 7):
                words[r.randrange(len(words))] = sentence(r, 1)
            t = " ".join(words)
        if i % 5 == 2:
            t = sentence(r, 10) + " " + passage + "\n" + sentence(r, 10)
        if i % 6 == 5:
            t = sentence(r, 60) + "\n" + "Released under the MIT License." + "\n" + sentence(r, 3)
        out[i] = t
    out |= {120: None, 121: "", 122: " \n\t ", 123: "a" * 400, 124: "a" * 300, 125: "b a" * 100, 126: "one two", 127: "one two", 128: "é" * 60 + "日本語" * 30, 129: "日本語" * 30}
    out[130] = sentence(r, 40_000)
    out[131] = out[130][:100_000] + " " + sentence(r, 300)
    out[132] = "This work is licensed under the GNU General Public License, version 3.\nGNU GENERAL PUBLIC LICENSE cc by cc BY"
    out[133] = "###\n###\n\nx y z x y z x y z | <b>"
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):  # noqa: F811
    """The texts with extra columns whose names the operators use themselves."""
    sources = [None, "b", "a", "é", "hot"]
    rows = [(i, t, ("en", "fr", None)[i % 3], sources[min(i % 9, 4)], len(t or ""), 0.5, "x", "y", 1, 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)
