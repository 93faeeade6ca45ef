"""Count automata and collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import collocations
from millrace.llm.automata import Automaton, summed, union

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inside = Counter()
        for p in often:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], counts[p])
        found = []
        for p in often:
            a = counts[p]
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 2, 3, 5])
@pytest.mark.parametrize("top", [4, 300, 1 << 40])
def test_automata(width, top):
    r, shards, total = random.Random(width), [], Counter()
    for _ in range(4):
        c = Counter(tuple(r.randrange(top) if r.random() < 0.5 else r.randrange(3) for _ in range(width)) for _ in range(300))
        total += c
        rows, weights = summed(np.array(list(c.elements()), np.int64).reshape(-1, width), np.ones(300, np.int64))
        shards.append(Automaton.load(Automaton.build(rows, weights).dump()))
        again, counts = shards[-1].rows()
        assert (again == rows).all() and (counts == weights).all()
    rows, weights = union(shards)
    assert rows.tolist() == sorted(rows.tolist()) and dict(zip(map(tuple, rows.tolist()), weights.tolist(), strict=True)) == dict(total)
    paths = np.concatenate([rows[::3], np.array([[r.randrange(top) for _ in range(width)] for _ in range(100)], np.int64)])
    assert Automaton.build(rows, weights).weights(paths).tolist() == [total.get(tuple(p), 0) for p in paths.tolist()]


def test_tails_are_shared():
    rows = np.array([[i, 7, 8] for i in range(100)], np.int64)
    a = Automaton.build(rows, np.ones(100, np.int64))
    assert [len(labels) for _, labels, _ in a.levels] == [100, 1, 1]


def _rows():
    r = random.Random(5)
    words = ["of", "The", "a-b", "É", "x\x00y", "日本", "new", "york", "city", "*", "\x1cz"]
    line = "in new york city the a-b of"
    rows = []
    for i in range(150):
        text = " ".join(r.choices(words, range(11, 0, -1), k=r.randrange(40)))
        text = re.sub(" ", lambda m: r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]), text)
        rows.append((i if i % 9 else None, text if i % 10 else line, ("en", "fr", None, "und", "é")[i % 5 if i % 3 else 0], "s", 1))
    rows += [(7, None, "en", "s", 1), (7, "", None, "s", 1), (8, line, "de", "s", 1), (8, line, "de", "s", 1), (8, " \t\n", "nn", "s", 1)]
    rows.append((9, " ".join(r.choices(words, k=4000)), "en", "s", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), "doc_id bigint, text string, lang string, source string, rank int").repartition(3).cache()


@pytest.mark.parametrize("small", [{}, {"SHARD_WORDS": 97, "SLICE": 50, "RANGE_WORDS": 40, "BLOCK_PHRASES": 9, "_WORDS": 5}, {"DICTIONARY": 4, "SHARD_WORDS": 300, "FILTER_BITS": 65536, "BLOCK_PHRASES": 20}])
def test_mine(docs, monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(collocations, name, value)
    got = sorted(tuple(r) for r in collocations.mine(docs, 3, 60).collect())
    expected = brute([(r[2], r[1]) for r in _rows()], 3, 60)
    assert len(expected) > 100 and got == expected


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations.mine(none).collect() == []
    few = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    assert collocations.mine(few).collect() == [] and collocations.mine(few).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [tuple(r) for r in collocations.mine(few, 1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_slices_of_long_texts(monkeypatch):
    """Slices and shards end within a text; every pair counts once."""
    import types

    import pyarrow as pa

    monkeypatch.setattr(collocations, "SLICE", 40)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 30)
    r = random.Random(1)
    texts = [" ".join(r.choices(["ab", "c", "de.", "f"], k=n)).encode() for n in (500, 3, 0, 77)]
    counts = Counter(w for t in texts for s in collocations.tokens(t) for w in s)
    assert counts.pop(b"\xff") == sum(t.count(b".") for t in texts)
    v = collocations.Vocabulary([("en", w, n) for w, n in counts.most_common()], {"en": counts.total()}, counts.total(), 7, True, 0)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "text"])
    box = types.SimpleNamespace(value=v)
    parts = [Automaton.load(b) for out in collocations._shards(box, None)(iter([batch])) for b in out.column(3).to_pylist()]
    rows, weights = union(parts)
    word = {i: w.decode() for w, i in v.ids["en"].items() if i >= 0}
    pairs = Counter()
    for t in texts:
        for piece in t.decode().split("."):
            words = piece.split()
            pairs.update(zip(words, words[1:]))  # noqa: B905
    assert {(word[a], word[b]): n for (a, b), n in zip(rows.tolist(), weights.tolist(), strict=True)} == dict(pairs)
