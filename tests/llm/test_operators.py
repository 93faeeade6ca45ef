"""Operators against brute force on a small table with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import ann, graph, langid, license_join, mixing, near_dup, packing, quality_qda, quality_rules, suffix_dedup, toxicity
from millrace.llm.common import Scratch
from tests.llm import brute

LABELS = "doc_id bigint, quality int, toxic int"


def test_suffix_dedup(docs, texts, empty):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(docs).collect()}
    assert got == brute.repeated_bytes(texts)
    assert suffix_dedup.digest(empty).collect() == []


def test_suffix_dedup_blocks_and_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    t = "0123456789" * 12 + "abcdefghij" * 9
    rows = [(5, t), (5, t), (None, t), (7, "x" + t[30:] + "y"), (2, t[:60]), (9, None)]
    got = sorted(((r[0], r[2], r[3]) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    expected = brute.repeated_bytes({2: t[:60], 5: t, 7: rows[3][1], 8: t})
    assert got == sorted([(2, 0, 0), (5, *expected[5][1:3]), (5, *expected[5][1:3]), (7, *expected[7][1:3]), (None, *expected[8][1:3]), (9, 0, 0)], key=str)


def test_strip(docs, texts):
    out = suffix_dedup.strip(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[124]["text"] == "" and kept[0]["text"] == texts[0] and kept[0]["n_chars"] == len(texts[0])


def test_near_duplicates(docs, texts, empty):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    short = {i: t for i, t in texts.items() if len(t or "") < 50_000}
    expected = brute.classes(short)
    assert {i: got[i] for i in short} == expected
    assert len(got) == len(texts) and got[130] == 130
    assert near_dup.classes(empty).collect() == []
    first = near_dup.first_of_each(docs)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(got.values())


def test_near_duplicates_in_blocks(docs, texts, monkeypatch):
    """A neighbourhood of many blocks gives the same classes."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs.where("length(text) < 50000")).collect()}
    assert got == brute.classes({i: t for i, t in texts.items() if t is not None and len(t) < 50_000})


def test_near_duplicate_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_dup.classes(df).collect()), key=str) == sorted([(None, None), (1, 1), (1, 1), (2, 2), (3, 3)], key=str)
    assert sorted((r["doc_id"] or 0) for r in near_dup.first_of_each(df).collect()) == [0, 1, 2, 3]


def test_near_duplicates_with_one_id(spark):
    """Different texts of one doc_id are decided on each; nothing that is said only once is lost."""
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (7, "a b c d e f"), (7, "only here one two three"), (8, "g h i j k l"), (9, "a  b c d e f"), (7, "only here one two three"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in near_dup.classes(df).collect()} == {(1, 1), (7, 1), (8, 1), (9, 1)}
    assert sorted(map(tuple, near_dup.first_of_each(df).collect())) == [(1, "a b c d e f"), (1, "g h i j k l"), (7, ""), (7, "only here one two three")]


def test_near_duplicates_in_a_chain(spark):
    """Neighbours of a chain are alike, its ends are not: links that no band's head has are found within the bands."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**9)}" for _ in range(60)]
    texts = {}
    for i in range(40):
        texts[(i * 17) % 40] = " ".join(words)
        words[i % 60] = f"x{i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_dup.classes(df).collect()}
    assert got == brute.classes(texts) and len(set(got.values())) < 40


def test_signature_estimates_probability_jaccard():
    from millrace.llm import shingles as S

    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(1 << 60, 300, replace=False).astype(np.uint64))
    wa = rng.integers(1, 6, 300)
    wb = np.where(rng.random(300) < 0.8, wa, 0)
    b, wb = a[wb > 0], wb[wb > 0]
    exact = S.probability_jaccard((a, wa), (b, wb))
    assert exact == pytest.approx(brute.probability_jaccard(collections.Counter(dict(zip(a.tolist(), wa.tolist(), strict=True))), collections.Counter(dict(zip(b.tolist(), wb.tolist(), strict=True)))))
    agree = []
    for salt in range(30):
        x, y = (S.mix(v + np.uint64(salt * 7919)) for v in (a, b))
        s = S.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), np.concatenate([wa, wb]).astype(float), 2)
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(exact, abs=0.03)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)] + [(200, 200 + i) for i in range(1, 30)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark), "t").collect()}
    assert out == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}


def test_license_join(docs, texts, empty):
    got = {r["doc_id"]: (*tuple(r)[1:-1], round(r["score"], 9)) for r in license_join.scan(docs).collect()}
    assert got == {i: brute.licenses(t, license_join.PHRASES, license_join.TEMPLATES, license_join.LEAST, license_join.SPAN, license_join.STEP) for i, t in texts.items()}
    assert got[132][:4] == (20, 4, 6, 18)
    assert license_join.scan(empty).collect() == []


def test_license_notices_in_lines(spark):
    wrapped = "Redistribution and use in source and binary\nforms, with or without\n# modification, are permitted provided that"
    other = "Licensed under the Mozilla Public License, Version 2.0"
    far = "released " + "x " * 60 + "under the mit " + "y " * 60 + "license"
    rows = [(1, "z " * 37 + wrapped), (2, other), (3, far), (4, "MIT K\u212aL Released Under THE\nMIT license"), (4, None), (None, wrapped)]
    got = sorted(((r["doc_id"] or 0, r["labels"]) for r in license_join.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert got == [(0, "bsd"), (1, "bsd"), (2, ""), (3, ""), (4, ""), (4, "mit")]


def test_rules(spark, docs, texts, empty):
    labels = spark.createDataFrame([(i, int(i % 5 != 2), 0) for i in range(120)], LABELS)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: brute.statistics(t) for i, t in texts.items()}
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)
    assert quality_rules.learn(docs, spark.createDataFrame([], LABELS)) == []
    assert quality_rules.judge(empty, labels).collect() == []


def test_rules_learn(spark):
    rows = [(i, " ".join(["word"] * (60 + i % 9)) + ("#" * (i % 40) if i % 4 == 0 else "")) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(not (i % 4 == 0 and i % 40 >= 12)), 0) for i in range(400)], LABELS)
    rules = quality_rules.learn(documents, labels)
    assert rules and all(len(r) <= quality_rules.CONDITIONS for r in rules)
    kept = {r["doc_id"]: r["rule"] is None for r in quality_rules.judge(documents, labels).collect()}
    wrong = sum(kept[i] == (i % 4 == 0 and i % 40 >= 12) for i in range(400))
    assert wrong <= 8


def test_mixing(docs, texts, empty):
    rows = mixing.takes(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(re.findall(brute.WS, t or "")) for i, t in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    expected = brute.water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s]) and r["taken"] <= 2 * r["size"]
    for s in names:
        taken = sum(r["taken"] for r in rows if source[r["doc_id"]] == s)
        assert abs(taken - expected[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    again = {r["doc_id"]: r["taken"] for r in mixing.takes(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mix(docs)
    count = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert count == collections.Counter({r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in rows})
    assert mixing.takes(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_packing(docs, texts, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_CHARS", 9_000)
    t = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    assert set(by) == set(texts)
    for i, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    total = collections.Counter()
    for i, x in ids.items():
        total[source[i]] += len(x)
    share = {s: n / sum(total.values()) for s, n in total.items()}
    for k, pieces in sequences.items():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or k == max(sequences)
        if at == 2048:
            own = collections.Counter()
            for _, n, i in pieces:
                own[source[i]] += n
            assert all(abs(own[s] - share[s] * 2048) <= len(share) for s in share)
    assert packing.pack(empty).collect() == []


def test_packing_targets():
    """With given rates the early sequences hold those proportions; the rest goes to who is left."""
    s = packing.Schedule(np.array([30_000, 1_000, 5]), np.array([0.5, 0.5, 0.0]), 100)
    given = s.given(np.arange(0, 400))
    assert (np.diff(given, axis=0) >= 0).all() and given[10].tolist() == [500, 500, 0]
    assert given[-1].tolist() == [30_000, 1_000, 5]


def test_language(spark, empty):
    fr, en = "le chat est dans la maison avec les enfants ", "the cat is in the house with some children "
    rows = [(i, (fr if i % 2 else en) * (1 + i % 3), "fr" if i % 2 else "en") for i in range(90)] + [(200, None, "en"), (201, "", "fr"), (202, "12 34 !", "en"), (203, "x" * 5_000_000 + " le chat", None), (None, en, "en")]
    df = spark.createDataFrame([(*r, "s", 1.0, "q") for r in rows], "doc_id bigint, text string, lang string, source string, score double, lang_pred string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == ("fr" if i % 2 else "en") for i in range(90))
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    kept = langid.accept(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= set(range(90)) and kept.where("lang_pred <> 'q'").count() == 0
    assert langid.identify(empty).collect() == []
    assert {r["lang_pred"] for r in langid.identify(df.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    said = {"en": "the cat is in the house with some children", "fr": "le chat est dans la maison avec les enfants", "sv": "katten är i huset med några barn", "fi": "kissa on talossa lasten kanssa"}
    rows = [(i, said["fr" if i % 2 else "en"], "fr" if i % 2 else "en") for i in range(6000)] + [(9000 + i, said["fi" if i % 2 else "sv"], "fi" if i % 2 else "sv") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, rows=200).collect()}
    assert got == {i: lang for i, _, lang in rows}
    model = langid.train(df, rows=200)
    known = collections.Counter(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert np.allclose(np.exp(model.log_prior), [(known[k] + 1) / (known.total() + 4) for k in model.languages])
    assert langid.quota([5, 1000, 3000], 205) == 100 and langid.quota([5, 10], 20) >= 10 and langid.quota([100] * 50, 60) == langid.LEAST_ROWS


def _labelled(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows, labels = [], []
    for i in range(400):
        t = list(rng.choice(words, 40))
        bad = i % 4 == 0
        if bad:
            for k in range(5):
                t[k * 7] = str(rng.choice(["nastyword", "vilething", "grimterm"]))
        rows.append((i, " ".join(t), "en"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(900, None, "en"), (901, "", "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], LABELS)


def test_toxicity(spark, empty):
    documents, labels = _labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.classify(documents, labels).collect()}
    assert len(got) == 402
    for i in range(400):
        assert got[i]["predicted"] == int(i % 4 == 0), i
    assert got[900]["predicted"] == 0 and got[901]["score"] < 0.3 and 0 <= got[900]["score"] <= 1
    assert toxicity.classify(documents, labels.where("toxic = 0")).where("score <> 0").count() == 0
    assert toxicity.classify(empty, labels).collect() == []


def test_block_max_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    n, terms = 500, 60
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.15)
    x[10] = x[11] = x[12]
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    example, term = np.nonzero(x)
    ids = rng.permutation(n) + 1000
    for often, block in ((1, 64), (6, 16), (32, 64)):  # inverted lists alone; both; a matrix alone
        monkeypatch.setattr(toxicity, "OFTEN", often)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        index = toxicity.build_index(np.ones(terms), ids, (ids % 2).astype(float), (example, term, x[example, term]))
        for q in range(0, n, 17):
            t = np.flatnonzero(x[q])
            best, cosine = toxicity.nearest(index, t, x[q, t], 15, skip=ids[q])
            score = x @ x[q]
            score[q] = 0
            order = [i for i in np.lexsort((ids, -np.round(score, 12))) if score[i] > 1e-12][:15]
            assert np.allclose(np.sort(cosine), np.sort(score[order])) and len(set(index.ids[best]) & set(ids[order])) >= len(order) - 2


def test_quality(spark, empty):
    rng = np.random.default_rng(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows = []
    for i in range(600):
        t = [str(w) for w in rng.choice(words, 30 + i % 20)]
        rows.append((i, ("!! ".join(t).upper() if i % 3 == 0 else " ".join(t) + ".")))
    documents = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(600)], LABELS)
    got = {r["doc_id"]: r for r in quality_qda.classify(documents, labels).collect()}
    assert sum(got[i]["predicted"] == int(i % 3 != 0) for i in range(600)) >= 595
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert quality_qda.classify(documents, labels.where("quality = 1")).where("score <> 0.5").count() == 0
    assert quality_qda.classify(empty, labels).collect() == []


def test_statistics_of_long_texts():
    at = {name: i for i, name in enumerate(quality_qda.STATISTICS)}
    got = quality_qda.statistics(["alpha beta\n" * 500_000])[0]  # 5.5 million characters
    assert got[at["distinct_words"]] == pytest.approx(np.log1p(2) - np.log1p(1_000_000))
    assert got[at["distinct_lines"]] == pytest.approx((1 - 1 / 500_001) ** 0.5, abs=1e-9)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abAB .\n\t"), int(rng.integers(1, 300)), p=[0.2, 0.2, 0.2, 0.1, 0.15, 0.05, 0.08, 0.02])) for _ in range(150)]
    texts += ["x" * 500, "ab\n" * 99, "AB CD " * 60 + "\n" + "AB CD " * 60, "\n" * 80, " " * 80, "ab " * 40 + "c" * 100 + "\n\n" + "ab " * 40]
    for longest in (1, 2, 7, 64):
        assert (quality_qda.statistics(texts, longest) == quality_qda.statistics(texts)).all()


def test_log_ratio_is_that_of_normal_densities():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(1, 2, (300, 4))])
    y = np.repeat([0, 1], 300)
    m = quality_qda.fit(x, y, shrink=0.0, diagonal=0.0)
    z = (x - m.mean) / m.scale
    d = []
    for c in (0, 1):
        s = np.cov(z[y == c].T) + 1e-3 * np.eye(4)
        u = z - z[y == c].mean(axis=0)
        d.append(np.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", u, np.linalg.inv(s), u))
    expected = d[1] - d[0]
    assert np.allclose(quality_qda.log_ratio(m, x), np.sign(expected) * np.log1p(np.abs(expected)))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 12)).astype(np.float32)
    x[100:260] = x[100]  # a common vector
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1020, [0.0] * 12, 1), (1040, [float("nan")] * 12, 1), (1060, [1.0, None] + [0.0] * 10, 1), (1080, [1.0, 2.0], 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, list int").repartition(5)
    got = collections.defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    d = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        score = d @ d[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(700), -score))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(f[2] == pytest.approx(score[f[1]], abs=1e-12) for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({f[1] for f in found} & set(order.tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.where("vec_id > 5")).collect() == []


def test_adaptive_scan_of_varied_lengths(spark):
    r = np.random.default_rng(12)
    x = r.standard_normal((2000, 32)) * np.exp(0.6 * r.standard_normal((2000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for row in ann.search(df).collect():
        got[row["query_id"]].add(row["vec_id"])
    hits = 0
    for q in range(0, 2000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_adaptive_scan_goes_on_to_further_lists(spark):
    r = np.random.default_rng(13)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((200, 8)))] + [(40, [1.0] * 8)] * 30
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for row in ann.search(df, probes=1).collect():
        got[row["query_id"]].add(row["rank"])
    assert set(got) == set(range(0, 200, 20)) and all(ranks == set(range(1, 21)) for ranks in got.values())


def test_repeated_vectors(spark):
    """A row is no candidate of itself; other rows with its id are, and each query row has its own result."""
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    got = collections.Counter(tuple(r)[:3] for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    expected = collections.Counter()
    for own in (0, 1, 2):
        scores = sorted((-sum(a * b for a, b in zip(rows[own][1], v, strict=True)), i) for k, (i, v) in enumerate(rows) if k != own)
        expected.update((0, rank + 1, i) for rank, (_, i) in enumerate(scores))
    assert got == expected


def test_many_languages(spark, monkeypatch):
    """A matrix that is cut by languages gives the same names and probabilities."""
    said = {"en": "the cat is in the house", "fr": "le chat est dans la maison", "sv": "katten är i huset", "fi": "kissa on talossa", "de": "die katze ist im haus"}
    df = spark.createDataFrame([(i, said[k] if i % 7 else "1 2", k) for i, k in enumerate([*said] * 12)], "doc_id bigint, text string, lang string")
    whole = {r["doc_id"]: r for r in langid.identify(df).collect()}
    monkeypatch.setattr(langid, "TOGETHER", 2)
    cut = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(cut[i]["lang_pred"] == r["lang_pred"] and cut[i]["score"] == pytest.approx(r["score"]) for i, r in whole.items())
    assert all(r["lang_pred"] == ([*said][i % 5] if i % 7 else "und") for i, r in cut.items())


def test_packing_many_sources(spark):
    """Any number of sources are queues of their own; added tokens, null ids and repeated rows are packed as they are."""
    from tokenizers import Tokenizer

    rows = [(i, f"words of source {i % 100} " * 12, f"s{i % 100:03d}") for i in range(400)]
    rows += [(None, "no id", "s000"), (400, "a <|endoftext|> b", None), (401, "same", "s001"), (401, "same", "s001"), (402, None, "s002")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    wanted = {f"s{i:03d}" for i in range(90, 100)}
    targets = {f"s{i:03d}": 1.0 if f"s{i:03d}" in wanted else 0.0001 for i in range(100)}
    t = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    source = {i: s for i, _, s in rows}
    length = 256
    got = packing.pack(df, targets, length=length).collect()
    first = [r for r in got if r["sequence_id"] == 0]
    assert sum(r["length"] for r in first) == length and sum(r["length"] for r in first if source[r["doc_id"]] in wanted) >= length - 2
    ids = np.array([*t.encode("a <|endoftext|> b", add_special_tokens=False).ids, 1], "<u4")
    assert len(ids) == 5 and all(r["doc_tokens"] == 5 and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got if r["doc_id"] == 400)
    total = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows)
    assert sum(r["length"] for r in got) == total
    fill = collections.Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == length for k, n in fill.items() if k != max(fill)) and len(fill) == -(-total // length)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == len(t.encode("no id").ids) + 1
    assert sum(r["length"] for r in got if r["doc_id"] == 401) == 2 * (len(t.encode("same").ids) + 1)


def test_language_scores_by_brute_force(spark):
    """Counts of n-grams within words, smoothed, times the prior: names and probabilities as from plain dictionaries."""
    r = random.Random(4)
    letters = {"en": "abcde", "fr": "cdefg", "de": "efgab"}
    rows = [(i, " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(1, 4))) for _ in range(6)), k) for i, k in enumerate(["en", "fr", "de", "en"] * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(df).collect()}

    def grams(text):
        return [(n, w[i : i + n]) for word in text.split() for n in (1, 2, 3) for w in [word if n == 1 else f" {word} "] for i in range(len(w) - n + 1) if w[i] != " " or w[i + n - 1] != " "]

    counts, docs = {k: collections.Counter() for k in letters}, collections.Counter()
    for i, text, k in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[k].update(grams(text))
            docs[k] += 1
    for i, text, _ in rows:
        s = {k: np.log((docs[k] + 1) / (docs.total() + 3)) + sum(np.log((counts[k][g] + 0.5) / (counts[k].total() + 0.5 * 65536)) for g in grams(text)) for k in letters}
        best = max(s, key=s.get)
        p = 1 / sum(np.exp(v - s[best]) for v in s.values())
        if p > 0.6:
            assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(p, abs=0.02)
