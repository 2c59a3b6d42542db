import random
import zlib

import numpy as np
import pytest

from paceline.llm import langid


def test_counts_of_long_texts_in_pieces(monkeypatch):
    text = "Ärger über Öl " * 50
    want = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.counts(text) == want).all()
    data = f" {text.lower()} ".encode()
    assert want.sum() == sum(len(data) - n + 1 for n in langid.ORDERS)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    # The score is the chance to be right: calibrated to a few hundredths.
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == r.lang for r in held])) < 0.05


def test_only_the_text_decides_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the cat", "and dog", "wolf"]) for _ in range(20)), "en", 1) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(["le chat", "et chien", "loup"]) for _ in range(20)), "fr", 1) for i in range(60)]
    rows += [(300, None, "en", 1), (301, "", "fr", 1), (302, "12 !? \n", "fr", 1), (None, "le chat et chien", None, 1), (5, "the cat", "xx", 1), (5, "the cat", "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = langid.digest(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {by[i].lang_pred for i in (300, 301, 302)} == {"und"} and by[None].lang_pred == "fr" and by[None].held_out
    assert all(by[i].lang_pred == "en" for i in range(60) if i != 5) and all(by[100 + i].lang_pred == "fr" for i in range(60))


def test_a_rare_language_is_learnt_beside_many_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 50)
    monkeypatch.setattr(langid, "ROWS", 400)
    rng = random.Random(3)
    text = lambda k: " ".join(chr(97 + 2 * k) + rng.choice("aeiou") + chr(98 + 2 * k) for _ in range(12))
    rows = [(i, text(i % 10), f"l{i % 10}") for i in range(10_000)] + [(20_000 + i, text(11), "rare") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, ~langid.held_out())
    assert model.languages == [f"l{k}" for k in range(10)] + ["rare"]
    assert [model.predict(t)[0] for _, t, _ in rows[-40:]] == ["rare"] * 40


def test_rows_each():
    assert langid.rows_each([10**6] * 4) == 500 and langid.rows_each([]) == 500
    for sizes in ([10**6] * 8 + [400], [10**5] * 12 + [300] * 3, [10**6] * 150 + [3] * 50):
        each = langid.rows_each(sizes)
        assert 0.85 * langid.ROWS < sum(min(n, each) for n in sizes) <= 0.9 * langid.ROWS and each >= 20


@pytest.mark.parametrize("rows", [[], [(0, "abc def", "en")], [(0, None, None)]])
def test_too_little_to_learn_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.digest(docs).collect()] in ([], ["und"], ["en"])


def test_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        tf = np.zeros(langid.BUCKETS)
        tf[rng.integers(0, 2000, 50)] = 1
        tf[5000 + k % 2] = 8
        index = np.flatnonzero(tf)
        rows.append(("ab"[k % 2], index, tf[index]))
    model = langid.fit(rows, np.ones(langid.BUCKETS))
    assert (model.weights[5000] != 0).all() and (model.weights[:2000] == 0).mean() > 0.2
    assert model.scores(*model.features(np.eye(1, langid.BUCKETS, 5001)[0])).argmax() == 1


def test_columns_of_any_name_stay(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the cat", "le chat"][i % 2].split()) for _ in range(20)), ["en", "fr"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, _text string, __text string, `a.b` string")
    got = langid.predict(docs, langid.train(docs, ~langid.held_out()))
    assert got.columns == [*docs.columns, "lang_pred", "lang_score"]
    assert {(r["_text"], r["__text"], r["a.b"]) for r in got.collect()} == {("x", "y", "z")}
    assert sum(r.lang_pred == r.lang for r in got.collect()) > 70
