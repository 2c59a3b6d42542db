import random

import numpy as np
import pytest

from paceline.llm import nearcopies


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def slow_groups(rows):
    """rows: id and text; the smallest id reached from each id."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if label[j] < label[i] and (i == j or similar(a, b)):
                    label[i], changed = label[j], True
    return label


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = "other%d" % rng.randrange(10**6)
    return out


def texts():
    rng = random.Random(3)
    out = []
    for i in range(60):
        base = ["w%d" % rng.randrange(5000) for _ in range(rng.choice([3, 40, 300, 900]))]
        out.append(" ".join(base))
        for n in (1, 2, 6, 12):
            out.append(" ".join(changed(rng, base, min(n, len(base)))))
        out.append("  ".join(base).upper())
    return out + ["", None, " \t\n", "x", "X", "x y"]


def groups(spark, rows, schema="doc_id long, text string, same string, keys string"):
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], schema)
    return sorted((r.id, r.component) for r in nearcopies.near_copies(docs).collect())


def test_against_brute_force(spark):
    found = texts()
    rows = list(zip(random.Random(6).sample(range(len(found)), len(found)), found))
    assert groups(spark, rows) == sorted(slow_groups(rows).items())


def test_a_large_group_of_different_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CHUNK", 50)
    rng = random.Random(8)
    base = ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(400)] + [(1000, "nothing of all this stands in here")]
    assert groups(spark, rows) == sorted(slow_groups(rows).items())
    assert len({c for _, c in groups(spark, rows)}) == 2


def test_a_copy_behind_many_nearer_texts(spark, monkeypatch):
    """Of 996 shingles 22 changed words leave a similarity of 0.801, 23 one of 0.793."""
    monkeypatch.setattr(nearcopies, "MORE", 2)
    rng = random.Random(12)
    base = ["w%d" % i for i in range(1000)]

    def spaced(words, n):
        out = list(words)
        for i in rng.sample(range(5, len(out) - 5, 5), n):
            out[i] = "other%d" % rng.randrange(10**9)
        return out

    copy = spaced(base, 22)
    near = [" ".join(spaced(x, 23)) for x in (base, copy) for _ in range(80)]
    rows = [(1000, " ".join(base)), (1001, " ".join(copy)), *enumerate(near)]
    wanted = slow_groups(rows)
    assert wanted[1001] == wanted[1000]
    assert groups(spark, rows) == sorted(wanted.items())


def test_pairs_below_the_similarity_make_no_rows(spark, monkeypatch):
    """200 texts within the radius of each other: their pairs are compared, but only links come out of the tiles."""
    monkeypatch.setattr(nearcopies, "SET_BYTES", 20 * 8 * 996)
    counts, pin = [], nearcopies.pin

    def counted(df):
        kept = pin(df)
        if {"a", "b"} <= set(kept.columns):
            counts.append(kept.count())
        return kept

    monkeypatch.setattr(nearcopies, "pin", counted)
    rng = random.Random(13)
    base = ["w%d" % i for i in range(1000)]

    def spaced(n):
        out = list(base)
        for i in rng.sample(range(5, len(out) - 5, 5), n):
            out[i] = "other%d" % rng.randrange(10**9)
        return out

    rows = [(i, " ".join(spaced(rng.choice([11, 12, 15, 16])))) for i in range(200)]
    wanted = slow_groups(rows)
    assert len(set(wanted.values())) > 50
    assert groups(spark, rows) == sorted(wanted.items())
    assert sum(counts) <= 2 * nearcopies.TILES * len(rows), counts


def test_a_very_long_text(spark):
    rng = random.Random(9)
    words = ["w%d" % rng.randrange(50000) for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(changed(rng, words, 2000))), (3, " ".join(words[:100_000]))]
    assert groups(spark, rows) == [(1, 1), (2, 1), (3, 3)]


def test_nulls_repeats_and_empty(spark):
    kind = "doc_id long, text string, id string, component string"
    long = " ".join("w%d" % i for i in range(50))
    rows = [(None, long), (None, None), (9, long), (4, long), (4, "something else"), (5, "something else"), (6, None), (7, " ")]
    docs = spark.createDataFrame([(*r, "i", "c") for r in rows], kind)
    got = sorted((r.id, r.component) for r in nearcopies.near_copies(docs).collect())
    assert got == [(4, 4), (4, 4), (5, 4), (6, 6), (7, 6), (9, 4)]
    kept = nearcopies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 4, 4, 6]
    assert nearcopies.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity, least", [(0.8, 0.97), (0.9, 0.999)])
def test_pairs_of_that_similarity_share_a_tile(similarity, least):
    rng = np.random.default_rng(4)
    shared = 0
    for _ in range(400):
        union = rng.integers(0, 2**64, 500, dtype=np.uint64)
        both = round(500 * similarity)
        half = (500 - both) // 2
        left, right = union[: both + half], np.concatenate([union[:both], union[both + half :]])
        shared += bool((nearcopies.tile_keys(left) == nearcopies.tile_keys(right)).any())
    assert shared >= 400 * least
