import hashlib
import random
import re

import duckdb
import pytest

from paceline.llm import debruijn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, window=50):
    least = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") if seed % 2 else "w%d" % rng.randrange(3000)
    passages = [[word() for _ in range(rng.randrange(window - 3, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            at = rng.randrange(len(text) + 1)
            text[at:at] = p[a : a + rng.randrange(len(p))]
        rows.append((rng.randrange(-10, 40) if i % 7 == 0 else 100 + i, " ".join(text)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (502, None), (503, ""), (504, "x " * 400), (505, "x\n" * 300)]
    rows += [(600 + i, " ".join(passages[0])) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed,window,k", [(0, 50, 16), (1, 12, 4), (2, 12, 12), (3, 20, 5)])
def test_against_brute_force(spark, seed, window, k):
    rows = corpus(seed, window)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    out = debruijn.drop_repeated_words(docs, window=window, k=k).collect()
    got = [(r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]
    assert sorted(got, key=str) == slow(rows, window)
    assert sum(g[2] for g in got) > 500


def test_sql_says_the_same(spark):
    rows = list({i: t for i, t in corpus(4, 50) if i is not None}.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(debruijn.ORACLE).fetchall()
    assert sorted(map(tuple, debruijn.digest(docs).collect())) == sorted(want)


def test_nothing(spark):
    assert debruijn.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
