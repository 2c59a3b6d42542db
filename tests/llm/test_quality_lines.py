import hashlib
import random
import re

import pytest

from paceline.llm import linechunks, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_signals(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))


def sample_texts():
    rng = random.Random(4)
    out = ["", None, " \n\t ", "a", "one two three four five", "x y z x y z x y z x y z x y z x", "é\n\né\n é\né", "a b c d e a b c d e"]
    for n in (30, 60, 120):
        out.append(" ".join(rng.choice("ab") for _ in range(n)))
        out.append("\n".join(rng.choice(["l1 a", "l2 b", "", "##$"]) for _ in range(n)))
        out.append(" ".join("w%d" % rng.randrange(1000) for _ in range(n)))
    return out


def test_signals(spark):
    rows = [(i, t, "x") for i, t in enumerate(sample_texts())] + [(None, "a b", "x"), (3, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.digest(docs).collect()
    want = sorted(((i or 0), *slow_signals(t)) for i, t, _ in rows)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(((r.doc_id or 0), *[r[n] for n in names]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert quality.digest(docs.limit(0)).count() == 0


SAYS = [-1, -1, -1, -1, 1]
#: How often each rule votes: one against at random, two that are often wrong, one sharp, one for.
ON_GOOD, ON_BAD = [0.3, 0.08, 0.06, 0.01, 0.9], [0.3, 0.45, 0.5, 0.8, 0.25]


def voted(n, seed=0, good=0.8):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        is_good = rng.random() < good
        rates = ON_GOOD if is_good else ON_BAD
        texts.append((tuple(s * (rng.random() < p) for s, p in zip(SAYS, rates)), is_good))
    counts = {}
    for votes, _ in texts:
        counts[votes] = counts.get(votes, 0) + 1
    return texts, list(counts.items())


def slow_em(texts, says, rounds):
    """Text by text: posteriors after so many rounds, by plain products of rates."""
    good = quality.SHARE_GOOD
    on = {c: [dict(zip((-1, 0, 1), b[s])) for s in says] for c, b in (("g", quality.BELIEF_GOOD), ("b", quality.BELIEF_BAD))}
    for i in range(rounds + 1):
        posterior = []
        for votes, _ in texts:
            p, q = good, 1 - good
            for k, v in enumerate(votes):
                p, q = p * on["g"][k][v], q * on["b"][k][v]
            posterior.append(p / (p + q))
        if i == rounds:
            return posterior
        w = quality.STRENGTH
        good = (sum(posterior) + w * quality.SHARE_GOOD) / (len(texts) + w)
        for c, belief, mass in (("g", quality.BELIEF_GOOD, posterior), ("b", quality.BELIEF_BAD, [1 - p for p in posterior])):
            for k, s in enumerate(says):
                own = {v: sum(m for m, (votes, _) in zip(mass, texts) if votes[k] == v) for v in (-1, 0, 1)}
                on[c][k] = {v: (own[v] + w * belief[s][v + 1]) / (sum(own.values()) + w) for v in own}


def test_em_equals_a_slow_one():
    texts, patterns = voted(600)
    for rounds in (1, 7, 60):
        model = quality.fit(patterns, SAYS, rounds, tolerance=0)
        slow = slow_em(texts, SAYS, rounds)
        assert all(abs(model.posterior(v) - p) < 1e-9 for (v, _), p in zip(texts, slow))


def test_em_finds_the_accuracies():
    texts, patterns = voted(60_000)
    model = quality.fit(patterns, SAYS)
    assert abs(model.good - 0.8) < 0.03
    for found, true in ((model.on_good, ON_GOOD), (model.on_bad, ON_BAD)):
        assert all(abs(rates[s + 1] - p) < 0.04 for rates, s, p in zip(found, SAYS, true))
    right = sum((model.log_odds(v) > 0) == g for v, g in texts)
    bayes = quality.LabelModel(0.8, *[[tuple({s: p, 0: 1 - p}.get(v, 0.5) for v in (-1, 0, 1)) for s, p in zip(SAYS, r)] for r in (ON_GOOD, ON_BAD)])
    assert right >= sum((bayes.log_odds(v) > 0) == g for v, g in texts) - 60


def test_a_noisy_rule_alone_does_not_reject_but_two_that_agree_do():
    _, patterns = voted(20_000)
    model = quality.fit(patterns, SAYS)
    kept = lambda *votes: model.posterior(votes) >= 0.5
    assert kept(0, 0, 0, 0, 1)
    assert kept(-1, 0, 0, 0, 1) and kept(0, -1, 0, 0, 1) and kept(0, 0, -1, 0, 1) and kept(-1, -1, 0, 0, 1)
    assert not kept(0, -1, -1, 0, 0) and not kept(0, 0, -1, -1, 1) and not kept(0, 0, 0, -1, 0)


def test_tables_without_evidence():
    assert quality.fit([], SAYS).posterior((0,) * 5) > 0.5
    assert quality.fit([((0, 0, 0, 0, 1), 1)], SAYS).posterior((0, 0, 0, 0, 1)) > 0.5
    assert quality.fit([((0, 0, 0, 0, 1), 10**12)], SAYS).posterior((0, 0, 0, 0, 1)) > 0.9


def test_kept_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.digest(docs).select("doc_id", "kept").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    by = {(r.quality, r.kept): r["count"] for r in rows}
    assert by.get((0, True), 0) <= 0.05 * by[0, False], by
    # All but a few of the good texts that go break a base rule.
    clean = quality.judge(docs).where("not base_failed and not kept").select("doc_id").join(labels.where("quality = 1"), "doc_id")
    assert clean.count() <= 0.001 * by[1, True], by


def xx(x):
    import xxhash

    return xxhash.xxh64_intdigest(x, 42)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hash_longs(values):
    """Spark's hash of longs in a row: each is hashed with the hash before as the seed."""
    import struct

    import xxhash

    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(v % 2**64)), h)
    return h


def slow_chunks(text):
    """Lines, and of every chunk its first line, its end, and how far it reaches with the next line on either side."""
    lines = (text or "").split("\n") if text is not None else []
    h = [xx(x.encode()) for x in lines]
    at = [i for i, x in enumerate(lines) if WORD.search(x)]
    r = [signed(hash_longs(h[a : b + 1])) for a, b in zip(at, at[1:])]
    out = []
    for k, x in enumerate(r):
        if len(r) == 1 or (k > 0 and x <= r[k - 1]) or (k + 1 < len(r) and x <= r[k + 1]):
            out.append((at[k], at[k + 1] + 1, at[max(k - 1, 0)], at[min(k + 2, len(at) - 1)] + 1))
    return lines, out


def slow_dedup(rows):
    first = {}
    key = lambda i, t: (i is None, i or 0, signed(xx(t.encode())) if t is not None else 0)
    for i, t in rows:
        lines, spans = slow_chunks(t)
        for a, b, low, high in spans:
            c = "\n".join(lines[a:b])
            first[c] = min(first.get(c, ((True, 2**70, 0, 0),)), ((*key(i, t), a), lines[low:a], lines[b:high]))
    out = []
    for i, t in rows:
        lines, spans = slow_chunks(t)
        gone = set()
        for a, b, low, high in spans:
            place, left, right = first["\n".join(lines[a:b])]
            if place != (*key(i, t), a):
                gone |= set(range(low if lines[low:a] == left else a, high if lines[b:high] == right else b))
        kept = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), kept))
    return out


def test_line_chunks(spark):
    rng = random.Random(8)
    passages = [["p%d line %d" % (k, j) for j in range(rng.randrange(2, 30))] for k in range(5)]
    rows = []
    for i in range(60):
        lines = ["own %d %d" % (i, j) for j in range(rng.randrange(0, 12))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = rng.choice(passages) if i % 3 else []
        rows.append((i, "\n".join(lines)))
    rows += [(70, rows[4][1]), (71, rows[4][1]), (4, rows[4][1]), (None, rows[4][1]), (80, None), (81, ""), (82, "\n\n\n"), (83, "\n\n\n"), (84, "a\n" * 50)]
    rows += [(90 + k, f"\n\nx {k}\n" + "\n\n".join(["u", "v", " ", "w"][: k + 1]) + "\nz" * (k % 2)) for k in range(5)]
    rows += [(100, "\n".join(f"long {j % 3000}" for j in range(7000)))]
    docs = spark.createDataFrame([(*r, "o") for r in rows], "doc_id long, text string, start string")
    got = linechunks.drop_repeated_chunks(docs).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3] or "")
    assert sorted(((r.doc_id, r._lines, r._removed, r.text) for r in got), key=order) == sorted(slow_dedup(rows), key=order)
    assert sum(r._removed for r in got) > 100 and {r.start for r in got} == {"o"}
    shown = {r.doc_id: r.kept_sha256 for r in linechunks.digest(docs).collect()}
    for r in got:
        assert r.doc_id == 4 or shown[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert linechunks.digest(docs.limit(0)).count() == 0


def test_equal_hash_with_other_bytes_stays(spark, monkeypatch):
    def same(docs):
        real = chunks(docs)
        return real.withColumn("hash", real["hash"] * 0)

    chunks = linechunks.chunks
    monkeypatch.setattr(linechunks, "chunks", same)
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linechunks.drop_repeated_chunks(docs).collect()} == {1: "a\nb", 2: "c\nd", 3: ""}


@pytest.mark.parametrize("size", [3, 4, 6, 10, 20])
def test_repeated_passages_go_whole(spark, size):
    rows = []
    for k in range(60):
        passage = [f"passage {size} {k} {j}" for j in range(size)]
        rows += [(i, "\n".join([f"own {i} {j}" for j in range(i % 5)] + passage + [f"tail {i}"])) for i in (2 * k, 2 * k + 1)]
    got = linechunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r._removed == size * (r.doc_id % 2) for r in got)
    assert all("passage" not in r.text for r in got if r.doc_id % 2)


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", "k", 5), (2, "a\nb", "l", 6)], "_id long, _text string, _KEY string, _gone int")
    got = linechunks.drop_repeated_chunks(docs, "_id", "_text").collect()
    assert {(r["_id"], r["_text"], r["_KEY"], r["_gone"], r["_removed"]) for r in got} == {(1, "a\nb", "k", 5, 0), (2, "", "l", 6, 2)}


def test_plans_have_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for out in (quality.digest(docs), linechunks.digest(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
