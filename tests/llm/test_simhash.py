import random

import xxhash

from paceline.llm import simhash


def slow_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius):
    """fps: id to fingerprint."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[b] < label[a] and bin(fps[a] ^ fps[b]).count("1") <= radius:
                    label[a], changed = label[b], True
    return label


def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    out = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        out.append(" ".join(base))
        near = list(base)
        near[rng.randrange(len(near))] = "other"
        out.append("  ".join(near).upper() if i % 3 else " ".join(near))
    return out + ["", None, " \t\n", "Äpfel ÄPFEL äpfel", out[0], out[0]]


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.digest(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps, 2)


def test_hash_is_the_one_of_spark(spark):
    row = spark.sql("select xxhash64('naïve a b') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("naïve a b".encode(), 42)


def test_chains_and_dense_groups_are_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS_PER_CHUNK", 100)  # several chunks a tile
    rng = random.Random(1)
    fps = {}
    for i in range(250):
        base = rng.getrandbits(64) if i % 25 == 0 else fps[i - 1]
        fps[i] = base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    for i in range(250, 400):
        fps[i] = 0xFFFF0000FFFF0000 ^ (1 << rng.randrange(64))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    by_fp = {}
    for i, f in fps.items():
        by_fp.setdefault(f, i)
    classes = spark.createDataFrame([(signed(f), i) for f, i in by_fp.items()], "fp long, node long")
    from paceline.llm.graph import components

    got = {r.node: r.component for r in components(simhash.near_edges(classes), "a", "b").collect()}
    want = slow_components({i: f for f, i in by_fp.items()}, 2)
    assert {i: got.get(i, i) for i in want} == want


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (7, "a b c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.digest(docs).collect())
    assert [g for g in got if g[0] > 0] == [(3, 3), (3, 3), (7, 3)]
    assert [g[1] for g in got if g[0] < 0] == [None, None]
    assert simhash.digest(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in simhash.drop_near_copies(docs).collect()) == [-1, -1, 3, 3]
