import hashlib
import random
import zlib

import pytest

from paceline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def slow_levels(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def slow_path(levels, pos):
    """What stands before and after a leaf's node in its run, at each level below the root."""
    for nodes in levels[:-1]:
        first = pos - pos % 8
        yield "".join(nodes[first:pos]), "".join(nodes[pos + 1 : first + 8])
        pos //= 8


def slow(rows):
    """By (doc_id, leaf): the whole result of the query."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, slow_leaf(r), r))
    trees = {lang: sorted(rs, key=lambda x: x[:3]) for lang, rs in by_lang.items()}
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    levels = {lang: slow_levels([x[2] for x in trees[lang]]) for lang in order}
    top = slow_levels([levels[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for pos, (_, _, leaf, r) in enumerate(trees[lang]):
            steps = [*slow_path(levels[lang], pos), *slow_path(top, t)]
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                lower = r[4] if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                folded = slow_leaf((*r[:4], lower))
            for before, after in steps:
                folded = h(before, folded, after)
            root = top[-1][0]
            out.append((r[0], leaf, levels[lang][-1][0], root, h(*[x for s in steps for x in s]), folded, folded == root))
    return sorted(out, key=repr)


def table(n, langs, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n + 10), n)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("aBÄ語 \n") for _ in range(rng.randrange(6)))
    return [(i, rng.choice(["s", "ß", "", None]), rng.choice(langs), rng.choice([None, 5]), text()) for i in ids]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows, langs", [(1, ["de"]), (8, ["de"]), (9, ["de", None]), (130, ["de", "", None, "Z", "é"]), (9000, ["x"] * 9 + ["y"])])
def test_against_brute_force(spark, rows, langs):
    rows = table(rows, langs)
    got = merkle.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(got) == slow(rows)


def test_many_groups_and_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB", 1)
    monkeypatch.setattr(merkle, "PARTITION", 8)
    rows = table(700, [f"l{i}" for i in range(80)] + ["big"] * 80)
    assert result(merkle.digest(spark.createDataFrame(rows, SCHEMA))) == slow(rows)


def test_every_change_is_found(spark):
    rows = table(300, ["a", "b"])
    for r in merkle.digest(spark.createDataFrame(rows, SCHEMA)).collect():
        text = next(x[4] for x in rows if x[0] == r.doc_id)
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and "B" in (text or "")
        assert r.verified == (not changed)


def test_nulls_repeats_long_texts_empty_and_other_columns(spark):
    rows = [(None, None, None, None, None)] * 3 + [(4, "s", "de", 1, "A")] * 20 + [(4, "s", "de", 2, "B")]
    rows += [(7, "s", "de", 3_000_000, "Lang " * 600_000), (8, "", "", 0, "")]
    wide = spark.createDataFrame([(*r, 1, "g", "f", b"x") for r in rows], SCHEMA + ", id int, `group` string, f0 string, leaf binary")
    assert result(merkle.digest(wide)) == slow(rows)
    empty = merkle.digest(wide.limit(0))
    assert empty.count() == 0 and empty.dtypes == merkle.digest(wide).dtypes


def test_missing_nodes_are_enough_and_least():
    rng = random.Random(2)
    for n in [1, 2, 7, 8, 9, 63, 64, 65, 513, 700]:
        leaves = [str(i).encode() for i in range(n)]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([merkle.node_hash(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        for k in {1, min(n, 3), n // 2 or 1, n}:
            positions = rng.sample(range(n), k)
            need = merkle.missing_nodes(positions, n)
            assert len(set(need)) == len(need)
            known = {(level, p): levels[level][p] for level, p in need} | {(0, p): leaves[p] for p in positions}
            before = set(known)
            assert merkle.climb(known, positions, n) == levels[-1][0]
            # None of them can be left out: none stands below, or is, a node that is derived from the others.
            assert not {(level, p // 8**level) for level in range(1, len(levels)) for p in positions} & {
                (level, p) for level, p in need
            }
            for gone in need:
                with pytest.raises(KeyError):
                    merkle.climb({x: known[x] for x in before - {gone}}, positions, n)


def test_proofs_of_some_leaves_of_a_stored_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB", 2)
    monkeypatch.setattr(merkle, "PARTITION", 64)
    rows = table(1500, ["a", "a", "a", "b", None])
    df = spark.createDataFrame(rows, SCHEMA)
    merkle.build(merkle.leaf_hashes(df, merkle.FIELDS, "lang", "doc_id"), str(tmp_path / "m"))
    stored = merkle.open_manifest(spark, str(tmp_path / "m"))
    want = {r[0]: r for r in slow(rows)}
    assert stored.root == slow(rows)[0][3] and stored.trees == 3
    some = sorted(want)[::17]
    got = merkle.prove(stored, stored.leaves.where(stored.leaves.id.isin(some))).collect()
    assert sorted(r.id for r in got) == some
    for r in got:
        assert tuple(r)[1:5] == want[r.id][1:5] and r.verified and r.folded_root == r.root
