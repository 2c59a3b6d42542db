import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paceline.llm import digestindex
from paceline.llm.digestindex import DigestIndex


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "in'dex")


def slow(rows):
    """Of (id, text) rows: id, id that stays, size of the group, digest."""
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest(), []).append((i, t))
    out = []
    for h, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), h) for i, _ in members]
    return sorted(out, key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    base = ["".join(rng.choice("abäß\x1f\xa0語") for _ in range(rng.randrange(5))) for _ in range(12)]
    return [None if rng.random() < 0.05 else rng.choice(spaces).join(rng.choice(base)) for _ in range(n)]


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 300))] + [(900, "x" * 2_000_000), (901, " " + "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = digestindex.digest(df).cache()
    assert got(out) == slow(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out.collect())
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_copies_that_are_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(digestindex, "join_lookup", lambda *a: join(*a, broadcast_rows=5, hot_rows=50))
    from paceline.operators.joins import join_lookup as join

    rows = [(i, "copy" if i % 3 else f"text {i}") for i in range(400)]
    assert got(digestindex.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)


def test_later_batches_meet_the_index_on_disk(spark, path):
    first = [(i, t) for i, t in enumerate(texts(2, 60))]
    later = [(100 + i, t) for i, t in enumerate(texts(3, 60) + ["new one", "newone", None])]
    index = DigestIndex(spark, path, buckets=3)
    index.add(spark.createDataFrame(first, "doc_id long, text string"), "a")
    kept_of = {h: keep for _, keep, _, h in slow(first)}
    spark.sql(f"DROP TABLE {index.table}")  # as a new session: only the folder is left
    again = DigestIndex(spark, path, buckets=99)
    assert again.buckets == 3 and again.entries().count() == len(kept_of)
    want = sorted([(i, kept_of.get(h, keep), n, h) for i, keep, n, h in slow(later)], key=repr)
    df = spark.createDataFrame(later, "doc_id long, text string")
    out = again.add(df, "b").cache()
    assert got(out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out.collect())
    # The same batch once more: nothing is appended, and the answer is the same.
    entries = again.entries().count()
    assert got(again.add(df, "b")) == want and again.entries().count() == entries
    assert sorted(r.doc_id for r in again.add(df, "b").where("kept").collect()) == sorted(
        r.doc_id for r in out.where("kept").collect()
    )
    assert again.add(df, "c").where("kept").count() == 0


def test_a_half_written_batch_is_completed(spark, path):
    rows = [(i, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = DigestIndex(spark, path, buckets=4)
    half = df.where("doc_id < 20").select(
        digestindex.text_digest(F.col("text")), "doc_id", F.length("text"), F.lit("a")
    )
    half.write.insertInto(index.table)
    assert index.add(df, "a").where("kept AND doc_id = keep_id").count() == 50
    assert index.entries().count() == 50 == index.entries().select("digest").distinct().count()


def test_the_entries_are_not_shuffled(spark, path):
    index = DigestIndex(spark, path, buckets=4)
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    index.add(df, "a")
    plan = index.unknown(df.select(digestindex.text_digest(F.col("text")).alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1
    assert "Bucketed: true" in plan and "Python" not in plan and "Arrow" not in plan


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = digestindex.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nulls_repeats_empty_and_other_columns(spark, path):
    rows = [(None, "a", 1), (3, "a", 2), (3, "a", 3), (2, " a", 4), (None, None, 5), (None, "", 6), (7, " ", 7), (None, "z", 8)]
    schema = "doc_id long, text string, row int, digest string, keep_id string, _row int"
    df = spark.createDataFrame([(i, t, k, "d", "k", k) for i, t, k in rows], schema)
    out = digestindex.digest(df)
    assert got(out) == slow([r[:2] for r in rows])
    assert out.where("kept").count() == 3
    index = DigestIndex(spark, path)
    stay = index.keep_new(df, "a")
    assert stay.columns == df.columns
    assert sorted((r.doc_id or -1, r.text, r.digest) for r in stay.collect()) == [(-1, "z", "d"), (2, " a", "d"), (7, " ", "d")]
    assert index.keep_new(df, "b").count() == 0
    assert digestindex.digest(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(3, "a")] * 5, "doc_id long, text string")
    assert [r.kept for r in digestindex.digest(repeated).collect()].count(True) == 1


def test_ids_of_another_type(spark, path):
    df = spark.createDataFrame([("b", "x"), ("a", "x ")], "name string, body string")
    out = DigestIndex(spark, path, "string").add(df, "a", "name", "body")
    assert sorted((r.name, r.keep_id, r.kept) for r in out.collect()) == [("a", "a", True), ("b", "a", False)]
