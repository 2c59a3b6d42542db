import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from paceline.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    out = ["", None, " ", "\n\n  a", "it's we'll I'd 'tis", "  two  blanks ", " x  y\x1c\x1dz\x85", "日本語 テキスト ½ ²", "😀👍🏽 é", "a" * 700]
    for alphabet in ("abcde ", "thein ", "0123.,'\n ", "äöüß é", "αβγ あ ", "<>&%$# "):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(15)]
    return out


@pytest.mark.parametrize("head", [0, 5])
def test_same_as_the_library(spark, head, monkeypatch):
    monkeypatch.setattr(bytebpe, "HEAD_WORDS", head)
    rows = [(i, t, "o") for i, t in enumerate(texts())] + [(None, "no id", "o"), (3, "twice", "o"), (3, "twice", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bytebpe.encode(docs.drop("ids"), bytebpe.Codec(bytebpe.read_ranks(PATH), public_tokenizers.PATTERN), head=head).collect()
    library = encoding()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or ""), repr(r.text)


def test_digest_and_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    library = encoding()
    got = {r.doc_id: r for r in bytebpe.digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts()):
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    assert bytebpe.digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_the_table_of_pairs_stands_in_a_fold_no_more_than_twice(spark):
    """The plan holds it as a literal each time, and a key is worked out once for each look-up."""
    ranks = {bytes([b]): b for b in range(256)} | {b"qz": 256}
    folded = bytebpe.Codec(ranks, public_tokenizers.PATTERN).fold(F.col("word"))
    docs = spark.createDataFrame([(" qzq qz",), ("",), ("qqzzqz",)], "word string")
    assert [r[0].replace(bytebpe.GAP, "") for r in docs.select(folded).collect()] == [" \u0100q \u0100", "", "q\u0100z\u0100"]
    plan = docs.select(folded)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("keys: [qz]") <= 2 and plan.count("xxhash64(concat") == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = bytebpe.digest(docs, PATH, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "from_json" not in plan


def test_tables_stand_neither_in_the_plan_nor_in_its_rows(spark):
    """As literals they filled the driver's memory with the texts of plans, and each task read them anew."""
    docs = spark.createDataFrame([(1, "a b", 5, "own")], "doc_id long, text string, _tables int, ids string")
    codec = bytebpe.Codec(bytebpe.read_ranks(PATH), public_tokenizers.PATTERN)
    out = bytebpe.decode(bytebpe.encode(docs, codec), codec)
    assert out.columns == ["doc_id", "text", "_tables", "ids", "bytes"]
    (row,) = out.collect()
    assert (row["_tables"], row.bytes, np.frombuffer(row.ids, "<u4").tolist()) == (5, b"a b", encoding().encode_ordinary("a b"))
    execution = bytebpe.digest(docs, PATH, public_tokenizers.PATTERN)._jdf.queryExecution()
    assert len(execution.toString()) < 50_000
    # Once for the rank map and the words, once for the pieces, each where it is used; rows don't carry them.
    plan = execution.optimizedPlan().toString()
    assert plan.count("transform(array(scalar-subquery#") == 2 and plan.count("scalar-subquery#") == 2
    assert "AS _tables" not in plan


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_early_merges_keep_the_order(spark, seed):
    """Ranks without any order, as a vocabulary may have them: replacing stops where it would change a result."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    for _ in range(40):
        token = rng.choice(tokens[97:101] + tokens[256:]) + rng.choice(tokens[97:101] + tokens[256:])
        tokens += [token] if token not in tokens else []
    tail = tokens[256:]
    if seed > 2:
        rng.shuffle(tail)
    ranks = {t: i for i, t in enumerate(tokens[:256] + tail)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bytebpe.Codec(ranks, public_tokenizers.PATTERN)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = bytebpe.with_tables(rows, "word", "tokens", lambda t, word: codec.fold(word, t["pairs"]), pairs=(codec.pairs.maps, bytebpe.Lookup.KIND))
    for r in got.collect():
        if r.word.encode() not in ranks:  # else the library takes the word as it is, whatever its merges give
            assert [ord(c) for c in r.tokens[::2]] == library.encode_ordinary(r.word), r.word


def test_early_merges_stop_where_the_order_matters():
    assert bytebpe.early_merges({256: [(1, 2)], 257: [(1, 256)], 258: [(3, 3)]}, 9) == [(1, 2, 256), (1, 256, 257), (3, 3, 258)]
    assert bytebpe.early_merges({256: [(1, 2)], 257: [(1, 256)]}, 1) == [(1, 2, 256)]
    assert bytebpe.early_merges({256: [(1, 2)], 257: [(3, 258)], 258: [(4, 5)]}, 9) == [(1, 2, 256), (3, 258, 257)]
    assert bytebpe.early_merges({256: [(1, 2)], 257: [(1, 256), (256, 1)]}, 9) == [(1, 2, 256)]
