import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paceline.llm import packing, tokenfile, wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's  a\ttest.\r\n", "", None, " \n ", "ÀÉ é Ǆ ΣΑΣ ΟΔΟΣ İ ß", "a b c\u0085d\x1ce",
    "日本語 テキスト 123 4567", "\x00 null \x00mark\x00", "<|endoftext|> <|startoftext|>x", "naïve café 😀😀 !!!???", "w " * 5000,
    "x" * 3000, " ́b ́", "a <|endoftext|> b", "É<|endoftext|>É<|startoftext|><|endoftext|>.", "<|ENDOFTEXT|> <|endoftext| <|endoftext|>",
    "e<|endoftext|>\u0301",
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("aÉ'.,1 \ńst") for _ in range(300)) for _ in range(40)]
    assert [x.tolist() for x in wordbpe.WordEncoder(PATH).encode(texts)] == whole(texts)
    monkeypatch.setattr(wordbpe, "SLICE", 50)
    monkeypatch.setattr(wordbpe, "CALL", 7)
    small = wordbpe.WordEncoder(PATH, table_words=60)  # emptied again and again
    assert [x.tolist() for x in small.encode(texts)] == whole(texts)


def test_tokenizer_with_white_space_is_refused():
    with pytest.raises(ValueError):
        wordbpe.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [2**40, 2**40, 2**62], [0] * 500 + [10**9]])
def test_elias_fano(values):
    data = b"xx" + tokenfile.pack_sequence(np.array(values, np.uint64))
    read = tokenfile.Sequence(data, 2)
    assert read.all().tolist() == values and [read[i] for i in range(read.n)] == values and read.end == len(data)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 10_000))
    assert len(tokenfile.pack_sequence(ends)) < 10_000 * 2


def test_token_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 300)
    rows = [(7 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, shard string, payload string")
    tokenfile.write_token_file(docs.repartition(3), str(tmp_path / "f"), PATH, end_id=2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_token_file(spark, str(tmp_path / "f")).collect())
    assert [g[1] for g in got] == [None, None] + sorted(i for i, _ in rows if i is not None)
    ids = {i: x + [2] for (i, _), x in zip(rows, whole([t for _, t in rows]))}
    at = 0
    for start, doc_id, n, crc in got:
        assert start == at
        at += n
        if doc_id is not None:
            assert (n, crc) == (len(ids[doc_id]), zlib.crc32(np.array(ids[doc_id], "<u4").tobytes()))
    block = tokenfile.Block(spark.read.parquet(str(tmp_path / "f")).orderBy("shard", "block").first().payload)
    assert [len(block.document(i)) for i in range(block.n)] == [g[2] for g in got[: block.n]]


def test_token_file_of_nothing(spark, tmp_path):
    tokenfile.write_token_file(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), PATH, 2)
    assert tokenfile.read_token_file(spark, str(tmp_path / "e")).count() == 0


def check_packing(rows, capacity, lengths):
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == sorted(lengths)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, " \n "), (None, "a b")]
    pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 1, capacity=64)
    ids = [x + [1] for x in whole([t for _, t in rows])]
    want = [(i or 0, p, len(x[p * 64 : p * 64 + 64])) for (i, _), x in zip(rows, ids) for p in range(-(-len(x) // 64))]
    got = packing.pack(pieces, 64).collect()
    n = check_packing(got, 64, want)
    assert n <= 1.1 * -(-sum(map(len, ids)) // 64)
    by = {(r.doc_id, r.piece): r for r in got}
    for i, x in enumerate(ids[:-2]):
        for p in range(-(-len(x) // 64)):
            r = by[i, p]
            assert r.start == 64 * p and r.ids_crc32 == zlib.crc32(np.array(x[64 * p : 64 * p + 64], "<u4").tobytes())


@pytest.mark.parametrize("capacity,seed", [(1, 0), (7, 1), (100, 2), (4096, 3), (4096, 4), (600, 5)])
def test_plan(capacity, seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(capacity, 1 + rng.lognormal(np.log(capacity) * 0.7, 1, 3000).astype(int))
    if seed % 2:
        lengths[:1000] = lengths[0]
    histogram = np.bincount(lengths, minlength=capacity + 1)
    made = packing.plan(histogram, capacity)
    fill, seen = np.zeros(made.sequences, int), {}
    for length, rank, count, at in made.runs:
        fill[at : at + count] += length
        seen.setdefault(length, []).append((rank, count))
    for length, runs in seen.items():
        at = 0
        for rank, count in sorted(runs):
            assert rank == at
            at += count
        assert at == histogram[length]
    assert fill.max() <= capacity and fill.min() > 0
    bins: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):  # plain best fit, longest first
        room = min((b for b in bins if b >= length), default=None)
        if room is None:
            bins.append(capacity - length)
        else:
            bins[bins.index(room)] -= length
    assert made.sequences <= 1.01 * len(bins) + 1


def test_repeat_counts_solve_the_problem():
    shapes = packing.patterns(8, np.ones(9, bool))
    want = np.zeros(len(shapes))
    want[[0, 2, 4]] = [5, 3, 8]
    histogram = np.bincount(shapes.ravel(), np.repeat(want, 3), 9)
    histogram[0] = 0
    x = packing.repeat_counts(histogram, shapes, 3000)
    made = np.bincount(shapes.ravel(), np.repeat(x, 3), 9)
    assert (x >= 0).all() and abs(made[1:] - histogram[1:]).max() < 0.05


def test_packing_of_nothing(spark):
    pieces = packing.token_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH, 1)
    assert packing.pack(pieces).count() == 0
