"""The pipeline against brute force, stage by stage, each on what the one before left."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import langid
from test_pii import slow as slow_pii
from test_quality_lines import slow_dedup
from test_nearcopies import slow_groups
from test_tokens import check_packing

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(12)
    vocabulary = {"en": ["the", "house", "with", "water", "thing"], "de": ["das", "haus", "über", "wasser", "ding"]}
    out = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        line = lambda: " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(40)) for _ in range(8))  # noqa: B023, E731
        text = "\n".join(line() for _ in range(rng.randrange(1, 9)))
        out.append((i, text, lang))
    out += [(200 + i, out[5][1], "en") for i in range(4)] + [(210, "12 34", "en"), (211, None, "en"), (212, "", "de")]
    out += [(220, "the house of jo@mail.org at 10.1.2.3 is +1 202 555 0143 open", "en"), (None, "the water", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in out]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.createDataFrame(rows(), KIND)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def listed(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns


def test_language(stages):
    before, after = listed(stages[0], "doc_id", "text"), listed(stages[1], "doc_id", "text")
    model = langid.train(stages[0], ~langid.held_out())
    good = lambda t: (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE
    assert after == [r for r in before if good(r[1])]
    assert {r[0] for r in before} - {r[0] for r in after} == {210, 211, 212}


def test_lines(stages):
    want = sorted(((i, kept) for i, _, _, kept in slow_dedup([tuple(r) for r in stages[1].select("doc_id", "text").collect()])), key=str)
    assert listed(stages[2], "doc_id", "text") == want
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_copies(stages):
    before = listed(stages[2], "doc_id", "text")
    group = slow_groups([(i, t) for i, t in before if i is not None])
    assert listed(stages[3], "doc_id", "text") == [r for r in before if r[0] is None or group[r[0]] == r[0]]


def test_personal_data(stages):
    before, after = dict(listed(stages[3], "doc_id", "text")), dict(listed(stages[4], "doc_id", "text"))
    for i, text in before.items():
        out, at = "", 0
        for kind, start, end in sorted(slow_pii(text), key=lambda s: s[1:]):
            out += text[at:start] + f"<{kind}>"
            at = end
        assert after[i] == out + text[at:]
    assert "<email>" in after[220] and "<ip>" in after[220] and "<phone>" in after[220]


def test_packing(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = [(i or 0, 0, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in listed(stages[4], "doc_id", "text")]
    check_packing(stages[5].collect(), 4096, sizes)


def test_run_reads_documents(spark, tmp_path):
    spark.createDataFrame(rows(), KIND).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
