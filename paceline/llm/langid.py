"""Language identification: sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.sources.scratch import pin

#: Hash buckets of the n-grams, and the lengths of n-grams in bytes of lower-cased text.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3, 4)
#: Rows the classifier is fitted on at most, of each language and in all. The rest of the
#: labelled rows counts for the document frequencies only.
ROWS_PER_LANGUAGE, ROWS = 500, 4000
#: Languages that are learnt at most, the most frequent ones: the weights on the driver are
#: one number for each of them and each bucket. Texts in others get one of these.
LANGUAGES = 200
EPOCHS = 3
#: Characters of a text that are counted at once.
PIECE = 1 << 18
UNKNOWN = "und"


def buckets(text: str | None, orders: tuple[int, ...] = ORDERS) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the whole text, a piece at a time; each n-gram is counted once."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)
    longest = max(orders)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + longest - 1].astype(np.uint32)
        size = min(PIECE, len(data) - at)
        code = np.zeros(len(piece), np.uint32)
        for n in range(1, longest + 1):
            code = code[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(1)
            if n in orders and len(code):
                mixed = code[:size] * np.uint32(0x9E3779B1)
                yield (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def counts(text: str | None) -> np.ndarray:
    """Occurrences by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for found in buckets(text):
        total += np.bincount(found, minlength=BUCKETS)
    return total


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; one vector per task reaches the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen = np.zeros(BUCKETS, bool)
                for found in buckets(text.as_py()):
                    seen[found] = True
                total[:-1] += seen
                rows += 1
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out[:-1], int(out[-1])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by bucket
    weights: np.ndarray  # bucket x language; most are zero
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[index] + self.bias

    def features(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and TF-IDF values of unit length."""
        index = np.flatnonzero(tf)
        value = np.log1p(tf[index]) * self.idf[index]
        return index, value / max(float(np.sqrt(value @ value)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.scores(*self.features(counts(text))) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def fit(
    rows: list[tuple[str, np.ndarray, np.ndarray]],
    idf: np.ndarray,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.05,
    epochs: int = EPOCHS,
) -> Model:
    """Follow the regularised leader over ``(language, buckets, counts)``, then set the temperature.

    The weights of a bucket follow from its sums of gradients alone: nought while they are
    below ``l1``, and drawn in by ``l2``, step sizes falling per weight. Every fifth row is
    kept out of the steps; on these the temperature is the one of smallest log loss.
    """
    languages = sorted({r[0] for r in rows})
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    place = {x: k for k, x in enumerate(languages)}
    data = []
    for language, index, tf in rows:
        dense = np.zeros(BUCKETS)
        dense[index] = tf
        data.append((place[language], *model.features(dense)))
    order = np.random.default_rng(7).permutation(len(data))
    held = set(order[::5].tolist())
    z = np.zeros((BUCKETS + 1, len(languages)))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        w = -(part - np.sign(part) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(part) <= l1] = 0
        return w

    for _ in range(epochs):
        for k in order.tolist():
            if k in held:
                continue
            target, index, value = data[k]
            at, value = np.append(index, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            error = softmax(value @ w)
            error[target] -= 1
            g = value[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = every[:-1], every[-1]
    checked = [(t, model.scores(i, v)) for t, i, v in (data[k] for k in sorted(held))]
    losses = {
        t: -sum(np.log(max(softmax(s / t)[k], 1e-300)) for k, s in checked) for t in np.geomspace(0.05, 4, 40).tolist()
    }
    model.temperature = min(losses, key=losses.get)
    return model


def rows_each(sizes: list[int]) -> int:
    """Rows for each language that has more, so that all languages have about ``ROWS`` at most.

    What small languages leave goes to the others. A tenth stays free, as samples vary in size.
    """
    room, left = ROWS * 9 // 10, len(sizes)
    for n in sorted(sizes):
        if n * left > room:
            break
        room, left = room - n, left - 1
    return max(1, min(ROWS_PER_LANGUAGE, room // left)) if left else ROWS_PER_LANGUAGE


def train(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """A model from the rows where ``learn`` holds and the language is known.

    Document frequencies are of all those rows. The classifier is fitted on a bounded sample
    of them, chosen by a hash of the id so that every language has about ``rows_each`` of
    its rows, or all if it has fewer; of these only bucket counts reach the driver. Of more
    than ``LANGUAGES`` values of ``lang`` the less frequent ones are not learnt.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    each = rows_each([n for _, n in sizes])
    frequency, rows = document_frequencies(known, "text")
    idf = np.log((1 + rows) / (1 + frequency)) + 0.2
    unit = (F.xxhash64(F.lit("sample"), "id") / F.lit(2.0**64)) + 0.5
    share = F.lit(0.0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rank, text in zip(*batch.columns):
                tf = counts(text.as_py())
                index = np.flatnonzero(tf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang.as_py()]),
                        pa.array([rank.as_py()]),
                        pa.array([index.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([tf[index].astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    ["lang", "rank", "buckets", "counts"],
                )

    sample = known.where(unit < share).select("lang", (unit / share).alias("rank"), "text")
    chosen = sample.mapInArrow(run, "lang string, rank double, buckets array<int>, counts array<int>")
    chosen = pin(chosen).orderBy("rank", "lang", F.xxhash64("buckets")).limit(ROWS)
    return fit([(r.lang, np.array(r.buckets, np.int32), np.array(r.counts, np.int32)) for r in chosen.toLocalIterator()], idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``lang_score``; the text alone decides.

    A text that is null or has no letter is ``und`` with score 0, as is every text if the
    model knows no language. Long texts are counted piece by piece. Columns of any name stay
    as they are, but for those of the two results.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    model_bytes = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model_bytes.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*columns, "lang_pred", "lang_score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in ("lang_pred", "lang_score"))
    # By place, as names may clash or hold dots, which mapInArrow can't look up.
    rows = docs.select(*[f"`{c}`" for c in columns], F.col(text_col)).toDF(*[f"c{i}" for i in range(len(columns) + 1)])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, lang_score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the ids that no model learns from; a null id is never learnt from."""
    third = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    return F.coalesce(third, F.lit(True))


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query."""
    model = train(docs, ~held_out())
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
