"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.words import SPACES, count_of, indices, words
from paceline.sources.scratch import pin

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text: words, their characters, symbols, repeated lines and words.

    All in one pass without a shuffle; time and memory follow the length of a text (repeated
    windows are found by sorting, and only in texts that have some). A null text has no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        count_of(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        count_of(F.col("text"), "!").cast("long").alias("n_exclaims"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    window = F.transform(
        indices(F.lit(0), F.size("h") - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("g", window).drop("h")
    some = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("g", F.when(some, placed))
    same = lambda e, j: F.get(F.col("g"), j).getField("x") == e.getField("x")
    twice = F.filter("g", lambda e, j: F.coalesce(F.when(j > 0, same(e, j - 1)), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)))
    rows = rows.withColumn("g", F.array_sort(F.transform(twice, lambda e: e.getField("i"))))
    covered = F.transform("g", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("g"), j + 1) - i, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", repeated).drop("g")


@dataclass(frozen=True)
class Rule:
    """Votes against a text (-1) or for it (1) where its condition holds; abstains (0) otherwise.

    A defect rule has nothing to say for a text: it could only vouch that its own defect is
    not there. How much its silence tells is estimated with its votes.
    """

    name: str
    says: int
    condition: Column

    def vote(self) -> Column:
        return F.when(self.condition, self.says).otherwise(0)


def rules() -> list[Rule]:
    per_word = lambda c: F.try_divide(c, "n_words")
    word_length = per_word("word_chars")
    shouting = F.greatest(F.try_divide("n_capitals", "word_chars"), per_word("n_exclaims"))
    return [
        Rule("few_words", -1, F.col("n_words") < 10),
        Rule("long_words", -1, word_length > 14.0),
        Rule("short_words", -1, word_length < 2.0),
        Rule("symbols", -1, per_word("n_symbols") > 0.1),
        Rule("repeated_lines", -1, F.try_divide("n_dup_lines", "n_lines") > 0.5),
        Rule("repeated_words", -1, per_word("n_repeat_words") > 0.2),
        Rule("shouting", -1, shouting > 0.4),
        # Words of usual length, few capitals and marks, little said twice: looser bounds than
        # those of the defects, so that a text just beyond one of these still has a voice for it.
        Rule(
            "prose",
            1,
            (F.col("n_words") >= 10) & word_length.between(3.0, 9.0) & (shouting < 0.4)
            & (per_word("n_symbols") < 0.15) & (per_word("n_repeat_words") < 0.4),
        ),
    ]


VOTES = (-1, 0, 1)
#: What is believed of any rule before it is seen at work: how often its votes (against, none,
#: for) fall on a good text and on a bad one; and the share of good texts.
BELIEF_GOOD = {-1: (0.02, 0.93, 0.05), 1: (0.02, 0.18, 0.80)}
BELIEF_BAD = {-1: (0.30, 0.65, 0.05), 1: (0.05, 0.65, 0.30)}
SHARE_GOOD = 0.85
#: Texts that each belief weighs as much as: a table of any size overrules it.
STRENGTH = 2.0


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts; of each rule how often it gives each vote to a good and to a bad one."""

    good: float
    on_good: list[tuple[float, ...]]
    on_bad: list[tuple[float, ...]]

    def weight(self, k: int, vote: int) -> float:
        """What a rule's vote, or its silence, adds to the log odds of a good text."""
        return math.log(self.on_good[k][vote + 1] / self.on_bad[k][vote + 1])

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.good / (1 - self.good)) + sum(self.weight(k, v) for k, v in enumerate(votes))

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = self.log_odds(votes)
        return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def fit(patterns: list[tuple[tuple[int, ...], int]], says: list[int], rounds: int = 1000, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many texts have each.

    ``says`` has the sign each rule can vote with. Starts from the beliefs, which also count
    as a few texts each (so no rate is ever zero), and ends when no rate moves any more.
    Which class is the good one comes from the start alone: there, votes against are rarer.
    """
    model = LabelModel(SHARE_GOOD, [BELIEF_GOOD[s] for s in says], [BELIEF_BAD[s] for s in says])
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [n * model.posterior(v) for v, n in patterns]
        bad = [n - g for (_, n), g in zip(patterns, good)]

        def rates(k: int, mass: list[float], belief: tuple[float, ...]) -> tuple[float, ...]:
            own = [sum(m for (v, _), m in zip(patterns, mass) if v[k] == vote) for vote in VOTES]
            return tuple((m + STRENGTH * b) / (sum(own) + STRENGTH) for m, b in zip(own, belief))

        before, model = model, LabelModel(
            (sum(good) + STRENGTH * SHARE_GOOD) / (total + STRENGTH),
            [rates(k, good, BELIEF_GOOD[s]) for k, s in enumerate(says)],
            [rates(k, bad, BELIEF_BAD[s]) for k, s in enumerate(says)],
        )
        flat = lambda m: [m.good, *[p for side in (m.on_good, m.on_bad) for r in side for p in r]]
        if max(abs(x - y) for x, y in zip(flat(before), flat(model))) < tolerance:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The signals of every row with ``base_failed``, ``quality`` (posterior) and ``kept``.

    The vote patterns, of which there are at most two to the number of rules, are counted
    over all rows; only those counts reach the driver. The base rules hold in any case.
    Null ids, repeated rows and ids are rows like any other; an empty table stays empty.
    """
    rows = pin(signals(docs, id_col, text_col))
    voters = rules()
    votes = rows.select(*[r.vote().cast("tinyint").alias(r.name) for r in voters])
    counted = votes.groupBy(*votes.columns).count().collect()
    model = fit([(tuple(r[:-1]), r[-1]) for r in counted], [r.says for r in voters])
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for k, rule in enumerate(voters):
        says = F.coalesce(rule.condition, F.lit(False))
        odds = odds + F.when(says, F.lit(model.weight(k, rule.says))).otherwise(F.lit(model.weight(k, 0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judge(docs).select(*columns)
