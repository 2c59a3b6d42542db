"""Target encoding, category codes, one-hot columns and the model matrix."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from paceline.functions.numeric import finite_or
from paceline.operators.folds import FOLD
from paceline.operators.joins import free_names, join_lookup
from paceline.operators.ordered import global_index
from paceline.schema import CATEGORICAL_COLS, ENCODED_COL, RACE
from paceline.sources.scratch import pin

SMOOTHING = 10
LABEL = "label"
FEATURES = "features"
LOCAL_LABELS = 10_000


class TargetEncoder:
    """Smoothed mean of the target per category, learnt from one table.

    ``weights`` (one row per category) and ``default`` (the overall mean, one row) are written
    once when they are learnt, from one scan of the table; every later use reads them.
    Nothing passes the driver.
    """

    def __init__(self, weights: DataFrame, default: DataFrame, column: str):
        self.weights, self.default, self.column = weights, default, column

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        column: str = RACE.event_clean,
        target: str = RACE.pace,
        m: float = SMOOTHING,
    ) -> TargetEncoder:
        stats = train.groupBy(F.col(column).alias("_category")).agg(*_target_sums(target))
        return cls.from_sums(pin(stats), column, m)

    @classmethod
    def from_sums(cls, stats: DataFrame, column: str, m: float = SMOOTHING) -> TargetEncoder:
        """From ``_category, _n, _sum`` of every category, null included: a written table."""
        default = pin(stats.agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_mean")))
        # Sum and mean * count are the same; a category without targets gets the mean.
        weight = (F.coalesce("_sum", F.lit(0.0)) + m * default.scalar()) / (F.col("_n") + m)
        known = stats.filter(F.col("_category").isNotNull())
        return cls(pin(known.select("_category", weight.alias("_weight"))), default, column)

    def transform(self, df: DataFrame, output: str = ENCODED_COL) -> DataFrame:
        """Left join on the category; unseen and null categories get the overall mean.

        Few categories (they are counted) are broadcast; with more, hot ones are joined apart.
        """
        joined = join_lookup(df, self.weights, {self.column: "_category"})
        encoded = F.coalesce(F.col("_weight"), self.default.scalar())
        return joined.withColumn(output, encoded).drop("_weight")


def _target_sums(target: str) -> list[Column]:
    return [F.count(target).alias("_n"), F.sum(F.col(target).cast("double")).alias("_sum")]


def target_encode(
    train: DataFrame,
    test: DataFrame,
    column: str = RACE.event_clean,
    target: str = RACE.pace,
    m: float = SMOOTHING,
    output: str = ENCODED_COL,
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train`` only, apply to both."""
    encoder = TargetEncoder.fit(train, column, target, m)
    return encoder.transform(train, output), encoder.transform(test, output)


def encode_validation_folds(
    folded: DataFrame,
    column: str = RACE.event_clean,
    target: str = RACE.pace,
    m: float = SMOOTHING,
    output: str = ENCODED_COL,
    fold: str = FOLD,
) -> DataFrame:
    """Encode every validation row with what its own fold may know: earlier folds only.

    One aggregate per (category, fold) serves all folds; a running sum over the few
    folds of a category gives the statistics of its training part.
    """
    stats = folded.groupBy(F.col(column).alias("_category"), F.col(fold).alias("_fold")).agg(
        F.count(target).alias("_n"), F.sum(target).alias("_sum")
    )
    known = stats.filter(F.col("_category").isNotNull())
    # A category has at most one row per fold here, and so has the whole table below.
    earlier = Window.partitionBy("_category").orderBy("_fold").rowsBetween(Window.unboundedPreceding, -1)
    by_category = known.select(
        "_category",
        "_fold",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_sum"),
    )
    before = Window.orderBy("_gfold").rowsBetween(Window.unboundedPreceding, -1)
    overall = (
        stats.groupBy(F.col("_fold").alias("_gfold"))
        .agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
        .select("_gfold", F.try_divide(F.sum("_sum").over(before), F.sum("_n").over(before)).alias("_mean"))
    )
    rows = folded.filter(F.col(fold) >= 0)
    rows = rows.join(
        by_category, (rows[column] == F.col("_category")) & (rows[fold] == F.col("_fold")), "left"
    ).join(F.broadcast(overall), rows[fold] == F.col("_gfold"), "left")
    n, total = F.coalesce("_n", F.lit(0)), F.coalesce("_sum", F.lit(0.0))
    encoded = F.coalesce((total + m * F.col("_mean")) / (n + m), F.col("_mean"))
    return rows.withColumn(output, encoded).select(*folded.columns, output)


def label_dictionary(df: DataFrame, column: str, local_labels: int = LOCAL_LABELS) -> tuple[DataFrame, bool]:
    """Distinct non-null labels with alphabetical codes 0, 1, ...; and whether they are few.

    A dictionary checked to be small is numbered in one task; a larger one through the
    range-partitioned global index.
    """
    labels = df.select(F.col(column).alias("_label")).filter(F.col("_label").isNotNull()).distinct()
    return _numbered(pin(labels), local_labels)


def _numbered(labels: DataFrame, local_labels: int = LOCAL_LABELS) -> tuple[DataFrame, bool]:
    """A written table of different labels with their codes, written too; and whether they are few."""
    few = labels.limit(local_labels + 1).count() <= local_labels
    if few:
        place = F.row_number().over(Window.orderBy("_label")) - 1
        return pin(labels.withColumn("_code", place.cast("bigint"))), True
    return pin(global_index(labels, ["_label"], "_code")), False


def apply_codes(df: DataFrame, column: str, output: str, codes: DataFrame, few: bool) -> DataFrame:
    """Codes of a fitted dictionary; null and unknown labels become -1.

    A dictionary of few labels is broadcast; with more, hot labels are joined apart.
    """
    (code,) = free_names(df.columns, ["_code"])
    codes = codes.withColumnRenamed("_code", code)
    if few:
        joined = df.join(F.broadcast(codes), df[column] == F.col("_label"), "left").drop("_label")
    else:
        joined = join_lookup(df, codes, {column: "_label"})
    return joined.withColumn(output, F.coalesce(F.col(code), F.lit(-1)).cast("int")).drop(code)


def category_codes(
    tables: list[DataFrame],
    column: str,
    output: str | None = None,
    local_labels: int = LOCAL_LABELS,
) -> list[DataFrame]:
    """Replace (or add) ordinal codes from one dictionary over all tables."""
    both = reduce(DataFrame.unionByName, [t.select(column) for t in tables])
    codes, few = label_dictionary(both, column, local_labels)
    return [apply_codes(t, column, output or column, codes, few) for t in tables]


def one_hot_name(column: str, level: str) -> str:
    return f"{column}_{level}"


def one_hot_levels(train: DataFrame, column: str, max_levels: int = 1000) -> list[str]:
    """Sorted training levels without the first.

    Levels become columns, so they must be known on the driver: more than
    ``max_levels`` of them is an error.
    """
    found = train.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{column} has more than {max_levels} levels")
    return sorted(r[0] for r in found)[1:]


def apply_one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Replace the category by one 0/1 column per level; other values get zeros everywhere."""
    flags = {
        one_hot_name(column, v): F.when(F.col(column).eqNullSafe(F.lit(v)), 1).otherwise(0) for v in levels
    }
    return df.withColumns(flags).drop(column)


def one_hot(
    train: DataFrame, test: DataFrame, column: str, max_levels: int = 1000
) -> tuple[DataFrame, DataFrame, list[str]]:
    """One-hot columns with the training levels, applied to both tables."""
    levels = one_hot_levels(train, column, max_levels)
    names = [one_hot_name(column, v) for v in levels]
    return apply_one_hot(train, column, levels), apply_one_hot(test, column, levels), names


def sparse_levels(train: DataFrame, column: str, local_labels: int = LOCAL_LABELS) -> tuple[DataFrame, bool, int]:
    """The dictionary of a column's training levels, whether they are few, and the places of its vector.

    The first level has no place, so there is one less than there are levels.  Any number of
    levels will do: they stay in a table and never reach the driver.
    """
    codes, few = label_dictionary(train, column, local_labels)
    return codes, few, max(codes.count() - 1, 0)


def apply_sparse(df: DataFrame, column: str, output: str, codes: DataFrame, few: bool, places: int) -> DataFrame:
    """Add (or replace by) a sparse one-hot vector: a one at the level's place, other values get zeros.

    The vector is parsed from its stored form, type 0 with size, indices and values, so it
    is made inside the engine and takes the same room whatever its length.
    """
    (code,) = free_names(df.columns, ["_place"])
    coded = apply_codes(df, column, code, codes, few)
    held = F.col(code) >= 1
    at = F.when(held, F.concat(F.lit("["), (F.col(code) - 1).cast("string"), F.lit("]"))).otherwise("[]")
    one = F.when(held, "[1.0]").otherwise("[]")
    stored = F.concat(F.lit(f'{{"v":{{"type":0,"size":{places},"indices":'), at, F.lit(',"values":'), one, F.lit("}}"))
    vector = F.from_json(stored, StructType([StructField("v", VectorUDT())])).getField("v")
    return coded.withColumn(output, vector).drop(code)


def sparse_one_hot(
    train: DataFrame, test: DataFrame, column: str, output: str, local_labels: int = LOCAL_LABELS
) -> tuple[DataFrame, DataFrame, int]:
    """Sparse one-hot vectors over the training levels for both tables, and their length."""
    codes, few, places = sparse_levels(train, column, local_labels)
    both = [apply_sparse(t, column, output, codes, few, places) for t in (train, test)]
    return both[0], both[1], places


def clean_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast the columns to double with -1 for null, NaN and infinities, in one projection."""
    cleaned = {c: finite_or(F.col(c).cast("double")) for c in columns}
    return df.withColumns(cleaned)


class ModelMatrix:
    """Turns feature rows into model input: encode, code categories, clean, assemble.

    Fitted on training rows; ``also`` names further tables whose labels join the category
    dictionaries.  ``encoding`` of the categories is ``codes``, ``one_hot`` (a column per level)
    or ``sparse`` (a sparse vector, for any number of levels).  What is learnt is written once,
    from one scan of the training rows, and read by every later use.
    """

    def __init__(
        self,
        encoder: TargetEncoder,
        feature_cols: list[str],
        dictionaries: dict[str, tuple[DataFrame, bool]],
        levels: dict[str, list[str]],
        sparse: dict[str, tuple[DataFrame, bool, int]] | None = None,
    ):
        self.encoder = encoder
        self.feature_cols = feature_cols
        self.dictionaries = dictionaries
        self.levels = levels
        self.sparse = sparse or {}
        flags = [one_hot_name(c, v) for c, vs in levels.items() for v in vs]
        self.numbers = [n for n in [*feature_cols, ENCODED_COL] if n not in levels and n not in self.sparse] + flags
        #: Of each place of the assembled vector; a place of a sparse column goes by its number.
        self.names = self.numbers + [f"{c}[{i}]" for c, (_, _, places) in self.sparse.items() for i in range(places)]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        feature_cols: list[str],
        target: str = RACE.pace,
        encode_column: str = RACE.event_clean,
        categorical: list[str] | None = None,
        encoding: str = "codes",
        also: list[DataFrame] | None = None,
    ) -> ModelMatrix:
        categorical = cls._checked(feature_cols, categorical, encoding)
        learnt = pin(cls._counts(train, target, [encode_column, *categorical], []))
        labels = {c: [t.select(F.col(c).alias("_label")) for t in also or []] for c in categorical}
        return cls._of_counts(learnt, dict(train.dtypes), feature_cols, encode_column, labels, encoding)

    @classmethod
    def fit_folds(
        cls,
        folded: DataFrame,
        feature_cols: list[str],
        target: str = RACE.pace,
        encode_column: str = RACE.event_clean,
        categorical: list[str] | None = None,
        encoding: str = "codes",
        folds: int = 5,
    ) -> tuple[list[ModelMatrix], dict[int, int]]:
        """One matrix for each fold of ``time_folds``, fitted on the earlier folds, and the rows of every fold.

        The labels of a fold join its category dictionaries, as those of ``also`` do in ``fit``.
        The table is scanned once for all folds; what differs by fold adds up from its counts.
        """
        categorical = cls._checked(feature_cols, categorical, encoding)
        keys = [encode_column, *categorical]
        learnt = pin(cls._counts(folded, target, keys, [FOLD]))
        first = learnt.where(F.col("_set") == cls._set_of(0, len(keys)))
        rows_of = {r[FOLD]: r["n"] for r in first.groupBy(FOLD).agg(F.sum("_rows").alias("n")).collect()}
        kinds, matrices = dict(folded.dtypes), []
        for i in range(folds):
            own = learnt.where(F.col(FOLD) == i)
            labels = {c: [cls._labels(own, place, len(keys), kinds[c])] for place, c in enumerate(categorical, 1)}
            names = [f"_g{k}" for k in range(len(keys))]
            before = learnt.where(F.col(FOLD) < i).groupBy("_set", *names).agg(
                F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum")
            )
            matrices.append(cls._of_counts(before, kinds, feature_cols, encode_column, labels, encoding))
        return matrices, rows_of

    @staticmethod
    def _checked(feature_cols: list[str], categorical: list[str] | None, encoding: str) -> list[str]:
        if encoding not in ("codes", "one_hot", "sparse"):
            raise ValueError(f"unknown encoding {encoding!r}")
        return [c for c in (CATEGORICAL_COLS if categorical is None else categorical) if c in feature_cols]

    @staticmethod
    def _counts(df: DataFrame, target: str, columns: list[str], by: list[str]) -> DataFrame:
        """One scan and one shuffle count the encoded column's targets and every category's labels, ``by`` others."""
        keys = {c: f"_g{i}" for i, c in enumerate(columns)}
        rows = df.select(*by, F.col(target).alias("_y"), *[F.col(c).cast("string").alias(k) for c, k in keys.items()])
        sets = [[*[F.col(c) for c in by], F.col(k)] for k in keys.values()]
        return rows.groupingSets(sets, *by, *keys.values()).agg(
            F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows"), *_target_sums("_y")
        )

    @staticmethod
    def _set_of(place: int, keys: int) -> int:
        """The grouping id of a key's own rows."""
        return (1 << keys) - 1 - (1 << (keys - 1 - place))

    @classmethod
    def _labels(cls, counts: DataFrame, place: int, keys: int, kind: str) -> DataFrame:
        """The rows of one grouping set, with the column's own type."""
        own = counts.where(F.col("_set") == cls._set_of(place, keys))
        return own.select(F.col(f"_g{place}").cast(kind).alias("_label"))

    @classmethod
    def _of_counts(
        cls,
        counts: DataFrame,
        kinds: dict[str, str],
        feature_cols: list[str],
        encode_column: str,
        others: dict[str, list[DataFrame]],
        encoding: str,
    ) -> ModelMatrix:
        """From the counts of all training rows; ``others`` has further labels by category."""
        keys = 1 + len(others)
        own = counts.where(F.col("_set") == cls._set_of(0, keys))
        own = own.withColumn("_category", F.col("_g0").cast(kinds[encode_column]))
        encoder = TargetEncoder.from_sums(own, encode_column)
        dictionaries, levels, sparse = {}, {}, {}
        for place, (c, more) in enumerate(others.items(), 1):
            labels = cls._labels(counts, place, keys, kinds[c]).where(F.col("_label").isNotNull())
            if encoding == "codes":
                more = [t.where(F.col("_label").isNotNull()) for t in more]
                labels = reduce(DataFrame.unionByName, [labels, *more]).distinct() if more else labels
                dictionaries[c] = _numbered(pin(labels))
            elif encoding == "sparse":
                codes, few = _numbered(labels)
                sparse[c] = (codes, few, max(codes.count() - 1, 0))
            else:
                levels[c] = one_hot_levels(labels.withColumnRenamed("_label", c), c)
        return cls(encoder, list(feature_cols), dictionaries, levels, sparse)

    def transform(
        self, df: DataFrame, target: str | None = RACE.pace, keep: list[str] | None = None
    ) -> DataFrame:
        """``features``, ``label`` (when ``target`` is given) and the ``keep`` columns."""
        kept = {f"_keep_{i}": c for i, c in enumerate(keep or [])}
        extra = [F.col(c).alias(n) for n, c in kept.items()]
        if target:
            extra.append(F.col(target).alias(LABEL))
        out = self.encoder.transform(df).select(*self.feature_cols, ENCODED_COL, *extra)
        for c, (codes, few) in self.dictionaries.items():
            out = apply_codes(out, c, c, codes, few)
        for c, values in self.levels.items():
            out = apply_one_hot(out, c, values)
        vectors = [c for c, (_, _, places) in self.sparse.items() if places]
        for c in vectors:
            codes, few, places = self.sparse[c]
            out = apply_sparse(out, c, c, codes, few, places)
            out = VectorSizeHint(inputCol=c, size=places, handleInvalid="optimistic").transform(out)
        assembler = VectorAssembler(inputCols=[*self.numbers, *vectors], outputCol=FEATURES, handleInvalid="error")
        ready = assembler.transform(clean_matrix(out, self.numbers))
        label = [LABEL] if target else []
        return ready.select(FEATURES, *label, *[F.col(n).alias(c) for n, c in kept.items()])

    def save(self, path: str) -> None:
        """Write the learnt tables below ``path`` as Parquet."""
        spark = self.encoder.weights.sparkSession
        self.encoder.weights.write.mode("overwrite").parquet(f"{path}/weights")
        self.encoder.default.write.mode("overwrite").parquet(f"{path}/default")
        few = {}
        for i, (c, (codes, is_few)) in enumerate(self.dictionaries.items()):
            codes.write.mode("overwrite").parquet(f"{path}/codes_{i}")
            few[c] = is_few
        for i, (codes, _, _) in enumerate(self.sparse.values()):
            codes.write.mode("overwrite").parquet(f"{path}/sparse_{i}")
        facts = {
            "column": self.encoder.column,
            "feature_cols": self.feature_cols,
            "few": few,
            "levels": self.levels,
            "sparse": {c: [is_few, places] for c, (_, is_few, places) in self.sparse.items()},
        }
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(
            f"{path}/facts"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelMatrix:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()[0])
        encoder = TargetEncoder(
            spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/default"), facts["column"]
        )
        dictionaries = {
            c: (spark.read.parquet(f"{path}/codes_{i}"), few) for i, (c, few) in enumerate(facts["few"].items())
        }
        sparse = {
            c: (spark.read.parquet(f"{path}/sparse_{i}"), few, places)
            for i, (c, (few, places)) in enumerate(facts.get("sparse", {}).items())
        }
        return cls(encoder, facts["feature_cols"], dictionaries, facts["levels"], sparse)


def prepare_model_data(
    train: DataFrame,
    test: DataFrame,
    feature_cols: list[str],
    target: str = RACE.pace,
    encode_column: str = RACE.event_clean,
    categorical: list[str] | None = None,
    encoding: str = "codes",
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, ModelMatrix]:
    """Fit the model input on ``train`` and apply it to both tables."""
    matrix = ModelMatrix.fit(train, feature_cols, target, encode_column, categorical, encoding, [test])
    return matrix.transform(train, target, keep), matrix.transform(test, target, keep), matrix
