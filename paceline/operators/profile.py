"""Profiles of tables and residuals: the numbers behind overview and residual charts."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.numeric import normal_quantile
from paceline.operators.joins import join_lookup
from paceline.operators.metrics import with_error
from paceline.operators.ordered import broadcast_if, global_index, range_blocks, weighted_ranks
from paceline.sources.scratch import pin
from paceline.sources.tables import write_stage


def _long(wide: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn one row of aggregates into rows, one per entry struct."""
    return wide.select(F.inline(F.array(*entries)))


# ---- table overview ---------------------------------------------------------


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, in one scan."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)],
    )
    missing = [F.col("_n") - F.col(f"_c{i}") for i in range(len(names))]
    return _long(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                m.alias("nulls"),
                (F.try_divide(m, F.col("_n")) * 100).alias("null_pct"),
            )
            for c, m in zip(names, missing)
        ],
    )


def dtype_profile(df: DataFrame) -> DataFrame:
    """Number of columns per type (a fact of the schema, no data is read)."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, columns bigint")


# Bytes per value of the fixed-width types.
WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def column_bytes(df: DataFrame, top: int = 10) -> DataFrame:
    """Approximate bytes per column, largest first: fixed width or text length."""
    sums = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        width = WIDTHS.get(type(f.dataType))
        if width:
            size = F.count(c) * width
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.sum(F.octet_length(c))
        else:
            size = F.sum(F.octet_length(F.to_json(F.struct(c))))
        sums.append(F.coalesce(size, F.lit(0)).cast("bigint"))
    wide = df.agg(*[s.alias(f"_b{i}") for i, s in enumerate(sums)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_b{i}").alias("bytes")) for i, c in enumerate(df.columns)
    ]
    return _long(wide, rows).orderBy(F.desc("bytes"), "column").limit(top)


def top_values(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent non-null values; ties in value order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), column).limit(top)


def rows_over_time(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null time value, in time order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(column)


def data_overview(
    df: DataFrame, number: str | None = None, category: str | None = None, time: str | None = None
) -> dict[str, DataFrame]:
    """The overview panels: nulls, types, bytes, and one of each role that a column has.

    Say which column is the number, the category and the time; by default each is the first
    column of a fitting type (dates and timestamps for the time).
    """

    def first(given: str | None, *kinds: type) -> str | None:
        return given or next((f.name for f in df.schema.fields if isinstance(f.dataType, kinds)), None)

    panels = {"nulls": null_profile(df), "dtypes": dtype_profile(df), "bytes": column_bytes(df)}
    if number := first(number, T.NumericType):
        panels["histogram"] = histogram(df, number, 30)
    if category := first(category, T.StringType):
        panels["top_values"] = top_values(df, category)
    if time := first(time, T.DateType, T.TimestampType, T.TimestampNTZType):
        panels["rows_over_time"] = rows_over_time(df, time)
    return panels


def inspect_table(df: DataFrame, sample_columns: int = 5, sample_rows: int = 5) -> dict[str, DataFrame]:
    """Rows, columns, types, nulls and a few example rows of a stored table."""
    shape = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    return {
        "shape": shape,
        "columns": types.join(null_profile(df), "column"),
        "sample": df.select(*df.columns[:sample_columns]).limit(sample_rows),
    }


def added_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns a stage added, in table order."""
    return [c for c in after.columns if c not in before.columns]


class StageWriter:
    """Writes stages and notes their rows and columns on the way, without a job of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.seen: list[tuple[str, int, int]] = []

    def write(self, name: str, df: DataFrame, path: str, partition_by: str | None = None, then_by: list[str] | None = None) -> DataFrame:
        """``write_stage``, observed: the stage read back."""
        rows = Observation()
        out = write_stage(df, path, partition_by, then_by, rows)
        self.seen.append((name, rows.get["rows"] or 0, len(df.columns)))
        return out

    def counts(self) -> DataFrame:
        """``stage, rows, columns`` of the stages written so far."""
        return self.spark.createDataFrame(self.seen, "stage string, rows bigint, columns bigint")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per stage."""
    parts = [
        d.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("stage"), "rows", F.lit(len(d.columns)).cast("bigint").alias("columns")
        )
        for name, d in stages.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- distributions ----------------------------------------------------------


def _finite(df: DataFrame, column: str, *keep: str | Column) -> DataFrame:
    """The column as ``_v`` without nulls, NaN and infinities."""
    rows = df.select(*keep, F.col(column).cast("double").alias("_v"))
    return rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))


def histogram(df: DataFrame, column: str, bins: int = 30, density: bool = False) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed.

    Nulls, NaN and infinities are in no bin.  Empty bins show with a zero.  A constant column gets the unit interval around it.
    """
    finite = _finite(df, column)
    lo, hi = finite.agg(F.min("_v"), F.max("_v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], f"bin bigint, bin_start double, bin_end double, {'density double' if density else 'rows bigint'}"
        )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1))
    counts = finite.groupBy(place.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )
    if density:
        total = counts.agg(F.sum("rows")).scalar()
        out = out.withColumn("density", F.col("rows") / (total * width)).drop("rows")
    return out


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Equal values are counted together before any shuffle of rows, then the distinct
    values are ranked across range partitions; no group is gathered in one task.
    """
    by = by or []
    return _quantiles(_placed_values(df, value, by), probs, by)


def _placed_values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values per group with their counts, in pinned range partitions."""
    counted = _finite(df, value, *by).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return range_blocks(counted, [*by, "_v"])


def _quantiles(placed: DataFrame, probs: dict[str, float], by: list[str]) -> DataFrame:
    ranks = weighted_ranks(placed, by, "_n")
    first, last = F.col("_rank"), F.col("_rank") + F.col("_n") - 1
    picks = []
    for name, q in probs.items():
        at = (F.col("_size") - 1) * q
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when(place.between(first, last), F.col("_v"))).alias(f"_{side}_{name}"))
    found = ranks.groupBy(*by).agg(F.max("_size").alias("rows"), *picks)
    out = {}
    for name, q in probs.items():
        at = (F.col("rows") - 1) * q
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out[name] = low + (at - F.floor(at)) * (high - low)
    return found.withColumns(out).select(*by, "rows", *out)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def box_stats(df: DataFrame, value: str, by: list[str] | None = None, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within ``reach`` * IQR, outlier count, extremes."""
    by = by or []
    # A constant stands in when there is no group, so both joins below are equi-joins.
    keys = by or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(1))
    placed = _placed_values(source, value, keys)
    quartiles = _quantiles(placed, QUARTILES, keys)
    names = {c: f"_k{i}" for i, c in enumerate(keys)}
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    # One row per group: broadcast when they are counted to be few.
    fences = pin(quartiles.withColumnsRenamed(names))
    joined = placed.join(broadcast_if(fences, fences.count()), same)
    spread = F.col("q3") - F.col("q1")
    inside = F.col("_v").between(F.col("q1") - reach * spread, F.col("q3") + reach * spread)
    return joined.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    ).drop("_all")


def category_distribution(df: DataFrame, category: str, value: str) -> DataFrame:
    """Box statistics, mean and sample deviation per category."""
    moments = _finite(df, value, F.col(category).alias("_cat")).groupBy("_cat").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std")
    )
    boxes = box_stats(df, value, [category])
    return boxes.join(moments, F.col(category).eqNullSafe(F.col("_cat"))).drop("_cat")


def density_by_category(
    df: DataFrame, category: str, value: str, points: int = 100, cut: float = 2.0
) -> DataFrame:
    """Gaussian kernel density of the values of each category: ``category, point, x, density``.

    The bandwidth is Scott's for the category, and its grid reaches ``cut`` bandwidths beyond
    its extremes.  A category without two different values has no density and doesn't show;
    null is a category.  Equal values are counted first; then every value adds to all grid
    points of its category in one grouped aggregate, so no row is multiplied and a task
    shuffles one row per category.  A category with any share of the rows is combined in
    place: only its partial sums meet.
    """
    values = _finite(df, value, F.col(category).alias("_cat"))
    facts = values.groupBy("_cat").agg(
        F.count("_v").alias("_all"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
        F.stddev_samp("_v").alias("_sd"),
    )
    facts = facts.where(F.col("_sd") > 0).withColumn("_h", F.col("_sd") * F.pow("_all", F.lit(-0.2)))
    start, end = F.col("_low") - cut * F.col("_h"), F.col("_high") + cut * F.col("_h")
    facts = pin(facts.select("_cat", "_all", "_h", start.alias("_start"), ((end - start) / (points - 1)).alias("_step")))
    counted = values.groupBy("_cat", "_v").agg(F.count(F.lit(1)).alias("_n"))
    known = join_lookup(counted, facts, {"_cat": "_cat"}, "inner", null_safe=True)

    def kernel(point: int) -> Column:
        z = (F.col("_start") + point * F.col("_step") - F.col("_v")) / F.col("_h")
        return F.sum(F.col("_n") * F.exp(-0.5 * z * z))

    about = [F.first(c).alias(c) for c in ("_all", "_h", "_start", "_step")]
    wide = known.groupBy("_cat").agg(F.array(*[kernel(k) for k in range(points)]).alias("_sums"), *about)
    scale = F.col("_all") * F.col("_h") * (2 * math.pi) ** 0.5
    return wide.select("*", F.posexplode("_sums").alias("point", "_sum")).select(
        F.col("_cat").alias(category),
        "point",
        (F.col("_start") + F.col("point") * F.col("_step")).alias("x"),
        (F.col("_sum") / scale).alias("density"),
    )


def scatter_sample(df: DataFrame, key: str, columns: list[str], share: float) -> DataFrame:
    """A repeatable sample for scatter plots: rows whose key hash falls in the first ``share``."""
    limit = f"{int(share * 16**6):06x}"
    return df.filter(F.substring(F.md5(F.col(key).cast("string")), 1, 6) < limit).select(key, *columns)


def binned_pairs(
    df: DataFrame, x: str, y: str, x_width: float, y_width: float
) -> DataFrame:
    """Row counts on a grid of x and y cells: a scatter plot that keeps every row."""
    cells = {
        "x_bin": F.floor(F.col(x) / x_width).cast("bigint"),
        "y_bin": F.floor(F.col(y) / y_width).cast("bigint"),
    }
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *[c.alias(n) for n, c in cells.items()]
    )
    return known.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("rows"))


# ---- correlation ------------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair (each pair once), over rows where both are known."""
    columns = numeric_columns(df) if columns is None else columns
    pairs = list(combinations(columns, 2))
    if not pairs:
        raise ValueError("correlation needs at least two numeric columns")
    wide = df.agg(*[_corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ]
    return _long(wide, rows)


def _corr(a: str, b: str) -> Column:
    """Correlation over rows with both values; null, not an error, for a constant column."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def top_correlations(
    df: DataFrame, target: str, columns: list[str] | None = None, top: int = 10
) -> DataFrame:
    """Columns with the largest absolute correlation with the target."""
    columns = numeric_columns(df) if columns is None else columns
    columns = [c for c in columns if c != target]
    wide = df.agg(*[_corr(c, target).alias(f"_r{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.abs(F.col(f"_r{i}")).alias("abs_r"))
        for i, c in enumerate(columns)
    ]
    known = _long(wide, rows).filter(F.col("abs_r").isNotNull())
    return known.orderBy(F.desc("abs_r"), "feature").limit(top)


# ---- residuals --------------------------------------------------------------


def residual_histogram(df: DataFrame, y_true: str, y_pred: str, bins: int = 50) -> DataFrame:
    """Density histogram of actual minus predicted."""
    return histogram(with_error(df, y_true, y_pred, "_residual"), "_residual", bins, density=True)


def qq_points(df: DataFrame, value: str, key: str) -> DataFrame:
    """Ordered values against normal quantiles at the Filliben order-statistic medians."""
    known = _finite(df, value, key).withColumnRenamed("_v", "ordered")
    placed = global_index(known, ["ordered", key], "rank")
    n = placed.count()
    if n == 0:
        return placed.withColumn("theoretical", F.lit(None).cast("double")).select(
            key, "rank", "theoretical", "ordered"
        )
    last = 0.5 ** (1.0 / n)
    median = (
        F.when(F.col("rank") == n - 1, F.lit(last))
        .when(F.col("rank") == 0, F.lit(1 - last))
        .otherwise((F.col("rank") + 1 - 0.3175) / (n + 0.365))
    )
    return placed.select(key, "rank", normal_quantile(median).alias("theoretical"), "ordered")


def qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line through the points and their correlation."""
    return points.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        _corr("ordered", "theoretical").alias("r"),
    )


def kde_curve(df: DataFrame, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, with Scott's bandwidth.

    Every row contributes to every grid point; equal values are counted first and weighted.
    Each grid point is one sum of a single aggregation, so rows are never multiplied and one
    partial row per task is shuffled.
    """
    values = _finite(df, value)
    n, lo, hi, sd = values.agg(
        F.count("_v"), F.min("_v"), F.max("_v"), F.stddev_samp("_v")
    ).first()
    if not sd:
        raise ValueError("a density needs at least two different values")
    width = sd * n ** (-1.0 / 5)
    start = lo - cut * width
    step = (hi + cut * width - start) / (points - 1)
    counted = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    scale = 1.0 / (n * width * (2 * 3.141592653589793) ** 0.5)

    def density(point: int) -> Column:
        z = (F.lit(start + point * step) - F.col("_v")) / width
        return F.sum(F.col("_n") * F.exp(-0.5 * z * z)) * scale

    wide = counted.agg(F.array(*[density(k) for k in range(points)]).alias("density"))
    sums = wide.select(F.posexplode("density").alias("point", "density"))
    return sums.select("point", (F.lit(start) + F.col("point") * step).alias("x"), "density")
