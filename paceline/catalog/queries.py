"""The registered queries: every operator over the driver tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import text
from paceline.operators import clean, encode, folds, history, joins, metrics, model, profile, split, validate
from paceline.operators.ordered import Prior, global_index, prior_aggregates
from paceline.plans import flows
from paceline.plans.race_view import TEST_YEAR, race_entities, race_raw, table
from paceline.schema import RACE, ROW_ID
from paceline.sources import runlog, tables
from paceline.sources.scratch import new_folder, pin

Query = Callable[[SparkSession, str], DataFrame]

# Names of the result columns that carry spaces in the race tables.
SHORT = {
    "Athlete ID": "athlete_id",
    "Year of event": "event_year",
    "Event name": "event_name",
    "Event_name_clean": "event_name_clean",
    "Event distance_numeric": "distance_km",
    "Event distance/length": "distance_text",
    "Athlete gender": "gender",
    "Event number of finishers": "finishers",
    "Race_Pace_Mean_Encoded": "encoded",
}
FOLD_ORDER = [RACE.year, ROW_ID]
ONE_TREE = {"n_estimators": 1, "num_leaves": 64, "subsample": 1.0, "colsample_bytree": 1.0}
EVENT_BLOCK_ROWS = 2000
ONE_LEAF = {**ONE_TREE, "num_leaves": 1}
SMALL_TREES = {"n_estimators": 5, "num_leaves": 8, "learning_rate": 0.3}


def show(df: DataFrame, *columns: str) -> DataFrame:
    """Select columns under their short names, doubles rounded for comparison."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns or df.columns:
        v = F.round(F.col(c), 6) if isinstance(kinds[c], T.DoubleType) else F.col(c)
        out.append(v.alias(SHORT.get(c, c)))
    return df.select(*out)


def even(column: str, digits: int):
    """Round a mean of two-digit decimals, which may sit exactly between two results:
    a nudge far below the last digit lets every engine pick the same one."""
    return F.round(F.col(column) + 10.0 ** (-digits - 3), digits)


# ---- shared inputs ----------------------------------------------------------


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_races(race_raw(spark, sf_dir), size_source=race_entities(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_features(cleaned(spark, sf_dir), size_source=race_entities(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The feature table (or the columns asked for) written once, for queries that read it several times."""
    found = features(spark, sf_dir)
    return pin(found.select(*columns) if columns else found)


def target_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    return split.split_by_target_event(features(spark, sf_dir), TEST_YEAR)


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past mean and past best pace as two simple predictions of the next pace."""
    known = features(spark, sf_dir).filter(F.col("cum_num_races") > 0)
    return known.select(
        ROW_ID,
        F.col(RACE.pace).alias("y_true"),
        F.col("cum_avg_pace").alias("y_pred"),
        F.col("cum_best_pace").alias("y_best"),
        F.col(RACE.distance).alias("distance"),
        F.col(RACE.gender).alias("gender"),
        F.col("cum_num_races").alias("num_races"),
    )


def stored_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and residual of the past-mean prediction, written once: two narrow columns."""
    known = baseline_predictions(spark, sf_dir)
    return pin(metrics.with_error(known, "y_true", "y_pred", "residual").select(ROW_ID, "residual"))


def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untyped text cells, some of them missing or malformed."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias(ROW_ID),
        F.when(k % 7 == 0, "NULL").when(k % 7 == 1, "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 11 == 0, "NA")
        .when(k % 11 == 1, "n/k")
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("customer"),
        F.when(k % 5 == 0, "null").when(k % 5 == 1, "1x").otherwise(F.concat((k % 97).cast("string"), F.lit(".5"))).alias(
            "amount"
        ),
    )


CELL_SCHEMA = T.StructType(
    [
        T.StructField(ROW_ID, T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("customer", T.LongType()),
        T.StructField("amount", T.DoubleType()),
    ]
)


# ---- text functions ---------------------------------------------------------


def clean_event_name(spark, d):
    return show(text.with_clean_name(race_raw(spark, d)), ROW_ID, "Event_name_clean")


def _documents(spark, d) -> DataFrame:
    return tables.spread(table(spark, d, "documents").select("doc_id", "text"))


def clean_event_name_documents(spark, d):
    return text.with_clean_name(_documents(spark, d), "text", "name").select("doc_id", "name")


def clean_event_name_noise(spark, d):
    named = text.with_clean_name(race_raw(spark, d), cleaner=text.clean_event_name_noise)
    return show(named, ROW_ID, "Event_name_clean")


def clean_event_name_noise_documents(spark, d):
    docs = _documents(spark, d)
    return text.with_clean_name(docs, "text", "name", text.clean_event_name_noise).select("doc_id", "name")


def duration_groups(spark, d):
    parts = text.groups(F.col(RACE.performance), text.DURATION, 4)
    named = race_raw(spark, d).select(ROW_ID, parts.alias("g"))
    return named.select(
        ROW_ID, *[F.col(f"g.{i + 1}").alias(n) for i, n in enumerate(["days", "hours", "minutes", "seconds"])]
    )


def duration_seconds(spark, d):
    return race_raw(spark, d).select(ROW_ID, text.duration_seconds(F.col(RACE.performance)).alias("seconds"))


def duration_seconds_strict(spark, d):
    seconds = text.duration_seconds_strict(F.col(RACE.performance))
    return race_raw(spark, d).select(ROW_ID, seconds.alias("seconds"))


def distance_km(spark, d):
    out = clean.with_distance_km(race_raw(spark, d))
    return show(out, ROW_ID, "distance_numeric", "distance_str", RACE.distance)


def distance_km_legacy(spark, d):
    out = clean.with_distance_km(race_raw(spark, d), legacy_units=True)
    return show(out, ROW_ID, RACE.distance)


def distance_corrections(spark, d):
    out = clean.with_distance_km(race_raw(spark, d), corrections=clean.DISTANCE_CORRECTIONS)
    return show(out, ROW_ID, RACE.distance, RACE.distance_text)


# ---- reading ----------------------------------------------------------------


def null_tokens(spark, d):
    cells = text_cells(spark, d)
    names = ["status", "customer", "amount"]
    return cells.select(ROW_ID, *[text.null_if_token(F.col(c), tables.NULL_TOKENS).alias(c) for c in names])


def typed_parse(spark, d):
    cells = text_cells(spark, d).withColumn(ROW_ID, F.col(ROW_ID).cast("string"))
    return tables.type_text_columns(cells, CELL_SCHEMA)


def malformed_cells(spark, d):
    cells = text_cells(spark, d).withColumn(ROW_ID, F.col(ROW_ID).cast("string"))
    return tables.malformed_cells(cells, CELL_SCHEMA)


BAD_SCHEMA = T.StructType(
    [
        T.StructField("k", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("customer", T.LongType()),
        T.StructField("amount", T.DoubleType()),
    ]
)


def bad_rows(spark, d):
    """Orders as CSV lines, some with an open quote, too few or too many cells, or a wrong type."""
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 10
    status, customer = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    amount = (F.col("o_orderkey") % 89).cast("string")
    plain = F.concat_ws(",", k, status, customer, amount)
    line = (
        F.when(kind == 0, F.concat_ws(",", k, F.concat(F.lit('"'), status), customer, amount))
        .when(kind == 1, F.concat_ws(",", k, status, customer))
        .when(kind == 2, F.concat_ws(",", plain, F.lit("more")))
        .when(kind == 3, F.concat_ws(",", k, F.concat(F.lit('"'), status, F.lit(', ""x"""')), customer, amount))
        .when(kind == 4, F.concat_ws(",", k, status, F.lit("n/k"), F.concat(amount, F.lit("x"))))
        .when(kind == 5, F.concat_ws(",", k, F.lit(""), F.lit("NULL"), amount))
        .otherwise(plain)
    )
    path = new_folder(spark, "bad-csv")
    table(spark, d, "orders").select(line).write.text(path)
    found = tables.bad_rows(spark, path, BAD_SCHEMA, header=False)
    return found.select("problem", "cells", F.array_join("columns", " ").alias("columns"), "record")


def csv_round_trip(spark, d):
    """Race rows written as CSV and read with the declared schema."""
    path = new_folder(spark, "races-csv")
    race_raw(spark, d).drop(ROW_ID).write.option("header", True).csv(path)
    back = tables.read_races_csv(spark, path)
    return back.select(
        F.col(RACE.entity).alias("athlete_id"),
        F.col(RACE.year).alias("event_year"),
        F.col(RACE.event).alias("event_name"),
        F.col(RACE.distance_text).alias("distance_text"),
        F.col(RACE.performance).alias("performance"),
        F.col(RACE.gender).alias("gender"),
        F.col(RACE.finishers).alias("finishers"),
        F.col(RACE.birth_year).alias("birth_year"),
    )


def stage_round_trip(spark, d):
    """Cleaned races written as a stage partitioned by year, and read back."""
    path = new_folder(spark, "races-stage")
    tables.write_stage(cleaned(spark, d), path, RACE.year, [RACE.entity, ROW_ID])
    return show(tables.read_stage(spark, path), ROW_ID, RACE.year, RACE.event_clean, RACE.pace)


def predictions_csv_round_trip(spark, d):
    """Actual, predicted and error columns written as CSV and read back."""
    path = new_folder(spark, "predictions-csv")
    tables.write_predictions_csv(baseline_predictions(spark, d), path, "y_true", "y_pred")
    kinds = "actual_pace double, predicted_pace double, error double"
    return show(spark.read.schema(kinds).option("header", True).csv(path))


def importance_csv_round_trip(spark, d):
    train, test = _one_tree_split(spark, d)
    fitted, _ = model.train_and_predict(train, test, ONE_TREE)
    path = new_folder(spark, "importance-csv")
    tables.write_importance_csv(model.feature_importance(fitted, ["x"], train), path)
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)


# ---- filters and cleaning ---------------------------------------------------


def keep_distance_races(spark, d):
    return show(clean.keep_distance_races(race_raw(spark, d), RACE.distance_text), ROW_ID, RACE.distance_text)


def drop_named_events(spark, d):
    return show(clean.drop_named_events(race_raw(spark, d), RACE.event), ROW_ID, RACE.event)


def drop_listed_names(spark, d):
    """Orders without those of the listed customers: two thirds of all names, written another way."""
    customer = table(spark, d, "customer")
    orders = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    listed = customer.where(F.col("c_custkey") % 3 > 0).select(F.concat(F.lit("  "), F.upper("c_name")).alias("listed"))
    return clean.drop_listed_events(orders, "c_name", listed, "listed").select("o_orderkey", "c_name")


def lookup_hot_keys(spark, d):
    """Prices of parts for order lines, half of which name one part and a ninth none: hot keys joined apart."""
    part = F.when(F.col("l_orderkey") % 2 == 0, 7).when(F.col("l_orderkey") % 9 != 0, F.col("l_partkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", part.cast("bigint").alias("part"))
    prices = pin(table(spark, d, "part").where(F.col("p_partkey") % 3 != 0).select("p_partkey", "p_retailprice"))
    # Low bounds, so that the cut-up form runs at any size; they change no result.
    return show(joins.join_lookup(lines, prices, {"part": "p_partkey"}, broadcast_rows=0, hot_rows=1000))


def missing_required(spark, d):
    return clean.require(race_raw(spark, d), [RACE.birth_year, RACE.distance_text]).select(ROW_ID)


def single_gender(spark, d):
    kept = clean.single_valued_entities(race_raw(spark, d), RACE.entity, RACE.gender)
    return show(kept, ROW_ID, RACE.entity, RACE.gender)


def single_valued_events(spark, d):
    """Order lines whose order has one return flag only."""
    kept = clean.single_valued_entities(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))


def conflicting_entities_removed(spark, d):
    raw = race_raw(spark, d)
    mixed = raw.groupBy(RACE.entity).agg(F.count_distinct(RACE.gender).alias("genders"))
    kept = clean.entities_not_in(raw, RACE.entity, mixed.filter(F.col("genders") > 1))
    return show(kept, ROW_ID, RACE.entity)


def missing_distance_events(spark, d):
    return show(clean.missing_distance_events(race_raw(spark, d)))


def names_with_digits(spark, d):
    named = text.with_clean_name(_documents(spark, d), "text", "name")
    return clean.names_with_digits(named, "name")


def clean_races(spark, d):
    return show(
        cleaned(spark, d), ROW_ID, RACE.entity, RACE.year, RACE.event_clean, RACE.distance,
        "performance_clean", "performance_seconds", RACE.pace,
    )


def clean_races_original(spark, d):
    """The first version's rules: strict durations and name corrections."""
    out = clean.clean_races(
        race_raw(spark, d), corrections=clean.DISTANCE_CORRECTIONS, strict_durations=True
    )
    return show(out, ROW_ID, RACE.distance, "performance_seconds", RACE.pace)


def mean_pace_by_year(spark, d):
    by_year = cleaned(spark, d).groupBy(RACE.year).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(RACE.pace).alias("mean_pace")
    )
    return show(by_year)


def distinct_reduction(spark, d):
    named = text.with_clean_name(race_raw(spark, d))
    return show(clean.distinct_reduction(named, RACE.event, RACE.event_clean))


# ---- history ----------------------------------------------------------------

HISTORY_COLS = [
    "cum_num_races", "cum_avg_pace", "cum_best_pace", "cum_total_distance", "cum_shortest_distance",
    "cum_longest_distance", "cum_avg_distance", "cum_ws_finishes", "recent_avg_distance",
    "distance_gap_from_longest", "athlete_age",
]


def history_all(spark, d):
    return show(features(spark, d), ROW_ID, RACE.entity, RACE.year, RACE.event_clean, *HISTORY_COLS)


def _history_query(column: str) -> Query:
    def query(spark, d):
        return show(features(spark, d), ROW_ID, column)

    query.__name__ = f"history_{column}"
    return query


def order_history(spark, d):
    """The history operator over plain orders: what a customer spent before each order."""
    specs = [
        Prior("orders_before", "count"),
        Prior("spent_before", "sum", "o_totalprice"),
        Prior("mean_before", "mean", "o_totalprice"),
        Prior("best_before", "max", "o_totalprice"),
        Prior("recent_mean", "recent_mean", "o_totalprice", 5),
    ]
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = prior_aggregates(orders, "o_custkey", ["o_orderdate", "o_orderkey"], specs)
    rounded = {s.name: even(s.name, 3) for s in specs if s.kind != "count"}
    return out.withColumns(rounded).select("o_orderkey", *[s.name for s in specs])


def event_type_history(spark, d):
    """The history operator where a handful of keys hold all rows (event types)."""
    specs = [
        Prior("seen_before", "count"),
        Prior("mean_before", "mean", "value"),
        Prior("low_before", "min", "value"),
        Prior("recent_mean", "recent_mean", "value", 3),
    ]
    events = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    # A low limit, so that the cut-up form runs at any size; it changes no result.
    out = prior_aggregates(events, "event_type", ["ts", "event_id"], specs, EVENT_BLOCK_ROWS)
    rounded = {s.name: even(s.name, 5) for s in specs if s.kind != "count"}
    return out.withColumns(rounded).select("event_id", *[s.name for s in specs])


# ---- splits and folds -------------------------------------------------------


def split_target_event_train(spark, d):
    return show(target_split(spark, d)[0], ROW_ID, RACE.entity, RACE.year, "cum_num_races")


def _nullable_entities(spark, d) -> DataFrame:
    """Features where every seventh athlete has no id, so that null is one large entity."""
    races = cleaned(spark, d)
    some = F.when(F.col(RACE.entity) % 7 != 0, F.col(RACE.entity))
    return history.history_features(races.withColumn(RACE.entity, some))


def split_null_entity_train(spark, d):
    train, _, _ = split.split_by_target_event(_nullable_entities(spark, d), TEST_YEAR)
    return show(train, ROW_ID, RACE.entity, RACE.year, "cum_num_races")


def validate_null_entity(spark, d):
    """Counts of the null entity's rows raised by one: each is reported."""
    df = _nullable_entities(spark, d)
    off = F.col("cum_num_races") + F.when(F.col(RACE.entity).isNull(), 1).otherwise(0)
    found = validate.temporal_issues(df.withColumn("cum_num_races", off))
    return show(found.filter("entity_id is null").groupBy("type", "year").agg(F.count(F.lit(1)).alias("issues")))


def split_target_event_test(spark, d):
    return show(target_split(spark, d)[1], ROW_ID, RACE.entity, RACE.year, "cum_num_races")


def split_year_train(spark, d):
    train, _, _ = split.split_by_year(cleaned(spark, d), TEST_YEAR)
    return show(train, ROW_ID, RACE.year)


def split_year_test(spark, d):
    _, test, _ = split.split_by_year(cleaned(spark, d), TEST_YEAR, "western states", case_insensitive=True)
    return show(test, ROW_ID, RACE.year)


def time_index(spark, d):
    return show(global_index(pin(cleaned(spark, d)), FOLD_ORDER), ROW_ID, RACE.year, "row_index")


def _folded(spark, d) -> DataFrame:
    return folds.time_folds(pin(cleaned(spark, d)), FOLD_ORDER, 5)


def time_folds(spark, d):
    return show(_folded(spark, d), ROW_ID, "row_index", "fold")


def time_fold_sizes(spark, d):
    return folds.fold_sizes(_folded(spark, d), 5)


def kfold_ranges(spark, d):
    lines = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return folds.kfold_ranges(lines, ["o_orderdate", "o_orderkey"], 7).select("o_orderkey", "row_index", "fold")


# ---- encoding ---------------------------------------------------------------


def _encoded(spark, d) -> tuple[DataFrame, DataFrame]:
    train, test, _ = split.split_by_year(pin(cleaned(spark, d)), TEST_YEAR)
    return encode.target_encode(train, test)


def target_encoding_train(spark, d):
    return show(_encoded(spark, d)[0], ROW_ID, RACE.event_clean, "Race_Pace_Mean_Encoded")


def target_encoding_test(spark, d):
    return show(_encoded(spark, d)[1], ROW_ID, RACE.event_clean, "Race_Pace_Mean_Encoded")


def target_encoding_per_fold(spark, d):
    coded = encode.encode_validation_folds(_folded(spark, d))
    return show(coded, ROW_ID, "fold", "Race_Pace_Mean_Encoded")


def category_codes(spark, d):
    rows = pin(cleaned(spark, d).select(ROW_ID, RACE.year, RACE.event_clean))
    train, test = rows.filter(F.col(RACE.year) < TEST_YEAR), rows.filter(F.col(RACE.year) >= TEST_YEAR)
    parts = encode.category_codes([train, test], RACE.event_clean, "code")
    return show(parts[0].unionByName(parts[1]), ROW_ID, "code")


def one_hot(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    train, test, names = encode.one_hot(orders.filter(~late), orders.filter(late), "o_orderpriority")
    plain = {n: f"level_{i}" for i, n in enumerate(names, 1)}
    return train.unionByName(test).withColumnsRenamed(plain).drop("o_orderdate")


def one_hot_sparse(spark, d):
    """A sparse vector over all customers with an order before 2000: its length and the place of the one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").cast("string").alias("customer"))
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    train, test, _ = encode.sparse_one_hot(orders.filter(~late), orders.filter(late), "customer", "vector")
    stored = F.unwrap_udt("vector")
    return train.unionByName(test).select(
        "o_orderkey", stored["size"].alias("places"), F.get(stored["indices"], F.lit(0)).alias("place"),
        F.size(stored["values"]).alias("ones"),
    )


def model_matrix_clean(spark, d):
    """Numeric model inputs with categories coded and gaps filled."""
    train, test, cols = _stored_split(spark, d)
    train, test = encode.target_encode(train, test)
    parts = encode.category_codes([train, test], RACE.gender)
    names = [*cols, "Race_Pace_Mean_Encoded"]
    both = parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("test")))
    return show(encode.clean_matrix(both, names), ROW_ID, "part", *names)


# ---- metrics ----------------------------------------------------------------


def regression_metrics(spark, d):
    return show(metrics.regression_metrics(baseline_predictions(spark, d)))


def metrics_long(spark, d):
    return show(metrics.metrics_long(baseline_predictions(spark, d), model="past mean"))


def metrics_by_distance(spark, d):
    return show(metrics.metrics_by_distance(baseline_predictions(spark, d)))


def metrics_by_category(spark, d):
    return show(metrics.metrics_by(baseline_predictions(spark, d), "gender"))


def metrics_by_experience(spark, d):
    return show(metrics.metrics_by_experience(baseline_predictions(spark, d)))


def metrics_by_custom_bins(spark, d):
    return show(metrics.metrics_by_distance(baseline_predictions(spark, d), bins=[0, 42, 80, 120]))


def metrics_by_segment(spark, d):
    """All segment reports in one pass."""
    bins = {
        "distance_range": ("distance", metrics.DISTANCE_BINS, metrics.DISTANCE_LABELS),
        "experience_range": ("num_races", metrics.EXPERIENCE_BINS, metrics.EXPERIENCE_LABELS),
    }
    return show(metrics.segment_report(baseline_predictions(spark, d), bins, ["gender"]))


def compare_models(spark, d):
    both = {"past mean": "y_pred", "past best": "y_best"}
    return show(metrics.compare_models(baseline_predictions(spark, d), "y_true", both))


def yearly_score_summary(spark, d):
    """Spread of the yearly mean absolute error of the past-mean prediction."""
    known = features(spark, d).filter(F.col("cum_num_races") > 0)
    per_year = metrics.metrics_by(known, RACE.year, RACE.pace, "cum_avg_pace")
    return show(metrics.score_summary(per_year, "MAE"))


def prediction_errors(spark, d):
    return show(metrics.with_error(baseline_predictions(spark, d), "y_true", "y_pred"), ROW_ID, "error")


# ---- validation -------------------------------------------------------------


def _tampered(spark, d) -> DataFrame:
    """Features with some history values made wrong on purpose."""
    k = F.col(ROW_ID)
    return stored_features(spark, d).withColumns(
        {
            "cum_num_races": F.col("cum_num_races") + F.when(k % 50 == 0, 1).otherwise(0),
            "cum_avg_pace": F.col("cum_avg_pace") + F.when(k % 70 == 0, 0.5).otherwise(0.0),
        }
    )


def validate_temporal(spark, d):
    return show(validate.temporal_issues(stored_features(spark, d)))


def validate_temporal_tampered(spark, d):
    return show(validate.temporal_issues(_tampered(spark, d)))


def validate_temporal_summary(spark, d):
    whole = stored_features(spark, d)
    return validate.temporal_summary(whole, validate.temporal_issues(whole))


def validate_first_issues(spark, d):
    return show(validate.first_issues(validate.temporal_issues(_tampered(spark, d))))


def validate_split(spark, d):
    train, test, _ = _stored_split(spark, d)
    return show(validate.split_issues(train, test, TEST_YEAR))


def validate_split_wrong_year(spark, d):
    whole = stored_features(spark, d)
    train, test = whole.filter(F.col(RACE.year) < 1999), whole.filter(F.col(RACE.year) >= 1999)
    return show(validate.split_issues(train, test, 2005, "Comrades"))


def validate_split_summary(spark, d):
    train, test, _ = _stored_split(spark, d)
    return validate.split_summary(train, test, validate.split_issues(train, test, TEST_YEAR))


def validate_report(spark, d):
    settings = flows.RunSettings(output_dir="", test_year=TEST_YEAR)
    return flows.leakage_report(stored_features(spark, d), settings)["report"]


# ---- profiles ---------------------------------------------------------------


def null_profile(spark, d):
    return show(profile.null_profile(race_raw(spark, d)))


def inspect_columns(spark, d):
    return show(profile.inspect_table(table(spark, d, "lineitem"))["columns"])


def column_bytes(spark, d):
    return profile.column_bytes(table(spark, d, "orders"))


def top_values(spark, d):
    return show(profile.top_values(race_raw(spark, d), RACE.event))


def rows_over_time(spark, d):
    return profile.rows_over_time(
        table(spark, d, "events").withColumn("day", F.to_date("ts")), "day"
    )


def stage_counts(spark, d):
    """Rows and columns of the stages, noted while each is written from the one before."""
    writer, folder = profile.StageWriter(spark), new_folder(spark, "stages")
    raw = writer.write("raw", race_raw(spark, d), f"{folder}/raw")
    races = writer.write("cleaned", clean.clean_races(raw), f"{folder}/cleaned")
    writer.write("features", history.history_features(races), f"{folder}/features")
    return writer.counts()


def histogram(spark, d):
    return show(profile.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50))


def histogram_density(spark, d):
    out = profile.histogram(table(spark, d, "events"), "value", 30, density=True)
    return show(out.withColumn("density", F.col("density") * 1000))


def box_stats(spark, d):
    return show(profile.box_stats(table(spark, d, "lineitem"), "l_extendedprice"))


def category_distribution(spark, d):
    return show(profile.category_distribution(table(spark, d, "events"), "event_type", "value"))


def density_by_category(spark, d):
    out = profile.density_by_category(table(spark, d, "events"), "event_type", "value", 50)
    return show(out.withColumn("density", F.col("density") * 1000))


def quantiles_by_flag(spark, d):
    tenths = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return show(profile.exact_quantiles(table(spark, d, "lineitem"), "l_quantity", tenths, ["l_returnflag"]))


def scatter_sample(spark, d):
    lines = table(spark, d, "orders")
    return profile.scatter_sample(lines, "o_orderkey", ["o_custkey", "o_totalprice"], 0.05)


def binned_pairs(spark, d):
    return profile.binned_pairs(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 5000.0)


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def correlations(spark, d):
    return show(profile.correlations(table(spark, d, "lineitem"), LINE_NUMBERS))


def top_correlations(spark, d):
    cols = ["cum_num_races", "cum_avg_pace", "cum_best_pace", "recent_avg_distance", "athlete_age", RACE.distance]
    out = profile.top_correlations(features(spark, d), RACE.pace, cols, 3)
    return show(out)


def residual_histogram(spark, d):
    known = pin(baseline_predictions(spark, d).select("y_true", "y_pred"))
    return show(profile.residual_histogram(known, "y_true", "y_pred", 50))


def _residual_points(spark, d) -> DataFrame:
    return profile.qq_points(stored_residuals(spark, d), "residual", ROW_ID)


def qq_points(spark, d):
    return show(_residual_points(spark, d), ROW_ID, "rank", "theoretical", "ordered")


def qq_fit(spark, d):
    return show(profile.qq_fit(_residual_points(spark, d)))


def kde_curve(spark, d):
    return show(profile.kde_curve(stored_residuals(spark, d), "residual", 100))


# ---- models -----------------------------------------------------------------


def _stored_split(spark, d) -> tuple[DataFrame, DataFrame, list[str]]:
    return split.split_by_target_event(stored_features(spark, d), TEST_YEAR)


def _assembled(spark, d) -> tuple[DataFrame, DataFrame, encode.ModelMatrix]:
    train, test, cols = _stored_split(spark, d)
    return encode.prepare_model_data(train, test, cols, keep=[ROW_ID])


def _one_tree_input(spark, d) -> DataFrame:
    """One input with six values, so that one deep tree predicts the mean label of each value."""
    known = stored_features(spark, d, ROW_ID, RACE.year, RACE.pace, "cum_num_races")
    x = F.least("cum_num_races", F.lit(5)).cast("double")
    rows = known.select(ROW_ID, RACE.year, x.alias("x"), F.col(RACE.pace).alias(encode.LABEL))
    return VectorAssembler(inputCols=["x"], outputCol=encode.FEATURES).transform(rows)


def _one_tree_split(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _one_tree_input(spark, d)
    return rows.filter(F.col(RACE.year) < TEST_YEAR), rows.filter(F.col(RACE.year) >= TEST_YEAR)


def tree_predict(spark, d):
    train, test = _one_tree_split(spark, d)
    _, predicted = model.train_and_predict(train, test, ONE_TREE)
    return show(predicted, ROW_ID, "label", "prediction")


def tree_metrics(spark, d):
    train, test = _one_tree_split(spark, d)
    return show(model.evaluate(model.train_and_predict(train, test, ONE_TREE)[1]))


def tree_importance(spark, d):
    train, test = _one_tree_split(spark, d)
    return show(model.feature_importance(model.train_and_predict(train, test, ONE_TREE)[0], ["x"], train))


def tree_split_counts(spark, d):
    """A tree that tells six values apart splits five times."""
    train, test = _one_tree_split(spark, d)
    return show(model.feature_importance(model.train_and_predict(train, test, ONE_TREE)[0], ["x"], train, "split"))


def tree_leaves(spark, d):
    """The leaves of the tree: training rows and prediction of each."""
    train, test = _one_tree_split(spark, d)
    nodes = model.tree_nodes(model.train_and_predict(train, test, ONE_TREE)[0])
    return show(nodes.where("feature is null"), "rows", "prediction")


def tree_residuals(spark, d):
    """Residuals against the most important input of the tree."""
    train, test = _one_tree_split(spark, d)
    fitted, predicted = model.train_and_predict(train, test, ONE_TREE)
    best = model.feature_importance(fitted, ["x"], train, "split").first()["feature"]
    known = metrics.with_error(predicted, "label", "prediction", "residual")
    return show(known.select(ROW_ID, vector_to_array("features")[["x"].index(best)].alias("top_feature"), "residual"))


def tree_temporal_cv(spark, d):
    """Fold sizes and scores of a tree of one leaf, which predicts the mean of the earlier folds."""
    train, _, cols = _stored_split(spark, d)
    return show(model.temporal_cv(train, cols, 5, ONE_LEAF, order=FOLD_ORDER))


def tree_saved_model(spark, d):
    """A tree of one leaf and its preparation tables, stored and loaded again for new rows."""
    train, test, cols = _stored_split(spark, d)
    matrix = encode.ModelMatrix.fit(train, cols, also=[test])
    fitted = model.make_regressor(ONE_LEAF).fit(matrix.transform(train))
    path = new_folder(spark, "model")
    model.save_model(fitted, matrix, path)
    return show(model.score_rows(test, path, [ROW_ID]))


def tree_kfold(spark, d):
    train, _ = _one_tree_split(spark, d)
    return show(model.kfold_evaluation(train, [ROW_ID], 5, ONE_TREE)[1])


def tree_grid(spark, d):
    """A leaf alone, which predicts the mean, against the deep tree; the last fifth decides."""
    train, _ = _one_tree_split(spark, d)
    grid = {**{k: [v] for k, v in ONE_TREE.items()}, "num_leaves": [1, 64]}
    _, tried = model.grid_search(train, grid, "holdout", [ROW_ID])
    return show(tried.select(F.regexp_extract("params", r"num_leaves=(\d+)", 1).cast("int").alias("num_leaves"), "mae"))


def gbt_predict(spark, d):
    train, test, _ = _assembled(spark, d)
    _, predicted = model.train_and_predict(train, test, SMALL_TREES)
    return show(predicted, ROW_ID, "label", "prediction")


def gbt_metrics(spark, d):
    train, test, _ = _assembled(spark, d)
    _, predicted = model.train_and_predict(train, test, SMALL_TREES)
    return show(model.evaluate(predicted))


def feature_importance(spark, d):
    train, test, matrix = _assembled(spark, d)
    fitted, _ = model.train_and_predict(train, test, SMALL_TREES)
    return show(model.feature_importance(fitted, matrix.names, train))


def residual_by_top_feature(spark, d):
    """Residuals against the most important input."""
    train, test, matrix = _assembled(spark, d)
    fitted, predicted = model.train_and_predict(train, test, SMALL_TREES)
    best = model.feature_importance(fitted, matrix.names, train).first()["feature"]
    known = metrics.with_error(predicted, "label", "prediction", "residual")
    value = vector_to_array("features")[matrix.names.index(best)]
    return show(known.select(ROW_ID, value.alias("top_feature"), "residual"))


def temporal_cv(spark, d):
    train, _, cols = _stored_split(spark, d)
    return show(model.temporal_cv(train, cols, 5, SMALL_TREES, order=FOLD_ORDER))


def kfold_eval(spark, d):
    train, _, _ = _assembled(spark, d)
    _, summary = model.kfold_evaluation(train, [ROW_ID], 5, SMALL_TREES)
    return show(summary)


def grid_search(spark, d):
    train, _, _ = _assembled(spark, d)
    grid = {"n_estimators": [3, 5], "num_leaves": [4, 8]}
    _, scores = model.grid_search(train, grid, "holdout", [ROW_ID])
    return show(scores)


def score_saved_model(spark, d):
    """A model stored with its preparation tables, loaded again for new rows."""
    train, test, cols = _stored_split(spark, d)
    matrix = encode.ModelMatrix.fit(train, cols, also=[test])
    fitted = model.make_regressor(SMALL_TREES).fit(matrix.transform(train))
    path = new_folder(spark, "model")
    model.save_model(fitted, matrix, path)
    return show(model.score_rows(test, path, [ROW_ID]))


def run_log(spark, d):
    """Baseline metrics logged twice; the history keeps both runs."""
    found = metrics.regression_metrics(baseline_predictions(spark, d)).first().asDict()
    folder = new_folder(spark, "runs")
    for run_id in ("first", "second"):
        runlog.log_run(spark, folder, "baseline", run_id, found)
    return show(runlog.run_history(spark, folder).drop("ts"))


def _raw_csv(spark, d, folder: str) -> str:
    race_raw(spark, d).drop(ROW_ID).write.option("header", True).csv(f"{folder}/raw")
    return f"{folder}/raw"


def _tree_settings(folder: str, folds: int = 5) -> flows.RunSettings:
    return flows.RunSettings(output_dir=folder, run_id="check", test_year=TEST_YEAR, cv_folds=folds, params=ONE_LEAF)


def sorted_stage(spark, d):
    """The first stage of a run as it lies in its files: each row with its place in the global order."""
    folder = new_folder(spark, "sorted")
    raw = tables.read_races_csv(spark, _raw_csv(spark, d, folder), row_id=True)
    stage = tables.write_stage(history.sort_for_sink(raw).withColumn("file_order", F.monotonically_increasing_id()), f"{folder}/sorted")
    return show(global_index(stage, ["file_order"], "place"), RACE.entity, RACE.year, RACE.event, RACE.performance, "place")


def run_data_features(spark, d):
    """The feature table of a run that starts from CSV."""
    folder = new_folder(spark, "run")
    found = flows.run(spark, "data", _tree_settings(folder), csv_path=_raw_csv(spark, d, folder))
    return show(found, RACE.entity, RACE.year, RACE.event_clean, *HISTORY_COLS)


def run_ml_metrics(spark, d):
    """A whole run from CSV with a tree of one leaf: the test metrics."""
    folder = new_folder(spark, "run")
    result = flows.run(spark, "ml", _tree_settings(folder, 2), csv_path=_raw_csv(spark, d, folder))
    return show(result.metrics)


def run_cv_scores(spark, d):
    """Cross-validation alone, from a stored feature table."""
    folder = new_folder(spark, "run")
    features(spark, d).write.parquet(f"{folder}/stored")
    return show(flows.run(spark, "cv", _tree_settings(folder), features_path=f"{folder}/stored").cv_scores)


def run_final_predictions(spark, d):
    """Final training alone, with one-hot categories: actual and predicted of the test rows."""
    folder = new_folder(spark, "run")
    settings = replace(_tree_settings(folder), encoding="one_hot")
    result = flows.run(spark, "final", settings, features=stored_features(spark, d))
    return show(result.predictions, "label", "prediction")


def full_run(spark, d):
    """CSV to stages, features, split, cross-validation, final model and its metrics."""
    folder = new_folder(spark, "run")
    race_raw(spark, d).drop(ROW_ID).write.option("header", True).csv(f"{folder}/raw")
    settings = flows.RunSettings(
        output_dir=folder, run_id="check", test_year=TEST_YEAR, cv_folds=2, params=SMALL_TREES
    )
    result = flows.run(spark, "ml", settings, csv_path=f"{folder}/raw")
    return show(result.metrics)


PLAIN: list[Query] = [
    clean_event_name, clean_event_name_documents, clean_event_name_noise, clean_event_name_noise_documents,
    duration_groups, duration_seconds, duration_seconds_strict, distance_km, distance_km_legacy,
    distance_corrections, null_tokens, typed_parse, malformed_cells, csv_round_trip, stage_round_trip, predictions_csv_round_trip, importance_csv_round_trip,
    keep_distance_races, drop_named_events, missing_required, single_gender, single_valued_events,
    conflicting_entities_removed, missing_distance_events, names_with_digits, clean_races,
    clean_races_original, mean_pace_by_year, distinct_reduction, history_all, order_history,
    event_type_history, split_null_entity_train, validate_null_entity, split_target_event_train, split_target_event_test, split_year_train,
    split_year_test, time_index, time_folds, time_fold_sizes, kfold_ranges, target_encoding_train,
    target_encoding_test, target_encoding_per_fold, category_codes, one_hot, model_matrix_clean,
    regression_metrics, metrics_long, metrics_by_distance, metrics_by_category, metrics_by_experience,
    metrics_by_custom_bins, compare_models, yearly_score_summary, prediction_errors, validate_temporal,
    validate_temporal_tampered, validate_temporal_summary, validate_first_issues, validate_split,
    validate_split_wrong_year, validate_split_summary, validate_report, null_profile, inspect_columns,
    column_bytes, top_values, rows_over_time, stage_counts, histogram, histogram_density, box_stats,
    category_distribution, quantiles_by_flag, scatter_sample, binned_pairs, correlations,
    top_correlations, residual_histogram, qq_points, qq_fit, kde_curve, tree_predict, tree_metrics, tree_importance, tree_kfold, tree_grid, gbt_predict, gbt_metrics,
    feature_importance, residual_by_top_feature, temporal_cv, kfold_eval, grid_search,
    score_saved_model, run_log, full_run, bad_rows, drop_listed_names, lookup_hot_keys, one_hot_sparse,
    metrics_by_segment, density_by_category, tree_split_counts, tree_leaves, tree_residuals, tree_temporal_cv,
    tree_saved_model, sorted_stage, run_data_features, run_ml_metrics, run_cv_scores, run_final_predictions,
]

QUERIES: dict[str, Query] = {q.__name__: q for q in PLAIN}
QUERIES.update({f"history_{c}": _history_query(c) for c in HISTORY_COLS})
